"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tripwire.plans.queries import ORACLES, QUERIES, flagship

SMALL = "/root/testdata/sf0.001"
TRAINED = {"classifier", "boosted_classifier", "importances", "iforest_flags", "tlearner_effects", "stream_pipeline", "stream_profile"}


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else bool(x) if str(type(x).__name__).startswith("bool") else float(x) if not isinstance(x, str) else x
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got, expected = QUERIES[name](spark, SMALL).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_all_but_trained_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == TRAINED


def test_classifier_beats_chance(spark):
    report = {r.cls: r for r in QUERIES["classifier"](spark, "/root/testdata/sf0.01").collect()}
    assert report["normal"].f1 > 0.9 and report["dependency_failure"].f1 > 0.9 and sum(r.f1 for r in report.values()) / len(report) > 0.5
    assert report["normal"].recall > 0.9  # under a tenth of healthy rows are called incidents


def test_boosted_classifier_beats_chance(spark):
    report = {r.cls: r for r in QUERIES["boosted_classifier"](spark, "/root/testdata/sf0.01").collect()}
    assert report["normal"].f1 > 0.9 and report["dependency_failure"].f1 > 0.9 and sum(r.f1 for r in report.values()) / len(report) > 0.53


def test_detector_flags_few_healthy_rows_and_many_others(spark):
    rates = {r.y: r.flag_rate for r in QUERIES["iforest_flags"](spark, "/root/testdata/sf0.01").collect()}
    assert rates["normal"] < 0.03 and min(v for k, v in rates.items() if k != "normal") > 5 * rates["normal"]


def test_outcome_models_act_where_it_pays(spark):
    counts = {r.action: r.n for r in QUERIES["tlearner_effects"](spark, "/root/testdata/sf0.01").collect()}
    assert max(counts, key=counts.get) == "none" and counts["failover"] == max(n for a, n in counts.items() if a != "none")


def test_stream_profile(spark):
    row = QUERIES["stream_profile"](spark, SMALL).first()
    assert row["rows"] == 1000 and row.n >= 1 and row.p50 <= row.p99 <= row["max"] and row.dropped_late == 0


def test_flagship(spark):
    assert flagship(spark, SMALL).count() == 5

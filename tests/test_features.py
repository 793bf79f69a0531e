"""Windowed features: hand-worked rows, one kernel for batch and stream, no lookahead, any dealing of rows."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.operators import features, models, sliding, splits
from tripwire.operators.features import windowed
from tripwire.plans import fixtures
from tripwire.sources.storage import shared_folder
from tripwire.sources.telemetry import write_jsonl
from tripwire.streaming import live

SMALL = "/root/testdata/sf0.001"


def tick(seq=0, ts=0.0, latency=100.0, service="checkout-api", version="v1.0.0", mem=50.0):
    return (seq, float(ts), service, version, latency, 0.001, 40.0, mem, 200.0, "GET 200", None, 0)


def computed(spark, rows, **options):
    out = features.features(spark.createDataFrame(rows, C.TELEMETRY), **options).orderBy("seq").collect()
    return [r.asDict() for r in out]


def test_first_tick_is_neutral(spark):
    (row,) = computed(spark, [tick()])
    assert [row[f"{m}_over_baseline"] for m in ("latency", "cpu", "rps")] == [1.0, 1.0, 1.0]
    assert row["mem_slope_per_min"] == 0.0 and row["since_deploy_s"] == 3600.0
    named = features.features(spark.createDataFrame([tick()], C.TELEMETRY)).select(features.feature_map().alias("m")).first().m
    assert named == {f: row[f] for f in C.FEATURES}


def test_baseline_excludes_the_current_row(spark):
    rows = [tick(k, k) for k in range(30)] + [tick(30, 30, 1000.0)]
    assert computed(spark, rows)[-1]["latency_over_baseline"] == pytest.approx(10.0)


def test_services_do_not_mix(spark):
    rows = [tick(2 * k + s, k, 1000.0 if s else 100.0, "bs"[s]) for k in range(30) for s in (0, 1)] + [tick(99, 30, 100.0, "b")]
    assert computed(spark, rows)[-1]["latency_over_baseline"] == pytest.approx(1.0)


def test_sustained_outage_stays_visible(spark):
    rows = [tick(k, k) for k in range(300)] + [tick(300 + k, 300 + k, 300.0) for k in range(250)]
    out = computed(spark, rows)
    assert out[300]["latency_over_baseline"] == pytest.approx(3.0) and out[-1]["latency_over_baseline"] > 2.5


def test_window_ages_out(spark):
    rows = [tick(k, k, 1000.0) for k in range(5)] + [tick(5, 500), tick(6, 501)]
    assert computed(spark, rows, baseline_s=10.0)[-1]["latency_over_baseline"] == 1.0


def test_deploy_stamps(spark):
    rows = [tick(k, k) for k in range(5)] + [tick(5, 5, version="v1.0.1"), tick(6, 9, version="v1.0.1")]
    out = computed(spark, rows)
    assert [r["since_deploy_s"] for r in out[4:]] == [3600.0, 0.0, 4.0]


def test_deploys_are_carried_over_buckets_and_gaps(spark):
    rows = [tick(0, 0), tick(1, 5000, version="v2"), tick(2, 8000, version="v2"), tick(3, 12000, version="v2")]
    for bucket in (900.0, 1000.0, 3600.0, 1e6):
        assert [r["since_deploy_s"] for r in computed(spark, rows, bucket_s=bucket)] == [3600.0, 0.0, 3000.0, 3600.0]


def test_no_lookahead(spark):
    calm = [tick(k, k) for k in range(60)]
    assert computed(spark, calm) == computed(spark, calm + [tick(60 + k, 60 + k, 5000.0) for k in range(20)])[:60]


def by_row(rows, baseline_s=900.0, slope_s=60.0):
    """The features of one service's rows in arrival order, worked out row by row."""
    old, memory, version, deployed, out = [], [], None, None, []
    for ts, own, latency, cpu, mem, rps in rows:
        while old and ts - old[0][0] > baseline_s:
            old.pop(0)
        base = [statistics.median(x[k] for x in old) if old else v for k, v in ((1, latency), (2, cpu), (3, rps))]
        deployed = ts if version is not None and own != version else deployed
        version = own
        old.append((ts, latency, cpu, rps))
        while memory and ts - memory[0][0] > slope_s:
            memory.pop(0)
        memory.append((ts, mem))
        span = ts - memory[0][0]
        out.append((latency / base[0], cpu / base[1], rps / base[2], (mem - memory[0][1]) / span * 60 if span > 0 else 0.0, 3600.0 if deployed is None else min(ts - deployed, 3600.0)))
    return out


def test_windows_equal_a_row_by_row_loop():
    rng = random.Random(3)
    for kind in range(6):
        ts, rows = 0.0, []
        for _ in range(400):
            ts += rng.choice([0.0, 1.0, 5.0, 400.0 if kind % 2 else 2.0])
            at = ts - rng.choice([0, 0, 0, 700]) if kind > 3 else ts  # some rows arrive out of order
            rows.append((at, f"v{rng.randrange(3) if rng.random() < 0.05 else 0}", rng.uniform(1, 900), rng.uniform(1, 99), rng.uniform(1, 99), rng.uniform(1, 99)))
        pdf = pd.DataFrame(rows, columns=["ts", "version", "latency_ms", "cpu_pct", "mem_pct", "rps"]).assign(seq=range(len(rows)), service="s", error_rate=0.0)
        whole, version, _ = windowed(pdf, np.ones(len(pdf), bool))
        assert version == rows[-1][1]
        got = whole[["latency_over_baseline", "cpu_over_baseline", "rps_over_baseline", "mem_slope_per_min", "since_deploy_s"]].to_numpy().tolist()
        assert got == [pytest.approx(x, abs=1e-9) for x in by_row(rows)]


def test_ties_are_taken_in_arrival_order():
    pdf = pd.DataFrame({"seq": [0, 1], "ts": [1.0, 1.0], "service": "s", "version": "v1", "latency_ms": [100.0, 300.0], "error_rate": 0.0, "cpu_pct": 1.0, "mem_pct": 1.0, "rps": 1.0})
    assert windowed(pdf, np.ones(2, bool))[0]["latency_over_baseline"].tolist() == [1.0, 3.0]


def test_buckets_follow_the_rate_of_a_service(spark):
    rows = spark.createDataFrame([("busy", k / 10) for k in range(1, 40_001)] + [("idle", float(k)) for k in range(1, 4001)], "service string, ts double")
    assert {r.service: r.span for r in features.bucket_spans(rows, rows=18_000).collect()} == {"busy": 900.0, "idle": 17_100.0}


def test_busy_services_slide_over_intervals(spark, monkeypatch):
    """Ties, bursts, pauses and deploys of two services that are taken for busy, beside one that isn't, in intervals far smaller than a window."""
    rng, rows, seq = random.Random(5), [], 0
    for service, many in (("a", 1500), ("b", 900), ("calm", 40)):
        ts = 100.0
        for k in range(many):
            ts += rng.choice([0.0, 0.1, 0.5, 3.0]) if k % 400 > 200 else rng.choice([0.0, 0.0, 0.05])
            ts += 700.0 if k in (500, 900) else 0
            rows.append((seq, ts, service, f"v{k // 333}", rng.choice([100.0, 100.0, rng.uniform(1, 900)]), 0.0, rng.uniform(1, 99), rng.uniform(1, 99), float(k % 7), "", None, 0))
            seq += 1
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, C.TELEMETRY).withColumn("ts", F.round("ts", 3))
    monkeypatch.setattr(sliding, "CELLS", 4)
    monkeypatch.setattr(features, "BUCKET_ROWS", 50)
    expected = {r.seq: tuple(r) for r in features.features(t, bucket_s=1e6).collect()}
    for busy in (200, 10**9):
        got = {r.seq: tuple(r) for r in features.features(t, busy=busy, keep=("log",)).drop("log").collect()}
        assert got.keys() == expected.keys()
        for k, row in got.items():
            assert row[:3] == expected[k][:3] and row[3:] == pytest.approx(expected[k][3:], abs=1e-9), (busy, row, expected[k])
    from_few = sliding.baselines(t.filter("service <> 'calm'"), 30)
    assert {(r.seq, r.base_latency_ms) for r in from_few.collect()} == {(r.seq, r.base_latency_ms) for r in sliding.baselines(t.filter("service <> 'calm'"), 10_000).collect()}


def test_rows_leave_when_window_functions_drop_them():
    rng = np.random.default_rng(1)
    ts = np.round(rng.uniform(0, 5000, 2000), 3)
    left = sliding.leaving(ts, 900.0)
    assert (left - 900 > ts).all() and (np.nextafter(left, -np.inf) - 900 <= ts).all()


def test_kernel_equals_window_functions_however_dealt(spark):
    t = fixtures.telemetry(spark, SMALL).filter("seq < 400")
    expected = [tuple(r) for r in features.features_sql(t).select("seq", *C.FEATURES).orderBy("seq").collect()]
    for bucket, parts in ((900.0, 1), (50.0, 7)):
        got = [tuple(r) for r in features.features(t.repartition(parts), bucket_s=bucket).select("seq", *C.FEATURES).orderBy("seq").collect()]
        assert len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            assert a == pytest.approx(b, abs=1e-9)


def test_stream_equals_batch_over_restarts(spark):
    live.rocks(spark)
    t = fixtures.telemetry(spark, SMALL)
    folder = shared_folder(spark)
    schema = C.TELEMETRY
    for k in range(3):  # a restart after each file: state comes from the checkpoint
        write_jsonl(t.filter(f"seq >= {k * 200} and seq < {(k + 1) * 200}").coalesce(1), f"{folder}/log")
        stream = live.features(spark.readStream.schema(schema).json(f"{folder}/log"))
        live.run_to_end(stream, f"{folder}/checkpoint", f"{folder}/rows")
    got = spark.read.parquet(f"{folder}/rows").select("seq", *C.FEATURES).orderBy("seq").collect()
    expected = features.features(t.filter("seq < 600")).select("seq", *C.FEATURES).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r), abs=1e-9) for r in expected]


def test_repeated_deliveries_count_once(spark):
    t = fixtures.telemetry(spark, SMALL).filter("seq < 300")
    folder = shared_folder(spark)
    write_jsonl(t.union(t.filter("seq % 3 = 0")), f"{folder}/log")
    rows = live.run_to_end(live.deduplicated(spark.readStream.schema(C.TELEMETRY).json(f"{folder}/log")))
    assert rows.count() == 300


def test_subscribers_each_see_everything(spark):
    t = fixtures.telemetry(spark, SMALL).filter("seq < 50")
    folder = shared_folder(spark)
    write_jsonl(t, f"{folder}/log")
    got = live.subscribe(spark.readStream.schema(C.TELEMETRY).json(f"{folder}/log"), f"{folder}/groups", ["a", "b"])
    assert {g: rows.count() for g, rows in got.items()} == {"a": 50, "b": 50}


def test_drift_monitor_over_micro_batches(spark):
    t = fixtures.telemetry(spark, SMALL)
    folder = shared_folder(spark)
    monitor = live.DriftMonitor(splits.healthy(t), folder, window=300)
    for k in range(4):
        monitor.observe(t.filter(f"seq div 250 = {k}"), k)
    monitor.observe(t.filter("seq div 250 = 3"), 3)  # a batch that is repeated
    from tripwire.operators import drift

    assert monitor.windows(spark).orderBy("window_id").collect() == drift.drift_windows(splits.healthy(t), t, window=300).orderBy("window_id").collect()
    # only the open block and the count are carried, and the tables of the last two batches
    assert spark.read.parquet(f"{folder}/open/batch=3").count() == t.count() % 300 + 1
    assert {r[0] for r in spark.read.parquet(f"{folder}/open").select("batch").distinct().collect()} == {2, 3}


def test_stream_of_decisions_equals_batch(spark):
    """Decisions and anomalies of a stream of features are those of the same rows as a table."""
    live.rocks(spark)
    t, folder = fixtures.telemetry(spark, SMALL), shared_folder(spark)
    fitted = models.fit_all(t, trees=5, forest_trees=10)
    rows = live.run_to_end(live.features(_as_stream(spark, t, folder)), f"{folder}/checkpoint", f"{folder}/features")
    again = lambda: spark.readStream.schema(rows.schema).parquet(f"{folder}/features")
    decided = live.run_to_end(live.decisions(again(), fitted))
    key = ["seq", "prediction", "action", "reason", "escalated", "resolved", "remediation"]
    expected = live.decide(live.score(features.features(t, keep=live.CARRIED), fitted), fitted)
    assert decided.select(*key).orderBy("seq").collect() == expected.select(*key).orderBy("seq").collect()
    assert decided.count() == t.count() and decided.filter("escalated and action = 'act' and prediction not in ('bad_deploy', 'dependency_failure')").isEmpty()
    strange = live.run_to_end(live.anomalies(again(), fitted))
    batch = models.strangeness(fitted.forest, features.features(t))
    assert strange.select("seq", "flag").orderBy("seq").collect() == batch.select("seq", "flag").orderBy("seq").collect()


def _as_stream(spark, rows, folder):
    rows.write.parquet(f"{folder}/log")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/log")

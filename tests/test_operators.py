"""Edge cases of splits, sets, readers, decisions, drift and delivery."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tripwire.functions import conformal, logs
from tripwire.functions import constants as C
from tripwire.operators import boosting, decision, delivery, drift, metrics, models, ranks, splits
from tripwire.plans import fixtures

SMALL = "/root/testdata/sf0.001"


def numbers(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "seq long, x double")


def test_quantiles_follow_three_rules(spark):
    rows = numbers(spark, [5, 1, 4, 2, 3, 3])
    assert ranks.floor_index_quantiles(rows, "x", [0.5, 0.99]) == [3.0, 5.0]
    assert ranks.linear_quantiles(rows, "x", [0.0, 0.5, 0.9]) == [1.0, 3.0, 4.5]
    assert ranks.linear_quantiles(rows.limit(0), "x", [0.5]) == [None]
    assert [r.rank for r in ranks.with_rank(rows, "x", "seq").orderBy("x", "seq").collect()] == list(range(6))


def test_threshold_rank(spark):
    p = [[1 - k / 10, k / 10] for k in range(10)]
    rows = spark.createDataFrame([("bad_deploy", x) for x in p], "y string, p array<double>")
    index = min(math.ceil(11 * 0.8), 9)
    assert conformal.qhat(rows, 0.2) == pytest.approx(index / 10)


def test_missing_classes_are_refused(spark):
    rows = spark.createDataFrame([(float(k), "a" if k < 6 else "b") for k in range(10)], "ts double, y string")
    with pytest.raises(ValueError, match="test but not in training"):
        splits.temporal_split(rows, 0.5)
    with pytest.raises(ValueError, match="calibration but not in training"):
        splits.three_way_split(rows)
    with pytest.raises(ValueError, match="without an incident"):
        splits.healthy(spark.createDataFrame([("memory_leak",)], "incident_type string"))
    with pytest.raises(ValueError, match="don't align"):
        splits.aligned(rows.select(F.col("ts").alias("seq")), rows.limit(3).select(F.col("ts").alias("seq")))


def test_fixed_point_text_is_pythons(spark):
    values = [0.0005, 0.0015, 0.0025, 0.0045, 0.5, 1.5, 2.5, 0.125, 99.995, 1234.5, 48.49999999, 1e-9, 0.0, 7.0, 2.675, -0.5, -1.25]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(logs.fixed(F.col("x"), k).alias(str(k)) for k in (0, 1, 2, 3)))
    for r in rows.collect():
        assert [r[str(k)] for k in (0, 1, 2, 3)] == [f"{r.x:.{k}f}" for k in (0, 1, 2, 3)]


def event(spark, log="GET 200", **more):
    row = {"seq": 0, "ts": 0.0, "service": "s", "version": "v1.0.0", "latency_ms": 123.4, "error_rate": 0.0123, "cpu_pct": 41.0, "mem_pct": 52.0, "rps": 200.0, "log": log, "incident_type": None, "label": 0} | more
    return spark.createDataFrame([tuple(row[n] for n in C.TELEMETRY.names)], C.TELEMETRY)


def test_reader_takes_the_first_pattern(spark):
    read = lambda text: logs.with_verdict(event(spark, text)).first()
    both = read("returning 500; upstream x timeout")
    assert (both.incident, both.evidence, both.remediation, both.grounded) == ("dependency_failure", "upstream x timeout", "failover", True)
    assert read("\x00\x1f").incident == "normal"


def test_groundedness(spark):
    ask = lambda text: event(spark).select(logs.grounded(F.lit(text)).alias("x")).first().x
    assert ask("it took 123ms") and ask("version v1.0.0") and not ask("999999ms and 7.7%")


def test_a_failing_reader_gives_normal_verdicts(spark):
    def broken(prompt):
        raise TimeoutError

    row = logs.read_with(event(spark).withColumn("prompt", F.lit("?")), broken, "remote").first()
    assert (row.incident, row.remediation, row.failed, row.explanation, row.grounded) == ("normal", "none", True, "reader failed: TimeoutError", False)


def test_true_effects(spark):
    cases = [("memory_leak", "restart", 0.75), ("memory_leak", "failover", -0.1), ("memory_leak", "none", 0.0), (None, "restart", -0.1)]
    rows = spark.createDataFrame(cases, "incident string, action string, expected double")
    assert all(r.e == r.expected for r in rows.select("expected", decision.true_effect(F.col("incident"), F.col("action")).alias("e")).collect())


def test_small_gains_do_not_pay(spark):
    effects = {a: F.lit(0.01) for a in C.ACTIONS}
    assert spark.range(1).select(decision.best_action(decision.effects_array(effects))["action"].alias("a")).first().a == "none"
    free = decision.best_action(decision.effects_array(effects | {"none": F.lit(0.0)}), charge=False)
    assert spark.range(1).select(free["action"].alias("a")).first().a == "restart"


def test_uplift_needs_an_untreated_arm(spark):
    with pytest.raises(ValueError, match="action none"):
        decision.uplift(spark.createDataFrame([("a", "restart", 1.0)], "y string, action string, outcome double"))


def test_qini_ends_at_the_policy_value(spark):
    t = fixtures.scores(fixtures.telemetry(spark, SMALL)).withColumn("action", logs.remedy(F.col("prediction"), "none"))
    curve = decision.qini(t, "risk").orderBy("step").collect()
    assert curve[0].gain == 0 and curve[-1].gain == pytest.approx(decision.policy_value(t).first().value)


def test_stability_index(spark):
    a = numbers(spark, range(1000))
    assert drift.psi(a, a, "x").first().psi < 0.01
    assert drift.psi(a, a.limit(0), "x").first().psi == 0.0
    same = numbers(spark, [1] * 50)
    assert drift.psi(same, same, "x").first().psi == pytest.approx(0.0)


def test_only_full_windows_are_judged(spark):
    reference = numbers(spark, range(100))
    live = lambda n: numbers(spark, [9999] * n)
    assert drift.drift_windows(reference, live(499), "x", 500).count() == 0
    assert drift.drift_windows(reference, live(500), "x", 500).first().alert
    with pytest.raises(ValueError, match="needs reference rows"):
        drift.drift_windows(reference.limit(0), live(3), "x", 2)


def test_canary_gates(spark):
    rows = spark.createDataFrame([("a", "a", "b")] * 300, "y string, prediction string, prediction_b string")
    assert drift.canary(rows.limit(10)).first().reason == "only 10 events, need 200"
    worse = drift.canary(rows).first()
    assert not worse.promote and worse.reason.startswith("regression: 0.000 vs 1.000")
    assert drift.canary(rows, candidate="prediction").first().promote


def test_releases(spark):
    log = lambda *steps: drift.releases(spark.createDataFrame([(k, *s) for k, s in enumerate(steps)], "n long, action string, model string"))
    assert tuple(log(("promote", "a"), ("promote", "b"), ("rollback", None)).first()) == ("a", "b")
    with pytest.raises(PySparkException, match="without an earlier model"):
        log(("promote", "a"), ("rollback", None)).collect()
    rng = random.Random(4)
    for block in (1, 3, 1000):
        state, steps = (None, None), []
        for k in range(40):
            back = state[1] is not None and rng.random() < 0.4
            steps.append((k, "rollback", None) if back else (k, "promote", f"m{k}"))
            state = (state[1], state[0]) if back else (f"m{k}", state[0])
            if k % 13 == 12:
                assert tuple(drift.releases(spark.createDataFrame(steps, "n long, action string, model string"), block).first()) == state
    with pytest.raises(PySparkException, match="without an earlier model"):
        drift.releases(spark.createDataFrame([(0, "promote", "a"), (5, "rollback", None)], "n long, action string, model string"), 2).collect()


def test_quantiles_of_ties(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 7.0).otherwise(F.col("id").cast("double")).alias("x"), "id")
    assert ranks.linear_quantiles(rows, "x", [0.0, 0.5, 0.899, 0.9, 1.0]) == pytest.approx(np.quantile([7.0] * 900 + list(range(900, 1000)), [0.0, 0.5, 0.899, 0.9, 1.0]).tolist())
    same = spark.range(500).select(F.lit(1).alias("x"))
    assert sorted(r.rank for r in ranks.with_rank(same, "x").collect()) == list(range(500))


def test_union_of_consumers(spark):
    rows = spark.range(6).select(F.col("id").alias("seq"), F.lit("c").alias("consumer"))
    assert sorted(r.seq for r in delivery.union_processed([rows.filter("seq < 3"), rows.filter("seq > 1")]).collect()) == list(range(6))


def test_redelivery(spark):
    events = spark.range(4).select(F.col("id").alias("seq"), F.lit("s").alias("service"))
    claims = events.select(F.lit("g").alias("grp"), "seq", F.lit("c").alias("consumer"), F.lit(0.0).alias("at"))
    none = claims.limit(0)
    assert [r.deliveries for r in delivery.redeliver(events, claims, none, 5.0, 1.0, 10).collect()] == [2] * 4
    assert delivery.redeliver(events, claims, none, 5.0, 10.0, 10).count() == 0
    audit = delivery.recovery_audit(events, claims.union(claims.filter("seq < 2"))).first()
    assert (audit.processed, audit.distinct_offsets, audit.duplicates, audit.lost) == (6, 4, 2, 0)


def test_reports_cover_classes_of_either_side(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, prediction string")
    report = {r.cls: (r.precision, r.recall, r.support) for r in metrics.class_report(rows).collect()}
    assert report == {"a": (0.5, 0.5, 2), "b": (0.0, 0.0, 0), "c": (0.0, 0.0, 1)}


def test_isolation_forest_finds_the_strange_row_however_dealt(spark):
    rows = [(k, float(k % 7), float(k % 5)) for k in range(300)] + [(300, 500.0, -80.0)]
    t = spark.createDataFrame(rows, "seq long, a double, b double")
    scores = []
    for parts in (1, 5):
        forest = models.fit_forest(t.filter("seq < 300").repartition(parts), trees=30, columns=["a", "b"])
        scores.append({r.seq: r.strangeness for r in models.strangeness(forest, t, ["a", "b"]).collect()})
    assert scores[0] == scores[1] and scores[0][300] == max(scores[0].values())


def _rings(spark, n=600):
    """Three classes that no single cut tells apart, with nulls and a repeated row."""
    rng = random.Random(5)
    rows = []
    for k in range(n):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((k, a if k % 50 else None, b, "inner" if a * a + b * b < 0.3 else "left" if a < 0 else "right", 0.5))
    return spark.createDataFrame([*rows, rows[1]], "seq long, a double, b double, y string, p double")


def test_boosted_trees_are_the_same_however_dealt_and_learn(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 4)  # scores are written on the way
    rows, made = _rings(spark), []
    for parts in (1, 5):
        made.append(boosting.train(rows.repartition(parts), rounds=9, rate=0.3, least=5, ridge=1.0, columns=["a", "b"]))
    for one, other in zip(made[0].rounds, made[1].rounds, strict=True):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.value == other.value).all()
    out = boosting.classify(made[0], rows).collect()
    assert len(out) == 601 and set(out[0].asDict()) == {"seq", "a", "b", "y", "p", "prediction"}
    assert sum(r.y == r.prediction for r in out) > 0.95 * len(out) and all(abs(sum(r.p) - 1) < 1e-9 for r in out)
    assert sum(g for _, g in boosting.importances(made[0])) == pytest.approx(1) and made[0].classes == ["inner", "left", "right"]


def test_boosted_trees_equal_sums_in_memory(spark):
    """The first round against slopes, curvatures and cuts worked out over all rows at once."""
    rows = _rings(spark, 300)
    model = boosting.train(rows, rounds=1, depth=1, rate=1.0, least=5, ridge=1.0, columns=["a", "b"])
    local = rows.toPandas()
    weight = (len(local) / 3 / local.y.map(local.y.value_counts())).to_numpy()
    bins = model.bins(local[["a", "b"]].to_numpy(float))
    for k, name in enumerate(model.classes):
        slope, curve = (1 / 3 - (local.y == name).to_numpy()) * weight, 2 / 9 * weight
        best = max(
            (sum(slope[s].sum() ** 2 / (curve[s].sum() + 1) for s in (bins[:, f] <= b, bins[:, f] > b)), -f, -b)
            for f in range(2) for b in range(len(model.edges[f])) if min((bins[:, f] <= b).sum(), (bins[:, f] > b).sum()) >= 5
        )
        trees = model.rounds[0]
        assert (trees.feature[k, 0], trees.cut[k, 0]) == (-best[1], -best[2])
        under = bins[:, -best[1]] <= -best[2]
        assert trees.value[k, 1] == pytest.approx(-slope[under].sum() / (curve[under].sum() + 1), rel=1e-4)


def test_boosted_trees_edges(spark):
    from tripwire.sources.storage import shared_folder

    rows, folder = _rings(spark, 60), shared_folder(spark)
    with pytest.raises(ValueError, match="with a class"):
        boosting.train(rows.limit(0), columns=["a", "b"])
    one = boosting.train(rows.withColumn("y", F.lit("x")), columns=["a", "b"])
    assert not one.rounds and {tuple(r.p) for r in boosting.classify(one, rows).collect()} == {(1.0,)}
    model = boosting.train(rows.withColumn("y", F.when(F.col("seq") > 5, F.col("y"))), rounds=2, columns=["a", "b"])
    boosting.save(spark, model, folder)
    again = boosting.load(spark, folder)
    assert models.classify(again, rows).exceptAll(models.classify(model, rows)).isEmpty() and boosting.classify(again, rows.limit(0)).count() == 0
    assert models.importances(again, rows).collect() == models.importances(model, rows).collect() and models.classes_of(again) == model.classes


def test_snapshot_and_offsets(spark):
    from tripwire.sources import telemetry as source
    from tripwire.sources.storage import shared_folder

    t = fixtures.telemetry(spark, SMALL).limit(20)
    folder = shared_folder(spark)
    source.write_snapshot({"classes": metrics.ground_truth(t), "rate": t.agg(F.count("*").alias("n"))}, folder)
    assert spark.read.json(folder).first().rate[0].n == 20
    log = shared_folder(spark)
    source.append(t, log)
    source.append(t, log, first=20)
    assert sorted(r.seq for r in source.read_jsonl(spark, log).collect()) == list(range(40))


def test_a_fit_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    each = (F.pmod(F.xxhash64("seq", F.lit(c)), F.lit(1000)) / 1000 for c in C.FEATURES)
    rows = spark.range(600).select(F.col("id").alias("seq"), *(x.alias(c) for x, c in zip(each, C.FEATURES, strict=True)))
    rows = rows.withColumn("y", F.when(F.col("cpu_over_baseline") > 0.5, "a").otherwise("b")).withColumn("action", F.when(F.col("seq") % 2 == 0, "none").otherwise("restart")).withColumn("outcome", F.col("mem_pct"))
    counted = rows.mapInPandas(costly, rows.schema)
    fits = (lambda: models.train_classifier(counted, trees=2, depth=2), lambda: models.fit_outcomes(counted, trees=2), lambda: models.fit_forest(counted, trees=3, sample=20), lambda: boosting.train(counted, rounds=2), lambda: models.detect(counted, F.col("y") == "a", trees=3, sample=20).count())
    for fit in fits:
        before = seen.value
        fit()
        assert seen.value - before == 600


def test_detecting_is_fitting_and_scoring(spark):
    rows = spark.range(500).select(F.col("id").alias("seq"), *((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000).alias(c) for c in C.FEATURES))
    normal = F.col("seq") % 3 > 0
    found = models.detect(rows, normal, trees=9, sample=40)
    assert found.select("seq", "strangeness", "flag").exceptAll(models.strangeness(models.fit_forest(rows.filter(normal), 9, 40), rows).select("seq", "strangeness", "flag")).isEmpty()

"""The registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions import conformal, logs
from tripwire.functions import constants as C
from tripwire.operators import boosting, decision, delivery, drift, features, metrics, models, reading, registry, splits
from tripwire.operators.ranks import floor_index_quantiles
from tripwire.plans import fixtures as X
from tripwire.sources import storage
from tripwire.sources import telemetry as source
from tripwire.sources.sink import STEPS
from tripwire.sources.storage import shared_folder
from tripwire.streaming import ledger, live
from tripwire.streaming.subscribers import Subscribers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, views: str = X.TELEMETRY_SQL):
    """Registers a function of (telemetry) under its name, with its SQL over the views."""

    def wrap(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(X.telemetry(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = f"WITH {views} {oracle}"
        return f

    return wrap


def r6(*names: str):
    """The named columns rounded: sums of floats depend on their order."""
    return [F.round(n, 6).alias(n) for n in names]


def sql6(**columns: str) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())


# --- sources, projections and filters


@query("SELECT y AS cls, count(*) AS n, CAST(sum(label) AS BIGINT) AS breaching, round(avg(label), 6) AS share FROM telemetry GROUP BY y")
def slo_summary(t):
    return metrics.ground_truth(t).select("cls", "n", "breaching", *r6("share"))


@query("SELECT * EXCLUDE y FROM telemetry WHERE label = 1")
def breaching_events(t):
    return t.filter("label = 1")


@query("SELECT seq, ts, service, latency_ms FROM telemetry WHERE incident_type IS NULL")
def healthy_rows(t):
    return splits.healthy(t).select("seq", "ts", "service", "latency_ms")


@query("SELECT q, x FROM (SELECT list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n FROM telemetry), (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) s(q), LATERAL (SELECT v[CAST(floor(q * n) AS INT) + 1] AS x)")
def latency_order_stats(t):
    shares = [0.5, 0.95, 0.99]
    rows = list(zip(shares, floor_index_quantiles(t, "latency_ms", shares), strict=True))
    return t.sparkSession.createDataFrame(rows, "q double, x double")


@query("SELECT CAST(row_number() OVER (ORDER BY ts, service) - 1 AS BIGINT) AS seq, ts, service, latency_ms FROM telemetry")
def appended_offsets(t):
    return source.append(t, shared_folder(t.sparkSession)).select("seq", "ts", "service", "latency_ms")


@query("SELECT count(DISTINCT service) AS services, count(DISTINCT y) AS classes, count(DISTINCT version) AS versions FROM telemetry")
def distinct_counts(t):
    return t.agg(F.count_distinct("service").alias("services"), F.count_distinct(logs.class_of("incident_type")).alias("classes"), F.count_distinct("version").alias("versions"))


@query("SELECT seq, latency_ms, round(rps, 6) AS rps, label FROM (SELECT seq, round(latency_ms * CAST(1.8 AS DOUBLE), 6) AS latency_ms, rps * 1.5::DOUBLE AS rps, CAST(latency_ms * CAST(1.8 AS DOUBLE) > 500 OR error_rate > CAST(0.05 AS DOUBLE) AS INT) AS label FROM telemetry)")
def shifted_stream(t):
    return source.shifted(t).select("seq", *r6("latency_ms", "rps"), "label")


# --- features

_FRAMED = """,
framed AS (SELECT *, quantile_cont(latency_ms, 0.5) OVER base AS b_lat, quantile_cont(cpu_pct, 0.5) OVER base AS b_cpu, quantile_cont(rps, 0.5) OVER base AS b_rps,
  first(ts) OVER slope AS first_ts, first(mem_pct) OVER slope AS first_mem, lag(version) OVER (PARTITION BY service ORDER BY ts, seq) AS previous FROM telemetry
  WINDOW base AS (PARTITION BY service ORDER BY ts RANGE BETWEEN CAST(900 AS DOUBLE) PRECEDING AND CAST(0.000001 AS DOUBLE) PRECEDING),
         slope AS (PARTITION BY service ORDER BY ts RANGE BETWEEN CAST(60 AS DOUBLE) PRECEDING AND CURRENT ROW)),
deployed AS (SELECT *, max(CASE WHEN previous <> version THEN ts END) OVER (PARTITION BY service ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS last_deploy FROM framed),
features AS (SELECT seq, ts, service, y, latency_ms, latency_ms / greatest(coalesce(b_lat, latency_ms), CAST(0.000001 AS DOUBLE)) AS latency_over_baseline, error_rate, cpu_pct / greatest(coalesce(b_cpu, cpu_pct), CAST(0.000001 AS DOUBLE)) AS cpu_over_baseline, mem_pct,
  CASE WHEN ts > first_ts THEN (mem_pct - first_mem) / (ts - first_ts) * 60 ELSE 0 END AS mem_slope_per_min, rps / greatest(coalesce(b_rps, rps), CAST(0.000001 AS DOUBLE)) AS rps_over_baseline, CAST(least(coalesce(ts - last_deploy, 3600), 3600) AS DOUBLE) AS since_deploy_s FROM deployed)"""
_LEAKY = """,
means AS (SELECT service, avg(latency_ms) AS m_lat, avg(cpu_pct) AS m_cpu, avg(rps) AS m_rps FROM telemetry GROUP BY service),
leaky AS (SELECT seq, ts, t.service, y, latency_ms, latency_ms / m_lat AS latency_over_baseline, error_rate, cpu_pct / m_cpu AS cpu_over_baseline, mem_pct, 0.0::DOUBLE AS mem_slope_per_min, rps / m_rps AS rps_over_baseline, 3600.0::DOUBLE AS since_deploy_s FROM telemetry t JOIN means m ON t.service = m.service)"""
_ALL8 = sql6(**{f: f for f in C.FEATURES})


@query(f"SELECT seq, ts, service, {_ALL8} FROM features", X.TELEMETRY_SQL + _FRAMED)
def features_full(t):
    return features.features(t).select("seq", "ts", "service", *r6(*C.FEATURES))


@query(f"SELECT seq, ts, service, {_ALL8} FROM leaky", X.TELEMETRY_SQL + _LEAKY)
def features_leaky(t):
    return features.leaky_features(t).select("seq", "ts", "service", *r6(*C.FEATURES))


@query("SELECT f.y AS y, round(avg(f.latency_over_baseline), 6) AS online, round(avg(l.latency_over_baseline), 6) AS leaky, count(*) AS n FROM features f JOIN leaky l ON f.seq = l.seq GROUP BY f.y", X.TELEMETRY_SQL + _FRAMED + _LEAKY)
def feature_means_by_class(t):
    return metrics.feature_means(features.features(t), features.leaky_features(t), t.select("seq", logs.class_of("incident_type").alias("y"))).select("y", "n", *r6("online", "leaky"))


@query("SELECT seq, ts, service, previous AS previous_version, version FROM deployed WHERE previous <> version", X.TELEMETRY_SQL + _FRAMED)
def deploy_events(t):
    return features.deploys(t)


@query("SELECT service, count(*) AS n, round(avg(mem_slope_per_min), 6) AS mean_slope, round(max(mem_slope_per_min), 6) AS max_slope FROM features GROUP BY service", X.TELEMETRY_SQL + _FRAMED)
def mem_slope(t):
    return features.features(t).groupBy("service").agg(F.count("*").alias("n"), F.round(F.avg("mem_slope_per_min"), 6).alias("mean_slope"), F.round(F.max("mem_slope_per_min"), 6).alias("max_slope"))


@query("SELECT y, round(min(latency_over_baseline), 6) AS low, round(max(latency_over_baseline), 6) AS high, round(avg(CAST(latency_over_baseline > 1 AS INT)), 6) AS above_one FROM features GROUP BY y", X.TELEMETRY_SQL + _FRAMED)
def feature_ranges(t):
    return metrics.feature_ranges(splits.build_dataset(t, 0.0), "latency_over_baseline").select("y", *r6("low", "high", "above_one"))


@query("SELECT seq, " + sql6(**{f: f for f in C.ANOMALY_FEATURES}) + " FROM features", X.TELEMETRY_SQL + _FRAMED)
def anomaly_view(t):
    return features.features(t).select("seq", *r6(*C.ANOMALY_FEATURES))


@query("SELECT y, count(*) AS n, round(avg(latency_over_baseline), 6) AS ratio FROM features WHERE ts >= 60 GROUP BY y", X.TELEMETRY_SQL + _FRAMED)
def dataset_classes(t):
    return splits.build_dataset(t).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("latency_over_baseline"), 6).alias("ratio"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, round(avg({f}), 6) AS mean FROM features" for f in C.FEATURES), X.TELEMETRY_SQL + _FRAMED)
def feature_maps(t):
    """Means by name over the rows' maps from names to values."""
    named = features.features(t).select(F.explode(features.feature_map()).alias("feature", "value"))
    return named.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# --- splits


def _kept(t):
    return t.filter(F.col("ts") >= C.WARM_UP_S).select("seq", "ts", logs.class_of("incident_type").alias("y"))


_KEPT = X.TELEMETRY_SQL + ", kept AS (SELECT seq, ts, y FROM telemetry WHERE ts >= 60)"


@query("SELECT CASE WHEN ts < (SELECT quantile_cont(ts, 0.7) FROM kept) THEN 'train' ELSE 'test' END AS part, y, count(*) AS n FROM kept GROUP BY ALL", _KEPT)
def dataset_split_counts(t):
    train, test = splits.temporal_split(_kept(t))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "y").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN ts < (SELECT quantile_cont(ts, 0.55) FROM kept) THEN 'train' WHEN ts < (SELECT quantile_cont(ts, 0.75) FROM kept) THEN 'calibrate' ELSE 'test' END AS part, y, count(*) AS n FROM kept GROUP BY ALL", _KEPT)
def three_way_split(t):
    parts = [p.withColumn("part", F.lit(n)) for p, n in zip(splits.three_way_split(_kept(t)), ("train", "calibrate", "test"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part", "y").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN (seq * 7919 + 5) % 10 < 3 THEN 'held' ELSE 'train' END AS part, y, count(*) AS n FROM kept GROUP BY ALL", _KEPT)
def random_split(t):
    """A split that ignores time, by an arithmetic pick in place of the hash."""
    train, held = splits.random_split(_kept(t), 0.3, pick=(F.col("seq") * 7919 + 5) % 10 < 3)
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held")))
    return both.groupBy("part", "y").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT y FROM kept EXCEPT SELECT DISTINCT y FROM kept WHERE y <> 'memory_leak'", _KEPT)
def missing_classes(t):
    rows = _kept(t)
    return splits.missing_classes(rows, splits.held_out_class(rows, "memory_leak")[0])


@query("SELECT y, round(total / (classes * n), 6) AS weight FROM (SELECT y, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS classes FROM kept GROUP BY y)", _KEPT)
def class_weights(t):
    return metrics.class_weights(_kept(t)).select("y", *r6("weight"))


# --- reports on scores

_REPORT = X.SCORES_SQL + """,
sides AS (SELECT y AS cls, 1 AS actual, 0 AS predicted, y = prediction AS hit FROM scores UNION ALL SELECT prediction, 0, 1, y = prediction FROM scores),
cnt AS (SELECT cls, CAST(sum(actual) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(CASE WHEN hit THEN actual ELSE 0 END) AS BIGINT) AS tp FROM sides GROUP BY cls),
pr AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall FROM cnt),
report AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM pr)"""


@query('SELECT cls, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report', _REPORT)
def class_report(t):
    return metrics.class_report(X.scores(t)).select("cls", "support", *r6("precision", "recall", "f1"))


@query("SELECT round(avg(f1), 6) AS macro_f1, (SELECT round(avg(CAST(y = prediction AS INT)), 6) FROM scores) AS accuracy, (SELECT count(*) FROM scores) AS n FROM report", _REPORT)
def macro_f1(t):
    return metrics.macro(X.scores(t)).select("n", *r6("macro_f1", "accuracy"))


@query("SELECT y, " + ", ".join(f"count(*) FILTER (prediction = '{c}') AS {c}" for c in C.CLASSES) + " FROM scores GROUP BY y", X.SCORES_SQL)
def confusion(t):
    return metrics.confusion(X.scores(t))


@query("SELECT y, round(avg(CAST(flag AS INT)), 6) AS flag_rate, count(*) AS n FROM scores GROUP BY y", X.SCORES_SQL)
def detection_rate(t):
    return metrics.detection_rate(X.scores(t)).select("y", "n", *r6("flag_rate"))


@query("SELECT round(avg(CASE WHEN prediction = 'normal' AND y <> 'normal' THEN CAST(flag AS INT) END), 6) AS rescue_rate, round(avg(CASE WHEN prediction = 'normal' AND flag THEN CAST(y <> 'normal' AS INT) END), 6) AS flag_precision, round(avg(CASE WHEN prediction = 'normal' THEN CAST(y <> 'normal' AS INT) END), 6) AS base_rate FROM scores", X.SCORES_SQL)
def rescue_rate(t):
    return metrics.rescue(X.scores(t)).select(*r6("rescue_rate", "flag_precision", "base_rate"))


@query("SELECT round(corr(recall, rate), 6) AS correlation FROM report r JOIN (SELECT y, avg(CAST(flag AS INT)) AS rate FROM scores GROUP BY y) d ON r.cls = d.y WHERE cls <> 'normal'", _REPORT)
def layer_corr(t):
    return metrics.layer_correlation(X.scores(t)).select(*r6("correlation"))


@query('SELECT round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(max(latency_ms), 6) AS "max", count(*) AS n FROM telemetry')
def latency_profile(t):
    return metrics.latency_profile(t, "latency_ms").select("n", *r6("p50", "p95", "p99", "max"))


@query("SELECT CAST(row_number() OVER (ORDER BY n DESC, cls) AS INT) AS place, cls, n FROM (SELECT y AS cls, count(*) AS n FROM telemetry GROUP BY y)")
def most_common_classes(t):
    return metrics.most_common(t.select(logs.class_of("incident_type").alias("cls")), "cls")


@query("SELECT prediction, count(*) AS n, count(*) FILTER (t.y = s.prediction) AS hits FROM telemetry t JOIN scores s ON s.seq = t.seq GROUP BY prediction", X.SCORES_SQL)
def alignment(t):
    """Events and their predictions, which must be of the same rows."""
    both = splits.aligned(t.select("seq", logs.class_of("incident_type").alias("y")), X.scores(t).select("seq", "prediction"))
    return both.groupBy("prediction").agg(F.count("*").alias("n"), F.sum((F.col("y") == F.col("prediction")).cast("long")).alias("hits"))


# --- conformal sets

_Q = X.SCORES_SQL + """,
calib AS (SELECT 1 - p_true AS s, row_number() OVER (ORDER BY 1 - p_true) - 1 AS i, count(*) OVER () AS n FROM scores WHERE seq % 4 = 0),
q AS (SELECT s AS qhat FROM calib WHERE i = least(CAST(ceil((n + 1) * (1 - CAST(0.05 AS DOUBLE))) AS BIGINT), n - 1)),
sets AS (SELECT *, list_filter(""" + X._CLASSES + """, lambda c, i: p[i] >= 1 - qhat) AS st FROM scores, q)"""


def _with_sets(t):
    s = X.scores(t)
    return s.withColumn("set", conformal.prediction_set(conformal.qhat(s.filter("seq % 4 = 0"))))


@query("SELECT round(qhat, 9) AS qhat FROM q", _Q)
def qhat(t):
    q = conformal.qhat(X.scores(t).filter("seq % 4 = 0"))
    return t.sparkSession.createDataFrame([(q,)], "qhat double").select(F.round("qhat", 9).alias("qhat"))


@query("SELECT seq, prediction, array_to_string(st, ',') AS \"set\", CASE WHEN len(st) <> 1 THEN 'escalate' ELSE 'act' END AS action, CASE WHEN len(st) <> 1 THEN 'ambiguous set [' || array_to_string(st, ', ') || ']' ELSE 'confident ' || prediction END AS reason FROM sets", _Q)
def prediction_sets(t):
    return _with_sets(t).select("seq", "prediction", F.array_join("set", ",").alias("set"), conformal.action().alias("action"), conformal.reason().alias("reason"))


@query(f"SELECT seq, array_to_string(list_sort(list_distinct(list_append(list_filter({X._CLASSES}, lambda c, i: p[i] >= 1 - CAST(0.05 AS DOUBLE)), prediction))), ',') AS \"set\" FROM scores", X.SCORES_SQL)
def naive_sets(t):
    return X.scores(t).select("seq", F.array_join(conformal.naive_set(), ",").alias("set"))


@query("SELECT " + sql6(coverage="avg(CAST(list_contains(st, y) AS INT))", mean_size="avg(len(st))", singleton="avg(CAST(len(st) = 1 AS INT))", ambiguous="avg(CAST(len(st) > 1 AS INT))", empty="avg(CAST(len(st) = 0 AS INT))") + " FROM sets", _Q)
def coverage(t):
    return conformal.coverage(_with_sets(t)).select(*r6("coverage", "mean_size", "singleton", "ambiguous", "empty"))


@query("SELECT " + sql6(act_singleton="avg(CAST(len(st) = 1 AS INT))", escalate_ambiguous="avg(CAST(len(st) > 1 AS INT))", escalate_empty="avg(CAST(len(st) = 0 AS INT))") + " FROM sets", _Q)
def routing(t):
    return conformal.routing(_with_sets(t)).select(*r6("act_singleton", "escalate_ambiguous", "escalate_empty"))


@query("SELECT round(avg(CAST(list_has_all(st, ['bad_deploy', 'dependency_failure']) AS INT)), 6) AS hedged FROM sets WHERE y = 'dependency_failure'", _Q)
def hedged_share(t):
    return conformal.hedged_share(_with_sets(t), "dependency_failure", C.ESCALATED_CLASSES).select(*r6("hedged"))


@query("SELECT round(avg(p_bad_deploy), 6) AS p_wrong, round(avg(p_dependency_failure), 6) AS p_right, count(*) AS n FROM scores WHERE y = 'dependency_failure' AND prediction = 'bad_deploy'", X.SCORES_SQL)
def misread_confidence(t):
    return conformal.misread_confidence(X.scores(t), "dependency_failure", "bad_deploy").select("n", *r6("p_wrong", "p_right"))


# --- logs

_READ = """CASE WHEN regexp_extract(log, 'upstream \\S+ (?:timeout|503)|connection pool exhausted|retrying \\(') <> '' THEN 'dependency_failure'
  WHEN regexp_extract(log, 'Exception in \\w+\\.\\w+|returning 500') <> '' THEN 'bad_deploy' WHEN regexp_extract(log, 'GC pause|heap at \\d+%|old-gen') <> '' THEN 'memory_leak'
  WHEN regexp_extract(log, 'queue depth|worker pool saturated|requests shed') <> '' THEN 'traffic_spike' ELSE 'normal' END"""
_EVIDENCE = """coalesce(nullif(regexp_extract(log, 'upstream \\S+ (?:timeout|503)|connection pool exhausted|retrying \\('), ''), nullif(regexp_extract(log, 'Exception in \\w+\\.\\w+|returning 500'), ''),
  nullif(regexp_extract(log, 'GC pause|heap at \\d+%|old-gen'), ''), nullif(regexp_extract(log, 'queue depth|worker pool saturated|requests shed'), ''), '')"""
_LATENCY = "CAST(CAST(round_even(latency_ms, 0) AS BIGINT) AS VARCHAR)"
_VERDICTS = X.SCORES_SQL + f""",
read0 AS (SELECT *, {_READ} AS incident, {_EVIDENCE} AS evidence FROM scores),
verdicts AS (SELECT *, {X.sql_remedy("incident", "none")} AS remediation, CASE WHEN incident = 'normal' THEN service || ' logged a routine request at ' || {_LATENCY} || 'ms.' ELSE service || ' shows ' || trim(split_part(log, ';', 1)) || ' at ' || {_LATENCY} || 'ms latency.' END AS explanation FROM read0)"""


@query("SELECT seq, incident, evidence, remediation, explanation FROM verdicts", _VERDICTS)
def log_verdicts(t):
    return logs.with_verdict(t).select("seq", "incident", "evidence", "remediation", "explanation")


_WHOLE = lambda m: f"CAST(CAST(round_even({m}, 0) AS BIGINT) AS VARCHAR)"
_QUOTED = "[" + ", ".join(_WHOLE(m) for m in ("latency_ms", "cpu_pct", "mem_pct", "rps")) + ", printf('%.3f', error_rate), printf('%.2f', error_rate), CAST(CAST(trunc(latency_ms) AS BIGINT) AS VARCHAR), version]"
_CLAIM = "CASE seq % 4 WHEN 0 THEN 'cpu at ' || " + _WHOLE("cpu_pct") + " || ' pct' WHEN 1 THEN 'took ' || CAST(seq % 1000 AS VARCHAR) || 'ms' WHEN 2 THEN 'since ' || version ELSE 'a routine request' END"


@query(f"SELECT seq, len(list_filter({_QUOTED}, lambda v: v <> '' AND contains(explanation, v))) > 0 AS own, len(list_filter({_QUOTED}, lambda v: v <> '' AND contains({_CLAIM}, v))) > 0 AS other FROM verdicts", _VERDICTS)
def grounded(t):
    """Of the reader's own explanations, and of texts that may quote nothing of their row."""
    kind, seq = F.col("seq") % 4, F.col("seq")
    claim = F.when(kind == 0, F.concat(F.lit("cpu at "), logs.fixed(F.col("cpu_pct"), 0), F.lit(" pct"))).when(kind == 1, F.concat(F.lit("took "), (seq % 1000).cast("string"), F.lit("ms"))).when(kind == 2, F.concat(F.lit("since "), F.col("version"))).otherwise("a routine request")
    return logs.with_verdict(t).select("seq", F.col("grounded").alias("own"), logs.grounded(claim).alias("other"))


@query("""SELECT seq, 'Service ' || service || ', second ' || CAST(CAST(ts AS BIGINT) AS VARCHAR) || ': latency ' || CAST(CAST(round_even(latency_ms, 0) AS BIGINT) AS VARCHAR) || ' ms (1.0 times its baseline), error rate ' || printf('%.3f', error_rate) || ', cpu ' || CAST(CAST(round_even(cpu_pct, 0) AS BIGINT) AS VARCHAR)
  || ' % (1.0 times its baseline), memory ' || CAST(CAST(round_even(mem_pct, 0) AS BIGINT) AS VARCHAR) || ' %, ' || CAST(CAST(round_even(rps, 0) AS BIGINT) AS VARCHAR) || ' requests a second, version ' || version || '. Log: ' || log || '. Which one is it: memory_leak, dependency_failure, traffic_spike, bad_deploy or normal? Answer as JSON with incident, evidence and explanation.' AS prompt FROM telemetry""")
def prompts(t):
    none = F.lit(None).cast("double")
    return t.withColumn("latency_over_baseline", none).withColumn("cpu_over_baseline", none).select("seq", logs.prompt().alias("prompt"))


@query(f"""SELECT seq, CASE WHEN seq % 5 < 2 THEN y ELSE 'normal' END AS incident, CASE WHEN seq % 5 < 2 THEN {X.sql_remedy("y", "none")} ELSE 'none' END AS remediation, CASE WHEN seq % 5 < 2 THEN 'e' || seq ELSE '' END AS evidence,
  CASE seq % 5 WHEN 0 THEN 'at ' || version WHEN 1 THEN 'at ' || version WHEN 2 THEN 'x' WHEN 3 THEN 'unparseable reply: {{"incident": "memory_leak", ' ELSE 'unparseable reply: no idea' END AS explanation, seq % 5 > 2 AS failed FROM telemetry""")
def reply_parse(t):
    return logs.parse_reply(X.replies(t)).select("seq", "incident", "remediation", "evidence", "explanation", "failed")


@query("SELECT seq, prediction, CASE WHEN prediction IN ('bad_deploy', 'dependency_failure') THEN incident ELSE prediction END AS resolved FROM verdicts", _VERDICTS)
def resolve(t):
    return X.scores(t).select("seq", "prediction", logs.resolve(t).alias("resolved"))


def _stage_sql(stage: str, column: str) -> str:
    return f"""SELECT '{stage}' AS stage, round(avg(f1), 6) AS macro_f1, round(max(CASE WHEN cls = 'dependency_failure' THEN recall END), 6) AS dependency_recall FROM (
      SELECT cls, recall, coalesce(2 * pr * recall / nullif(pr + recall, 0), 0) AS f1 FROM (SELECT cls, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS recall FROM (
      SELECT cls, sum(a) AS support, sum(b) AS predicted, sum(CASE WHEN hit THEN a ELSE 0 END) AS tp FROM (SELECT y AS cls, 1 AS a, 0 AS b, y = {column} AS hit FROM rv UNION ALL SELECT {column}, 0, 1, false FROM rv) GROUP BY cls)))"""


@query(f"SELECT s.*, (SELECT round(avg(CAST(prediction IN ('bad_deploy', 'dependency_failure') AS INT)), 6) FROM rv) AS read_share FROM ({_stage_sql('before', 'prediction')} UNION ALL {_stage_sql('after', 'resolved')}) s", _VERDICTS + ", rv AS (SELECT y, prediction, CASE WHEN prediction IN ('bad_deploy', 'dependency_failure') THEN incident ELSE prediction END AS resolved FROM verdicts)")
def resolve_report(t):
    s = X.scores(t)
    return metrics.resolution_report(s.withColumn("resolved", logs.resolve(s))).select("stage", *r6("macro_f1", "dependency_recall", "read_share"))


@query("SELECT 'stub' AS reader, seq % 11 = 0 AS failed, count(*) AS calls FROM telemetry WHERE y IN ('bad_deploy', 'dependency_failure') GROUP BY ALL")
def reader_calls(t):
    """An offline stub in place of an external reader, on the escalated rows only: it fails on some."""
    none = F.lit(None).cast("double")
    asked = t.filter(logs.class_of("incident_type").isin(C.ESCALATED_CLASSES)).withColumn("latency_over_baseline", none).withColumn("cpu_over_baseline", none).withColumn("prompt", F.when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(logs.prompt()))
    return logs.reader_counts(logs.read_with(asked, _stub, "stub"))


def _busy_stub(prompt: str) -> str:
    """A reader that some prompts, those of one service, always fail."""
    if "auth-api" in prompt:
        raise TimeoutError(prompt)
    return _stub(prompt)


@query("""SELECT run, CASE WHEN run = 1 THEN count(*) ELSE 0 END AS asked, count(*) + 2 * count(*) FILTER (service = 'auth-api') AS calls, count(*) FILTER (service = 'auth-api') AS failures, count(*) AS verdicts
  FROM telemetry, (VALUES (1), (2)) r(run) WHERE y IN ('bad_deploy', 'dependency_failure') GROUP BY run""")
def reader_store(t):
    """Escalated rows read with replies kept: a first run asks each prompt, failing ones three times; a second asks nothing."""
    spark, none = t.sparkSession, F.lit(None).cast("double")
    store = reading.VerdictStore(spark, shared_folder(spark))
    asked = t.filter(logs.class_of("incident_type").isin(C.ESCALATED_CLASSES)).withColumn("latency_over_baseline", none).withColumn("cpu_over_baseline", none).withColumn("prompt", logs.prompt())
    told = []
    for run in (1, 2):
        n = store.ask(asked, _busy_stub, wait_s=0.001)
        verdicts = store.verdicts(asked, "stub").agg(F.count_if("failed").alias("failures"), F.count("*").alias("verdicts"))
        calls = store.rows().agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
        told.append(storage.stored(verdicts.join(F.broadcast(calls)).select(F.lit(run).alias("run"), F.lit(n).cast("long").alias("asked"), "calls", "failures", "verdicts")))
    return told[0].unionByName(told[1])


def _stub(prompt: str) -> str:
    if prompt is None:
        raise ValueError("nothing asked")
    return '{"incident": "bad_deploy", "evidence": "", "explanation": ""}'


# --- decisions


@query("SELECT seq, y, action, round(outcome, 6) AS outcome, breach FROM experiment", X.TELEMETRY_SQL + X.EXPERIMENT_SQL)
def experiment(t):
    return decision.experiment(t, X.assigned()).select("seq", "y", "action", "breach", *r6("outcome"))


@query("SELECT round(max(n) / min(n), 6) AS balance, count(*) AS actions FROM (SELECT action, CAST(count(*) AS DOUBLE) AS n FROM experiment GROUP BY action)", X.TELEMETRY_SQL + X.EXPERIMENT_SQL)
def assignment_balance(t):
    return decision.assignment_balance(decision.experiment(t, X.assigned())).select("actions", *r6("balance"))


_UPLIFT = X.SCORES_SQL + X.EXPERIMENT_SQL + f""",
arms AS (SELECT y, action, avg(outcome) AS m FROM experiment GROUP BY ALL),
uplift AS (SELECT g.y, g.action, CASE WHEN g.action = 'none' THEN 0 WHEN a.m IS NULL THEN 0 ELSE coalesce(b.m, 0) - a.m END AS effect
  FROM (SELECT DISTINCT y, unnest({X._ACTIONS}) AS action FROM experiment) g LEFT JOIN arms a ON a.y = g.y AND a.action = g.action LEFT JOIN arms b ON b.y = g.y AND b.action = 'none'),
best AS (SELECT y, arg_min(action, 10 * round(-gain, 9) + pos / 1e6) AS action FROM (SELECT y, action, effect - {X.sql_cost("action")} AS gain, list_position({X._ACTIONS}, action) AS pos FROM uplift) GROUP BY y)"""


@query("SELECT y, action, round(effect, 6) AS effect FROM uplift", _UPLIFT)
def uplift(t):
    return decision.uplift(decision.experiment(t, X.assigned())).select("y", "action", *r6("effect"))


@query("SELECT prediction, best.action AS action, count(*) AS n FROM scores JOIN best ON scores.prediction = best.y GROUP BY ALL", _UPLIFT)
def policy_table(t):
    table = decision.uplift(decision.experiment(t, X.assigned()))
    return decision.table_policy(X.scores(t), table).groupBy("prediction", "action").agg(F.count("*").alias("n"))


_BY_EFFECT = X.SCORES_SQL + X.EFFECTS_SQL + f""",
gains AS (SELECT seq, {", ".join(f"round(effect_{a} - {X.sql_cost(repr(a))}, 9) AS g_{a}" for a in C.ACTIONS)} FROM effects),
chosen AS (SELECT seq, CASE greatest(0, {", ".join(f"g_{a}" for a in C.ACTIONS)}) WHEN 0 THEN 'none' {" ".join(f"WHEN g_{a} THEN '{a}'" for a in C.ACTIONS)} END AS action, greatest(0, {", ".join(f"g_{a}" for a in C.ACTIONS)}) AS score FROM gains)"""


def _by_effect(t):
    rows = t.withColumn("y", logs.class_of("incident_type"))
    effects = {a: F.round(c, 9) for a, c in X.effect_columns().items()}
    best = decision.best_action(decision.effects_array(effects))
    return rows.withColumn("action", best["action"]).withColumn("score", F.round(best["gain"], 9))


@query("SELECT seq, action FROM chosen", _BY_EFFECT)
def policy_effects(t):
    return _by_effect(t).select("seq", "action")


_RISK = X.SCORES_SQL + f""",
risky AS (SELECT *, CASE WHEN risk >= (SELECT quantile_cont(risk, 0.9) FROM scores) THEN {X.sql_remedy("prediction", "restart")} ELSE 'none' END AS act FROM scores)"""


@query("SELECT act AS action, count(*) AS n FROM risky GROUP BY act", _RISK)
def risk_policy(t):
    s = X.scores(t)
    return s.select(decision.risk_action(decision.risk_cut(s, 0.9)).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def _gain_sql(action: str) -> str:
    return f"({X.sql_true_effect(action)} * label - {X.sql_cost(action)})"


@query(f"SELECT round(sum({_gain_sql('act')}), 6) AS value, CAST(sum(CAST(act <> 'none' AS INT)) AS BIGINT) AS treated FROM risky", _RISK)
def policy_value(t):
    s = X.scores(t)
    return decision.policy_value(s.withColumn("action", decision.risk_action(decision.risk_cut(s, 0.9)))).select("treated", *r6("value"))


_COMPARE = _UPLIFT + X.EFFECTS_SQL + _BY_EFFECT[len(X.SCORES_SQL + X.EFFECTS_SQL):] + f""",
arm AS (SELECT incident_type, label, scores.seq AS seq, unnest([{{'policy': 'nobody', 'a': 'none'}}, {{'policy': 'every alert', 'a': {X.sql_remedy("prediction", "none")}}},
  {{'policy': 'risk 10%', 'a': CASE WHEN risk >= (SELECT quantile_cont(risk, 0.9) FROM scores) THEN {X.sql_remedy("prediction", "restart")} ELSE 'none' END}},
  {{'policy': 'risk 25%', 'a': CASE WHEN risk >= (SELECT quantile_cont(risk, 0.75) FROM scores) THEN {X.sql_remedy("prediction", "restart")} ELSE 'none' END}},
  {{'policy': 'class table', 'a': best.action}}, {{'policy': 'effects', 'a': chosen.action}}]) AS s FROM scores JOIN best ON best.y = scores.prediction JOIN chosen ON chosen.seq = scores.seq)"""


@query(f"SELECT s.policy AS policy, round(sum({_gain_sql('s.a')}), 6) AS value, CAST(sum(CAST(s.a <> 'none' AS INT)) AS BIGINT) AS treated FROM arm GROUP BY s.policy", _COMPARE)
def policy_compare(t):
    s = X.scores(t)
    top10, top25 = decision.risk_cuts(s, [0.9, 0.75])
    rows = decision.table_policy(s, decision.uplift(decision.experiment(t, X.assigned())))
    effects = {a: F.round(c, 9) for a, c in X.effect_columns().items()}
    policies = {
        "nobody": F.lit("none"), "every alert": logs.remedy(F.col("prediction"), "none"), "risk 10%": decision.risk_action(top10), "risk 25%": decision.risk_action(top25),
        "class table": F.col("action"), "effects": decision.best_action(decision.effects_array(effects))["action"],
    }
    return decision.compare_policies(rows, policies).select("policy", "treated", *r6("value"))


@query(f"""SELECT step, round(step / 20, 6) AS share, CAST(floor(step / 20 * n) AS BIGINT) AS taken, round(coalesce((SELECT sum(gain) FROM ranked r WHERE r.rank < floor(step / 20 * n)), 0), 6) AS gain
  FROM (SELECT CAST(unnest(range(21)) AS INT) AS step), (SELECT count(*) AS n FROM ranked)""",
       _BY_EFFECT + f", ranked AS (SELECT row_number() OVER (ORDER BY score DESC, c.seq) - 1 AS rank, {_gain_sql('action')} AS gain FROM chosen c JOIN telemetry t ON t.seq = c.seq)")
def qini(t):
    return decision.qini(_by_effect(t), "score").select("step", "taken", *r6("share", "gain"))


# --- drift and releases

_PSI = X.TELEMETRY_SQL + """,
ref AS (SELECT latency_ms AS x FROM telemetry WHERE incident_type IS NULL),
edge AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, quantile_cont(x, 0.5) AS med, count(*) AS n FROM ref),
was AS (SELECT b.bin, greatest(count(r.bin) / (SELECT n FROM edge), 0.0001::DOUBLE) AS was FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT len(list_filter(e, lambda v: v <= x)) AS bin FROM ref, edge) r ON r.bin = b.bin GROUP BY b.bin),
live AS (SELECT {0}, latency_ms{1} AS x FROM telemetry),
per AS (SELECT w, count(*) AS n, quantile_cont(x, 0.5) AS med FROM live GROUP BY w),
cur AS (SELECT p.w, p.n, b.bin, greatest(count(l.bin) / p.n, 0.0001::DOUBLE) AS cur FROM per p CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT w, len(list_filter(e, lambda v: v <= x)) AS bin FROM live, edge) l ON l.w = p.w AND l.bin = b.bin GROUP BY p.w, p.n, b.bin),
judged AS (SELECT cur.w, any_value(cur.n) AS n, sum((cur - was) * ln(cur / was)) AS psi FROM cur JOIN was ON cur.bin = was.bin GROUP BY cur.w)"""


@query("SELECT round(psi, 6) AS psi FROM judged", _PSI.replace("{0}", "0 AS w").replace("{1}", " * CAST(1.8 AS DOUBLE)"))
def psi(t):
    return drift.psi(splits.healthy(t), source.shifted(t), "latency_ms").select(*r6("psi"))


_WINDOWS = _PSI.replace("{0}", "seq // 600 AS w").replace("{1}", "") + """,
windows AS (SELECT j.w AS window_id, (j.w + 1) * 600 AS at_event, j.psi AS psi, p.med / greatest(e.med, CAST(1e-9 AS DOUBLE)) AS ratio FROM judged j JOIN per p ON p.w = j.w, edge e WHERE j.n = 600)"""


@query("SELECT window_id, at_event, round(psi, 3) AS psi, round(ratio, 3) AS median_ratio, psi > CAST(0.2 AS DOUBLE) AND abs(ratio - 1) > CAST(0.25 AS DOUBLE) AS alert, CASE WHEN psi > CAST(0.2 AS DOUBLE) AND abs(ratio - 1) > CAST(0.25 AS DOUBLE) THEN 'distribution and median both moved' END AS reason FROM windows", _WINDOWS)
def drift_windows(t):
    return drift.drift_windows(splits.healthy(t), t)


@query("SELECT CAST(sum(CAST(a AS INT)) AS BIGINT) AS alerts, count(*) AS windows, round(avg(CAST(a AS INT)), 6) AS rate FROM (SELECT psi > CAST(0.2 AS DOUBLE) AND abs(ratio - 1) > CAST(0.25 AS DOUBLE) AS a FROM windows)", _WINDOWS.replace("latency_ms AS x FROM telemetry)", "latency_ms * CAST(1.8 AS DOUBLE) AS x FROM telemetry)", 1))
def drift_rate(t):
    return drift.alert_rate(drift.drift_windows(splits.healthy(t), source.shifted(t))).select("alerts", "windows", *r6("rate"))


@query("SELECT count(*) AS n, round(avg(CAST(prediction <> prediction_b AS INT)), 6) AS disagreement FROM scores", X.SCORES_SQL)
def shadow(t):
    return drift.shadow(X.scores(t)).select("n", *r6("disagreement"))


def _canary_macro(column: str) -> str:
    return f"""(SELECT avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)) FROM (SELECT coalesce(tp / nullif(b, 0), 0) AS pr, coalesce(tp / nullif(a, 0), 0) AS rc FROM (
      SELECT cls, sum(a) AS a, sum(b) AS b, sum(CASE WHEN hit THEN a ELSE 0 END) AS tp FROM (SELECT y AS cls, 1 AS a, 0 AS b, y = {column} AS hit FROM pick UNION ALL SELECT {column}, 0, 1, false FROM pick) GROUP BY cls)))"""


@query("""SELECT n >= 200 AND cand >= base - CAST(0.02 AS DOUBLE) AS promote, CASE WHEN n < 200 THEN 'only ' || n || ' events, need 200' WHEN cand < base - CAST(0.02 AS DOUBLE) THEN 'regression: ' || printf('%.3f', cand) || ' vs ' || printf('%.3f', base) ELSE 'no regression: ' || printf('%.3f', cand) || ' vs ' || printf('%.3f', base) END AS reason,
  round(base, 6) AS base, round(cand, 6) AS cand, n FROM c""", X.SCORES_SQL + f", pick AS (SELECT * FROM scores WHERE (seq * 7919) % 10 = 0), c AS (SELECT {_canary_macro('prediction')} AS base, {_canary_macro('prediction_b')} AS cand, (SELECT count(*) FROM pick) AS n)")
def canary(t):
    return drift.canary(X.scores(t).filter("(seq * 7919) % 10 = 0")).select("promote", "reason", "n", *r6("base", "cand"))


@query("SELECT 'm' || (SELECT max(seq) FROM telemetry WHERE seq % 400 = 0) AS previous, 'm' || ((SELECT max(seq) FROM telemetry WHERE seq % 400 = 0) - 400) AS live")
def release_log(t):
    """Every 400th event releases a model; at last the newest is rolled back."""
    steps = t.filter("seq % 400 = 0").select(F.col("seq").alias("n"), F.lit("promote").alias("action"), F.concat(F.lit("m"), F.col("seq").cast("string")).alias("model"))
    back = t.agg((F.max("seq") + 1).alias("n")).select("n", F.lit("rollback").alias("action"), F.lit(None).cast("string").alias("model"))
    return drift.releases(steps.unionByName(back))


# --- delivery

_LEDGER = X.TELEMETRY_SQL + X.LEDGER_SQL


@query("SELECT 'scoring' AS grp, (SELECT count(*) FROM telemetry) AS appended, max(seq) + 1 AS consumed_next, (SELECT count(*) FROM telemetry) - (max(seq) + 1) AS backlog, (SELECT count(*) FROM flying) AS pending FROM claims", _LEDGER)
def lag(t):
    return delivery.lag(t, X.claims(t), X.acks(t))


@query("SELECT f.seq AS seq, f.deliveries + 1 AS deliveries, f.claimed_at AS claimed_at, t.service AS service FROM (SELECT * FROM flying WHERE 60 - claimed_at >= 30 ORDER BY seq LIMIT 100) f JOIN telemetry t ON t.seq = f.seq", _LEDGER)
def stale_pending(t):
    return delivery.redeliver(t, X.claims(t), X.acks(t), 60.0, 30.0, 100).select("seq", "deliveries", "claimed_at", "service")


@query("SELECT DISTINCT seq FROM claims c WHERE NOT EXISTS (SELECT 1 FROM acks a WHERE a.seq = c.seq)", _LEDGER)
def dedup(t):
    return delivery.not_seen(X.claims(t), X.acks(t)).select("seq")


@query("SELECT p AS processed, d AS distinct_offsets, p - d AS duplicates, (SELECT count(*) FROM telemetry WHERE seq % 21 = 0) AS lost FROM (SELECT count(*) AS p, count(DISTINCT seq) AS d FROM claims WHERE seq % 21 <> 0)", _LEDGER)
def recovery_audit(t):
    return delivery.recovery_audit(t, X.claims(t).filter("seq % 21 <> 0"))


@query("SELECT DISTINCT seq FROM claims WHERE seq % 2 = 0 OR seq % 3 = 0 OR seq % 50 = 0", _LEDGER)
def consumer_union(t):
    """Offsets that some consumer of a group has processed."""
    rows = X.claims(t)
    return delivery.union_processed([rows.filter("seq % 2 = 0"), rows.filter("seq % 3 = 0"), rows.filter("seq % 50 = 0")])


# --- feed and spend

_FEED = _VERDICTS + """,
calib AS (SELECT 1 - p_true AS s, row_number() OVER (ORDER BY 1 - p_true) - 1 AS i, count(*) OVER () AS n FROM scores WHERE seq % 4 = 0),
q AS (SELECT s AS qhat FROM calib WHERE i = least(CAST(ceil((n + 1) * (1 - CAST(0.05 AS DOUBLE))) AS BIGINT), n - 1)),
feed AS (SELECT *, list_filter(""" + X._CLASSES + """, lambda c, i: p[i] >= 1 - qhat) AS st FROM verdicts, q)"""
_ESC = "(len(st) <> 1 OR prediction IN ('dependency_failure', 'bad_deploy'))"


@query(f"""SELECT seq, ts, service, CAST(round(CAST(latency_ms AS DECIMAL(20, 10)), 1) AS DOUBLE) AS latency_ms, CAST(round(CAST(error_rate AS DECIMAL(20, 10)), 4) AS DOUBLE) AS error_rate, y AS truth, label = 1 AS breach, prediction AS predicted, array_to_string(st, ',') AS "set", CASE WHEN len(st) <> 1 THEN 'escalate' ELSE 'act' END AS action,
  CASE WHEN {_ESC} THEN incident END AS resolved, CASE WHEN {_ESC} THEN evidence END AS evidence, CASE WHEN {_ESC} THEN explanation END AS explanation, CASE WHEN {_ESC} THEN remediation END AS remediation FROM feed ORDER BY seq DESC LIMIT 400""", _FEED)
def decision_feed(t):
    """What was decided about the last 400 events."""
    last = logs.with_verdict(_with_sets(t).orderBy(F.desc("seq")).limit(400))
    escalated = (F.size("set") != 1) | F.col("prediction").isin(C.ESCALATED_CLASSES)
    return last.select(
        "seq", "ts", "service", F.round(F.col("latency_ms").cast("decimal(20,10)"), 1).cast("double").alias("latency_ms"), F.round(F.col("error_rate").cast("decimal(20,10)"), 4).cast("double").alias("error_rate"), F.col("y").alias("truth"), (F.col("label") == 1).alias("breach"), F.col("prediction").alias("predicted"),
        F.array_join("set", ",").alias("set"), conformal.action().alias("action"), *(F.when(escalated, F.col(a)).alias(b) for a, b in (("incident", "resolved"), ("evidence", "evidence"), ("explanation", "explanation"), ("remediation", "remediation"))),
    ).orderBy("seq")


@query(f"SELECT action, n, round(n * {X.sql_cost('action')}, 6) AS spend FROM (SELECT action, count(*) AS n FROM chosen GROUP BY action)", _BY_EFFECT)
def action_spend(t):
    return metrics.action_spend(_by_effect(t)).select("action", "n", *r6("spend"))


# --- models and streams; no SQL says the same of models


@query()
def classifier(t):
    """A forest trained on the first 70 % of the time, and its report on the rest."""
    train, test = splits.temporal_split(storage.stored(splits.build_dataset(t)))
    return metrics.class_report(models.classify(models.train_classifier(train), test))


@query()
def boosted_classifier(t):
    """Boosted trees trained on the same rows as the forest, and their report."""
    train, test = splits.temporal_split(storage.stored(splits.build_dataset(t)))
    return metrics.class_report(models.classify(boosting.train(train), test))


@query(
    f"SELECT y, count(*) AS n, count(*) AS whole, count(*) AS known, {len(C.CLASSES)} AS classes FROM kept WHERE ts >= (SELECT quantile_cont(ts, 0.7) FROM kept) GROUP BY y",
    _KEPT,
)
def boosted_totals(t):
    """Of the later rows of each class: how many get probabilities that sum to 1, and a class that the trees know; the trees are saved and loaded before."""
    train, test = splits.temporal_split(storage.stored(splits.build_dataset(t)))
    spark, folder = t.sparkSession, shared_folder(t.sparkSession)
    boosting.save(spark, boosting.train(train, rounds=8), folder)
    model = boosting.load(spark, folder)
    whole = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    return models.classify(model, test).groupBy("y").agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.count_if(F.col("prediction").isin(model.classes)).alias("known")).withColumn("classes", F.lit(len(model.classes)))


@query()
def importances(t):
    train, _ = splits.temporal_split(storage.stored(splits.build_dataset(t)))
    return models.importances(models.train_classifier(train), train)


@query()
def iforest_flags(t):
    return metrics.detection_rate(models.detect(splits.build_dataset(t), F.col("y") == C.NORMAL))


@query()
def tlearner_effects(t):
    rows = storage.stored(splits.build_dataset(t))
    logged = decision.experiment(t).select("seq", "action", "outcome")
    learned = models.effects(models.fit_outcomes(rows.join(logged, "seq")), rows)
    return learned.select("seq", decision.best_action(F.col("effects"))["action"].alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful stream over the events table, run to its end."""
    live.rocks(spark)
    return live.replayed(X.telemetry(spark, sf_dir), shared_folder(spark), live.features).select("seq", "ts", "service", *r6(*C.FEATURES))


def _logged(spark: SparkSession, rows: DataFrame, log: str, **options) -> DataFrame:
    """Appends rows to a log of files and returns the log as a stream."""
    rows.write.mode("append").parquet(log)
    return spark.readStream.schema(rows.schema).options(**options).parquet(log)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which a third of the offsets is delivered twice: what is left, and how many repeats there were."""
    live.rocks(spark)
    twice = lambda rows: rows.union(rows.filter("seq % 3 = 0"))
    unique, progress = live.run_with_progress(live.deduplicated(twice(_stream(spark, sf_dir))))
    return live.deduplicated_counts(twice(X.telemetry(spark, sf_dir)), unique, progress).select("delivered", "processed", "duplicates")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row comes after the others, a restart between: features of those that are not too late, and how many are dropped."""
    live.rocks(spark)
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    for rows in (t.filter("seq % 10 <> 0"), t.filter("seq % 10 = 0")):
        written = live.replayed(rows, folder, lambda log: live.features(log, late_s=600.0))
    late = ledger.totals(ledger.lines(spark, live.ledger_of(f"{folder}/checkpoint"))).select(F.col("late").alias("dropped_late"))
    return written.agg(F.count("*").alias("processed")).join(F.broadcast(late))


def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each delivery: a first run without every tenth row and with some rows twice, then every third row, some of them too late."""
    live.rocks(spark)
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    first = t.filter("seq % 10 <> 0")
    for rows in (first.union(first.filter("seq % 7 = 0")), t.filter("seq % 3 = 0")):
        stream = live.deliveries(_logged(spark, rows, f"{folder}/log"), late_s=600.0)
        told = live.run_to_end(stream, f"{folder}/checkpoint", f"{folder}/rows")
    return live.fates(told)


#: Files of the log that ``stream_ledger`` reads one by one: more than a query remembers reports.
_FILES = 110


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a stream that reads a file at a time and is restarted midway: micro-batches, and rows in all and in the smallest and largest of them."""
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    parts = t.withColumn("part", F.pmod("seq", F.lit(_FILES)))
    for rows in (parts.filter(F.col("part") < _FILES // 2), parts.filter(F.col("part") >= _FILES // 2)):
        rows.repartition("part").write.mode("append").partitionBy("part").parquet(f"{folder}/log")
        log = spark.readStream.schema(t.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
        live.run_to_end(log.select("seq", "latency_ms"), f"{folder}/checkpoint", f"{folder}/rows")
    told = ledger.lines(spark, live.ledger_of(f"{folder}/checkpoint"))
    sizes = told.agg(F.min("rows").alias("smallest"), F.max("rows").alias("largest"))
    return ledger.totals(told).select("batches", "rows", "late").join(F.broadcast(sizes))


def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift monitor over the stream, block by block."""
    return live.monitor(_stream(spark, sf_dir), splits.healthy(X.telemetry(spark, sf_dir)), shared_folder(spark))


def stream_drift_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift monitor over a stream that lacks every eleventh row and is restarted midway: blocks are of the rows that arrive."""
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    middle = t.agg((F.max("seq") / 2).alias("middle"))
    rows = t.filter("seq % 11 <> 0").join(F.broadcast(middle))
    for part in (rows.filter("seq < middle"), rows.filter("seq >= middle")):
        judged = live.monitor(_logged(spark, part.drop("middle"), f"{folder}/log"), splits.healthy(t), f"{folder}/drift")
    return judged


def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of a run's micro-batches, and rows a second."""
    return live.run_profile(live.run_with_progress(_stream(spark, sf_dir).select("seq", "latency_ms"))[1])


def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models trained on the first 60 % of the time; the rest is a stream of features, on which decisions, the detector and
    the drift monitor are streaming queries of their own."""
    live.rocks(spark)
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    cut = splits.time_cuts(t, [0.6])[0]
    fitted = models.fit_all(t.filter(F.col("ts") < cut))
    rows = live.replayed(t.filter(F.col("ts") >= cut), folder, live.features)
    again = lambda: spark.readStream.schema(rows.schema).parquet(f"{folder}/features")
    decided = live.run_to_end(live.decisions(again(), fitted)).groupBy("resolved", "remediation", "escalated").agg(F.count("*").alias("n"), F.sum(decision.gain(F.col("remediation"))).alias("value"))
    strange = live.run_to_end(live.anomalies(again(), fitted)).groupBy(logs.class_of("incident_type").alias("resolved")).agg(F.sum(F.col("flag").cast("long")).alias("n"))
    alerts = live.monitor(again(), fitted.reference, f"{folder}/drift").agg(F.coalesce(F.sum(F.col("alert").cast("long")), F.lit(0)).alias("n"))
    kinds = {"decision": decided, "anomaly": strange, "drift": alerts}
    parts = [x.withColumn("kind", F.lit(k)) for k, x in kinds.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a log in which some come twice, deduplicated by a query that is killed after each step of the sink once: what is lost or there twice in the end.

    The log grows in order of time, a micro-batch by each append, so a watermark of an hour leaves no row too late however long the log is.
    """
    live.rocks(spark)
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    appends = [str(k) for k in range(len(STEPS) + 1)]
    cuts = splits.time_cuts(t, [(k + 1) / len(appends) for k in range(len(STEPS))])
    parts = t.union(t.filter("seq % 5 = 0")).withColumn("part", splits.part(cuts, appends))
    deaths = {(step, number + 1) for number, step in enumerate(STEPS)}

    def die(step: str, batch: int) -> None:
        if (step, batch) in deaths:
            deaths.remove((step, batch))
            raise RuntimeError(f"killed after {step} of batch {batch}")

    with Subscribers(spark, folder) as running:
        for k in appends:  # stopped while the log grows, so that it sees an append whole
            log = _logged(spark, parts.filter(F.col("part") == k).drop("part"), f"{folder}/log")
            if k == appends[0]:
                running.add("sink", lambda: live.deduplicated(log).select("seq"), die)
            else:
                running.start("sink")
            running.catch_up()
            running.stop("sink")
        restarts, rows = running.groups["sink"].restarts, running.rows("sink")
    return delivery.recovery_audit(t, rows).withColumn("restarts", F.lit(restarts).cast("long"))


def stream_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups on one log at the same time: one is stopped while the log grows, lags, and catches up."""
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    read = lambda: _logged(spark, t.limit(0), f"{folder}/log").select("seq")
    log, told = lambda: spark.read.schema(t.schema).parquet(f"{folder}/log"), []
    t.filter("seq % 3 <> 0").write.mode("append").parquet(f"{folder}/log")
    with Subscribers(spark, f"{folder}/groups") as running:
        for name in ("audit", "drift", "scoring"):
            running.add(name, read)
        running.catch_up()
        running.stop("drift")
        t.filter("seq % 3 = 0").write.mode("append").parquet(f"{folder}/log")
        running.catch_up()
        told.append(storage.stored(running.lag(log()).withColumn("stage", F.lit("stopped"))))
        running.start("drift")
        running.catch_up()
        told.append(storage.stored(running.lag(log()).withColumn("stage", F.lit("caught up"))))
        seen = {name: running.rows(name).agg(F.count_distinct("seq").alias("seen")).withColumn("grp", F.lit(name)) for name in running.groups}
    return told[0].unionByName(told[1]).join(reduce(DataFrame.unionByName, seen.values()), "grp")


def stream_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saved versions; a stream is decided on by the one that is live: the first, then the second after its promotion, then the first after a rollback, with a restart before each."""
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    store = lambda: registry.Registry(spark, f"{folder}/registry")
    fitted = models.fit_all(t, trees=10, forest_trees=20)
    store().save(fitted, "v1")
    store().save(replace(fitted, classifier=models.train_classifier(splits.build_dataset(t), trees=20, seed=1)), "v2")
    rows = storage.stored(features.features(t, keep=live.CARRIED))
    acts = (lambda: store().promote("v1"), lambda: store().promote("v2"), lambda: store().rollback())
    for k, act in enumerate(acts):
        act()
        decided = live.serve_decisions(_logged(spark, rows.filter(F.col("seq") % 3 == k), f"{folder}/features"), store(), folder)
    known = F.count_if(F.col("resolved").isin(C.CLASSES)).alias("known")
    return decided.groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("decided"), known)


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and anomalies of a stream of features, row by row against the batch operators on the same events with the same models."""
    live.rocks(spark)
    t, folder = X.telemetry(spark, sf_dir), shared_folder(spark)
    fitted = models.fit_all(t, trees=10, forest_trees=20)
    rows = live.replayed(t, folder, live.features)
    again = lambda: spark.readStream.schema(rows.schema).parquet(f"{folder}/features")
    batch = storage.stored(features.features(t, keep=live.CARRIED))
    pairs = {
        "decision": (live.run_to_end(live.decisions(again(), fitted)), live.decide(live.score(batch, fitted), fitted), ("prediction", "action", "reason", "escalated", "resolved", "remediation")),
        "anomaly": (live.run_to_end(live.anomalies(again(), fitted)), models.strangeness(fitted.forest, batch), ("flag",)),
    }
    out = []
    for kind, (streamed, whole, columns) in pairs.items():
        both = streamed.select("seq", F.struct(*columns).alias("a")).join(whole.select("seq", F.struct(*columns).alias("b")), "seq", "full")
        out.append(both.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ")).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


def importance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features have an importance, and the sum of importances."""
    return QUERIES["importances"](spark, sf_dir).agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return source.telemetry(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir))


def snapshot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run as one nested row, and of each of its sections the rows and the sum of a figure."""
    t = X.telemetry(spark, sf_dir)
    run = lambda name: QUERIES[name](spark, sf_dir)
    rates = drift.alert_rate(drift.drift_windows(splits.healthy(t), t)).withColumn("stream", F.lit("clean")).unionByName(run("drift_rate").withColumn("stream", F.lit("shifted")))
    sections = {
        "sizes": (run("distinct_counts"), "services"), "classifier": (run("class_report"), "f1"), "reasoning": (run("resolve_report"), "macro_f1"), "policies": (run("policy_compare"), "value"),
        "drift": (rates, "windows"), "pipeline": (run("action_spend"), "spend"), "feed": (run("decision_feed"), "seq"),
    }
    whole = source.snapshot({name: report for name, (report, _) in sections.items()})
    total = lambda name, figure: F.aggregate(name, F.lit(0.0), lambda a, r: a + r[figure].cast("double"))
    listed = F.array(*(F.struct(F.lit(n).alias("section"), F.size(n).alias("rows"), F.round(total(n, f), 6).alias("total")) for n, (_, f) in sections.items()))
    return whole.select(F.explode(listed).alias("s")).select("s.*")


QUERIES |= {x.__name__: x for x in (stream_features, stream_dedup, stream_late, stream_deliveries, stream_ledger, stream_drift, stream_drift_gaps, stream_profile, stream_pipeline, stream_exactly_once, stream_groups, stream_registry, stream_equals_batch, importance_totals, snapshot_report)}
ORACLES |= {
    "stream_features": ORACLES["features_full"],
    "stream_drift": ORACLES["drift_windows"],
    "stream_dedup": f"WITH {X.TELEMETRY_SQL} SELECT count(*) + count(*) FILTER (seq % 3 = 0) AS delivered, count(*) AS processed, count(*) FILTER (seq % 3 = 0) AS duplicates FROM telemetry",
    "stream_late": f"""WITH {X.TELEMETRY_SQL}, late AS (SELECT count(*) AS n FROM telemetry WHERE seq % 10 = 0 AND ts <= (SELECT max(ts) FROM telemetry WHERE seq % 10 <> 0) - 600)
      SELECT (SELECT count(*) FROM telemetry) - n AS processed, n AS dropped_late FROM late""",
    "stream_deliveries": f"""WITH {X.TELEMETRY_SQL}, told AS (SELECT 'new' AS fate FROM telemetry WHERE seq % 10 <> 0 UNION ALL SELECT 'repeat' FROM telemetry WHERE seq % 10 <> 0 AND seq % 7 = 0
      UNION ALL SELECT CASE WHEN ts <= (SELECT max(ts) FROM telemetry WHERE seq % 10 <> 0) - 600 THEN 'late' WHEN seq % 10 <> 0 THEN 'repeat' ELSE 'new' END FROM telemetry WHERE seq % 3 = 0)
      SELECT count(*) AS delivered, count(*) FILTER (fate = 'new') AS processed, count(*) FILTER (fate = 'repeat') AS repeats, count(*) FILTER (fate = 'late') AS late FROM told""",
    "stream_ledger": f"WITH {X.TELEMETRY_SQL}, files AS (SELECT count(*) AS n FROM telemetry GROUP BY seq % {_FILES}) SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS late, min(n) AS smallest, max(n) AS largest FROM files",
    "stream_drift_gaps": ORACLES["drift_windows"].replace("SELECT seq // 600 AS w, latency_ms AS x FROM telemetry", "SELECT (row_number() OVER (ORDER BY seq) - 1) // 600 AS w, latency_ms AS x FROM telemetry WHERE seq % 11 <> 0"),
    "stream_exactly_once": f"WITH {X.TELEMETRY_SQL} SELECT count(*) AS processed, count(DISTINCT seq) AS distinct_offsets, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS lost, CAST({len(STEPS)} AS BIGINT) AS restarts FROM telemetry",
    "stream_groups": f"""WITH {X.TELEMETRY_SQL}, n AS (SELECT count(*) AS every, count(*) FILTER (seq % 3 = 0) AS later FROM telemetry)
      SELECT grp, stage, every AS appended, every - CASE WHEN stage = 'stopped' AND grp = 'drift' THEN later ELSE 0 END AS processed, CASE WHEN stage = 'stopped' AND grp = 'drift' THEN later ELSE 0 END AS backlog, every AS seen
      FROM n, (VALUES ('audit'), ('drift'), ('scoring')) g(grp), (VALUES ('stopped'), ('caught up')) s(stage)""",
    "stream_registry": f"WITH {X.TELEMETRY_SQL} SELECT CASE WHEN seq % 3 = 1 THEN 'v2' ELSE 'v1' END AS version, count(*) AS n, count(DISTINCT seq) AS decided, count(*) AS known FROM telemetry GROUP BY ALL",
    "stream_equals_batch": f"WITH {X.TELEMETRY_SQL} SELECT kind, count(*) AS n, CAST(0 AS BIGINT) AS differ FROM telemetry, (VALUES ('decision'), ('anomaly')) k(kind) GROUP BY kind",
    "importance_totals": f"SELECT CAST({len(C.FEATURES)} AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS negative",
    "snapshot_report": " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST(count(*) AS INT) AS rows, round(CAST(sum({figure}) AS DOUBLE), 6) AS total FROM ({ORACLES[name]})"
        for section, name, figure in (("sizes", "distinct_counts", "services"), ("classifier", "class_report", "f1"), ("reasoning", "resolve_report", "macro_f1"), ("policies", "policy_compare", "value"), ("pipeline", "action_spend", "spend"), ("feed", "decision_feed", "seq"))
    ) + f" UNION ALL SELECT 'drift', 2, CAST(2 * windows AS DOUBLE) FROM ({ORACLES['drift_rate']})",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class: rows, breaches, and the mean latency over the service's own baseline."""
    t = X.telemetry(spark, sf_dir)
    rows = features.features(t).join(t.select("seq", "label", logs.class_of("incident_type").alias("y")), "seq")
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("label").alias("breaching"), F.round(F.avg("latency_over_baseline"), 6).alias("latency_ratio"))

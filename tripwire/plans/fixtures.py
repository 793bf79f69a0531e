"""Views over the events table that the registered queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions import conformal
from tripwire.functions import constants as C
from tripwire.functions.logs import class_of, remedy
from tripwire.sources import telemetry as source

#: Multipliers of the deterministic scores, by class, and of the effects, by action.
SCORE_STEPS = dict(zip(C.CLASSES, (7, 11, 13, 17, 19), strict=True))
EFFECT_STEPS = {"restart": 3, "failover": 7, "scale_out": 13, "rollback": 17}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.telemetry(spark.read.parquet(f"{sf_dir}/events.parquet"))


def scores(events: DataFrame) -> DataFrame:
    """Telemetry with y, p, prediction, risk, prediction_b (a candidate model) and flag (a detector)."""
    seq = F.col("seq")
    seen = F.when((F.col("y") == "dependency_failure") & (seq % 2 == 0), "bad_deploy").otherwise(F.col("y"))
    boost = F.when(seq % 10 < 7, 4000).otherwise(240)
    weights = [((seq * m) % 97 + 1 + F.when(F.col("seen") == c, boost).otherwise(0)).cast("double") for c, m in SCORE_STEPS.items()]
    rows = events.withColumn("y", class_of("incident_type")).withColumn("seen", seen).withColumn("w", F.array(*weights))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("p", F.transform("w", lambda x: x / total)).drop("w", "seen").withColumn("prediction", conformal.argmax_class())
    risk = 1 - conformal.p_of(F.lit(C.NORMAL))
    candidate = F.when(seq % 13 == 0, C.NORMAL).otherwise(F.col("prediction"))
    return rows.withColumn("risk", risk).withColumn("prediction_b", candidate).withColumn("flag", (F.col("latency_ms") > 300) | (F.col("cpu_pct") > 68))


def assigned() -> Column:
    return ((F.col("seq") * 7919 + 13) % 10007) % 5


def effect_columns() -> dict[str, Column]:
    out = {"none": F.lit(0.0)}
    for action, m in EFFECT_STEPS.items():
        right = F.when(remedy(F.col("y"), "none") == action, C.RIGHT_EFFECT).otherwise(C.WRONG_EFFECT)
        out[action] = right * F.col("label") + ((F.col("seq") * m) % 11 - 5) / 100
    return out


def claims(events: DataFrame) -> DataFrame:
    first = events.select(F.lit("scoring").alias("grp"), "seq", F.lit("c1").alias("consumer"), (F.col("seq") / 100).alias("at"))
    again = first.filter("seq % 50 = 0").withColumn("consumer", F.lit("c2")).withColumn("at", F.col("seq") / 100 + 10)
    return first.unionByName(again)


def acks(events: DataFrame) -> DataFrame:
    return events.filter("seq % 7 <> 0").select(F.lit("scoring").alias("grp"), "seq", (F.col("seq") / 100).alias("at"))


def replies(events: DataFrame) -> DataFrame:
    seq = F.col("seq")
    body = F.concat(F.lit('{"incident": "'), class_of("incident_type"), F.lit('", "evidence": "e'), seq.cast("string"), F.lit('", "explanation": "at '), F.col("version"), F.lit('"}'))
    text = (
        F.when(seq % 5 == 0, body).when(seq % 5 == 1, F.concat(F.lit("I think: "), body, F.lit(" - that is all")))
        .when(seq % 5 == 2, F.lit('{"incident": "gremlins", "explanation": "x"}')).when(seq % 5 == 3, F.lit('{"incident": "memory_leak", ')).otherwise(F.lit("no idea"))
    )
    return events.withColumn("reply", text)


_ACTIONS = "['" + "', '".join(C.ACTIONS) + "']"
_CLASSES = "['" + "', '".join(C.CLASSES) + "']"
_REMEDY = "CASE {0} WHEN 'memory_leak' THEN 'restart' WHEN 'dependency_failure' THEN 'failover' WHEN 'traffic_spike' THEN 'scale_out' WHEN 'bad_deploy' THEN 'rollback' ELSE '{1}' END"
_COST = "CASE {0} WHEN 'none' THEN 0.0::DOUBLE WHEN 'restart' THEN 0.30::DOUBLE WHEN 'failover' THEN 0.35::DOUBLE WHEN 'scale_out' THEN 0.25::DOUBLE WHEN 'rollback' THEN 0.40::DOUBLE END"
_EFFECT = "CASE WHEN {1} = 'none' THEN 0.0::DOUBLE WHEN incident_type IS NOT NULL AND {2} = {1} THEN 0.75::DOUBLE ELSE -0.10::DOUBLE END"


def sql_remedy(incident: str, otherwise: str) -> str:
    return "(" + _REMEDY.format(incident, otherwise) + ")"


def sql_cost(action: str) -> str:
    return "(" + _COST.format(action) + ")"


def sql_true_effect(action: str) -> str:
    return "(" + _EFFECT.format("", action, sql_remedy("incident_type", "none")) + ")"


TELEMETRY_SQL = """
k0 AS (SELECT event_id, value, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
k1 AS (SELECT *, event_id AS seq, CASE WHEN event_type = 'error' AND k >= 45 THEN 'dependency_failure' WHEN event_type = 'purchase' AND value > 100 THEN 'traffic_spike'
  WHEN event_type = 'signup' AND value > 100 THEN 'memory_leak' WHEN event_type = 'click' AND value > 100 THEN 'bad_deploy' END AS incident_type,
  'v1.' || CAST((event_id + 97 * (event_id % 6)) // 720 AS VARCHAR) || '.0' AS version FROM k0),
k2 AS (SELECT seq, CAST(event_id // 6 AS DOUBLE) AS ts, ['checkout-api', 'payments-worker', 'search-api', 'auth-api', 'cart-api', 'recommend-api'][event_id % 6 + 1] AS service, version,
  40 + 4 * value AS latency_ms, CASE WHEN event_type = 'error' THEN CAST(k AS DOUBLE) / 1000 ELSE CAST(k AS DOUBLE) / 20000 END AS error_rate,
  20 + CAST(k AS DOUBLE) / 2 AS cpu_pct, 30 + CAST(event_id % 1800 AS DOUBLE) / 60 AS mem_pct, 50 + value AS rps,
  CASE WHEN incident_type = 'memory_leak' THEN 'collector at work: GC pause of ' || k || '0 ms; ' || k || ' regions kept'
    WHEN incident_type = 'dependency_failure' AND seq % 2 = 0 THEN 'call to upstream stock-db 503; giving up on order ' || seq
    WHEN incident_type = 'dependency_failure' THEN 'no free handle, connection pool exhausted; ' || k || ' callers queued'
    WHEN incident_type = 'traffic_spike' THEN 'queue depth ' || k || ' and rising; oldest entry ' || (2 * k) || ' ms'
    WHEN incident_type = 'bad_deploy' THEN 'Exception in Basket.total under ' || version || '; order ' || seq || ' dropped'
    ELSE 'served /items in ' || k || ' ms' END AS log, incident_type FROM k1),
telemetry AS (SELECT *, CAST(latency_ms > 500 OR error_rate > CAST(0.05 AS DOUBLE) AS INT) AS label, coalesce(nullif(incident_type, ''), 'normal') AS y FROM k2)"""

SCORES_SQL = TELEMETRY_SQL + f""",
s0 AS (SELECT *, CASE WHEN y = 'dependency_failure' AND seq % 2 = 0 THEN 'bad_deploy' ELSE y END AS seen, CASE WHEN seq % 10 < 7 THEN 4000 ELSE 240 END AS boost FROM telemetry),
s1 AS (SELECT *, {", ".join(f"CAST((seq * {m}) % 97 + 1 + CASE WHEN seen = '{c}' THEN boost ELSE 0 END AS DOUBLE) AS w_{c}" for c, m in SCORE_STEPS.items())} FROM s0),
s2 AS (SELECT *, {" + ".join(f"w_{c}" for c in C.CLASSES)} AS w_all FROM s1),
s3 AS (SELECT * EXCLUDE (w_all), {", ".join(f"w_{c} / w_all AS p_{c}" for c in C.CLASSES)} FROM s2),
s4 AS (SELECT *, [{", ".join(f"p_{c}" for c in C.CLASSES)}] AS p FROM s3),
scores AS (SELECT *, {_CLASSES}[list_position(p, list_max(p))] AS prediction, 1 - p_normal AS risk, p[list_position({_CLASSES}, y)] AS p_true,
  CASE WHEN seq % 13 = 0 THEN 'normal' ELSE {_CLASSES}[list_position(p, list_max(p))] END AS prediction_b, latency_ms > 300 OR cpu_pct > 68 AS flag FROM s4)"""

EXPERIMENT_SQL = f""",
e0 AS (SELECT *, {_ACTIONS}[((seq * 7919 + 13) % 10007) % 5 + 1] AS action FROM telemetry),
experiment AS (SELECT seq, y, action, label - {sql_true_effect("action")} * label AS outcome, CAST(label AS DOUBLE) AS breach FROM e0)"""

EFFECTS_SQL = f""",
effects AS (SELECT seq, y, incident_type, label, 0.0::DOUBLE AS effect_none, {", ".join(f"(CASE WHEN {sql_remedy('y', 'none')} = '{a}' THEN 0.75::DOUBLE ELSE -0.10::DOUBLE END) * label + CAST((seq * {m}) % 11 - 5 AS DOUBLE) / 100 AS effect_{a}" for a, m in EFFECT_STEPS.items())} FROM telemetry)"""

LEDGER_SQL = """,
claims AS (SELECT 'scoring' AS grp, seq, seq / 100 AS claimed FROM telemetry UNION ALL SELECT 'scoring', seq, seq / 100 + 10 FROM telemetry WHERE seq % 50 = 0),
acks AS (SELECT 'scoring' AS grp, seq FROM telemetry WHERE seq % 7 <> 0),
flying AS (SELECT grp, seq, count(*) AS deliveries, max(claimed) AS claimed_at FROM claims c WHERE NOT EXISTS (SELECT 1 FROM acks a WHERE a.grp = c.grp AND a.seq = c.seq) GROUP BY ALL)"""

"""Telemetry sources and sinks: JSON lines, offsets, the view over the events table, the report snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.operators.ranks import with_rank
from tripwire.sources.storage import Scratch


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line; blank lines are skipped."""
    return spark.read.schema(C.TELEMETRY).json(path)


def stream_jsonl(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(C.TELEMETRY)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_jsonl(events: DataFrame, path: str, mode: str = "append") -> None:
    """Compact JSON lines; a missing value stays in its line as null."""
    events.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append(events: DataFrame, path: str, first: int = 0, order: tuple[str, ...] = ("ts", "service")) -> DataFrame:
    """Appends the events to the log with dense offsets from ``first`` in ``order``; returns them with ``seq``."""
    spark, schema = events.sparkSession, events.drop("seq").schema.add("seq", "long")
    with Scratch(spark) as tmp:
        write_jsonl(with_rank(events.drop("seq"), *order, name="seq", tmp=tmp).withColumn("seq", F.col("seq") + first), path)
    return spark.read.schema(schema).json(path).filter(F.col("seq") >= first)


def telemetry(events: DataFrame) -> DataFrame:
    """The events table seen as telemetry of six services, one row of each per tick."""
    n, value, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    services = F.array(*map(F.lit, C.SERVICES))
    version = F.concat(F.lit("v1."), F.floor((n + 97 * (n % 6)) / 720).cast("string"), F.lit(".0"))
    incident = (
        F.when((kind == "error") & (k >= 45), "dependency_failure")
        .when((kind == "purchase") & (value > 100), "traffic_spike")
        .when((kind == "signup") & (value > 100), "memory_leak")
        .when((kind == "click") & (value > 100), "bad_deploy")
    )
    base = events.select(
        n.alias("seq"), F.floor(n / 6).cast("double").alias("ts"), F.element_at(services, (n % 6 + 1).cast("int")).alias("service"), version.alias("version"),
        (40 + 4 * value).alias("latency_ms"), F.when(kind == "error", k / 1000).otherwise(k / 20000).alias("error_rate"),
        (20 + F.lit(0.5) * k).alias("cpu_pct"), (30 + (n % 1800) / 60).alias("mem_pct"), (50 + value).alias("rps"),
        incident.alias("incident_type"), k.alias("k"),
    )
    return base.select(*(c for c in base.columns if c not in ("k", "incident_type")), log_text().alias("log"), "incident_type", slo_breach().alias("label")).select(*C.TELEMETRY.names)


def log_text() -> Column:
    """The log line of a row of the view, by its class."""
    k, seq, incident = F.col("k"), F.col("seq"), F.col("incident_type")
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return (
        F.when(incident == "memory_leak", s("collector at work: GC pause of ", k, "0 ms; ", k, " regions kept"))
        .when((incident == "dependency_failure") & (seq % 2 == 0), s("call to upstream stock-db 503; giving up on order ", seq))
        .when(incident == "dependency_failure", s("no free handle, connection pool exhausted; ", k, " callers queued"))
        .when(incident == "traffic_spike", s("queue depth ", k, " and rising; oldest entry ", 2 * k, " ms"))
        .when(incident == "bad_deploy", s("Exception in Basket.total under ", F.col("version"), "; order ", seq, " dropped"))
        .otherwise(s("served /items in ", k, " ms"))
    )


def slo_breach(latency: float = C.LATENCY_SLO, errors: float = C.ERROR_SLO) -> Column:
    return ((F.col("latency_ms") > latency) | (F.col("error_rate") > errors)).cast("int")


def shifted(events: DataFrame) -> DataFrame:
    """A drifted stream: slower and busier, without incidents."""
    moved = events.withColumn("latency_ms", F.col("latency_ms") * 1.8).withColumn("rps", F.col("rps") * 1.5).withColumn("incident_type", F.lit(None).cast("string"))
    return moved.withColumn("label", slo_breach())


def snapshot(reports: dict[str, DataFrame]) -> DataFrame:
    """One row with each report as a list of rows; reports are small tables."""
    rows = [report.agg(F.collect_list(F.struct(*report.columns)).alias(name)) for name, report in reports.items()]
    joined = rows[0]
    for row in rows[1:]:
        joined = joined.join(F.broadcast(row))
    return joined


def write_snapshot(reports: dict[str, DataFrame], path: str) -> None:
    """The snapshot as one JSON object."""
    snapshot(reports).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)

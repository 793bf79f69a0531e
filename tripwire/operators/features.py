"""Leak-free windowed features of each service.

``windowed`` is the one implementation: rows in arrival order, of which the first are remembered ones, and what is known of
earlier deploys give the features of the others. Batch runs it by (service, time bucket), each bucket with the rows of the
baseline window before it; streaming runs it by service with the rows that the state store remembers. What a bucket needs
from further back, the last version and the last deploy, comes from a summary of one row per bucket.
``features_sql`` says the same in window functions, for checks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.operators import sliding

OUT = "seq long, ts double, service string, " + ", ".join(f"{f} double" for f in C.FEATURES)


class _Before(BaseIndexer):
    """Windows from a given position up to the row before each row."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.begin, np.arange(num_values, dtype=np.int64)


def windowed(pdf: pd.DataFrame, new: np.ndarray, version: str | None = None, deployed: float | None = None, baseline_s: float = C.BASELINE_S, slope_s: float = C.SLOPE_S, no_deploy_s: float = C.NO_DEPLOY_S) -> tuple[pd.DataFrame, str | None, float | None]:
    """(features of the rows for which ``new`` holds, the version and the last deploy time after them).

    Rows are of one service, in arrival order, and the new ones come last; ``version`` and ``deployed`` are what was known
    before the new rows. A window reaches back over all rows that arrived earlier, and not past the first that is too old.
    """
    ts = pdf["ts"].to_numpy(float)
    horizon = np.maximum.accumulate(ts)
    reach = lambda span: np.maximum.accumulate(np.minimum(np.searchsorted(horizon, ts - span, "left"), np.arange(len(ts))))
    before = _Before(begin=reach(baseline_s).astype(np.int64))
    over = {}
    for m in ("latency_ms", "cpu_pct", "rps"):
        values = pdf[m].to_numpy(float)
        base = pd.Series(values).rolling(before, min_periods=1).median().to_numpy()
        over[m] = (values / np.maximum(np.where(np.isnan(base), values, base), 1e-6))[new]
    mem, first = pdf["mem_pct"].to_numpy(float), reach(slope_s)
    span = ts - ts[first]
    slope = np.where(span > 0, (mem - mem[first]) / np.where(span > 0, span, 1) * 60, 0.0)[new]

    own, versions = ts[new], pdf["version"].to_numpy(object)[new]
    changed = np.zeros(len(own), bool)
    if len(own):
        changed[0] = version is not None and versions[0] != version
        changed[1:] = versions[1:] != versions[:-1]
    last = np.maximum.accumulate(np.where(changed, np.arange(len(own)), -1))
    at = np.where(last >= 0, own[np.maximum(last, 0)], np.nan if deployed is None else deployed) if len(own) else own
    since = np.where(np.isnan(at), no_deploy_s, np.minimum(own - at, no_deploy_s))
    rows = pdf[new]
    out = pd.DataFrame({
        "seq": rows["seq"], "ts": rows["ts"], "service": rows["service"], "latency_ms": rows["latency_ms"], "latency_over_baseline": over["latency_ms"], "error_rate": rows["error_rate"],
        "cpu_over_baseline": over["cpu_pct"], "mem_pct": rows["mem_pct"], "mem_slope_per_min": slope, "rps_over_baseline": over["rps"], "since_deploy_s": since,
    })
    return out, (versions[-1] if len(own) else version), (deployed if not len(own) or np.isnan(at[-1]) else float(at[-1]))


_IN = ["seq", "ts", "service", "version", "latency_ms", "error_rate", "cpu_pct", "mem_pct", "rps"]


def _with_previous(rows: DataFrame) -> DataFrame:
    """Rows (service, own_bucket, ts, seq, version) with the version of the row before in the same bucket."""
    inside = Window.partitionBy("service", "own_bucket").orderBy("ts", "seq")
    return rows.withColumn("previous", F.lag("version").over(inside)).withColumn("is_first", F.row_number().over(inside) == 1)


def version_changes(rows: DataFrame) -> DataFrame:
    """Per service and time bucket that has rows: the version and the last deploy time before the bucket."""
    order = F.struct("ts", "seq")
    summary = _with_previous(rows.select("service", "ts", "seq", "version", "own_bucket")).groupBy("service", F.col("own_bucket").alias("bucket")).agg(
        F.min_by("version", order).alias("first_version"), F.max_by("version", order).alias("last_version"), F.min("ts").alias("first_ts"),
        F.max(F.when(F.col("previous").isNotNull() & (F.col("previous") != F.col("version")), F.col("ts"))).alias("changed"),
    )
    by_service = Window.partitionBy("service").orderBy("bucket")  # one row per bucket
    before = F.lag("last_version").over(by_service)
    summary = summary.withColumn("version_before", before)
    edge = F.when(F.col("version_before").isNotNull() & (F.col("version_before") != F.col("first_version")), F.col("first_ts"))
    deployed = F.coalesce("changed", edge)
    return summary.withColumn("deployed", deployed).select("service", "bucket", "version_before", F.last("deployed", True).over(by_service.rowsBetween(Window.unboundedPreceding, -1)).alias("deployed_before"))


#: Rows that a bucket and the rows before it hold, unless a baseline window alone holds more; and rows of a window from which on a
#: service's windows aren't gathered in groups at all.
BUCKET_ROWS, BUSY_ROWS = 10_000, 100_000


def bucket_spans(events: DataFrame, baseline_s: float = C.BASELINE_S, rows: int = BUCKET_ROWS) -> DataFrame:
    """(service, span, busiest): seconds of a bucket of each service, by the rows of its busiest stretch of a window's length."""
    slots = events.groupBy("service", F.floor(F.col("ts") / baseline_s).alias("slot")).agg(F.count("*").alias("n"))
    busiest = slots.groupBy("service").agg(F.max("n").alias("busiest"))
    span = (F.floor(rows / F.col("busiest")) - 1) * baseline_s
    return busiest.select("service", F.greatest(F.least(span, F.lit(86_400.0)), F.lit(float(baseline_s))).alias("span"), "busiest")


def features(events: DataFrame, bucket_s: float | None = None, baseline_s: float = C.BASELINE_S, slope_s: float = C.SLOPE_S, keep: tuple[str, ...] = (), busy: int = BUSY_ROWS) -> DataFrame:
    """seq, ts, service and the eight features of every row, and its columns ``keep``.

    Without ``bucket_s`` buckets follow each service's rate, and services of which a window may hold over ``busy`` rows go
    by ``sliding``.
    """
    rows = events.select(*_IN, *keep)
    if bucket_s is not None:
        return _bucketed(rows.withColumn("span", F.lit(float(bucket_s))), events, baseline_s, slope_s, keep)
    spans = bucket_spans(events, baseline_s)
    crowded = spans.filter(F.col("busiest") > busy)
    calm = _bucketed(rows.join(spans.filter(F.col("busiest") <= busy).drop("busiest"), "service"), events, baseline_s, slope_s, keep)
    if crowded.isEmpty():
        return calm
    return calm.unionByName(_of_busy(rows.join(crowded.select("service"), "service"), baseline_s, slope_s, keep))


def _of_busy(rows: DataFrame, baseline_s: float, slope_s: float, keep: tuple[str, ...]) -> DataFrame:
    """The features of services whose windows are too large for a group; deploys are followed by buckets of ``BUCKET_ROWS``."""
    each = BUCKET_ROWS
    placed = sliding.baselines(rows, each, baseline_s, slope_s).withColumn("own_bucket", F.floor(F.col("place") / each))
    before = version_changes(placed).withColumnRenamed("bucket", "own_bucket")
    joined = _with_previous(placed).join(before, ["service", "own_bucket"])
    previous = F.when(F.col("is_first"), F.col("version_before")).otherwise(F.col("previous"))
    changed = F.when(previous.isNotNull() & (previous != F.col("version")), F.col("ts"))
    inside = Window.partitionBy("service", "own_bucket").orderBy("ts", "seq")
    last = F.coalesce(F.last("changed", True).over(inside), F.col("deployed_before"))
    return joined.withColumn("changed", changed).select(*_of_framed(last), *keep)


def _bucketed(spanned: DataFrame, events: DataFrame, baseline_s: float, slope_s: float, keep: tuple[str, ...]) -> DataFrame:
    """Features by time buckets: rows come with the seconds ``span`` of their bucket."""
    spanned = spanned.withColumn("own_bucket", F.floor(F.col("ts") / F.col("span")))
    carried = version_changes(spanned)
    last = F.floor((F.col("ts") + baseline_s) / F.col("span"))  # buckets whose baseline window the row is in
    copied = spanned.withColumn("bucket", F.explode(F.sequence("own_bucket", last))).withColumn("own", F.col("bucket") == F.col("own_bucket")).drop("span", "own_bucket")
    dealt = copied.join(carried, ["service", "bucket"])  # a bucket without rows of its own needs no features

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable", ignore_index=True)
        before, deployed = pdf["version_before"].iloc[0], pdf["deployed_before"].iloc[0]
        own = pdf["own"].to_numpy(bool)
        out, _, _ = windowed(pdf, own, None if pd.isna(before) else before, None if pd.isna(deployed) else float(deployed), baseline_s, slope_s)
        return out.assign(**{c: pdf[c][own] for c in keep})

    more = "".join(f", {c} {events.schema[c].dataType.simpleString()}" for c in keep)
    return dealt.groupBy("service", "bucket").applyInPandas(run, OUT + more)


def mem_slope(ts: Column, first_ts: Column, mem: Column, first_mem: Column) -> Column:
    return F.when(ts > first_ts, (mem - first_mem) / (ts - first_ts) * 60).otherwise(0.0)


def features_sql(events: DataFrame, baseline_s: float = C.BASELINE_S, slope_s: float = C.SLOPE_S) -> DataFrame:
    """The features by window functions; rows of one service with equal ts don't see each other in the baseline."""
    events.createOrReplaceTempView("telemetry_for_features")
    medians = ", ".join(f"percentile({m}, 0.5) OVER base AS base_{m}" for m in ("latency_ms", "cpu_pct", "rps"))
    framed = events.sparkSession.sql(f"""
        SELECT *, {medians}, first(ts) OVER slope AS first_ts, first(mem_pct) OVER slope AS first_mem, lag(version) OVER arrival AS previous
        FROM telemetry_for_features
        WINDOW base AS (PARTITION BY service ORDER BY ts RANGE BETWEEN {baseline_s} PRECEDING AND 1e-6 PRECEDING),
               slope AS (PARTITION BY service ORDER BY ts RANGE BETWEEN {slope_s} PRECEDING AND CURRENT ROW),
               arrival AS (PARTITION BY service ORDER BY ts, seq)""")
    return _finished(framed)


def _of_framed(last: Column) -> list[Column]:
    """The features from base_<metric>, first_ts and first_mem, and the time of the last deploy."""
    over = lambda m: F.col(m) / F.greatest(F.coalesce(f"base_{m}", m), F.lit(1e-6))
    return [
        "seq", "ts", "service", "latency_ms", over("latency_ms").alias("latency_over_baseline"), "error_rate", over("cpu_pct").alias("cpu_over_baseline"), "mem_pct",
        mem_slope(F.col("ts"), F.col("first_ts"), F.col("mem_pct"), F.col("first_mem")).alias("mem_slope_per_min"),
        over("rps").alias("rps_over_baseline"), F.least(F.coalesce(F.col("ts") - last, F.lit(C.NO_DEPLOY_S)), F.lit(C.NO_DEPLOY_S)).alias("since_deploy_s"),
    ]


def _finished(framed: DataFrame) -> DataFrame:
    changed = F.when(F.col("previous").isNotNull() & (F.col("previous") != F.col("version")), F.col("ts"))
    last = F.last(changed, True).over(Window.partitionBy("service").orderBy("ts", "seq"))
    return framed.select(*_of_framed(last))


def leaky_features(events: DataFrame) -> DataFrame:
    """A counterexample to measure: baselines are means over the whole series, the future included."""
    means = events.groupBy("service").agg(*(F.avg(m).alias(f"base_{m}") for m in ("latency_ms", "cpu_pct", "rps")))
    over = lambda m: F.col(m) / F.greatest(F.col(f"base_{m}"), F.lit(1e-6))
    return events.join(F.broadcast(means), "service").select(
        "seq", "ts", "service", "latency_ms", over("latency_ms").alias("latency_over_baseline"), "error_rate", over("cpu_pct").alias("cpu_over_baseline"), "mem_pct",
        F.lit(0.0).alias("mem_slope_per_min"), over("rps").alias("rps_over_baseline"), F.lit(C.NO_DEPLOY_S).alias("since_deploy_s"),
    )


def deploys(events: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """Rows at which a service's version differs from its previous row's; the first sighting is none.

    Rows are compared within time buckets, and a bucket's first row with the last version of the bucket before.
    """
    rows = events.select("seq", "ts", "service", "version", F.floor(F.col("ts") / bucket_s).alias("own_bucket"))
    before = version_changes(rows).select("service", F.col("bucket").alias("own_bucket"), "version_before")
    placed = _with_previous(rows).join(before, ["service", "own_bucket"])
    previous = F.when(F.col("is_first"), F.col("version_before")).otherwise(F.col("previous"))
    return placed.withColumn("previous_version", previous).filter("previous_version is not null and previous_version <> version").select("seq", "ts", "service", "previous_version", "version")


def feature_map() -> Column:
    """The features of a row as a map from names to values."""
    return F.map_from_arrays(F.array(*map(F.lit, C.FEATURES)), F.array(*C.FEATURES))

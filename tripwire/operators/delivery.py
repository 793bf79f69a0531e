"""Delivery ledgers: what each group has claimed and acknowledged of a log.

claims(grp, seq, consumer, at) has a row per delivery, acks(grp, seq, at) a row per acknowledgement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(claims: DataFrame, acks: DataFrame) -> DataFrame:
    """Offsets in flight: claimed and not acknowledged, with how often and when last."""
    flown = claims.groupBy("grp", "seq").agg(F.count("*").alias("deliveries"), F.max("at").alias("claimed_at"))
    return flown.join(acks.select("grp", "seq").distinct(), ["grp", "seq"], "left_anti")


def lag(log: DataFrame, claims: DataFrame, acks: DataFrame) -> DataFrame:
    """Per group: rows in the log, the next offset to claim, the backlog, and how many are in flight."""
    appended = log.agg(F.count("*").alias("appended"))
    claimed = claims.groupBy("grp").agg((F.max("seq") + 1).alias("consumed_next"))
    flying = pending(claims, acks).groupBy("grp").agg(F.count("*").alias("pending"))
    return claimed.join(flying, "grp", "left").join(F.broadcast(appended)).select("grp", "appended", "consumed_next", (F.col("appended") - F.col("consumed_next")).alias("backlog"), F.coalesce("pending", F.lit(0)).alias("pending"))


def redeliver(log: DataFrame, claims: DataFrame, acks: DataFrame, now: float, stale_s: float, n: int) -> DataFrame:
    """The first n stale offsets in flight with their events; each counts one delivery more."""
    stale = pending(claims, acks).filter(F.lit(now) - F.col("claimed_at") >= stale_s).orderBy("grp", "seq").limit(n)
    return stale.join(log, "seq").withColumn("deliveries", F.col("deliveries") + 1)


def unprocessed(log: DataFrame, processed: DataFrame) -> DataFrame:
    return log.join(processed.select("seq").distinct(), "seq", "left_anti")


def not_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Each row once, and only if its offset was not processed before."""
    return unprocessed(rows, seen).dropDuplicates(["seq"])


def union_processed(consumers: list[DataFrame]) -> DataFrame:
    """The offsets that at least one of the consumers has processed."""
    return reduce(DataFrame.unionByName, [c.select("seq") for c in consumers]).distinct()


def recovery_audit(log: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows processed by all consumers, distinct offsets, duplicates and losses."""
    lost = unprocessed(log, processed).agg(F.count("*").alias("lost"))
    return processed.agg(F.count("*").alias("processed"), F.count_distinct("seq").alias("distinct_offsets")).withColumn("duplicates", F.col("processed") - F.col("distinct_offsets")).join(F.broadcast(lost))

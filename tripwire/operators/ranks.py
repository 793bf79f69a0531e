"""Global ranks, order statistics and quantiles without a task that sees all rows.

Ranks: rows are dealt by range, sorted and written with their place in their partition; the counts of the partitions, a
few numbers, then give each partition its first rank. Order statistics and quantiles count equal values first, so a
value that many rows have is one row from there on. Equal rows of a rank are dealt by a hash of all their columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.sources.storage import Scratch, stored

_SHIFT = 33  # monotonically_increasing_id: partition above, place in it below


def with_rank(df: DataFrame, *order, name: str = "rank", tmp: Scratch | None = None) -> DataFrame:
    """``df`` with dense ranks from 0 in the given order; equal rows get some order among themselves.

    The ranked rows are a table of ``tmp``, or one that stays.
    """
    dealt = df.withColumn("tie_", F.xxhash64(*df.columns)).repartitionByRange(*order, "tie_").sortWithinPartitions(*order, "tie_").drop("tie_")
    placed = (tmp.stored if tmp else stored)(dealt.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _SHIFT)
    first, firsts = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        firsts.append((r["part"], first))
        first += r["count"]
    if not firsts:
        return placed
    starts = df.sparkSession.createDataFrame(firsts, "part_ long, first_ long")  # as many rows as partitions
    return placed.withColumn("part_", part).join(F.broadcast(starts), "part_").withColumn(name, F.col(name).bitwiseAND((1 << _SHIFT) - 1) + F.col("first_")).select(*placed.columns)


def order_statistics(df: DataFrame, column: str, ranks_of) -> tuple[int, dict[int, float]]:
    """(number of rows, {rank: value}) of a column without nulls, for the 0-based ranks that ``ranks_of(n)`` names."""
    counted = df.select(F.col(column).cast("double").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    with Scratch(df.sparkSession) as tmp:
        dealt = tmp.stored(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
        first, bounds = 0, []
        for r in sorted(dealt.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
            bounds.append((r["part"], first, first + r["n"]))
            first += r["n"]
        wanted = {k for k in ranks_of(first) if 0 <= k < first} if first else set()
        held = [(p, lo, sorted(k - lo for k in wanted if lo <= k < hi)) for p, lo, hi in bounds]
        held = [x for x in held if x[2]]
        if not held:
            return first, {}
        # only the partitions that hold a wanted rank are summed up, each by itself
        asked = df.sparkSession.createDataFrame(held, "part int, first long, ranks array<long>")
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
        summed = dealt.join(F.broadcast(asked), "part").withColumn("upto", upto)
        inside = F.filter("ranks", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))
        rows = summed.select("value", F.explode(inside).alias("rank"), "first").collect()
    return first, {r["first"] + r["rank"]: r["value"] for r in rows}


def floor_index_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The element at floor(share * n), as an index from 0."""
    n, at = order_statistics(df, column, lambda n: [int(q * n) for q in shares])
    return [at.get(int(q * n)) for q in shares]


def linear_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring ranks."""
    n, at = order_statistics(df, column, lambda n: [k for q in shares for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))])
    if not n:
        return [None] * len(shares)
    out = []
    for q in shares:
        low, high = (at[f(q * (n - 1))] for f in (math.floor, math.ceil))
        out.append(low + (high - low) * (q * (n - 1) - math.floor(q * (n - 1))))
    return out

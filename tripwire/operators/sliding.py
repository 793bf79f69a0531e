"""Sliding medians of services that are too busy for a window's rows to meet in one group.

A row is in the windows of the rows between its arrival and its departure, the moment from which it is too old. Arrivals and
departures of a service, put in one order, are cut into intervals of equally many events. All windows of an interval
share a core, the rows that came before it and leave after it; the others are events of the interval itself, so
the median of any of its windows is near the core's, by ranks no farther than half the number of these events. An
interval's group therefore needs its own events and the middle of its core, however many rows the core has.

Where the middle of each core is comes from counts. Intervals are taken together in epochs that are longer than any
row stays, so that a row is in two of them at most; the rows of an epoch are ranked by value and cut into cells of
equally many. A row adds to its cell's count from the interval after its arrival to the one before its departure, so running
sums give the count of every interval and cell: one table of small numbers for each epoch. The cells that hold the
middle of a core name the rows that its interval fetches.

Event times are compared as ``ts - span`` with ``ts``, as window functions do.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.functions import constants as C
from tripwire.operators.ranks import with_rank
from tripwire.sources.storage import Scratch, stored

METRICS = ["latency_ms", "cpu_pct", "rps"]
#: Kinds of events, in the order of those at one time: rows leave before others arrive.
LEAVES, LEAVES_SLOPE, ARRIVES = 0, 1, 2
#: Cells to an interval's events.
CELLS = 8


def leaving(ts: np.ndarray, span: float) -> np.ndarray:
    """The least time t with t - span > ts."""
    out = ts + span
    for _ in range(4):
        out = np.where(out - span <= ts, np.nextafter(out, np.inf), out)
    for _ in range(4):
        down = np.nextafter(out, -np.inf)
        out = np.where(down - span > ts, down, out)
    return out


def _events(rows: DataFrame, baseline_s: float, slope_s: float) -> DataFrame:
    """Of ranked rows: when each arrives and leaves the two windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts = batch["ts"].to_numpy(zero_copy_only=False)
            for kind, at in ((ARRIVES, ts), (LEAVES, leaving(ts, baseline_s)), (LEAVES_SLOPE, leaving(ts, slope_s))):
                yield pa.RecordBatch.from_arrays([batch["service"], pa.array(at), pa.array(np.full(len(at), kind, np.int32)), batch["place"], *(batch[m] for m in METRICS)], names=["service", "at", "kind", "place", *METRICS])

    columns = rows.select("service", "ts", "place", *METRICS)
    return columns.mapInArrow(run, "service string, at double, kind int, place long, " + ", ".join(f"{m} double" for m in METRICS))


def _middles(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each service (by the place of its first row), metric and interval: the cells that hold the middle of its core, and how many of the core are below them.

    ``counts`` has changes of counts by epoch, cell and interval; ``sizes`` how many events of an interval enter or leave its windows.
    """

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(own):
            return pd.DataFrame({"start": [], "epoch": [], "metric": [], "interval": [], "low": [], "high": [], "below": [], "core": []})
        first, cells = int(own["interval"].min()), np.sort(pdf["cell"].unique())
        change = np.zeros((int(own["interval"].max()) - first + 1, len(cells)), np.int64)
        inside = pdf[pdf["interval"] <= own["interval"].max()]
        np.add.at(change, (np.maximum(inside["interval"].to_numpy() - first, 0), np.searchsorted(cells, inside["cell"].to_numpy())), inside["change"].to_numpy())
        upto = np.cumsum(np.cumsum(change, axis=0), axis=1)[own["interval"].to_numpy() - first]
        core, half = upto[:, -1], own["moving"].to_numpy() // 2 + 2
        low = (upto <= np.maximum(core // 2 - half, 0)[:, None]).sum(1)
        high = (upto < np.minimum(core // 2 + half, core)[:, None]).sum(1)
        low = np.minimum(low, high)
        below = np.where(low > 0, upto[np.arange(len(low)), np.maximum(low - 1, 0)], 0)
        top = len(cells) - 1
        return pd.DataFrame({"start": pdf["start"].iloc[0], "epoch": pdf["epoch"].iloc[0], "metric": pdf["metric"].iloc[0], "interval": own["interval"], "low": cells[np.minimum(low, top)], "high": cells[np.minimum(high, top)], "below": below, "core": core})

    of_metric = sizes.withColumn("metric", F.explode(F.lit(list(range(len(METRICS))))))
    keys = ["start", "epoch", "metric"]
    return counts.groupBy(*keys).cogroup(of_metric.groupBy(*keys)).applyInPandas(run, "start long, epoch long, metric int, interval long, low long, high long, below long, core long")


def _median(values: list[float], below: int, n: int) -> float:
    """The median of n values, of which ``values`` are the sorted ones from ``below`` on, apart from others above."""
    k = n // 2 - below
    return values[k] if n % 2 else (values[k - 1] + values[k]) / 2


def _slide(key: tuple, events: pd.DataFrame, core: pd.DataFrame) -> pd.DataFrame:
    """Medians of the windows of an interval's arrivals, and the place of the first row of each one's slope window."""
    events = events.sort_values(["at", "kind", "place"], kind="stable", ignore_index=True)
    kind, place, first = events["kind"].to_numpy(), events["place"].to_numpy(), events["first"].to_numpy()
    arrives = kind == ARRIVES
    here = set(place[arrives].tolist())
    out = {"place": place[arrives], "first": (first + np.cumsum(kind == LEAVES_SLOPE))[arrives]}
    moves = np.flatnonzero(kind != LEAVES_SLOPE)
    for m, name in enumerate(METRICS):
        own = core[core["metric"] == m]
        head = own[own["value"].isna()]
        below, n = (int(head["below"].iloc[0]), int(head["core"].iloc[0])) if len(head) else (0, 0)
        values = events[name].to_numpy(float)
        window = own["value"].dropna().tolist()
        before = [k for k in moves.tolist() if kind[k] == LEAVES and place[k] not in here]  # in the windows at first
        window = sorted(window + values[before].tolist())
        n += len(before)
        medians = []
        for k, x, arrival in zip(moves.tolist(), values[moves].tolist(), arrives[moves].tolist(), strict=True):
            if arrival:
                medians.append(_median(window, below, n) if n else x)
                insort(window, x)
                n += 1
            else:
                del window[bisect_left(window, x)]
                n -= 1
        out[f"base_{name}"] = medians
    return pd.DataFrame(out)


def baselines(events: DataFrame, rows: int, baseline_s: float = C.BASELINE_S, slope_s: float = C.SLOPE_S) -> DataFrame:
    """``events`` with place (a rank by service, ts and seq), base_<metric> medians of the window before each row, and first_ts and first_mem of its slope window.

    An interval has ``rows`` events, or ten times the root of the rows that a window may hold if that is more, which keeps
    an epoch's table of counts smaller than its rows.
    """
    ranked = with_rank(events, "service", "ts", "seq", name="place")
    with Scratch(events.sparkSession) as tmp:
        moves = with_rank(_events(ranked, baseline_s, slope_s), "service", "at", "kind", "place", name="number", tmp=tmp)
        by_slot = ranked.groupBy("service", F.floor(F.col("ts") / baseline_s).alias("slot")).agg(F.count("*").alias("n"), F.min("place").alias("start"))
        services = by_slot.groupBy("service").agg(F.greatest(F.lit(rows), F.ceil(10 * F.sqrt(2 * F.max("n")))).cast("long").alias("width"), F.min("start").alias("start"))
        placed = moves.join(services, "service").withColumn("interval", F.floor((F.col("number") - 3 * F.col("start")) / F.col("width")))
        # a service has three events for each row, and the services stand in one order in both ranks
        of_row = placed.filter(F.col("kind") == ARRIVES).select("start", "place", "width", F.col("interval").alias("came"), *METRICS)
        stay = tmp.stored(of_row.join(placed.filter(F.col("kind") == LEAVES).select("place", F.col("interval").alias("went")), "place"))
        longest = stay.groupBy("start").agg(F.greatest(F.max(F.col("went") - F.col("came")), F.lit(1)).alias("length"))
        inner = stay.filter("went - came >= 2").join(longest, "start")  # in the core of some interval
        epochs = F.sequence(F.floor((F.col("came") + 1) / F.col("length")), F.floor((F.col("went") - 1) / F.col("length")))
        lists = inner.select("start", "width", "came", "went", "length", *METRICS, F.explode(epochs).alias("epoch"))
        each = lists.select("start", "width", "epoch", F.greatest(F.col("came") + 1, F.col("epoch") * F.col("length")).alias("begin"), F.least(F.col("went"), (F.col("epoch") + 1) * F.col("length")).alias("end"), F.posexplode(F.array(*METRICS)).alias("metric", "value"))
        by_value = with_rank(each, "start", "epoch", "metric", "value", name="cell", tmp=tmp).withColumn("cell", F.floor(F.col("cell") * CELLS / F.col("width")))
        cells = tmp.stored(by_value.drop("width"))
        change = F.explode(F.array(F.struct(F.col("begin").alias("interval"), F.lit(1).alias("change")), F.struct(F.col("end").alias("interval"), F.lit(-1).alias("change"))))
        counts = cells.select("start", "epoch", "metric", "cell", change.alias("x")).groupBy("start", "epoch", "metric", "cell", "x.interval").agg(F.sum("x.change").alias("change"))

        moving = F.count_if(F.col("kind") != LEAVES_SLOPE).alias("moving")
        per = placed.groupBy("start", "interval").agg(moving, F.count_if(F.col("kind") == LEAVES_SLOPE).alias("slope"))
        gone = F.coalesce(F.sum("slope").over(Window.partitionBy("start").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per interval
        intervals = tmp.stored(per.withColumn("first", F.col("start") + gone))
        sizes = intervals.join(longest, "start").select("start", F.floor(F.col("interval") / F.col("length")).alias("epoch"), "interval", "moving")
        middles = tmp.stored(_middles(counts, sizes))
        asked = middles.filter("core > 0").select("start", "epoch", "metric", "interval", F.explode(F.sequence("low", "high")).alias("cell"))
        fetched = cells.join(asked, ["start", "epoch", "metric", "cell"]).filter("begin <= interval and interval < end").select("start", "interval", "metric", "value", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("core"))
        heads = middles.select("start", "interval", "metric", F.lit(None).cast("double").alias("value"), "below", "core")
        group = ["start", "interval"]
        own = placed.select(*group, "at", "kind", "place", *METRICS).join(intervals.select(*group, "first"), group)
        schema = "place long, first long, " + ", ".join(f"base_{m} double" for m in METRICS)
        slid = stored(own.groupBy(*group).cogroup(fetched.unionByName(heads).groupBy(*group)).applyInPandas(_slide, schema))
    begun = ranked.select(F.col("place").alias("first"), F.col("ts").alias("first_ts"), F.col("mem_pct").alias("first_mem"))
    return ranked.join(slid.join(begun, "first").drop("first"), "place")

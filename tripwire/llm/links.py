"""Classes of linked items from candidate buckets: which pairs to verify, and connected components.

Buckets are rows (bucket, id). Two items may be linked only if they share a bucket; ``verify`` decides. Each item also
has a set of elements and a slack: the sets of linked items differ in at most as many elements as either's slack.
Since only the classes are wanted, not all pairs of a bucket need verifying:

1. in buckets of at most ``SMALL`` items, all pairs that share enough buckets (an odd bucket is one of at least
   ``ODD_SHARED`` that linked items share, so fewer are no reason to verify, unless they also share a larger bucket) and whose
   sketches leave a link open;
2. in larger buckets, each item with the most typical item that stands first in one of its buckets (one pair an item);
   typical is what shares many buckets with others, and the most typical item of a bucket stands first in it;
3. in larger buckets whose items are not yet of one class, each item with the bucket's first item f;
4. in those still of several classes, items meet in groups by their differences from f, or from the first item of another bucket
   that f is in and resembles (``leaders``), so that an item is in one group or a few, not in one for each of its buckets; any
   set would do for f, as long as all items of a bucket have the same. With A and B what two items'
   sets don't share with f's, the sets differ where A and B do. Of linked items at most slack k of these elements
   aren't shared, so if A has more than k, both have one of them among their first k + 1 differences in a common order,
   and so if B has more. If neither has, and they share none, A and B have at most k together, so the smaller has at
   most k / 2: such items, near f and yet not linked to it, are joined with the others of at most k. A pair of a
   group that differs in class is verified if sizes and sketches (parities of elements by bin) allow at most k differences;
   differences that only items of one class have are left out before that.

The common order takes elements first that few items share: those that are not common in a sample of the group's
items, f's own elements after others. The sample has an influence on the size of the groups only, not on what is found.

A pair left out has its two items in one class already, or can't be linked, so the classes are those that all pairs
would give. Counting a bucket is an aggregation with partial sums and the way back to its items is a join whose skewed
keys Spark splits, so a bucket that holds a large part of all items doesn't meet in one task. Items that have a rare
difference from f in common are compared by sketch, each pair of a group; these groups are what grows fastest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.batches import mix, release
from tripwire.sources.storage import Scratch, stored

__all__ = ["Scratch", "stored"]

Verify = Callable[[DataFrame, DataFrame], DataFrame]
#: Items of a bucket whose pairs are all looked at, and how many odd buckets linked items share at least.
SMALL, ODD_SHARED = 16, 3
#: 64-bit words of a sketch.
SKETCH = 16
#: Items, about, that tell which differences from a first item are common: those that over one in ``OFTEN`` has.
SAMPLE, OFTEN = 256, 40
#: Times that the way from a first item to its leader is doubled.
LEADING = 3
#: Columns that ``sets_of`` gives beside others: sizes of linked items differ by ``reach`` at most, their elements by ``slack``,
#: the bits of their sketches by ``spread``.
SETS = "id long, size int, reach int, slack int, spread int, " + ", ".join(f"s{k} long" for k in range(SKETCH)) + ", elements array<long>"


#: The table that tells which rows can be of a bucket with several items has 2 to the power of so many bits, at least and at most, and
#: up to the most about ``_ROOM`` bits for each such bucket.
_LEAST_BITS, _MOST_BITS, _ROOM = 15, 27, 64


def crowded(tmp: Scratch, signed: Callable[[Callable[[np.ndarray], np.ndarray] | None], DataFrame]) -> DataFrame:
    """Of rows (bucket, id), those of buckets with two items or more, each once.

    ``signed`` gives the rows, or those whose buckets a function keeps. They are made twice: first buckets are counted, then
    the rows that can be of a crowded one, as a bit for each of a bounded number of slots tells, meet those buckets.
    """
    ends = signed(None).groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    buckets = tmp.stored(ends.select("bucket"))
    n_bits = min(max((buckets.count() * _ROOM).bit_length(), _LEAST_BITS), _MOST_BITS)
    slot = F.shiftright("bucket", 20).bitwiseAND((1 << n_bits) - 1)
    pages = buckets.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << 15) - 1)).alias("bits"))
    bits = np.zeros((1 << (n_bits - 15), 1 << 12), np.uint8)
    for page, held in pages.toLocalIterator():
        bits[page] = np.frombuffer(held, np.uint8)
    shared = buckets.sparkSession.sparkContext.broadcast(bits.ravel())
    del bits

    def kept(bucket: np.ndarray) -> np.ndarray:
        slot = (bucket.astype(np.int64) >> 20) & ((1 << n_bits) - 1)
        return (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    out = tmp.stored(signed(kept).join(buckets, "bucket").distinct())
    shared.destroy()  # the driver and the executors would hold it until the driver's garbage is collected
    tmp.drop(buckets)
    return out


def with_first(members: DataFrame) -> DataFrame:
    """``crowded`` rows with the item that stands first in the bucket, and in how many buckets that one is."""
    shares = members.withColumn("shares", F.count("*").over(Window.partitionBy("id")))  # an item is in few buckets
    firsts = shares.groupBy("bucket").agg(F.max(F.struct("shares", "id")).alias("first"))
    return members.join(firsts, "bucket").select("bucket", "id", F.col("first.id").alias("first"), F.col("first.shares").alias("shares"))


def pairs_of(rows: DataFrame) -> DataFrame:
    """(a, b) with a < b of rows (first, id)."""
    return rows.select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b"))


def components(tmp: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) of every item of the pairs (a, b): the least item that can be reached.

    Every round contracts each item into the neighbour that comes first in a random order. About half of a path's items
    and all but the centre of a star go in a round, so the number of rounds is about the logarithm of the longest path.
    """
    steps = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
        turn = lambda x: F.struct(F.xxhash64(x).alias("turn"), F.col(x).alias("item"))
        into = tmp.stored(both.groupBy("id").agg(F.min(turn("near")).alias("first")).select("id", F.least("first", turn("id"))["item"].alias("component")))
        moved = edges
        for end in "ab":
            moved = moved.join(into.select(F.col("id").alias(end), F.col("component").alias(f"{end}_into")), end)
        steps.append(into)
        edges = tmp.stored(moved.filter("a_into <> b_into").select(F.least("a_into", "b_into").alias("a"), F.greatest("a_into", "b_into").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = steps[0]
    for into in steps[1:]:
        later = into.select(F.col("id").alias("component"), F.col("component").alias("end"))
        labels = labels.join(later, "component", "left").select("id", F.coalesce("end", "component").alias("component"))
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return tmp.stored(labels.join(least, "component").select("id", F.col("least").alias("component")))


def sketch(elements: np.ndarray) -> np.ndarray:
    """``SKETCH`` words: bit k is whether the set has an odd number of elements in bin k. Sets differ in at least as many
    elements as their sketches in bits."""
    odd = np.bincount((mix(elements.astype(np.uint64)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_columns(sets: list[np.ndarray], sketched: list[np.ndarray], sizes: list[int], reaches: list[int], slacks: list[int], spreads: list[int]) -> tuple[list[pa.Array], list[str]]:
    """The columns of ``SETS`` after the id, and their names; ``sketched`` are the sets that sketches are made of."""
    sketches = np.array([sketch(x) for x in sketched], np.int64).reshape(len(sets), SKETCH)
    at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.int64)))
    columns = [*(pa.array(x, pa.int32()) for x in (sizes, reaches, slacks, spreads)), *(pa.array(sketches[:, k]) for k in range(SKETCH)), lists]
    return columns, ["size", "reach", "slack", "spread", *(f"s{k}" for k in range(SKETCH)), "elements"]


def _sets_in(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    lists = batch.column(name)
    values = np.array(lists.flatten())
    ends = np.cumsum(np.array(lists.value_lengths().fill_null(0)))
    return np.split(values, ends[:-1]) if len(lists) else []


def leaders(tmp: Scratch, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(first, leader) of the firsts of rows (first, id, shares): the most typical item that a way of some steps leads to, each from a first to
    the first of a bucket that it is in; or the first itself, if the two have less than a third of their elements in common.

    The items of one family stand in many buckets with different firsts, and by their leader they meet once.
    """
    firsts = open_.select(F.col("first").alias("id")).distinct()
    up = tmp.stored(open_.join(firsts, "id").groupBy("id").agg(F.max(F.struct("shares", "first")).alias("top")).select(F.col("id").alias("first"), F.col("top.first").alias("leader")))
    for _ in range(LEADING):
        up = tmp.stored(up.join(up.select(F.col("first").alias("leader"), F.col("leader").alias("next")), "leader").select("first", F.col("next").alias("leader")))
    left, right = (sets.select(F.col("id").alias(x), F.col("elements").alias(f"{x}_set")) for x in ("first", "leader"))
    shared = F.size(F.array_intersect("first_set", "leader_set"))
    near = up.filter("first <> leader").join(left, "first").join(right, "leader").filter(4 * shared >= F.size("first_set") + F.size("leader_set")).select("first", "leader")
    return tmp.stored(up.select("first").join(near, "first", "left").select("first", F.coalesce("leader", "first").alias("leader")))


def common_differences(open_: DataFrame, base: DataFrame, sets: DataFrame) -> DataFrame:
    """(first, common): the elements that many of a sample of the items (first, id) don't share with the first, rarest first."""
    sizes = open_.groupBy("first").agg(F.count("*").alias("n"))
    sample = open_.join(sizes, "first").filter(F.pmod(F.xxhash64("id", F.lit(17)), F.col("n")) < SAMPLE).select("first", "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        batch = table.to_batches()[0]
        found = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(_sets_in(batch, "base"), _sets_in(batch, "elements"), strict=True)]
        elements, counts = np.unique(np.concatenate(found), return_counts=True)
        often = counts > max(2, len(found) // OFTEN)
        ordered = elements[often][np.argsort(counts[often], kind="stable")]
        return pa.table({"first": batch.column("first").slice(0, 1), "common": pa.array([ordered], pa.list_(pa.int64()))})

    return sample.join(base, "first").join(sets.select("id", "elements"), "id").select("first", "base", "elements").groupBy("first").applyInArrow(run, "first long, common array<long>")


def leading_differences(rows: DataFrame) -> DataFrame:
    """(first, element, near, id, component): of rows (first, id, component, slack, base, common, elements), the slack + 1 differences
    that come first in the common order, or all of them and a row without an element that says in ``near`` how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            found, near = [], np.full(len(batch), -1)
            for k, (slack, base, own, common) in enumerate(zip(batch.column("slack").to_pylist(), *(_sets_in(batch, x) for x in ("base", "elements", "common")), strict=True)):
                new, lost = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
                ordered = np.concatenate([np.sort(x[~np.isin(x, common)]) for x in (new, lost)])
                if len(ordered) <= slack:
                    ordered = np.concatenate((ordered, common[np.isin(common, new) | np.isin(common, lost)]))
                if len(ordered) <= slack:
                    near[k] = len(ordered)
                found.append(ordered[: slack + 1])
            short = np.flatnonzero(near >= 0)
            of = pa.array(np.concatenate((np.repeat(np.arange(len(found)), [len(x) for x in found]), short)).astype(np.int64))
            elements = np.concatenate([*found, np.zeros(len(short), np.int64)]).astype(np.int64)
            which = np.concatenate((np.full(len(elements) - len(short), -1), near[short]))
            yield pa.RecordBatch.from_arrays([batch.column("first").take(of), pa.array(elements), pa.array(which.astype(np.int32)), batch.column("id").take(of), batch.column("component").take(of)], names=["first", "element", "near", "id", "component"])

    return rows.select("first", "id", "component", "slack", "base", "common", "elements").mapInArrow(run, "first long, element long, near int, id long, component long")


def with_company(leading: DataFrame) -> DataFrame:
    """Of ``leading_differences``, the rows without an element, and those whose element items of another class have too.

    Only pairs that differ in class are compared, so the others meet nothing; most differences are an item's own.
    """
    alike = leading.filter("near < 0")
    shared = alike.groupBy("first", "element").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return alike.join(shared.select("first", "element"), ["first", "element"], "left_semi").unionByName(leading.filter("near >= 0"))


def similar() -> Column:
    """Whether the sizes and sketches of rows with a_ and b_ columns leave it open that the items are linked."""
    bits = sum(F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(SKETCH))
    return (F.abs(F.col("a_size") - F.col("b_size")) <= F.least("a_reach", "b_reach")) & (bits <= F.least("a_spread", "b_spread"))


def traits(sets: DataFrame, side: str) -> DataFrame:
    """What ``similar`` compares of each item, as columns of one side."""
    columns = ["size", "reach", "spread", *(f"s{k}" for k in range(SKETCH))]
    return sets.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def classes(tmp: Scratch, members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], verify: Verify, sketched: bool = True) -> tuple[DataFrame, DataFrame]:
    """((id, component) of linked items, the verified links (a, b)) from the stored rows of ``crowded``, which it drops.

    ``sets_of`` gives the columns of ``SETS`` (elements sorted and distinct) and others of rows (id, compared); only
    compared ones need elements and sketches. ``verify`` gets rows (a, b) with a < b and that table, and returns the linked ones.
    """
    counted = tmp.stored(members.join(members.groupBy("bucket").agg(F.count("*").alias("n")), "bucket"))
    tmp.drop(members)
    few = counted.filter(F.col("n") <= SMALL)
    left, right = (few.select("bucket", F.col("id").alias(x)) for x in "ab")
    odd = F.sum(F.col("bucket").bitwiseAND(1))
    met = left.join(right, "bucket").filter("a < b").groupBy("a", "b").agg(odd.alias("odd"), F.count("*").alias("all"))
    met = tmp.stored(met.filter((F.col("odd") >= ODD_SHARED) | (F.col("odd") < F.col("all"))).select("a", "b"))
    large = tmp.stored(with_first(counted.filter(F.col("n") > SMALL)))
    once = met.select(F.explode(F.array("a", "b")).alias("id"), F.lit(False).alias("compared")).union(large.select("id", F.lit(True)))
    sets = tmp.stored(sets_of(once.groupBy("id").agg(F.max("compared").alias("compared"))))
    tmp.drop(counted)

    if sketched:
        met = tmp.stored(met.join(traits(sets, "a"), "a").join(traits(sets, "b"), "b").filter(similar()).select("a", "b"))
    typical = pairs_of(large.filter("id <> first").groupBy("id").agg(F.max(F.struct("shares", "first")).alias("best")).select("id", "best.first"))
    links = tmp.stored(verify(tmp.stored(met.union(typical).distinct()), sets))
    found = components(tmp, links)

    def classed(rows: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def several() -> DataFrame:
        """(first, shares, id, component) of the items of larger buckets that hold several classes."""
        now = classed(large)
        which = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
        return tmp.stored(now.join(which, "bucket").select("first", "shares", "id", "component").distinct())

    def more(pairs: DataFrame) -> None:
        nonlocal links, found
        new = tmp.stored(verify(tmp.stored(pairs.distinct()), sets))
        if not new.isEmpty():
            links = tmp.stored(links.unionByName(new).distinct())
            found = components(tmp, links)

    open_ = several()
    if not open_.isEmpty():
        heads = open_.filter("id = first").select("first", F.col("component").alias("own"))
        more(pairs_of(open_.join(heads, "first").filter("component <> own")))
        open_ = several()
    if not open_.isEmpty():
        base = sets.select(F.col("id").alias("first"), F.col("elements").alias("base"))
        led = open_.join(leaders(tmp, open_, sets), "first").filter("id <> first or first <> leader")  # all have been compared with their own first
        apart = tmp.stored(led.select(F.col("leader").alias("first"), "id", "component").distinct())
        rows = apart.join(base, "first").join(common_differences(apart.select("first", "id"), base, sets), "first", "left").join(sets, "id")
        leading = tmp.stored(leading_differences(rows))
        # a stored table's columns by side, so that the sketches are compared in the join itself
        columns = [c for c in sets.columns if c not in ("id", "elements", "content")]
        sides = tmp.stored(with_company(leading).join(sets.select("id", *columns), "id"))
        left, right = (sides.select("first", "element", "near", *(F.col(c).alias(x if c == "id" else f"{x}_{c}") for c in ("id", "component", *columns))) for x in "ab")
        differ = (F.col("a_component") != F.col("b_component")) & similar()
        alike = left.filter("near < 0").join(right.filter("near < 0"), ["first", "element"]).filter((F.col("a") < F.col("b")) & differ)
        tiny = left.filter("near >= 0 and 2 * near <= a_slack").withColumn("near", F.explode(F.sequence("near", F.col("a_slack") - F.col("near"))))
        beside = tiny.join(right.filter("near >= 0"), ["first", "near"]).filter((F.col("a") != F.col("b")) & differ)
        more(alike.select("a", "b").union(beside.select(F.least("a", "b"), F.greatest("a", "b"))))
    return found, links

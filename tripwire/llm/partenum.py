"""Jaccard join of word shingle sets by PartEnum signatures.

A document's set is its distinct shingles of ``words`` words (A-Z as a-z); with fewer words, the whole sequence is its
one shingle. Sets in one band of sizes differ in at most k elements if their Jaccard similarity reaches the threshold,
with k known from the band. The domain of shingles is cut into partitions and each into parts; signatures name a subset
of parts and the elements that the set has there. Small k: one partition of k + 2 parts, every pair of parts (k
differences leave two parts untouched). Larger k: partitions of two parts each, p parts in all; a difference spoils one
part, so at least p - k agree, and a set with up to p - k - 3 empty parts needs no signature for those; these buckets
are odd, and similar sets share three of them at least. A set with more empty parts signs all of them; p is chosen so
that few sets have to. A set signs for its own band and for bands above that hold sizes near enough to its own.

Equal sets are one item from the start; items that share a signature are verified exactly on their whole sets. A set is
named by a 64-bit hash and checked by a second, independent one: texts that share a name but not the check are
items of their own, which are linked with nothing.

Edge cases: a null text, or one without words, has no shingles and is linked with nothing (its component is its own
id); equal texts are linked, whatever their ids; repeated rows each return a row; a row with a null id takes part and
returns a null id, and never names a component unless all ids of one are null; an empty table gives an empty result;
other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.batches import mix, prefix_hash, release, row_chunks, slice_hash, text_buffer, word_spans
from tripwire.llm.links import ODD_SHARED, SETS, Scratch, classes, crowded, set_columns, stored

#: Rows of (id, set id) up to which the way back to the texts is a broadcast; beyond it, a join with a shuffle.
BROADCAST_ROWS = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = _LOWER[raw[offsets[0] : offsets[-1]]], offsets - offsets[0]
    begin, end = word_spans(raw, offsets)
    hashes = slice_hash(prefix_hash(raw), begin, end)
    at = np.searchsorted(begin, offsets)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            yield np.unique(rolled[lo : hi - words + 1])
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for x in hashes[lo:hi]:
                whole = mix(np.array([whole]) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
            yield np.array([whole])
        else:
            yield np.zeros(0, np.uint64)


def set_id(elements: np.ndarray, other: int = 3) -> int:
    """A 64-bit name of a set; another odd number ``other`` gives an independent one."""
    scrambled = mix(elements * np.uint64(other) + np.uint64(other))
    return int(mix(np.array([scrambled.sum(dtype=np.uint64) + np.uint64(len(elements))]))[0].astype(np.int64))


class PartEnum:
    """Signatures for Jaccard similarity of at least ``percent`` hundredths."""

    SMALL = 5  # differences up to which one partition is enough

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1, 2]
        self.known_parts: dict[int, int] = {}

    def band_start(self, band: int) -> int:
        while len(self.starts) <= band:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 3 // 2))
        return self.starts[band]

    def bands(self, size: int) -> list[int]:
        """The set's own band, and those above that hold a size which ``size`` can be similar to."""
        band = 0
        while self.band_start(band + 1) <= size:
            band += 1
        out = [band]
        while self.percent * self.band_start(out[-1] + 1) <= 100 * size:
            out.append(out[-1] + 1)
        return out

    def differences(self, band: int) -> int:
        """At most so many elements are in one of two similar sets of the band only."""
        return 2 * (self.band_start(band + 1) - 1) * (100 - self.percent) // (100 + self.percent)

    def slack(self, size: int) -> int:
        """A set of this size and one similar to it differ in at most so many elements."""
        return (size + 100 * size // self.percent) * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """How many parts the domain has for a band: an even number, more than its differences spoil."""
        if band not in self.known_parts:
            k, size = self.differences(band), max(self.band_start(band) * self.percent // 100, 1)
            p = k + 9 + k % 2

            def empty_at_most(p: int) -> float:
                """Empty parts of the smallest sets that sign in the band: their mean and four deviations."""
                none, load = math.exp(-size / p), size / p
                return p * none + 4 * math.sqrt(p * none * (1 - (1 + load) * none))

            while p < 5 * k and p - k - 3 < empty_at_most(p):
                p += 2
            self.known_parts[band] = 1 if k == 0 else k + 2 if k <= self.SMALL else p + p % 2
        return self.known_parts[band]

    def signed_bands(self, elements: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """Of a set given as sorted hashes; parts are ranges of them: (band, its signatures, how many of them ``rarest`` may leave out)."""
        sums = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix(elements), out=sums[1:])
        for band in self.bands(len(elements)):
            k, spare = self.differences(band), 0
            parts = self.parts(band)
            ends = np.searchsorted((elements >> np.uint64(40)).astype(np.int64) * parts >> 24, np.arange(parts), "right")
            begins = np.concatenate(([0], ends[:-1]))
            own = sums[ends] - sums[begins]
            own = mix(own + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
            if 1 <= k <= self.SMALL:
                left, right = np.array(list(combinations(range(parts), 2))).T
                own = own[left] * np.uint64(0x9E3779B97F4A7C15) + own[right]
            elif k and (ends > begins).sum() >= k + ODD_SHARED:
                own = own[ends > begins]
                spare = len(own) - k - ODD_SHARED
            yield band, own & ~np.uint64(1) | np.uint64(k > self.SMALL), spare

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        return np.concatenate([own for _, own, _ in self.signed_bands(elements)])


def rarest(members: DataFrame) -> DataFrame:
    """Rows (bucket, id) of ``crowded`` rows that also have band and spare, without those that a set can spare in a band.

    A set that signs its m filled parts has m - k of them in common with every similar set. In one order of all buckets, lone ones
    first, then rare ones, its first k + 3 hold three of those at least, and so do the similar set's (it leaves out none, if it signs empty
    parts too). So the last m - k - 3 can go, and a set with fewer than m - k crowded buckets in a band has no partner there: what
    stays is what similar sets share, not every shingle that many texts happen to have.
    """
    own = Window.partitionBy("id", "band")
    needed = F.col("spare") + F.when(F.col("bucket").bitwiseAND(1) == 1, ODD_SHARED).otherwise(1)
    counted = members.join(members.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").withColumn("spare", F.min("spare").over(own))
    ranked = counted.withColumns({"last": F.row_number().over(own.orderBy(F.desc("n"), F.desc("bucket"))), "held": F.count("*").over(own)})
    return ranked.filter((F.col("last") > F.col("spare")) & (F.col("held") >= needed)).select("bucket", "id").distinct()


def set_components(tmp: Scratch, documents: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows doc_id, text_key, n_shingles, id, check of each document; id, check, first, n_links of each set).

    ``first`` is the first document of the set's component, as (unnamed, doc_id, text_key); null ids come last.
    """
    plan = PartEnum(percent)
    keyed = documents.select("doc_id", "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            raw, offsets, _ = text_buffer(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                sets = list(shingle_sets(raw, offsets[lo : hi + 1], words))
                ids, checks = (pa.array([set_id(x, other) if len(x) else None for x in sets], pa.int64()) for other in (3, 7))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "text_key")), pa.array([len(x) for x in sets], pa.int64()), ids, checks], names=["doc_id", "text_key", "n_shingles", "id", "check"])

    def signed(kept: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in release(batches):
                raw, offsets, _ = text_buffer(batch.column(1))
                for lo, hi in row_chunks(offsets):
                    own = {set_id(x): x for x in shingle_sets(raw, offsets[lo : hi + 1], words) if len(x)}
                    signs = [(name, *x) for name, elements in own.items() for x in plan.signed_bands(elements)]
                    names, bands, spare = (np.array([x[k] for x in signs], np.int64) for k in (0, 1, 3))
                    of = np.repeat(np.arange(len(signs)), [len(x[2]) for x in signs])
                    buckets = np.concatenate([*(x[2] for x in signs), np.zeros(0, np.uint64)]).astype(np.int64)
                    columns = {"bucket": buckets, "id": names[of]}
                    if kept:
                        here = kept(buckets)
                        needed = spare[of] + np.where(buckets & 1, ODD_SHARED, 1)
                        here &= np.bincount(of[here], minlength=len(signs))[of] >= needed
                        columns |= {"band": bands[of].astype(np.int32), "spare": spare[of].astype(np.int32)}
                        columns = {k: x[here] for k, x in columns.items()}
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=[*columns])

        return keyed.mapInArrow(run, "bucket long, id long" + ", band int, spare int" * (kept is not None))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            raw, offsets, _ = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                ids, sets = batch.column(0).slice(lo, hi - lo), list(shingle_sets(raw, offsets[lo : hi + 1], words))
                slacks = [plan.slack(len(x)) for x in sets]
                columns, names = set_columns(sets, sets, [len(x) for x in sets], slacks, slacks, slacks)
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names])

    with_key = keyed.withColumn("text_key", F.xxhash64("doc_id", "text"))
    rows = tmp.stored(with_key.mapInArrow(described, "doc_id long, text_key long, n_shingles long, id long, check long"))
    held = rows.filter("id is not null")
    named = tmp.stored(held.groupBy("id").agg(F.min(F.struct("check", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")))

    def sets_of(items: DataFrame) -> DataFrame:
        """The sets of some items, each from one of its texts."""
        sample = tmp.stored(named.join(items, "id").select("id", F.col("first.doc_id").alias("of"), F.col("first.text_key").alias("of_key")))
        wanted = F.broadcast(sample) if sample.count() <= BROADCAST_ROWS else sample
        same = with_key["doc_id"].eqNullSafe(F.col("of")) & (with_key["text_key"] == F.col("of_key"))
        return with_key.join(wanted, same).select("id", "text").mapInArrow(listed, SETS)

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("id").alias(x), F.col("elements").alias(f"{x}_set")) for x in "ab")
        both = pairs.join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return both.filter(100 * shared >= percent * (F.size("a_set") + F.size("b_set") - shared)).select("a", "b").distinct()

    shared = crowded(tmp, signed)
    members = tmp.stored(rarest(shared))
    tmp.drop(shared)
    found, links = classes(tmp, members, sets_of, verify)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classed = named.join(found, "id", "left").join(degree, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = classed.groupBy("component").agg(F.min(F.struct("first.unnamed", "first.doc_id", "first.text_key")).alias("class_first"))
    return rows, classed.join(least, "component").select("id", F.col("first.check").alias("id_check"), F.col("class_first").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_components(documents: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and n_links: verified links of its set to different sets."""
    with Scratch(documents.sparkSession) as tmp:
        rows, sets = set_components(tmp, documents, words, percent)
        same = F.col("check") == F.col("id_check")
        component = F.coalesce(F.when(same, F.col("first.doc_id")), "doc_id").alias("component_id")
        return stored(rows.join(sets, "id", "left").select("doc_id", "n_shingles", component, F.coalesce(F.when(same, F.col("n_links")), F.lit(0)).alias("n_links")))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those similar to one that stays: of each component the first by (doc_id, text hash), null ids last.

    Rows equal in id and text are one document; they stay or go together.
    """
    with Scratch(documents.sparkSession) as tmp:
        rows, sets = set_components(tmp, documents, words, percent)
        later = (F.col("check") == F.col("id_check")) & ((F.col("first.text_key") != F.col("text_key")) | ~F.col("first.doc_id").eqNullSafe(F.col("doc_id")))
        gone = stored(rows.join(sets, "id").filter(later).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    same = documents["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(documents["doc_id"], documents["text"]) == gone["gone_key"])
    return documents.join(gone, same, "left_anti")

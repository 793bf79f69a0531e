"""Line dedup by a segment-partition edit join.

Lines of at least ``MIN_CHARS`` characters take part. With ``short``, so do shorter ones that hold more than white
space: those are copies of equal lines only, which needs neither buckets nor verification. Two long lines are copies if their edit distance is at most
``DISTANCE`` = d. Lengths are cut into classes of ``WIDTH``, and a line is of its length's class and of that of a copy shorter by d.
In a class of lengths from n, d + 1 segments are laid out, those of the first half from a line's begin and the others from its end. Of
two copies of a class, some segment k is untouched, with at most k edits before it and d - k after it, so it is moved by at most
m = min(k, d - k) against the side it is laid out from. A segment has m characters more than a window of it, and a line enters the buckets (n, k, window) of its
windows at 0 to m: of two such segments, some window of one is a window of the other. That is four buckets a line and class for d = 2. Lines that share a bucket are verified by edit distance, bit-parallel within a band of
diagonals. Classes of copies are closed under links; in each class the line that comes first by (doc_id, line number)
stays and the others go.

A line is named by a 64-bit hash and checked by its CRC: of lines that share a name, only those of
the least check take part, and the others stay.

Edge cases: a null text has no lines and stays null, an empty one has one short line; shorter lines stay unless
``short``, and those of white space only stay always; rows
equal in doc_id and text are one document, return a row each, and don't count as copies of each other; a null
doc_id comes before others; an empty table gives an empty result; columns other than text stay as they are, whatever their names (but a
column named line_dedup is replaced); texts and lines are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.batches import SEPARATOR, mix, prefix_hash, release, row_chunks, slice_hash, text_buffer
from tripwire.llm.links import SETS, Scratch, classes, crowded, set_columns, stored

MIN_CHARS, DISTANCE = 25, 2
#: Characters of the grams by which variants of one line are grouped, and of those in their sketches: the shorter, the
#: more of a word's change shows against what one edit allows.
GRAM, SKETCHED = 4, 2
#: Lengths of lines in a class: the more, the fewer lines are in two classes, and the more lines that can't be copies meet.
WIDTH = 4
#: Line hashes that a task remembers, so as to place copies of a line in buckets once.
REMEMBERED = 200_000


@dataclass
class Lines:
    """The lines of a run of texts: their bytes, where each is (bytes and characters), its text, and its number in it."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    #: Where each character begins, and the end; None if all are single bytes.
    place: np.ndarray | None

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray, min_chars: int, short: bool = False) -> Lines:
        """Lines of at least ``min_chars`` characters; with ``short`` those that hold more than white space too."""
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        breaks = np.flatnonzero(raw == 0x0A)
        begin = np.concatenate((offsets[:-1], breaks + 1))
        owner = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], breaks, "right")))
        order = np.lexsort((begin, owner))
        begin, owner = begin[order], owner[order]
        end = np.append(begin[1:] - 1, 0)
        last_of_text = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        end[last_of_text] = offsets[owner[last_of_text] + 1]
        end = end[: len(owner)]
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        place = None
        first, last = begin, end
        if len(raw) and raw.max() >= 0x80:
            place = np.flatnonzero(raw.view(np.int8) >= -64)  # all bytes but 80 to BF
            first, last, place = np.searchsorted(place, begin), np.searchsorted(place, end), np.append(place, len(raw))
        take = last - first >= min_chars
        if short:
            filled = np.flatnonzero(~SEPARATOR[raw])
            take |= np.searchsorted(filled, end) > np.searchsorted(filled, begin)
        return cls(raw, begin[take], end[take], first[take], last[take], owner[take], number[take], place)

    def only(self, which: np.ndarray) -> Lines:
        return Lines(self.raw, *(x[which] for x in (self.begin, self.end, self.first, self.last, self.owner, self.number)), self.place)


def gram_set(line: str, size: int = GRAM) -> np.ndarray:
    """The line's grams with the number of each occurrence, sorted: one edit changes at most 2 * size elements of the set."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for k in range(size):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + mix(codes[k : k + len(grams)] + np.uint64(1))
    grams.sort()
    if not len(grams):
        return grams
    first = np.concatenate(([True], grams[1:] != grams[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(grams)), 0))
    return np.unique(mix(grams + mix((np.arange(len(grams)) - start).astype(np.uint64))))


def line_buckets(prefix: list, lines: Lines, distance: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, which line) rows of the lines, all others having ``least`` characters too."""
    buckets, owners = [], []
    where = (lambda x: x) if lines.place is None else lines.place.__getitem__
    length, segments, width = lines.last - lines.first, distance + 1, max(WIDTH, distance)
    moves = [min(k, distance - k) for k in range(segments)]
    own = length // width * width
    # its own class, and the one before it if a shorter copy may be of that one
    for lengths, which in ((own, np.arange(len(own))), (own - width, np.flatnonzero((length - distance < own) & (own > least)))):
        lengths = lengths[which]
        size = (lengths - sum(moves)) // segments
        for k, most in enumerate(moves):
            left = 2 * k <= distance
            fits = which[size > 0]
            here, n = lengths[size > 0], size[size > 0]
            at = k * n + sum(moves[:k])
            begin = lines.first[fits] + at if left else lines.last[fits] - (segments - k) * n - sum(moves[k:])
            tag = mix((here * 64 + k).astype(np.uint64))
            for shift in range(most + 1):
                buckets.append(mix(slice_hash(prefix, where(begin + shift), where(begin + shift + n)) + tag) & ~np.uint64(1))
                owners.append(fits)
        tiny = which[size <= 0]  # too short for segments: one bucket
        buckets.append(np.zeros(len(tiny), np.uint64))
        owners.append(tiny)
    return np.concatenate(buckets), np.concatenate(owners)


def bucket_rows(prefix: list, lines: Lines, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, id) rows of the lines."""
    buckets, of = line_buckets(prefix, lines, distance)
    return buckets, ids[of]


def banded_distance(left: list[str], right: list[str], distance: int) -> np.ndarray:
    """Which pairs are within the edit distance: Hyyro's bit-vectors over a band of diagonals, all pairs at once."""
    out = np.zeros(len(left), bool)
    todo = []
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        if abs(len(a) - len(b)) > distance:
            continue
        if a == b:
            out[k] = True
            continue
        todo.append(k)
    todo.sort(key=lambda k: len(right[k]))
    for lo in range(0, len(todo), 2048):
        some = todo[lo : lo + 2048]
        out[some] = _banded([left[k] for k in some], [right[k] for k in some], distance)
    return out


def _padded(texts: list[str], before: int, width: int, fill: int) -> np.ndarray:
    out = np.full((width, len(texts)), fill, np.uint32)
    for k, text in enumerate(texts):
        out[before : before + len(text), k] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return out


def _banded(rows: list[str], columns: list[str], distance: int) -> np.ndarray:
    """Bit k of a vector is the row (column - distance + k); the distance is followed along the last cell's diagonal."""
    m, n = (np.array([len(x) for x in side]) for side in (rows, columns))
    width, steps = 2 * distance + 1, int(n.max())
    pattern = _padded(rows, distance, steps + 2 * width + int(m.max()), 0xFFFFFFFF)
    text = _padded(columns, 0, steps, 0xFFFFFFFE)
    one = np.uint64(1)
    diagonal = (m - n + distance).astype(np.uint64)
    score = np.abs(m - n)
    vp = np.full(len(rows), sum(1 << k for k in range(distance, 64)), np.uint64)
    vn = np.zeros(len(rows), np.uint64)
    alive = np.flatnonzero(n)
    for j in range(steps):
        match = np.zeros(len(alive), np.uint64)
        for k in range(width):  # row j + 1 - distance + k is at pattern index j + k
            match |= (pattern[j + k, alive] == text[j, alive]).astype(np.uint64) << np.uint64(k)
        p, q = vp[alive], vn[alive]
        d0 = (((match & p) + p) ^ p) | match | q
        hp, hn = q | ~(d0 | p), d0 & p
        shifted = d0 >> one
        vp[alive], vn[alive] = hn | ~(shifted | hp), shifted & hp
        counts = (j >= n[alive] - m[alive]) & (((d0 >> diagonal[alive]) & one) == 0)
        score[alive] += counts
        if j % 8 == 7 or j + 1 >= n[alive].min():
            alive = alive[(n[alive] > j + 1) & (score[alive] <= distance)]
            if not len(alive):
                break
    return score <= distance


def line_copies(tmp: Scratch, documents: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """Every eligible line that has copies: doc_id, document_key, line, and the first line of its class.

    ``documents`` has doc_id, document_key and text.
    """
    texts = documents.filter("text is not null").select("doc_id", "document_key", "text")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in release(batches):
            raw, offsets, _ = text_buffer(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                own = Lines.of(raw, offsets[lo : hi + 1], min_chars, short)
                prefix = prefix_hash(own.raw)
                ids = slice_hash(prefix, own.begin, own.end)
                of, view = pa.array(own.owner + lo), memoryview(own.raw)
                check = [zlib.crc32(view[a:b]) for a, b in zip(own.begin.tolist(), own.end.tolist(), strict=True)]
                _, once = np.unique(ids, return_index=True)
                once = np.sort(once[(own.last - own.first)[once] >= min_chars])
                new = once[[x not in seen for x in ids[once].tolist()]] if len(once) else once
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(ids[new].tolist())
                buckets, owners = line_buckets(prefix, own.only(new), distance, min_chars)
                buckets = buckets[np.argsort(owners, kind="stable")]
                counts = np.zeros(len(ids) + 1, np.int32)
                counts[1:][new] = np.bincount(owners, minlength=len(new))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(buckets.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("document_key").take(of), pa.array(own.number.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(check, pa.int64()), lists], names=["doc_id", "document_key", "line", "id", "check", "buckets"])

    def placed(kept: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
        held = lines.filter(F.size("buckets") > 0).select("buckets", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in release(batches):
                buckets, sizes = np.array(batch.column("buckets").flatten()), np.array(batch.column("buckets").value_lengths())
                here = kept(buckets)
                yield pa.RecordBatch.from_arrays([pa.array(buckets[here]), pa.array(np.repeat(np.array(batch.column("id")), sizes)[here])], names=["bucket", "id"])

        return held.mapInArrow(run, "bucket long, id long") if kept else held.select(F.explode("buckets").alias("bucket"), "id")

    # each line is hashed once; its buckets are read again, once for counting and once for the way back
    lines = tmp.stored(texts.mapInArrow(located, "doc_id long, document_key long, line int, id long, check long, buckets array<long>"))
    place = F.struct("check", "doc_id", "document_key", "line")
    named = tmp.stored(lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")))

    def spelled_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            found = []
            for text, some in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                cut = text.split("\n")
                found += [(x["id"], cut[x["line"]], x["compared"]) for x in some]
            for lo in range(0, len(found), 5000):
                ids, spelled, compared = zip(*found[lo : lo + 5000], strict=True)
                n, none = len(ids), np.zeros(0, np.uint64)
                sets, sketched = ([gram_set(x, size) if own else none for x, own in zip(spelled, compared, strict=True)] for size in (GRAM, SKETCHED))
                columns, names = set_columns(sets, sketched, [len(x) for x in spelled], [distance] * n, [2 * GRAM * distance] * n, [2 * SKETCHED * distance] * n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, pa.array(spelled, pa.string())], names=["id", *names, "content"])

    def contents_of(items: DataFrame) -> DataFrame:
        """The lines of some ids and, for those to be compared, their sets; texts are met once, however many of their lines are wanted."""
        wanted = named.join(items, "id").groupBy("first.doc_id", "first.document_key").agg(F.collect_list(F.struct("id", "compared", F.col("first.line").alias("line"))).alias("lines"))
        same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["document_key"] == wanted["document_key"])
        return texts.join(wanted, same).select("text", "lines").mapInArrow(spelled_many, SETS + ", content string")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            ok = banded_distance(batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist(), distance)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    def verify(pairs: DataFrame, contents: DataFrame) -> DataFrame:
        left, right = (contents.select(F.col("id").alias(x), F.col("content").alias(f"{x}_line")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").mapInArrow(verified, "a long, b long").distinct()

    found, _ = classes(tmp, crowded(tmp, placed), contents_of, verify, sketched=False)
    # a line that occurs once and is linked with none has no copies
    classed = named.join(found, "id", "left").filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    firsts = classed.groupBy("component").agg(F.min(F.struct("first.doc_id", "first.document_key", "first.line")).alias("class_first"), F.sum("n").alias("in_class")).filter("in_class > 1")
    copied = classed.join(firsts, "component").select("id", F.col("first.check").alias("id_check"), "class_first")
    return lines.drop("buckets").join(copied, "id").filter("check = id_check").select("doc_id", "document_key", "line", F.col("class_first").alias("first"))


def dedup(documents: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """``documents`` without the lines that copy an earlier one, and line_dedup: struct(n_lines, n_dropped, n_long_kept, class_doc_id,
    n_links).

    ``class_doc_id`` is the smallest doc_id that some line of the document is a copy of, or its own; ``n_links`` counts
    its lines that have copies elsewhere.
    """
    fields = [f for f in documents.schema.fields if f.name != "line_dedup"]
    given = documents.select(*(f.name for f in fields))
    own = {name: k for k, name in enumerate(given.columns)}
    # columns go by position, so that no name of theirs meets one of these
    plain = given.toDF(*(f"c{k}" for k in range(len(fields))))
    doc_id, text = f"c{own['doc_id']}", f"c{own['text']}"
    keyed = plain.withColumn("document_key", F.xxhash64(doc_id, text))
    later = (F.col("first.document_key") != F.col("document_key")) | (F.col("first.line") != F.col("line"))
    with Scratch(documents.sparkSession) as tmp:
        copies = line_copies(tmp, keyed.select(F.col(doc_id).alias("doc_id"), "document_key", F.col(text).alias("text")), distance, min_chars, short)
        dropped = stored(copies.distinct().groupBy("doc_id", "document_key").agg(F.collect_set(F.when(later, F.col("line"))).alias("dropped"), F.min("first.doc_id").alias("class_doc_id"), F.count("*").alias("n_links")))
    of = dropped.withColumnsRenamed({"doc_id": "of_doc_id", "document_key": "of_key"})
    joined = keyed.join(of, F.col(doc_id).eqNullSafe(F.col("of_doc_id")) & (F.col("document_key") == F.col("of_key")), "left")
    stats = T.StructType([T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped", "n_long_kept", "class_doc_id", "n_links")])
    struct_ = pa.struct([(f.name, pa.int64()) for f in stats.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            texts, made = [], []
            for key, whole, gone, class_id, links in zip(*(batch.column(x).to_pylist() for x in (doc_id, text, "dropped", "class_doc_id", "n_links")), strict=True):
                cut, drop = [] if whole is None else whole.split("\n"), set(gone or ())
                texts.append(None if whole is None else "\n".join(x for k, x in enumerate(cut) if k not in drop) if drop else whole)
                made.append({"n_lines": len(cut), "n_dropped": len(drop), "n_long_kept": sum(len(x) >= min_chars and k not in drop for k, x in enumerate(cut)), "class_doc_id": key if class_id is None else class_id, "n_links": links or 0})
            kept = [pa.array(texts, pa.string()) if k == own["text"] else batch.column(f"c{k}") for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, struct_)], names=[*(f"c{k}" for k in range(len(fields))), "line_dedup"])

    out = T.StructType([*(T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(fields)), T.StructField("line_dedup", stats)])
    return joined.select(*plain.columns, "dropped", "class_doc_id", "n_links").mapInArrow(run, out).toDF(*given.columns, "line_dedup")

"""Periodic runs of words: stretches that repeat a passage of q words at least ``EXPONENT`` times, with nothing between.

A run is a maximal stretch with smallest period q of at least max(``MIN_LENGTH``, ``EXPONENT`` * q) words. Words are the
stretches of bytes other than space and 09-0D, compared by 62-bit hashes and numbered anew in each text, so that no run
crosses texts and all texts of a chunk are one sequence.

Block convolution finds them. Periods of L to 2L - 1 are looked for at scale L, a power of two: a run of such a period
holds whole blocks of L words that stand at multiples of L, and each of them comes again q words later. For a block
and the window after it, sum (b - w)^2 is a sum of squares less twice a convolution, which a number-theoretic
transform of size 2L gives exactly; where it is zero modulo primes whose product no such sum reaches, the block occurs.
Occurrences at one distance in neighbouring blocks are joined, and the ends extended by less than a block word by word.

Two kinds of blocks need no convolution. One with a word that doesn't come again within 2L words occurs nowhere in its
window. One whose window lies in a run of a smaller period p, found before, has occurrences at multiples of p only: two
periods p < q of a stretch of p + q words make their greatest common divisor a period, and so q isn't the smallest. For
the same reason a stretch inside such a run is dropped, and one whose end runs on for a whole block, as
only a block that was left out ends it there.

Edge cases: a null text has no words, no runs, and collapses to the empty text; null ids and repeated rows each get
their row; an empty table gives none; texts are read whole, up to 2^26 words each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripwire.llm.batches import mix, prefix_hash, release, row_chunks, slice_hash, text_buffer, word_spans

MIN_LENGTH, EXPONENT = 6, 4
#: Primes k * 2^m + 1 under 2^31, and a generator of each.
PRIMES = {2013265921: 31, 469762049: 3, 167772161: 3}
#: Numbers that are transformed or compared at once, unless a single block has more.
AT_ONCE = 1 << 18

FOUND = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@lru_cache(256)
def _powers(prime: int, size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of order ``size``."""
    root = pow(PRIMES[prime], (prime - 1) // size, prime)
    root = pow(root, -1, prime) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate((out, out * np.uint64(pow(root, len(out), prime)) % np.uint64(prime)))
    return out


def transform(rows: np.ndarray, prime: int) -> np.ndarray:
    """Number-theoretic transforms of the rows, whose length is a power of two; the order is bit-reversed."""
    p, (many, size) = np.uint64(prime), rows.shape
    out, half = rows.astype(np.uint64), size // 2
    while half:
        pairs = out.reshape(many, -1, 2, half)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1]
        pairs[:, :, 1], pairs[:, :, 0] = (low + (p - high)) % p * _powers(prime, 2 * half, False) % p, (low + high) % p
        half //= 2
    return out


def back(rows: np.ndarray, prime: int) -> np.ndarray:
    """The inverse of ``transform``."""
    p, (many, size) = np.uint64(prime), rows.shape
    out, half = rows.copy(), 1
    while half < size:
        pairs = out.reshape(many, -1, 2, half)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1] * _powers(prime, 2 * half, True) % p
        pairs[:, :, 0], pairs[:, :, 1] = (low + high) % p, (low + (p - high)) % p
        half *= 2
    return out * np.uint64(pow(size, -1, prime)) % p


def _distances(words: np.ndarray, at: np.ndarray, size: int, prime: int) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of the blocks at ``at`` and the stretches from ``size`` to 2 * size - 1 words later."""
    p, block = np.uint64(prime), words[at[:, None] + np.arange(size)]
    window = words[at[:, None] + np.arange(size, 3 * size - 1)]
    padded = np.zeros((2, len(at), 2 * size), np.uint64)
    padded[0, :, :size], padded[1, :, : 2 * size - 1] = block[:, ::-1] % p, window % p
    # of the cyclic convolution, the places that don't wrap round
    product = back(transform(padded[0], prime) * transform(padded[1], prime) % p, prime)[:, size - 1 : 2 * size - 1]
    upto = np.zeros((len(at), 2 * size), np.uint64)
    np.cumsum(window * window, axis=1, out=upto[:, 1:])
    squares = (block * block).sum(1, keepdims=True) % p + (upto[:, size:] - upto[:, :size]) % p
    return (squares + 2 * (p - product)) % p


def _occurrences(words: np.ndarray, top: int, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, distances) at which the blocks at ``at`` come again, size to 2 * size - 1 words later; words are under ``top``."""
    step, found = max(1, AT_ONCE // (2 * size)), []
    for lo in range(0, len(at), step):
        own = at[lo : lo + step]
        zero, held = np.ones((len(own), size), bool), 1
        for prime in PRIMES:
            left = np.flatnonzero(zero.any(1))
            if held > size * top * top or not len(left):
                break
            zero[left] &= _distances(words, own[left], size, prime) == 0
            held *= prime
        row, shift = np.nonzero(zero)
        found.append((own[row], shift + size))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))


def _reach(words: np.ndarray, begin: np.ndarray, period: np.ndarray, step: int, most: int) -> np.ndarray:
    """For how many words from ``begin`` on, in steps of 1 or -1, each equals the one ``period`` later; at most ``most``."""
    out, rows = np.zeros(len(begin), np.int64), max(1, AT_ONCE // most)
    for lo in range(0, len(begin), rows):
        at = begin[lo : lo + rows, None] + step * np.arange(most)
        later = at + period[lo : lo + rows, None]
        inside = (at >= 0) & (later < len(words))
        same = np.zeros((len(at), most + 1), bool)
        same[:, :-1] = inside & (words[np.where(inside, at, 0)] == words[np.where(inside, later, 0)])
        out[lo : lo + rows] = same.argmin(1)
    return out


def find(words: np.ndarray, longest: int | None = None, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs in a sequence of integers, by start and period; an exponent is 3 at least.

    ``longest`` bounds the length of a run, where it is known.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    placed = words[order]
    number = np.zeros(n, np.int64)
    number[order] = np.concatenate(([0], np.cumsum(placed[1:] != placed[:-1]))) if n else 0
    again = np.full(n, 2 * n + 2)  # words from one to the next that equals it
    again[order[:-1]] = np.where(placed[1:] == placed[:-1], np.diff(order), 2 * n + 2)
    top, size = int(number.max(initial=0)) + 2, 1
    deep = np.zeros(n, np.int64)  # the farthest end of the runs that start at a word or before it
    found = [np.zeros((3, 0), np.int64)]
    while exponent * size <= min(n, n if longest is None else longest):
        blocks = n // size
        filled = (again[: blocks * size] < 2 * size).reshape(blocks, size).all(1)
        begins = np.arange(blocks) * size
        filled &= deep[begins] < np.minimum(begins + 3 * size - 1, n)
        lonely = ~np.concatenate((filled[1:], [False])) & ~np.concatenate(([False], filled[:-1]))
        filled &= ~lonely  # a run of this scale holds two blocks at least that come again
        if filled.any():
            # a number beyond all others stands for what follows the last word
            ended = np.concatenate((number, np.full(3 * size, top - 1))).astype(np.uint64)
            at, period = _occurrences(ended, top, begins[filled], size)
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (np.diff(at) != size) | (np.diff(period) != 0)
            first = np.flatnonzero(fresh)
            lo, q = at[first], period[first]
            hi = at[np.append(first[1:], len(at)) - 1] + size if len(at) else lo
            usable = (hi - lo + 2 * (size - 1) >= (exponent - 1) * q) & (deep[lo] < hi + q)
            lo, hi, q = lo[usable], hi[usable], q[usable]
            left, right = _reach(number, lo - 1, q, -1, size), _reach(number, hi, q, 1, size)
            start, end = lo - left, hi + right + q
            kept = (left < size) & (right < size) & (end - start >= np.maximum(min_length, exponent * q))
            start, end, q = start[kept], end[kept], q[kept]
            kept = deep[start] < end
            found.append(np.array([start[kept], end[kept], q[kept]]))
            np.maximum.at(deep, start[kept], end[kept])
            np.maximum.accumulate(deep, out=deep)
        size *= 2
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _joined(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the slices of ``raw``, each with a space after it; n + 1 offsets of them)."""
    lengths = end - begin + 1
    at = np.concatenate(([0], np.cumsum(lengths)))
    out = np.append(raw, np.uint8(0x20))[np.arange(at[-1]) + np.repeat(begin - at[:-1], lengths)]
    out[at[1:] - 1] = 0x20
    return out.tobytes(), at


def collapse(documents: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Per document: doc_id, its runs (start, length and period in words), and its words joined by one space without those that any run has after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            raw, offsets, _ = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                begin, end = word_spans(own, at)
                first = np.searchsorted(begin, at)  # of each text, its first word
                of_text = np.repeat(np.arange(hi - lo), np.diff(first))
                hashes = slice_hash(prefix_hash(own), begin, end)
                start, stop, period = find(hashes ^ mix(of_text.astype(np.uint64) + np.uint64(7)), int(np.diff(first).max()), min_length, exponent)
                dropped = np.zeros(len(begin) + 1, np.int64)
                np.add.at(dropped, start + period, 1)
                np.add.at(dropped, stop, -1)
                kept = np.cumsum(dropped)[:-1] == 0
                joined, ends = _joined(own, begin[kept], end[kept])
                text_at = ends[np.concatenate(([0], np.cumsum(kept)))[first]].tolist()
                texts = [joined[a : max(a, b - 1)].decode() for a, b in zip(text_at, text_at[1:], strict=False)]
                owner = np.searchsorted(first, start, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(stop - start), pa.array(period)], fields=list(_SPANS.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return documents.select("doc_id", "text").mapInArrow(run, FOUND)

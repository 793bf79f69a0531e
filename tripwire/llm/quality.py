"""Quality rules: counted heuristics, and divergence from language references.

Base counts are taken from the words (runs of bytes other than space and 09-0D) and lines of each text; a text
fails them if it has under ``MIN_WORDS`` words, or over a fifth of its words repeat in five-word windows.

The verdict on the others: the histogram of character classes, and the histogram of common words, are compared with the
references of all languages by Jensen-Shannon distance (base 2, so 0 to 1). A text goes if the closest reference
is farther than the limit, which widens for short texts, since theirs is noise; below ``GUARD_WORDS`` words the
verdict is not taken at all. References, and which words count as common, are counted over all documents that have a
language.

Edge cases: a null text has no words and fails; without any language in the table (or in an empty one) there is no
reference and the base rules decide alone, distances being null; references are as many as there are languages, a few
hundred at most; repeated rows each get their row; null ids stay;
texts are read whole; other columns are ignored (``accepted`` keeps
them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.batches import CONTINUES, SEPARATOR, Lookup, mix, prefix_hash, release, row_chunks, slice_hash, text_buffer, word_spans

MIN_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
GUARD_WORDS = 30
#: Limits of the two distances, and what is added to them over the square root of the number of words.
CHARACTER_LIMIT, CHARACTER_NOISE = 0.2, 0.9
WORD_LIMIT, WORD_NOISE = 0.42, 0.6
COMMON_WORDS = 64
#: Words of languages that a task counts before it passes the counts on.
COUNTED_WORDS = 100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Character classes: white space, small and capital ASCII letters, digits, marks of prose, other marks, all else.
CLASSES = 7
_CLASS = np.full(256, 5, np.uint8)
_CLASS[SEPARATOR] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 4
_CLASS[0xC0:] = 6

COUNTED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Counts:
    """Of a chunk of texts: the base counts, class histograms, and words as hashes with the text each stands in."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    of_text: np.ndarray


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys equal an earlier one, which equal any other)."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    later, some = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order], some[order] = same[:-1], same[:-1] | same[1:]
    return later, some


def count(raw: np.ndarray, offsets: np.ndarray, rules: bool = True) -> Counts:
    """All counts of the texts at ``offsets``; without ``rules`` only histograms and words."""
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    n, text_of = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letters = ~SEPARATOR[raw]
    begin, end = word_spans(raw, offsets)
    prefix = prefix_hash(raw)
    hashes = slice_hash(prefix, begin, end)
    of_text = text_of[begin]
    starts_char = ~CONTINUES[raw]
    classes = np.bincount(text_of[starts_char] * CLASSES + _CLASS[raw[starts_char]], minlength=n * CLASSES).reshape(n, CLASSES)
    n_words = np.bincount(of_text, minlength=n)
    zero = np.zeros(n, np.int64)
    if not rules:
        return Counts(n_words, zero, zero, zero, zero, classes, hashes, of_text)

    breaks = raw == 0x0A
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first[1:][breaks] = True
    line_begin = np.flatnonzero(first[:-1]) if len(raw) else np.zeros(0, np.int64)
    line_end = np.append(line_begin[1:], len(raw))[: len(line_begin)]
    line_end = line_end - breaks[line_end - 1] if len(line_begin) else line_end
    total = np.concatenate(([0], np.cumsum(letters)))
    has_word = total[line_end] > total[line_begin]
    line_begin, line_end = line_begin[has_word], line_end[has_word]
    line_text = text_of[line_begin]
    again, _ = _repeats(slice_hash(prefix, line_begin, line_end) ^ mix(line_text.astype(np.uint64) + np.uint64(7)))

    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        whole = np.flatnonzero(of_text[WINDOW - 1 :] == of_text[: len(of_text) - WINDOW + 1])
        window = np.zeros(len(whole), np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[whole + k]
        _, some = _repeats(mix(window) ^ mix(of_text[whole].astype(np.uint64) + np.uint64(7)))
        np.add.at(covered, whole[some], 1)
        np.add.at(covered, whole[some] + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    return Counts(
        n_words, _per_text(letters & starts_char, offsets), _per_text(_SYMBOL[raw], offsets),
        np.bincount(line_text[again], minlength=n), np.bincount(of_text[repeated], minlength=n), classes, hashes, of_text,
    )


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``count`` gives these words."""
    raw = [np.frombuffer(x.encode(), np.uint8) for x in words]
    if not raw:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(x) for x in raw])
    return slice_hash(prefix_hash(np.concatenate(raw)), ends - [len(x) for x in raw], ends)


def _word_counts(counts: Counts, common: Lookup, size: int) -> np.ndarray:
    """Histogram of common words by text; the last bin is all other words."""
    n, found = len(counts.n_words), common.find(counts.words)
    found = np.where(found >= 0, found, size)
    return np.bincount(counts.of_text * (size + 1) + found, minlength=n * (size + 1)).reshape(n, size + 1)


def common_words(documents: DataFrame, each: int = COMMON_WORDS) -> list[str]:
    """The most frequent words of each language, counted over all documents that have one."""
    limit = COUNTED_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bytes], int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in sums], pa.string()), pa.array([x.decode() for _, x in sums], pa.string()), pa.array(sums.values(), pa.int64())], names=["lang", "word", "n"])

        for batch in release(batches):
            langs = batch.column(0).dictionary_encode()
            names, which = langs.dictionary.to_pylist(), np.array(langs.indices)
            raw, offsets, _ = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                begin, end = word_spans(own, at)
                lang = which[lo:hi][np.searchsorted(at, begin, "right") - 1]
                keys = slice_hash(prefix_hash(own), begin, end) + mix(lang.astype(np.uint64) + np.uint64(1))
                _, one, n = np.unique(keys, return_index=True, return_counts=True)
                spelled = own.tobytes()
                for k, b, e, m in zip(lang[one].tolist(), begin[one].tolist(), end[one].tolist(), n.tolist(), strict=True):
                    word = (names[k], spelled[b:e])
                    sums[word] = sums.get(word, 0) + m
                if len(sums) > limit:
                    yield counted()
                    sums.clear()
        yield counted()

    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    by_lang = labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return sorted({r["word"] for r in by_lang.withColumn("rank", rank).filter(F.col("rank") <= each).select("word").collect()})


@dataclass
class References:
    """Class and common-word histograms of each language, as shares."""

    languages: list[str]
    words: list[str]
    of_classes: np.ndarray
    of_words: np.ndarray


def references(documents: DataFrame, words: list[str] | None = None) -> References | None:
    """Histograms over all documents that have a language."""
    words = common_words(documents) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Lookup(word_hashes(words))
        sums: dict[str, np.ndarray] = {}
        for batch in release(batches):
            langs = batch.column(0).dictionary_encode()
            names, which = langs.dictionary.to_pylist(), np.array(langs.indices)
            raw, offsets, _ = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                own = count(raw, offsets[lo : hi + 1], rules=False)
                both = np.hstack((own.classes, _word_counts(own, common, len(words))))
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + both[which[lo:hi] == k].sum(0)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(row)), pa.array(range(len(row)), pa.int32()), pa.array(row)], names=["lang", "bin", "n"])

    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rows = labelled.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    table = np.zeros((len(languages), CLASSES + len(words) + 1))
    number = {x: k for k, x in enumerate(languages)}
    for r in rows:
        table[number[r["lang"]], r["bin"]] = r["n"]
    share = [x / np.maximum(x.sum(1, keepdims=True), 1) for x in (table[:, :CLASSES], table[:, CLASSES:])]
    filled = share[0].sum(1) > 0
    return References([x for x, ok in zip(languages, filled, strict=True) if ok], words, share[0][filled], share[1][filled]) if filled.any() else None


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances (base 2) of the rows of p from one histogram q, both as shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left, right = (np.where(x > 0, x * np.log2(x / m), 0).sum(-1) for x in (p, np.broadcast_to(q, p.shape)))
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _measured(found: References | None, column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, row after the last, base counts and the two distances) of each chunk of texts."""
    common = Lookup(word_hashes(found.words)) if found else None
    raw, offsets, _ = text_buffer(column)
    for lo, hi in row_chunks(offsets):
        c = count(raw, offsets[lo : hi + 1])
        distances = [np.full(hi - lo, np.nan)] * 2
        if found:
            tables = (c.classes, _word_counts(c, common, len(found.words)))
            shares = [t / np.maximum(t.sum(1, keepdims=True), 1) for t in tables]
            distances = [np.min([jensen_shannon(p, q) for q in ref], axis=0) for p, ref in zip(shares, (found.of_classes, found.of_words), strict=True)]
        yield lo, hi, [*(x.astype(np.int64) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)), *(np.round(x, 9) for x in distances)]


def verdicts(n_words: np.ndarray, n_repeat_words: np.ndarray, character: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)
    noise = np.sqrt(np.maximum(n_words, 1))
    far = (character > CHARACTER_LIMIT + CHARACTER_NOISE / noise) | (word > WORD_LIMIT + WORD_NOISE / noise)
    return failed, ~failed & ~((n_words >= GUARD_WORDS) & far)


JUDGED = COUNTED + ", character_distance double, word_distance double, base_failed boolean, kept boolean"


def judge(documents: DataFrame, found: References | None = None) -> DataFrame:
    """Per document the base counts, the two distances, base_failed and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(found or references(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            for lo, hi, x in _measured(shared.value, batch.column(1)):
                columns = [*x, *verdicts(x[0], x[4], x[5], x[6])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, from_pandas=True) for c in columns)], names=[n.split()[0] for n in JUDGED.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, JUDGED)


def accepted(documents: DataFrame, found: References | None = None) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(found or references(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            for lo, hi, x in _measured(shared.value, batch.column("text")):
                yield batch.slice(lo, hi - lo).filter(pa.array(verdicts(x[0], x[4], x[5], x[6])[1]))

    return documents.mapInArrow(run, documents.schema)

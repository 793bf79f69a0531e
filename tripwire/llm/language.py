"""Language identification by prediction by partial matching over bytes, with frozen statistics.

Each language has a byte context tree of depth ``ORDER``. The code length of a byte is that of its longest known
context; a context that never saw the byte adds its escape code (escape probability d / (n + d) for d distinct
successors in n) and hands over to the context one byte shorter, at last to a uniform byte. Statistics are frozen
after training, so the code length of every known (context, byte) pair is worked out once for all languages and
prediction is a table lookup for most bytes. The language of least code length wins; ties go to the first by name.

Training reads documents that are not held out and have a language: blocks of ``BLOCK`` bytes of their texts,
``SAMPLE_BYTES`` in all at most on average and as much of each language, chosen by a hash of the document and the
block's number. A language's code lengths don't depend on other languages, so tables hold ``TOGETHER`` languages each and
only the grams that one of them has. That bounds the model, which is broadcast, by the sample, however many
languages share it; the time of a prediction grows with their number.

Edge cases: a null text or one without a letter is ``und`` with score 0 and no code length; so is every text if
nothing can be learned (an empty table, no languages); null ids count as the empty text in the hash; repeated rows
each get their row; texts are read whole; other columns are ignored (``accepted`` keeps them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.batches import Lookup, mix, release, row_chunks, text_buffer, within

ORDER = 4
#: Bytes of training text, shared evenly by the languages, and of the blocks that a hash picks.
SAMPLE_BYTES, BLOCK = 3_000_000, 4096
#: Languages whose trees are in one set of tables.
TOGETHER = 8
#: Bytes that are looked up at once; longer texts go in parts.
_BYTES_AT_ONCE = 250_000
_SHARES = 1 << 30
_LENGTH = np.uint64(56)  # a gram is its bytes, and its length above them

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def id_crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def _grams(raw: np.ndarray, depth: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, grams of ``length`` bytes that end there), within texts."""
    at = np.flatnonzero(depth >= length - 1)
    key = raw[at].astype(np.uint64)
    for k in range(1, length):
        key |= raw[at - k].astype(np.uint64) << np.uint64(8 * k)
    return at, key | (np.uint64(length) << _LENGTH)


def _depth(offsets: np.ndarray) -> np.ndarray:
    """For each byte, how many bytes of the same text come before it."""
    return np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))


def gram_counts(labelled: DataFrame, order: int = ORDER, shares: dict[str, int] | None = None) -> DataFrame:
    """How often each gram of up to ``order`` + 1 bytes occurs in the blocks of each language's texts.

    ``labelled`` has lang, text and, with ``shares`` (of ``_SHARES``, by language), a number ``document`` that picks blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            langs = batch.column(0).dictionary_encode()
            names, which = langs.dictionary, np.array(langs.indices)
            raw, offsets, _ = text_buffer(batch.column(1))
            sizes = np.diff(offsets)
            of_text = np.repeat(np.arange(len(sizes)), -(-sizes // BLOCK))
            number = within(-(-sizes // BLOCK))
            begin = offsets[of_text] + number * BLOCK
            end = np.minimum(begin + BLOCK, offsets[of_text + 1])
            if shares is not None:
                share = np.array([shares[x] for x in names.to_pylist()], np.uint64)[which[of_text]] if len(of_text) else np.zeros(0, np.uint64)
                key = mix(np.array(batch.column(2)).astype(np.uint64)[of_text] + mix(number.astype(np.uint64)))
                taken = key % np.uint64(_SHARES) < share
                of_text, begin, end = of_text[taken], begin[taken], end[taken]
            at = np.concatenate(([0], np.cumsum(end - begin)))
            for lo, hi in row_chunks(at):
                own = np.concatenate([raw[a:b] for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)])
                depth = _depth(at[lo : hi + 1])
                of_byte = np.repeat(which[of_text[lo:hi]], np.diff(at[lo : hi + 1]))
                for length in range(1, order + 2):
                    where, keys = _grams(own, depth, length)
                    for k in np.unique(of_byte).tolist():
                        grams, counts = np.unique(keys[of_byte[where] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([names[k].as_py()] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    columns = ["lang", "text", *(["document"] if shares is not None else [])]
    return labelled.select(*columns).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class _Tables:
    """Trees of a few languages as tables by gram length: what a known gram costs, and what escaping from it costs."""

    many: int
    order: int
    found: list[Lookup]
    cost: list[np.ndarray]
    escape: list[np.ndarray]
    unknown: np.ndarray

    @classmethod
    def fit(cls, many: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int) -> _Tables:
        """From counts of grams by language (numbers under ``many``)."""
        gram = gram.astype(np.uint64)
        length = (gram >> _LENGTH).astype(np.int64)
        found, counts = [], []
        for size in range(1, order + 2):
            keys, which = np.unique(gram[length == size], return_inverse=True)
            table = np.zeros((len(keys), many))
            table[which, lang[length == size]] = n[length == size]
            found.append(keys)
            counts.append(table)
        lookups = [Lookup(keys) for keys in found]
        low = np.uint64((1 << 56) - 1)
        cost, escape = [], []
        total, distinct = counts[0].sum(0, keepdims=True), (counts[0] > 0).sum(0, keepdims=True).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            unknown = np.where(total > 0, np.log2((total + distinct) / distinct), 0)[0] + 8
            for size in range(1, order + 2):
                keys, table = found[size - 1], counts[size - 1]
                if size == 1:
                    up, of = np.zeros(len(keys), np.int64), (total, distinct)
                    shorter = np.broadcast_to(8.0, table.shape)
                else:
                    up = lookups[size - 2].find(((keys & low) >> np.uint64(8)) | (np.uint64(size - 1) << _LENGTH))
                    # successors of each context, from the grams themselves
                    of = tuple(np.zeros((len(found[size - 2]), many)) for _ in range(2))
                    np.add.at(of[0], up, table)
                    np.add.at(of[1], up, table > 0)
                    escape.append(np.where(of[0] > 0, np.log2((of[0] + of[1]) / of[1]), 0).astype(np.float32))
                    tail = lookups[size - 2].find((keys & np.uint64((1 << (8 * (size - 1))) - 1)) | (np.uint64(size - 1) << _LENGTH))
                    shorter = cost[-1][tail]
                n_of, d_of = of[0][up], of[1][up]
                own = np.where(table > 0, np.log2((n_of + d_of) / table), np.where(n_of > 0, np.log2((n_of + d_of) / d_of), 0) + shorter)
                cost.append(own.astype(np.float32))
        return cls(many, order, lookups, cost, escape, unknown.astype(np.float32))

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; a long text goes in parts, each after the bytes that are its context."""
        if len(offsets) == 2 and offsets[1] - offsets[0] > _BYTES_AT_ONCE + self.order:
            parts = range(int(offsets[0]), int(offsets[1]), _BYTES_AT_ONCE)
            context = [min(self.order, begin - parts.start) for begin in parts]
            bounds = [np.array([begin - c, min(begin + _BYTES_AT_ONCE, offsets[1])]) for begin, c in zip(parts, context, strict=True)]
            return sum(self._bits(raw, b, c) for b, c in zip(bounds, context, strict=True))
        return self._bits(raw, offsets)

    def _bits(self, raw: np.ndarray, offsets: np.ndarray, skipped: int = 0) -> np.ndarray:
        """The same for texts at once; the first ``skipped`` bytes don't count."""
        depth = _depth(offsets)
        raw = raw[offsets[0] : offsets[-1]]
        out = np.zeros((len(raw), self.many), np.float32)
        left = np.arange(len(raw))
        for size in range(self.order + 1, 0, -1):
            own = left if size == 1 else left[depth[left] >= size - 1]
            if not len(own):
                continue
            key = np.zeros(len(own), np.uint64)
            for k in range(size):
                key |= raw[own - k].astype(np.uint64) << np.uint64(8 * k)
            got = self.found[size - 1].find(key | (np.uint64(size) << _LENGTH))
            hit = got >= 0
            if hit.all() and len(own) == len(left):
                out[own] += self.cost[size - 1][got]
                break
            out[own[hit]] += self.cost[size - 1][got[hit]]
            miss = own[~hit]
            if size == 1:
                out[miss] += self.unknown
                break
            context = self.found[size - 2].find((key[~hit] >> np.uint64(8)) | (np.uint64(size - 1) << _LENGTH))
            known = context >= 0
            out[miss[known]] += self.escape[size - 2][context[known]]
            done = np.zeros(len(raw), bool)
            done[own[hit]] = True
            left = left[~done[left]]
        out[:skipped] = 0
        filled = np.flatnonzero(np.diff(offsets))
        total = np.zeros((len(offsets) - 1, self.many))
        if len(filled):
            total[filled] = np.add.reduceat(out, (offsets[:-1] - offsets[0])[filled], axis=0, dtype=np.float64)
        return total


@dataclass
class ContextTrees:
    """All languages' trees, ``TOGETHER`` languages to a set of tables."""

    languages: list[str]
    tables: list[_Tables]

    @classmethod
    def fit(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER) -> ContextTrees:
        """From counts of grams by language (numbers into ``languages``)."""
        tables = []
        for first in range(0, len(languages), TOGETHER):
            own = np.flatnonzero((lang >= first) & (lang < first + TOGETHER))
            tables.append(_Tables.fit(min(TOGETHER, len(languages) - first), lang[own] - first, gram[own], n[own], order))
        return cls(languages, tables)

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        return np.hstack([tables.bits(raw, offsets) for tables in self.tables])


def train(documents: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> ContextTrees | None:
    """Trees for every language of the documents that are not held out, or None if there is none."""
    usable = documents.select("doc_id", "lang", "text").filter((id_crc() % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["size"] for r in usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    languages = sorted(x for x, size in sizes.items() if size)
    if not languages:
        return None
    shares = {name: int(min(1, sample_bytes / len(languages) / sizes[name]) * _SHARES) for name in sizes if sizes[name]}
    filled = usable.filter(F.octet_length("text") > 0)
    counts = gram_counts(filled.withColumn("document", F.xxhash64(F.lit(11), "doc_id", "text")), order, shares).toArrow()
    if not counts.num_rows:
        return None
    lang = counts["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    languages = sorted(names)
    place = {name: k for k, name in enumerate(languages)}
    number = np.array([place[x] for x in names])[np.array(lang.indices)]
    return ContextTrees.fit(languages, number, counts["gram"].to_numpy(), counts["n"].to_numpy(), order)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    ascii_ = np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw])))
    out = np.diff(ascii_[offsets]) > 0
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def judged(trees: ContextTrees | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits per byte or NaN) of each text; the score is its share among the languages' likelihoods per 64 bytes."""
    raw, offsets, _ = text_buffer(column)
    names, scores, rates = [], np.zeros(len(column)), np.full(len(column), np.nan)
    for lo, hi in row_chunks(offsets, _BYTES_AT_ONCE):
        if trees is None:
            names += ["und"] * (hi - lo)
            continue
        bits, size = trees.bits(raw, offsets[lo : hi + 1]), np.maximum(np.diff(offsets[lo : hi + 1]), 1)
        best, least, ok = bits.argmin(1), bits.min(1), has_letter(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        per = np.exp2((least[:, None] - bits) / np.maximum(size / 64, 1)[:, None])
        scores[lo:hi] = np.where(ok, 1 / per.sum(1), 0)
        rates[lo:hi] = np.where(ok, least / size, np.nan)
        names += [trees.languages[b] if x else "und" for b, x in zip(best, ok, strict=True)]
    return names, scores, rates


def predict(documents: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits_per_byte."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            names, scores, rates = judged(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(rates, from_pandas=True)], names=[x.split()[0] for x in PREDICTED.split(", ")])

    return documents.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "text").mapInArrow(run, PREDICTED)


def identify(documents: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    return predict(documents, train(documents, order, sample_bytes))


def accepted(documents: DataFrame, trees: ContextTrees | None = None, worst_bits: float = 8.0) -> DataFrame:
    """The documents that are in some language: with a letter, and cheaper than ``worst_bits`` a byte (8: no better than uniform bytes)."""
    shared = documents.sparkSession.sparkContext.broadcast(trees or train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            names, _, rates = judged(shared.value, batch.column("text"))
            yield batch.filter(pa.array(np.array([x != "und" for x in names], bool) & ~(rates >= worst_bits)))

    return documents.mapInArrow(run, documents.schema)

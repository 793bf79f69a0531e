"""Byte-level BPE: boundaries by codepoint classes and transition-function scans, merges cached by pre-token.

The pre-token pattern of the rank files is a finite automaton once each codepoint knows whether the next
one is white space and whether an apostrophe opens a contraction. A block of text is then a function from
states to states; functions of neighbouring blocks compose associatively, so every boundary of a record batch
is found by array operations, without a regular expression and without a loop over characters.

Edge cases: a null text encodes as the empty list; an empty list decodes to no bytes; an id outside the
vocabulary raises ``ValueError``; texts of any length are taken whole; rows keep all their columns, except that
the output columns replace columns of the same names.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tripwire.llm.batches import Lookup, prefix_hash, release, row_chunks, slice_hash, text_buffer, within

#: Pre-tokens that a Python worker keeps encoded; beyond it the cache starts anew.
CACHE_PIECES = 150_000

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def codepoint_classes() -> np.ndarray:
    """The class of each codepoint: letter, number, white space or other, as the library's tables of characters have it.

    An encoding of single bytes whose pattern is one class leaves of a text just the characters of that class.
    """
    if not _classes:
        table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            bytes_only = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            table[np.frombuffer(bytes(bytes_only.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


# Symbols of the automaton, and its states.
_PAD, _L, _N, _O, _SHORT, _LONG, _RUN, _LAST, _JOIN = range(9)
_NONE, _IN_L, _IN_N, _IN_O, _IN_RUN, _JOINED, _ONE_MORE, _TWO_MORE = range(8)
_FIRST = 16  # added to the symbol of a text's first codepoint


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token starts), both by symbol and state."""
    step, starts = np.zeros((32, 8), np.uint8), np.zeros((32, 8), bool)
    step[_PAD] = range(8)
    for symbol, own in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O), (_SHORT, _IN_O), (_LONG, _IN_O), (_RUN, _IN_RUN)):
        step[symbol], starts[symbol] = own, True
        starts[symbol, own] = False
        if symbol != _RUN:
            starts[symbol, _JOINED] = False
    for symbol, then in ((_SHORT, _ONE_MORE), (_LONG, _TWO_MORE)):
        step[symbol, starts[symbol]] = then
    step[_L, _ONE_MORE], step[_L, _TWO_MORE] = _NONE, _ONE_MORE
    starts[_L, [_ONE_MORE, _TWO_MORE]] = False
    step[_LAST], starts[_LAST] = _NONE, True
    step[_JOIN], starts[_JOIN] = _JOINED, True
    step[_FIRST:], starts[_FIRST:] = step[:16, :1], starts[:16, :1]
    return step, starts


_STEP, _STARTS = _automaton()
_BLOCK = 128
_NEVER = np.iinfo(np.int32).max
#: Bytes of a pre-token that is merged together with others of its length; longer ones are merged alone, with a heap.
_SHORT_PIECE = 64


def _symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each codepoint; ``first`` are the positions where texts start."""
    kinds = codepoint_classes()[codes]
    after = np.zeros((3, len(codes)), np.uint32)  # the next two codepoints of the same text, else 0
    for k in (1, 2):
        after[k, :-k] = codes[k:]
        for j in range(1, k + 1):
            after[k, first[first >= j] - j] = 0
    last = np.ones(len(codes), bool)
    last[:-1] = False
    last[first[first > 0] - 1] = True
    solid = np.ones(len(codes), bool)  # what follows is not white space
    solid[:-1] = kinds[1:] != _SPACE
    solid[last] = False
    symbols = kinds.copy()
    space = kinds == _SPACE
    symbols[space] = np.where(solid[space], np.where(codes[space] == 0x20, _JOIN, _LAST), _RUN)
    at = np.flatnonzero(codes == 0x27)
    one, two = after[1, at], after[2, at]
    letter = [ord(c) for c in "stmdrvle"]
    s, t, m, d, r, v, el, e = letter
    symbols[at[np.isin(one, [s, t, m, d])]] = _SHORT
    symbols[at[((two == e) & np.isin(one, [r, v])) | ((one == el) & (two == el))]] = _LONG
    symbols[first] += _FIRST
    return symbols


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start, in codepoints of concatenated texts that start at ``first``."""
    if not len(codes):
        return np.zeros(0, np.int64)
    symbols = _symbols(codes, first)
    blocks = -(-len(symbols) // _BLOCK)
    lanes = np.zeros(blocks * _BLOCK, np.intp)
    lanes[: len(symbols)] = symbols
    lanes = np.ascontiguousarray(lanes.reshape(blocks, _BLOCK).T) * 8
    step, starts = _STEP.ravel(), _STARTS.ravel()
    through = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))  # each block as a function of its entry state
    for row in lanes:
        through = step[row[:, None] + through]
    reach = 1
    while reach < blocks:  # compose: through[b] becomes the function of all blocks up to b
        through[reach:] = np.take_along_axis(through[reach:], through[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = through[:-1, _NONE]
    flags = np.empty(lanes.shape, bool)
    for k, row in enumerate(lanes):
        row = row + state
        flags[k], state = starts[row], step[row]
    return np.flatnonzero(flags.T.ravel()[: len(symbols)])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        rank, i = heapq.heappop(heap)
        if gone[i] or (j := ends[i]) >= n or ranks.get(piece[i : ends[j]]) != rank:
            continue
        gone[j], ends[i] = 1, ends[j]
        if ends[i] < n:
            before[ends[i]] = i
            if (new := ranks.get(piece[i : ends[ends[i]]])) is not None:
                heapq.heappush(heap, (new, i))
        if (b := before[i]) >= 0 and (new := ranks.get(piece[b : ends[i]])) is not None:
            heapq.heappush(heap, (new, b))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """A vocabulary and the pre-tokens encoded so far."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.forget()

    @cached_property
    def pairs(self) -> tuple[Lookup, np.ndarray]:
        """Pairs of ids whose bytes together are a token, and that token's id; only merging needs them."""
        joins = np.array([(self.ranks[a], self.ranks[b], rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := token[:k]) in self.ranks and (b := token[k:]) in self.ranks], np.int32).reshape(-1, 3)
        return Lookup((joins[:, 0].astype(np.uint64) << np.uint64(32)) | joins[:, 1].astype(np.uint64)), np.append(joins[:, 2], 0)

    def forget(self) -> None:
        """Empties the cache: numbers of pre-tokens by hash, and by number their ids and codepoints."""
        self.known: dict[int, int] = {}
        self.pool, self.pool_at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.spelled, self.spelled_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _added(self, text: str, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Encodes the pre-tokens [first, last) and returns their numbers."""
        got = self.merged([text[a:b].encode() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        numbers = len(self.pool_at) - 1 + np.arange(len(got))
        sizes, chars = np.fromiter(map(len, got), np.int64, len(got)), last - first
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(got), np.int32, sizes.sum())))
        self.pool_at = np.concatenate((self.pool_at, self.pool_at[-1] + np.cumsum(sizes)))
        self.spelled = np.concatenate((self.spelled, codes[np.repeat(first, chars) + within(chars)]))
        self.spelled_at = np.concatenate((self.spelled_at, self.spelled_at[-1] + np.cumsum(chars)))
        return numbers

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, joined = self.pairs
        found = pairs.find((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
        return np.where(found >= 0, joined[found], _NEVER)

    def _merge_equal(self, rows: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of bytes: ``merge`` for pre-tokens of one length, all at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
        ids, left = self.of_byte[rows], np.arange(len(rows))
        ranks = self._ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(left):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(left), np.int64)
            least = ranks[np.arange(len(left)), at] if ranks.shape[1] else np.full(len(left), _NEVER)
            if (over := least == _NEVER).any():
                for k, row in zip(left[over].tolist(), ids[over], strict=True):
                    out[k] = row
                on = ~over
                left, ids, ranks, at, least = left[on], ids[on], ranks[on], at[on], least[on]
                if not len(left):
                    break
            every, width = np.arange(len(left)), ids.shape[1]
            ids[every, at] = least
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(left), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(len(left), width - 2)
            for shift, inside in ((0, at < width - 2), (-1, at > 0)):
                row, column = every[inside], at[inside] + shift
                ranks[row, column] = self._ranks_of(ids[row, column], ids[row, column + 1])
        return out

    def merged(self, pieces: list[bytes]) -> list:
        """Ids of each pre-token."""
        out: list = [None if (whole := self.ranks.get(x)) is None else [whole] for x in pieces]
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(pieces):
            if out[k] is None:
                if len(x) <= _SHORT_PIECE:
                    by_length.setdefault(len(x), []).append(k)
                else:
                    out[k] = merge(x, self.ranks)
        for length, which in by_length.items():
            rows = np.frombuffer(b"".join(pieces[k] for k in which), np.uint8).reshape(len(which), length)
            for k, ids in zip(which, self._merge_equal(rows), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begins = np.cumsum(lengths) - lengths
        starts = boundaries(codes, begins[lengths > 0])
        ends = np.append(starts[1:], len(codes))
        keys, where, which = np.unique(slice_hash(prefix_hash(codes), starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self.forget()
        known, keys = self.known, keys.tolist()
        new = [k for k, key in enumerate(keys) if key not in known]
        if new:
            known.update(zip([keys[k] for k in new], self._added(text, codes, starts[where[new]], ends[where[new]]).tolist(), strict=True))
        number = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[which]
        # equal hashes are only a hint: pre-tokens that are spelled otherwise get numbers of their own
        chars = ends - starts
        other = np.diff(self.spelled_at)[number] != chars
        there = np.minimum(np.repeat(self.spelled_at[number] - starts, chars) + np.arange(len(codes)), len(self.spelled) - 1)
        wrong = codes != self.spelled[there]
        if wrong.any() or other.any():
            other[np.searchsorted(starts, np.flatnonzero(wrong), "right") - 1] = True
            number[other] = self._added(text, codes, starts[other], ends[other])
        counts = (self.pool_at[1:] - self.pool_at[:-1])[number]
        ids = self.pool[np.repeat(self.pool_at[number], counts) + within(counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        of_text = np.searchsorted(starts, np.append(begins, len(codes)))
        return ids, np.diff(total[of_text])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, how many bytes each id has)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is outside the vocabulary")
        sizes = self.lengths[ids]
        return self.bytes[np.repeat(self.offsets[ids], sizes) + within(sizes)], sizes


_encoders: dict[int, Encoder] = {}


def _encoder(file: bytes) -> Encoder:
    if (key := hash(file)) not in _encoders:
        _encoders[key] = Encoder(file)
    return _encoders[key]


def _appended(df: DataFrame, new: list[tuple[str, T.DataType]], make) -> DataFrame:
    """``df`` with the columns that ``make(column batch)`` returns; they replace columns of the same names."""
    kept = [f for f in df.schema.fields if f.name not in {n for n, _ in new}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in release(batches):
            for lo, hi, arrays in make(batch):
                own = [batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*names, *(n for n, _ in new)])

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in new)]))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """``df`` with the ids of each whole text and the byte offset at which each id's bytes start."""
    file = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def make(batch: pa.RecordBatch):
        own = _encoder(file.value)
        column = batch.column(text)
        _, ends, _ = text_buffer(column)
        for lo, hi in row_chunks(ends):
            got, counts = own.encode([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
            at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            sizes = own.lengths[got]
            begin = np.cumsum(sizes) - sizes
            begin -= np.repeat(begin[np.minimum(at[:-1], len(begin) - 1)] if len(begin) else at[:-1], counts)
            yield lo, hi, [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (got, begin)]

    several = T.ArrayType(T.IntegerType())
    return _appended(df, [(ids, several), (offsets, several)], make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each list of ids stands for; a null list gives no bytes."""
    file = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def make(batch: pa.RecordBatch):
        own = _encoder(file.value)
        column = batch.column(ids)
        counts = np.array(column.value_lengths().fill_null(0), np.int64)
        at = np.concatenate(([0], np.cumsum(counts)))
        values = np.array(column.flatten(), np.int64)
        for lo, hi in row_chunks(at, 1_000_000):
            raw, sizes = own.decode(values[at[lo] : at[hi]])
            total = np.concatenate(([0], np.cumsum(sizes)))[at[lo : hi + 1] - at[lo]]
            yield lo, hi, [pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(raw)])]

    return _appended(df, [(decoded, T.BinaryType())], make)

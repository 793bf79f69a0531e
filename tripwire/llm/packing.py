"""Packing of token pieces into sequences: dominance reduction, then best fit.

Each document becomes its ids and an end id; only documents over ``capacity`` are cut, into pieces of ``capacity``
ids of which the first may be shorter. Pieces are dealt by a hash of their content and of their row's number in its task into
groups of bounded size, so that repeated rows part, and each group is packed on its own, so no task or driver sees them all; a group wastes a part of one sequence.

Within a group sizes are counted. For the largest size still open, a set of pieces that provably dominates every
other set with it is fixed: the piece alone where nothing fits beside it; with the piece that fills it exactly;
with the largest that fits, where no two pieces fit, or where no two that fit weigh more and three don't fit. The
rest is packed best fit, largest first.

Edge cases: a null text is empty and still has its end id; repeated rows are packed as often as they occur; an
empty table gives an empty result; other columns are not read; texts of any length are taken whole; a special
token's string in a text is that token, as the tokenizer has it by default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.llm.batches import release, row_chunks, text_buffer

#: Documents whose pieces are packed together, on average.
GROUP_DOCUMENTS = 8_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, packing_group int"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def ranks_of(vocabulary: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks by token bytes, ids of the special tokens), from a byte-level BPE file in JSON whose merges are in the order of their ids."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    content = json.loads(vocabulary)
    special = {x["content"]: x["id"] for x in content.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): rank for token, rank in content["model"]["vocab"].items() if token not in special}, special


def _encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks, special = ranks_of(vocabulary)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_pieces(documents: DataFrame, vocabulary: str, pattern: str, groups: int, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of each document, each with the group that it is packed in."""
    file = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _encoding(file.value, pattern), 0
        for batch in release(batches):
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi in row_chunks(text_buffer(texts)[1]):
                rows: list[tuple] = []
                for key, text in zip(keys.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    ids = np.array([*coder.encode(text or "", allowed_special="all"), end_id], "<u4")
                    begin, k, row = 0, 0, row + 1
                    while begin < len(ids):
                        size = (len(ids) - begin) % capacity or capacity
                        crc = zlib.crc32(ids[begin : begin + size].tobytes())
                        rows.append((key, k, begin, size, crc, zlib.crc32(f"{key} {k} {crc} {row}".encode()) % groups))
                        begin, k = begin + size, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def dominating_sets(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Sets of sizes that some best packing has, each with how often; they are taken out of ``counts``.

    ``counts[s]`` is how many pieces have size s; the last index is the capacity.
    """
    capacity, fixed = len(counts) - 1, []

    def take(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((sizes, times))
        for s in sizes:
            counts[s] -= times

    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while counts[size]:
                rest, free = capacity - size, counts.copy()
                free[size] -= 1
                fits = np.flatnonzero(free[: rest + 1])
                if not len(fits):  # nothing fits beside it
                    take((size,), int(counts[size]) if 2 * size > capacity else 1)
                elif (large := int(fits[-1])) == rest:  # fills it exactly
                    take((size, large), int(counts[size]) // 2 if large == size else int(min(counts[size], counts[large])))
                else:
                    least = np.repeat(fits[:3], np.minimum(free[fits[:3]], 3))[:3]
                    two, three = least[:2].sum(), least.sum()
                    if len(least) >= 2 and two <= rest:
                        if len(least) >= 3 and three <= rest:
                            break  # sets of four pieces: not decided here
                        under = fits[np.searchsorted(fits, rest - fits, "right") - 1]
                        pair = fits + under
                        ok = (fits + fits[0] <= rest) & ((under != fits) | (free[fits] >= 2))
                        # a size that has one piece can't pair with itself: the next smaller one then
                        lone = (fits + fits[0] <= rest) & ~ok
                        smaller = np.searchsorted(fits, under[lone]) - 1
                        pairs = np.concatenate((pair[ok], (fits[lone] + fits[smaller])[smaller >= 0], [0]))
                        if pairs.max() > large:
                            break
                    take((size, large), 1)
                changed = True
    return fixed


def best_fit(counts: np.ndarray) -> list[list[int]]:
    """The rest, largest first, each into the fullest sequence that it fits in."""
    capacity, bins = len(counts) - 1, []
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask = 0  # of the rooms that some sequence has
    for size in range(capacity, 0, -1):
        for _ in range(int(counts[size])):
            if above := mask >> size:
                room = size + (above & -above).bit_length() - 1
                own = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
            else:
                room, own = capacity, []
                bins.append(own)
            own.append(size)
            by_room[room - size].append(own)
            mask |= 1 << (room - size)
    return bins


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size."""
    counts = np.bincount(sizes, minlength=capacity + 1)
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(counts)
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    number = 0
    rest = counts.copy()
    fixed = dominating_sets(rest)
    used = [(own, times) for own, times in fixed] + [(tuple(own), 1) for own in best_fit(rest)]
    for own, times in used:
        at = 0
        for size in own:
            for k in range(times):
                ends[size] -= 1
                item = order[ends[size]]
                sequence[item], offset[item] = number + k, at
            at += size
        number += times
    return sequence, offset


def pack(documents: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, -(-documents.count() // group_documents))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack_sizes(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["packing_group"].astype("int64") * (1 << 40) + sequence
        pdf["offset"] = offset
        return pdf.drop(columns="packing_group")

    pieces = token_pieces(documents, vocabulary, pattern, groups, capacity, end_id)
    return pieces.groupBy("packing_group").applyInPandas(run, PACKED)


def packed_tokens_lower_bound(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """How many sequences there are, and how many any packing needs at least."""
    return packed.agg(F.countDistinct("sequence_id").alias("n_sequences"), F.ceil(F.sum("length") / capacity).alias("at_least"))

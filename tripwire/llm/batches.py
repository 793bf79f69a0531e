"""Arrow string columns as byte buffers, for operators that work on whole record batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step holds, unless a single text is longer.
CHUNK_BYTES = 500_000


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets into them, which rows are not null); a null counts as empty."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0], valid


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) that hold at most ``limit`` bytes, or a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... restarting for each length: [2, 3] gives 0 1 0 1 2."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Primes just below 2^31, and a base for each.
_PRIMES, _BASES = (2147483647, 2147483629), (1153906873, 1640531513)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to n - 1, and those of its inverse, modulo the prime."""
    if which not in _powers or len(_powers[which][0]) < n:
        prime, made = _PRIMES[which], []
        for base in (_BASES[which], pow(_BASES[which], -1, prime)):
            powers = np.ones(1, np.uint64)
            while len(powers) < max(n, 1 << 16):
                powers = np.concatenate((powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)))
            made.append(powers)
        _powers[which] = tuple(made)
    return _powers[which]


def _running_sums(values: np.ndarray, bits: int, prime: int) -> np.ndarray:
    """Sums of the first 0, 1, ... of values under 2^bits, congruent modulo the prime; the sums start anew before they overflow."""
    n, width = len(values), 1 << (63 - bits)
    out = np.zeros(n + 1, np.uint64)
    if n <= width:
        np.cumsum(values, out=out[1:])
        return out
    rows = np.zeros((-(-n // width), width), np.uint64)
    rows.ravel()[:n] = values
    np.cumsum(rows, axis=1, out=rows)
    carried = np.cumsum(rows[:, -1] % np.uint64(prime)) % np.uint64(prime)
    rows[1:] += carried[:-1, None]
    out[1:] = rows.ravel()[:n]
    return out


def prefix_hash(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Polynomial prefix sums of an array of bytes or codepoints modulo two primes, for ``slice_hash``."""
    values = codes.astype(np.uint64) + np.uint64(1)
    bits = 31 + (9 if codes.dtype == np.uint8 else 22)
    return [(k, _running_sums(values * _powers_of(k, len(codes) + 1)[0][: len(codes)], bits, _PRIMES[k])) for k in range(len(_PRIMES))]


def slice_hash(prefix: list[tuple[int, np.ndarray]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hashes, scrambled to 64, of the slices [start, end) of the codes that ``prefix`` was made from.

    Two different slices of n codes that don't know the bases agree with odds of about (n / 2^31)^2.
    """
    out = np.zeros(len(starts), np.uint64)
    for k, sums in prefix:
        prime = np.uint64(_PRIMES[k])
        _, down = _powers_of(k, len(sums))
        out = (out << np.uint64(31)) | ((sums[ends] % prime + prime - sums[starts] % prime) * down[starts] % prime)
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, Arrow's pool gives back what it holds, so that an idle worker is small."""
    yield from batches
    pa.default_memory_pool().release_unused()


class Lookup:
    """Positions of 64-bit keys in a fixed list of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.value[at] < 0
            self.value[at[free]] = left[free]  # of those that want one slot, the last gets it
            won = self.value[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.wrap

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        keys = keys.astype(np.uint64, copy=False)
        at = self._home(keys)
        out = self.value[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.wrap
            out[left] = self.value[at]
            on = (out[left] >= 0) & (self.keys[at] != keys[left])
            left, at = left[on], at[on]
        return out


CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes other than space and 09-0D, within the texts at ``offsets`` (from 0)."""
    letters = ~SEPARATOR[raw]
    opens, closes = letters.copy(), letters.copy()
    opens[1:] &= ~letters[:-1]
    closes[:-1] &= ~letters[1:]
    begins, ends = offsets[:-1], offsets[1:]
    filled = ends > begins
    opens[begins[filled]] = letters[begins[filled]]
    closes[ends[filled] - 1] = letters[ends[filled] - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1

"""NumPy kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def fold_table() -> np.ndarray:
    """Identity, but A-Z becomes a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = fold_table()
# runs of [^\x20\x09-\x0D]
NOT_SPACE = ~byte_table([(0x09, 0x0D), (0x20, 0x20)])
# runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F], after folding
ALNUM = byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])


@dataclass
class Texts:
    """Texts laid end to end; row r is ``data[offsets[r]:offsets[r + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Texts]:
    """Consecutive rows of a string column, at most ``limit`` bytes or one row a piece.

    A missing text is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        body = np.zeros(0, dtype=np.uint8)
    else:
        body = np.frombuffer(data, dtype=np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield Texts(body[at[start] : at[stop]], at[start : stop + 1] - at[start], start)
        start = stop


@lru_cache(maxsize=4)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)

    def table(b: int) -> np.ndarray:
        out = np.full(length, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return table(base), table(inverse)


_LETTER = mix(np.arange(256, dtype=np.uint64), 7)


def _span_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(size).bit_length()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``data[start:end]``; spans are sorted and do not overlap much.

    Works in pieces, so that temporary arrays stay near ``PIECE`` bytes times 32.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        upto = int(ends[stop - 1])
        power, inverse = _span_table(upto - base + 1)
        total = np.zeros(upto - base + 1, dtype=np.uint64)
        np.cumsum(_LETTER[data[base:upto]] * power[: upto - base], out=total[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix((total[e] - total[s]) * inverse[s], 1)
        at = stop
    return out


@dataclass
class Words:
    """Words of many texts; those of row r are ``offsets[r]:offsets[r + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray


def words(texts: Texts, inside: np.ndarray, fold: bool = True, hashed: bool = True) -> Words:
    """Maximal runs of bytes that ``inside`` accepts; no run crosses a row."""
    data = FOLD[texts.data] if fold else texts.data
    part = inside[data]
    before = np.empty_like(part)
    before[1:], before[:1] = part[:-1], False
    rows = texts.offsets[:-1][texts.offsets[:-1] < len(data)]
    before[rows] = False
    starts = np.flatnonzero(part & ~before)
    after = np.empty_like(part)
    after[:-1], after[-1:] = part[1:], False
    last = texts.offsets[1:][texts.offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(part & ~after) + 1
    offsets = np.searchsorted(starts, texts.offsets)
    hashes = span_hashes(data, starts, ends) if hashed else np.zeros(0, dtype=np.uint64)
    return Words(starts, ends, offsets, hashes)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (also across rows; the caller masks those)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64), 11) | np.uint64(1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        total += hashes[i : i + count] * factors[i]
    return mix(total, n)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of every ``width`` consecutive values, the rightmost of equals."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, span = values, np.arange(len(values), dtype=np.int64), 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        right = best[step:] <= best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        span += step
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Lookup:
    """Values of different integer keys, none of them -1, in one hashed table; 0 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=values.dtype)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == -1
            # of several keys that want one slot, the first gets it
            takers = left[free]
            _, first = np.unique(slot[takers], return_index=True)
            won = takers[first]
            self.keys[slot[won]] = keys[won]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of every key, and whether it has one."""
        slot = self._slot(keys)
        held = self.keys[slot]
        known = held == keys
        value = np.where(known, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~known & (held != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held, wanted = self.keys[slot], keys[left]
            hit = held == wanted
            value[left[hit]] = self.values[slot[hit]]
            known[left[hit]] = True
            go = ~hit & (held != -1)
            left, slot = left[go], slot[go]
        return value, known

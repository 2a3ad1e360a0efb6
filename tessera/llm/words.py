"""Words of Arrow string columns as numpy arrays, without a Python object for each word.

The texts of a slice are joined into one byte buffer. A table of 256 entries says which bytes
separate words (all separators used here are ASCII, so UTF-8 text can be split by bytes).
Hashes are polynomials modulo 2^64 over prefix sums, so that every word, shingle or window of a
slice is hashed by a few vector operations. Whatever is decided by a hash of windows is compared
by its bytes afterwards where the operator's contract needs exact results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)


def _table(separators: set[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[sorted(separators)] = True
    return out


#: Separators of the words `[^\x20\x09-\x0D]+`.
SPACES = _table({0x20, *range(0x09, 0x0E)})
#: Separators of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower case.
NOT_ALNUM = _table({*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Values whose prefix sums are held at once, and ranges are hashed within; a longer range is hashed in pieces.
BLOCK = 1 << 20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as a block and a range that begins in it need."""

    def __init__(self, base: np.uint64):
        self.base = int(base)
        self.up, self.down = (self._powers(b) for b in (self.base, pow(self.base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        steps = np.full(1 << 16, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            # a power of i is that of its high part times that of its low part
            size = 1 << 16
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                low = getattr(self, name)[:size]
                high = np.array([pow(base, size * k, 1 << 64) for k in range(-(-n // size))], dtype=np.uint64)
                setattr(self, name, (high[:, None] * low[None, :]).ravel())


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)


def _within(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    powers.grow(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers.up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers.down[starts]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A polynomial of each range of the values; starts ascend. Memory is that of two blocks, however many values there are."""
    if len(values) <= 2 * BLOCK:
        return _within(values, starts, ends, powers)
    out = np.empty(len(starts), dtype=np.uint64)
    wide = ends - starts > BLOCK
    for i in np.flatnonzero(wide).tolist():
        total = 0
        for k, at in enumerate(range(int(starts[i]), int(ends[i]), BLOCK)):
            part = values[at : min(at + BLOCK, int(ends[i]))]
            total += int(_within(part, np.zeros(1, dtype=np.int64), np.array([len(part)]), powers)[0]) * pow(powers.base, k * BLOCK, 1 << 64)
        out[i] = total & 0xFFFFFFFFFFFFFFFF
    bounds = np.searchsorted(starts, np.arange(0, len(values) + BLOCK, BLOCK))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        rows = a + np.flatnonzero(~wide[a:b])
        if len(rows):
            lo = k * BLOCK
            out[rows] = _within(values[lo : int(ends[rows].max())], starts[rows] - lo, ends[rows] - lo, powers)
    return out


@dataclass
class Words:
    """Words of a slice. `text` holds every word followed by one space; starts and ends are byte
    positions in it, `doc` is each word's row in the slice, `first` the first word of each row
    (one more entry than rows)."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        h = _ranges(self.text, self.starts, self.ends, _BYTES)
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _STEP)

    def joined(self, first: int, last: int) -> bytes:
        """Words first..last-1 joined by one space."""
        return self.text[self.starts[first] : self.ends[last - 1]].tobytes() if last > first else b""


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, whatever rows they are in."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    at = np.arange(len(h) - n + 1)
    return mix(_ranges(h, at, at + n, _WORDS) + np.uint64(n))


def same_row(doc: np.ndarray, n: int) -> np.ndarray:
    """For all runs of n words, whether they lie in one row."""
    return doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.empty(0, dtype=bool)


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    if len(a) < n:
        return a[:0]
    k, out = 1, a
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    size = len(a) - n + 1
    return np.minimum(out[:size], out[n - k : n - k + size])


def split(texts: list[bytes], separators: np.ndarray = SPACES, fold: np.ndarray = SAME) -> Words:
    """Words of some texts; an empty text has none."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if fold is not SAME:
        data = fold[data]
    gap = separators[data]
    edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    starts, ends = edges[0::2], edges[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    first = np.searchsorted(starts, begins)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    keep = ~gap
    after = ends[ends < len(data)]
    keep[after] = True
    text = data[keep]
    sizes = ends - starts
    at = np.zeros(len(starts), dtype=np.int64)
    if len(at):
        np.cumsum(sizes[:-1] + 1, out=at[1:])
        text[np.minimum(at + sizes, len(text) - 1)] = 0x20
    return Words(text, at, at + sizes, doc, first)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows with about `most` bytes; null is the empty text."""
    rows: list[bytes] = []
    size = begin = 0
    for i, x in enumerate(column.cast(pa.large_binary()).to_pylist()):
        x = x or b""
        if rows and size + len(x) > most:
            yield begin, rows
            rows, size, begin = [], 0, i
        rows.append(x)
        size += len(x) + 1
    if rows:
        yield begin, rows


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """data[starts[0]:ends[0]] + data[starts[1]:ends[1]] + ..."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return b""
    offset = np.zeros(len(sizes), dtype=np.int64)
    np.cumsum(sizes[:-1], out=offset[1:])
    return data[np.arange(total) + np.repeat(starts - offset, sizes)].tobytes()


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]

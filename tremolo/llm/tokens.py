"""Words and hashes of whole Arrow text columns, vectorised with numpy.

The operators of this subpackage that work inside ``mapInArrow`` share these helpers.
A slice is a run of rows of one Arrow batch with at most ``SLICE_BYTES`` of text (a longer
text is a slice of its own), so a task's memory follows one slice and never the table.
Nulls read as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
PIECE_BYTES = 4 << 20  # a longer text is worked on in pieces where a step allows it

#: separators of space-split words: [^\x20\x09-\x0D]+
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: lower-cased ASCII letters, digits and every non-ASCII byte: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORD = np.ones(256, dtype=bool)
ALNUM_WORD[:0x30] = False
ALNUM_WORD[0x3A:0x61] = False
ALNUM_WORD[0x7B:0x80] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept and grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        grown = np.full(size, base, dtype=_U)
        grown[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(grown, out=grown)
        _powers[base] = have = grown
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that linear structure of a hash does not survive."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                base: int = _BASE) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for every span (position independent)."""
    if len(starts) == 0:
        return np.zeros(0, dtype=_U)
    prefix = np.zeros(len(values) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(_U) + _U(1)) * powers(base, len(values)), out=prefix[1:])
        raw = (prefix[ends] - prefix[starts]) * powers(pow(base, -1, 1 << 64),
                                                       len(values) + 1)[starts]
        raw += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix64(raw)


def window_hashes(values: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of every ``values[i:i + width]`` (values: uint64); empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    prefix = np.zeros(len(values) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(_U) + _U(1)) * powers(base, len(values)), out=prefix[1:])
        raw = prefix[width:] - prefix[:-width]
        raw *= powers(pow(base, -1, 1 << 64), n)
        raw += _U((width * 0xD6E8FEB86659FD93) % (1 << 64))
    return mix64(raw)


class Slice:
    """Consecutive rows of one batch: their text bytes, row offsets and the rows' position."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.rows = len(offsets) - 1
        self.part: pa.RecordBatch | None = None  # these rows with all their columns

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()

    def words(self, is_word: np.ndarray, lower: bool = False) -> Words:
        return Words(self, is_word, lower)


class Words:
    """Words of a slice: byte spans, their rows, and where each row's words begin."""

    def __init__(self, s: Slice, is_word: np.ndarray, lower: bool):
        data = LOWER[s.data] if lower else s.data
        inside = is_word[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        cuts = s.offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(s.offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, s.offsets)  # word number of each row's start
        self.rows = s.rows

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, made from about ``PIECE_BYTES`` of text at a time."""
        if len(self.data) <= 2 * PIECE_BYTES:
            return span_hashes(self.data, self.starts, self.ends)
        out = np.zeros(len(self.starts), _U)
        lo = 0
        while lo < len(out):
            begin = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.starts, begin + PIECE_BYTES)))
            out[lo:hi] = span_hashes(self.data[begin:self.ends[hi - 1]], self.starts[lo:hi] - begin,
                                     self.ends[lo:hi] - begin)
            lo = hi
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def window_rows(self, width: int) -> np.ndarray:
        """True at each word that starts a window of ``width`` words of its own row."""
        n = len(self.row) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        return self.row[:n] == self.row[width - 1:]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column of an Arrow batch into slices."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
        np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Slice(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], lo)
        lo = hi


def pieces(s: Slice, limit: int, overlap: int = 0, breaks: np.ndarray | None = None
           ) -> Iterator[tuple[Slice, int]]:
    """A slice as it is or, if it is one text of more than twice ``limit`` bytes, consecutive parts of it
    with the place where each begins. Parts share ``overlap`` bytes; with ``breaks`` (by byte value) they end
    behind such a byte, so that what lies between two of them stays whole."""
    n = len(s.data)
    if s.rows != 1 or n <= 2 * limit:
        yield s, 0
        return
    lo = 0
    while lo < n:
        hi = min(n, lo + limit + overlap)
        while breaks is not None and hi < n and not breaks[s.data[hi - 1]]:
            found = np.flatnonzero(breaks[s.data[hi:hi + limit]])
            hi = hi + int(found[0]) + 1 if len(found) else min(n, hi + limit)
        yield Slice(s.data[lo:hi], np.array([0, hi - lo], dtype=np.int64), s.first), lo
        if hi == n:
            return
        lo = hi - overlap


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True at each of ``n`` places inside any ``[start, end)``."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, ends, 1)
    return np.cumsum(step[:-1]) > 0


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in linear time for any width."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(mark: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of marked places; ``breaks[i]`` starts a new one."""
    begin = mark.copy()
    begin[1:] &= ~mark[:-1] | breaks[1:]
    first = np.flatnonzero(begin)
    total = np.concatenate(([0], np.cumsum(mark)))
    edges = np.concatenate((first, [len(mark)]))
    return first, total[edges[1:]] - total[first] if len(first) else np.zeros(0, np.int64)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each 64-bit value, as an (n, width) array."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``packed`` for the concatenated bytes."""
    full = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    full[:, :width] = raw.reshape(-1, width)
    return full.view("<u8").ravel()


def binary_array(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive pieces of ``raw``."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the length of each row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]] if len(off) else raw[:0], np.diff(off)

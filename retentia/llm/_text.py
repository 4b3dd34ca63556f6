"""Vectorised reading of Arrow text batches as UTF-8 bytes, shared by the text operators.

A *chunk* is a run of whole rows of a batch: one byte array and the row
offsets into it.  Chunks stay near ``CHUNK_BYTES`` (a longer text is a chunk of
its own), so the working arrays of a task do not grow with the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Rolling hash: polynomial modulo the prime 2^61 - 1 with a random base; the seed is fixed so that every task agrees.
_P = np.uint64(2**61 - 1)
_BASE = int(np.random.default_rng(20240229).integers(2**59, 2**60))
_BASE_INV = pow(_BASE, -1, 2**61 - 1)
_AT_ONCE = 1 << 14      # spans whose working arrays are held at a time
_POWERS: dict = {}


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2^61 - 1 of numbers below it."""
    low, half, s31, s30 = np.uint64(2**31 - 1), np.uint64(2**30 - 1), np.uint64(31), np.uint64(30)
    a1, a0, b1, b0 = a >> s31, a & low, b >> s31, b & low
    mid = a1 * b0 + a0 * b1
    return _mod(_mod((a1 * b1 << np.uint64(1)) + (mid >> s30) + ((mid & half) << s31)) + a0 * b0)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    """x * 2^bits modulo 2^61 - 1, for x below it."""
    return ((x << np.uint64(bits)) & _P) | (x >> np.uint64(61 - bits))


def _powers(n: int) -> tuple[int, list[np.ndarray], np.ndarray]:
    """(bits of a limb, limbs of the powers of the base, powers of its inverse) up to exponent ``n`` at least.

    A prefix sum carries one limb; with 31 bits its sum over 2^24 bytes stays
    below 2^64, with 21 bits that over 2^31 bytes.
    """
    bits = 31 if n < 1 << 24 else 21
    if _POWERS.get("bits") != bits or len(_POWERS["down"]) <= n:
        size = max(n, CHUNK_BYTES) + 1
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.ones(1, np.uint64)
            while len(steps) < size:
                more = steps[: size - len(steps)]
                steps = np.concatenate([steps, _times(more, np.uint64(pow(base, len(steps), 2**61 - 1)))])
            _POWERS[name] = steps
        mask, up = np.uint64((1 << bits) - 1), _POWERS.pop("up")
        _POWERS["limbs"] = [((up >> np.uint64(bits * k)) & mask).astype(np.uint32) for k in range(-(-61 // bits))]
        _POWERS["bits"] = bits
    return bits, _POWERS["limbs"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """64-bit hashes of arbitrary spans of one byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self._bits, limbs, self._down = _powers(len(data))
        value = data.astype(np.uint64) + np.uint64(1)
        self._prefix = []
        for limb in limbs:
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(value * limb[: len(data)], out=prefix[1:])
            self._prefix.append(prefix)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for lo in range(0, len(start), _AT_ONCE):
            out[lo: lo + _AT_ONCE] = self._spans(start[lo: lo + _AT_ONCE], end[lo: lo + _AT_ONCE])
        return out

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(start), np.uint64)
        for k, prefix in enumerate(self._prefix):
            total = _mod(total + _rotated(_mod(prefix[end] - prefix[start]), self._bits * k))
        return mix(_times(total, self._down[start]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_blocks(data: np.ndarray):
    """Function (positions, lengths) -> the next 8 bytes as one integer each, cut to the lengths (1 or more)."""
    padded = np.append(data, np.zeros(8, np.uint8))
    every = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))

    def at(position: np.ndarray, length: np.ndarray) -> np.ndarray:
        over = (8 - np.minimum(length, 8)).astype(np.uint64) * np.uint64(8)
        return (every[position] << over) >> over

    return at


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of short spans, 8 bytes a step."""
    block, length = byte_blocks(data), end - start
    out = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, k = np.flatnonzero(length > 0), 0
    while len(at):
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + block(start[at] + k, length[at] - k))
        k += 8
        at = at[length[at] > k]
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def chunks(column, target: int = CHUNK_BYTES):
    """Yield (first row, end row, bytes, offsets from 0) over a string column."""
    data, offs = text_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + target, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: (start, end, row), in order; none crosses rows."""
    w = _WORD[data]
    if not len(w):
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.zeros_like(w)
    before[1:] = w[:-1]
    first = offs[:-1]
    before[first[first < len(w)]] = False
    after = np.zeros_like(w)
    after[:-1] = w[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    return start, end, rows_of(offs, start)


def rows_of(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row that holds each byte position."""
    return np.searchsorted(offs, at, "right") - 1


def lines(data: np.ndarray, offs: np.ndarray, word_start: np.ndarray):
    """(start, end, row) of the lines that hold a word; lines are cut at line feeds and rows."""
    if not len(word_start):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offs[:-1], cut + 1])
    which = np.unique(np.searchsorted(starts, word_start, "right") - 1)
    ls = starts[which]
    row = rows_of(offs, word_start[np.searchsorted(word_start, ls)])
    nxt = np.searchsorted(cut, ls)
    le = np.where(nxt < len(cut), cut[np.minimum(nxt, max(len(cut) - 1, 0))] if len(cut) else len(data), len(data))
    return ls, np.minimum(le, offs[row + 1]), row


def window_starts(row: np.ndarray, size: int) -> np.ndarray:
    """Indices i of ``row`` (sorted) for which i .. i+size-1 lie in one row."""
    if len(row) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(row[: len(row) - size + 1] == row[size - 1:])


def window_hash(item: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive item hashes from each index of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + item[at + k])
    return out


def flat_index(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ranges start[i] .. start[i]+length[i]-1."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def int_lists(values: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    """Arrow list array from flat values and list lengths."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))

"""SentencePiece encoding and decoding by suffix-array matching (BPE models with byte fallback).

A text is cut into units at spaces (a run of spaces and what follows); no piece
crosses a unit, and each distinct unit of a task is encoded once.  The units of
a batch are laid end to end and indexed by a suffix array over their character
starts, compared on as many bytes as two machine words hold.  Every piece of
the vocabulary is found by binary search for its range in the array, which
gives all its occurrences at once; longer pieces are checked on the spot.  The
occurrences are edges (start, length, rank), sorted by position.

The edges are relaxed in the order of a BPE model: in each unit the best-ranked
edge that joins two neighbouring symbols (leftmost if equal) is taken until
none is left, all units of the batch in step.  Very long units are relaxed one
by one with a heap.  Symbols that are no piece fall back to their bytes.

Ids are those of the ``sentencepiece`` library for the same model; decoding is
a gather of piece bytes.  Defined results: null and empty texts have no ids
and decode to the empty text; U+2581 reads as a space, as in the library;
repeated rows are encoded alike; an empty table gives no rows; other columns
pass through, columns named like the outputs are replaced.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retentia.llm import _text
from retentia.llm._columns import add_columns
from retentia.llm._tokens import WordTokens

LONG_UNIT = 256          # symbols from which a unit is relaxed with a heap
BATCH_BYTES = 1 << 18    # bytes of distinct units indexed at once
_KEY = 16                # bytes the suffix array compares
_NONE = np.int64(2**62)
_SPACE = "▁"


class Codec:
    """Vocabulary of one model: sorted pieces for matching, piece bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        decoded, pieces = [], []
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[1:-1], 16)
                self.byte_id[value] = i
                decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                decoded.append(b"")
            else:
                raw = text.replace(_SPACE, " ").encode()
                if b" " in raw.lstrip(b" "):
                    raise ValueError(f"piece {i} crosses a space")
                decoded.append(raw)
                pieces.append((raw, -model.get_score(i), i))
        rank = {i: r for r, (_, _, i) in enumerate(sorted(pieces, key=lambda p: (p[1], p[2])))}
        self.pieces = [(raw, rank[i], i) for raw, _, i in sorted(pieces)]
        self.id_of_rank = np.zeros(len(pieces), np.int64)
        for _, r, i in self.pieces:
            self.id_of_rank[r] = i
        self._length = np.array([len(p[0]) for p in self.pieces])
        self._rank = np.array([p[1] for p in self.pieces])
        fill = lambda pad: np.frombuffer(b"".join(p[0][:_KEY].ljust(_KEY, pad) for p in self.pieces), ">u8").reshape(-1, 2)
        self._low, self._high = fill(b"\0").astype(np.uint64), fill(b"\xff").astype(np.uint64)
        self.decoded = np.frombuffer(b"".join(decoded), np.uint8)
        self.decoded_size = np.array([len(d) for d in decoded])
        self.decoded_start = np.cumsum(self.decoded_size) - self.decoded_size

    def edges(self, data: np.ndarray, end_of: np.ndarray, starts: np.ndarray):
        """Sorted (start * 64 + length, rank) of all pieces in the units; ``end_of`` is the unit's end at each start."""
        padded = np.append(data, np.zeros(_KEY, np.uint8))
        key = np.zeros((2, len(starts)), np.uint64)
        for k in range(_KEY):
            key[k // 8] = (key[k // 8] << np.uint64(8)) | padded[starts + k]
        order = np.lexsort((key[1], key[0]))
        suffix, hi, lo = starts[order], key[0][order], key[1][order]
        left = np.searchsorted(hi, self._low[:, 0], "left")
        right = np.searchsorted(hi, self._high[:, 0], "right")
        for p in np.flatnonzero((self._length > 8) & (right > left)):      # the second word decides
            a, b = left[p], right[p]
            left[p] = a + np.searchsorted(lo[a:b], self._low[p, 1], "left")
            right[p] = a + np.searchsorted(lo[a:b], self._high[p, 1], "right")
        count = np.maximum(right - left, 0)
        at = _text.flat_index(left, count)
        which = np.repeat(np.arange(len(count)), count)
        where, length = order[at], self._length[which]
        ok = suffix[at] + length <= end_of[where]
        for e in np.flatnonzero(ok & (length > _KEY)):
            s, raw = int(suffix[at[e]]), self.pieces[which[e]][0]
            ok[e] = data[s: s + len(raw)].tobytes() == raw
        key64 = suffix[at[ok]] * 64 + length[ok]
        rank = self._rank[which[ok]]
        by_place = np.argsort(key64)
        return key64[by_place], rank[by_place]

    def encode_units(self, units: list[bytes]) -> list:
        """Ids of each unit."""
        out, lo, size = [], 0, 0
        for hi, unit in enumerate(units, 1):
            size += len(unit)
            if size >= BATCH_BYTES or hi == len(units):
                out.extend(self._encode(units[lo:hi]))
                lo, size = hi, 0
        return out

    def _encode(self, units: list[bytes]) -> list:
        data = np.frombuffer(b"".join(units), np.uint8)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        start = np.flatnonzero((data & 0xC0) != 0x80)          # one symbol per character
        unit = np.searchsorted(ends, start, "right")
        key, rank = self.edges(data, ends[unit], start)

        def best(s, length):
            """Rank of the edge at s of that length; _NONE if there is none."""
            if not len(key):
                return np.full(len(s), _NONE)
            want = s * 64 + length
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            return np.where((length < 64) & (key[at] == want), rank[at], _NONE)

        stop = np.append(start[1:], len(data))
        per_unit = np.bincount(unit, minlength=len(units))
        long_units = np.flatnonzero(per_unit > LONG_UNIT)
        done = [(start[:0], stop[:0])]
        if len(long_units):
            is_long = np.isin(unit, long_units)
            for u in long_units:
                mine = unit == u
                done.append(_heap_relax(start[mine], stop[mine], best))
            start, stop, unit = start[~is_long], stop[~is_long], unit[~is_long]
        last = np.append(unit[1:] != unit[:-1], True) if len(unit) else np.zeros(0, bool)
        pair = np.full(len(start), _NONE)
        inner = np.flatnonzero(~last)
        pair[inner] = best(start[inner], stop[inner + 1] - start[inner])
        while len(start):
            first = np.flatnonzero(np.append(True, last[:-1]))
            chosen = np.where(pair < _NONE, (pair << np.int64(32)) | np.arange(len(pair)), _NONE)
            top = np.minimum.reduceat(chosen, first)
            go = top < _NONE
            if not go.all():                                   # units without an edge left are done
                rest = np.repeat(go, np.diff(np.append(first, len(start))))
                done.append((start[~rest], stop[~rest]))
                start, stop, last, pair = start[rest], stop[rest], last[rest], pair[rest]
                shift = np.cumsum(~rest) if len(rest) else rest
                top = top[go]
                at = (top & np.int64(2**32 - 1))
                at = at - shift[at]
                if not len(start):
                    break
            else:
                at = top & np.int64(2**32 - 1)
            stop[at] = stop[at + 1]
            last[at] = last[at + 1]
            keep = np.ones(len(start), bool)
            keep[at + 1] = False
            start, stop, last, pair = start[keep], stop[keep], last[keep], pair[keep]
            at = at - np.arange(len(at))                       # one symbol fewer for every merge before
            pair[at] = _NONE
            right = at[~last[at]]
            left = at[at > 0] - 1
            left = left[~last[left]]
            for i in (right, left):
                pair[i] = best(start[i], stop[i + 1] - start[i])
        start = np.concatenate([d[0] for d in done])
        stop = np.concatenate([d[1] for d in done])
        order = np.argsort(start)
        start, stop = start[order], stop[order]
        r = best(start, stop - start)
        known = r < _NONE
        n_ids = np.where(known, 1, stop - start)
        flat = np.zeros(int(n_ids.sum()), np.int64)
        first = np.cumsum(n_ids) - n_ids
        flat[first[known]] = self.id_of_rank[r[known]]
        flat[_text.flat_index(first[~known], n_ids[~known])] = self.byte_id[
            data[_text.flat_index(start[~known], n_ids[~known])]]
        cut = np.cumsum(np.bincount(np.searchsorted(ends, start, "right"), n_ids, len(units)).astype(np.int64))
        values = flat.tolist()
        return [values[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]

    def decode(self, ids: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts; the space that encoding put first is taken off."""
        size = self.decoded_size[ids]
        row = np.repeat(np.arange(len(per_row)), per_row)
        data = self.decoded[_text.flat_index(self.decoded_start[ids], size)]
        per = np.bincount(row, size, len(per_row)).astype(np.int64)
        offs = np.append(0, np.cumsum(per))
        head = offs[:-1][per > 0]
        head = head[data[head] == 0x20]
        keep = np.ones(len(data), bool)
        keep[head] = False
        gone = np.zeros(len(per_row), np.int64)
        gone[_text.rows_of(offs, head)] = 1
        return data[keep], np.append(0, np.cumsum(per - gone))


def _heap_relax(start: np.ndarray, stop: np.ndarray, best):
    """Symbols of one unit after all merges, best rank first, leftmost among equal ranks."""
    n = len(start)
    begin, end = start.tolist(), stop.tolist()
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    ranks = best(start[:-1], stop[1:] - start[:-1])
    heap = [(int(r), i, end[i + 1]) for i, r in enumerate(ranks.tolist()) if r < _NONE]
    heapq.heapify(heap)

    def offer(i):
        if i >= 0 and nxt[i] < n:
            stop_at = end[nxt[i]]
            r = int(best(np.array([begin[i]]), np.array([stop_at - begin[i]]))[0])
            if r < _NONE:
                heapq.heappush(heap, (r, i, stop_at))

    while heap:
        _, i, stop_at = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop_at:
            continue
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        offer(prev[i])
    at = [i for i in range(n) if alive[i]]
    return np.array([begin[i] for i in at]), np.array([end[i] for i in at])


def split_units(data: np.ndarray, offs: np.ndarray):
    """(bytes with a space before every text, unit starts, ends, rows)."""
    n = len(offs) - 1
    full = np.diff(offs) > 0
    ends = offs[1:] + np.cumsum(full)
    out = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offs))
    out[np.arange(len(data)) + np.cumsum(full)[row]] = data
    space = out == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    new_offs = np.append(0, ends)
    begin[new_offs[:-1][full]] = True
    start = np.flatnonzero(begin)
    return out, start, np.append(start[1:], len(out)), _text.rows_of(new_offs, start)


_LOADED: dict = {}


def _loaded(path: str):
    if path not in _LOADED:
        codec = Codec(path)
        _LOADED[path] = (codec, WordTokens(codec.encode_units, split_units))
    return _LOADED[path]


def _plain(column):
    """The text column with U+2581 read as a space."""
    import pyarrow.compute as pc

    return pc.replace_substring(column, _SPACE, " ")


def _encoded(text, path: str) -> tuple[np.ndarray, np.ndarray]:
    _, words = _loaded(path)
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, _, data, offs in _text.chunks(_plain(text)):
        i, n = words.ids(data, offs)
        ids.append(i)
        sizes.append(n)
    return np.concatenate(ids), np.concatenate(sizes)


def _decoded(ids: np.ndarray, sizes: np.ndarray, path: str) -> list:
    """[decoded texts, crc32 of the little-endian 32-bit ids] of some rows."""
    codec, _ = _loaded(path)
    data, offs = codec.decode(ids, sizes)
    raw = memoryview(ids.astype("<u4").tobytes())
    ends = (np.cumsum(sizes) * 4).tolist()
    crc = [zlib.crc32(raw[b - 4 * n: b]) for b, n in zip(ends, sizes.tolist())]
    text = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)),
                                                                pa.py_buffer(data)])
    return [text.cast(pa.large_string()).cast(pa.string()), pa.array(crc, pa.int64())]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` plus ids array<int>."""
    def compute(text):
        return [_text.int_lists(*_encoded(text, path), pa.int32())]

    return add_columns(documents, ["text"], compute, "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` plus decoded string and ids_crc32 long; null ids decode to the empty text."""
    def compute(lists):
        sizes = np.diff(lists.offsets.to_numpy())
        return _decoded(lists.flatten().to_numpy(zero_copy_only=False), sizes, path)

    return add_columns(encoded, ["ids"], compute, "decoded string, ids_crc32 long")


def encode_and_decode(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` plus ids, decoded and ids_crc32, in one pass of one Python worker per task."""
    def compute(text):
        ids, sizes = _encoded(text, path)
        return [_text.int_lists(ids, sizes, pa.int32()), *_decoded(ids, sizes, path)]

    return add_columns(documents, ["text"], compute, "ids array<int>, decoded string, ids_crc32 long")

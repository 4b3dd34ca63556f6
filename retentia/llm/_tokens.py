"""Token ids of whole texts from a cache of units: each distinct unit of a task is tokenised once.

A unit is a piece of text that the tokenizer never looks across, so the ids of
a text are the ids of its units in order.  Units are found by a 64-bit hash in
a sorted array and their bytes are compared on every hit, so units with equal
hashes cannot exchange ids.
"""

from __future__ import annotations

import os

import numpy as np

from retentia.llm import _text

CACHE_UNITS = 600_000
CACHE_BYTES = 32 << 20

# Kinds of bytes for ``word_units``; a word with a byte of kind 0 is one unit.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[0x27, 0x7C]] = 0     # ' starts contractions, | occurs in special tokens


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of every byte, lower-cased bytes); the letters U+00C0 to U+00FF are of kind 1."""
    kind, low = _KIND[data], _text.LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)       # the signs for times and divided by
    kind[lead[letter]] = kind[lead[letter] + 1] = 1
    capital = lead[letter & (second < 0x9F)]
    low[capital + 1] += 0x20
    return kind, low


def word_units(data: np.ndarray, offs: np.ndarray):
    """(bytes, starts, ends, rows) of the units of a tokenizer that cuts words into letters, digits and other signs.

    Words of printable ASCII signs other than ' and |, and of Latin-1 letters,
    are cut between letters, single digits and runs of other signs, and
    lower-cased; other words stay whole.
    """
    start, end, row = _text.words(data, offs)
    if not len(start):
        return data, start, end, row
    kind, low = _kinds(data)
    odd = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind == 0, out=odd[1:])
    plain = odd[start] == odd[end]
    step = np.zeros(len(data) + 1, np.int8)      # 1 inside the words that are cut
    step[start[plain]] += 1
    step[end[plain]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    cut = np.zeros(len(data), bool)              # a unit starts here
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == 2
    cut &= inside
    cut[start] = True
    cut_at = np.flatnonzero(cut)
    n_cut = np.zeros(len(data) + 1, np.int32)
    np.cumsum(cut, out=n_cut[1:])
    per_word = n_cut[end] - n_cut[start]
    stop = np.append(cut_at[1:], len(data))
    stop[np.cumsum(per_word) - 1] = end          # the last unit of a word ends with it
    return np.where(inside, low, data), cut_at, stop, np.repeat(row, per_word)


class WordTokens:
    """Flat ids of the units seen so far.

    ``encode`` maps a list of units (bytes) to a list of id lists, or to (flat
    ids, ids per unit); ``split`` maps a chunk to (bytes, unit starts, unit
    ends, unit rows).
    """

    def __init__(self, encode, split):
        self._encode, self._split = encode, split
        self._clear()

    def _clear(self):
        self._keys = np.zeros(0, np.uint64)      # sorted hashes
        self._place = np.zeros(0, np.int64)      # number of the unit with each hash
        self._ids, self._first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._bytes, self._from = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, ids per unit)."""
        lists = self._encode(texts)
        if isinstance(lists, tuple):
            return lists
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes

    def _add(self, keys: np.ndarray, texts: list[bytes]):
        """Take up units whose hashes are not held yet; ``keys`` is sorted."""
        flat, sizes = self._encoded(texts)
        n = len(self._first) - 1
        self._ids = np.concatenate([self._ids, flat])
        self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(sizes)])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self._bytes = np.concatenate([self._bytes, np.frombuffer(b"".join(texts), np.uint8)])
        self._from = np.concatenate([self._from, self._from[-1] + np.cumsum(lengths)])
        at = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, at, keys)
        self._place = np.insert(self._place, at, n + np.arange(len(keys)))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self._keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._place[at], -1)

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, ids per row) of a chunk."""
        n = len(offs) - 1
        data, start, end, row = self._split(data, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        h = _text.span_hashes(data, start, end)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self._keys) > CACHE_UNITS or len(self._bytes) > CACHE_BYTES:
            self._clear()
        at = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            self._add(keys[new], [raw[start[i]: end[i]] for i in first[new].tolist()])
            at = self._find(keys)
        unit = at[back]
        sizes = self._first[unit + 1] - self._first[unit]
        out = self._ids[_text.flat_index(self._first[unit], sizes)]
        wrong = self._differ(unit, data, start, end)
        if len(wrong):                   # equal hash, other bytes: these units are tokenised for themselves
            raw = data.tobytes()
            own, own_sizes = self._encoded([raw[start[i]: end[i]] for i in wrong.tolist()])
            parts = np.split(out, np.cumsum(sizes)[:-1])
            for i, ids in zip(wrong.tolist(), np.split(own, np.cumsum(own_sizes)[:-1])):
                parts[i] = ids
            sizes[wrong] = own_sizes
            out = np.concatenate(parts)
        return out, np.bincount(row, sizes, n).astype(np.int64)

    def _differ(self, unit, data, start, end) -> np.ndarray:
        """Indices of the units whose bytes are not those of the cached unit."""
        begin, length = self._from[unit], end - start
        same = self._from[unit + 1] - begin == length
        here, there = _text.byte_blocks(data), _text.byte_blocks(self._bytes)
        at, k = np.flatnonzero(same), 0
        while len(at):
            bad = here(start[at] + k, length[at] - k) != there(begin[at] + k, length[at] - k)
            same[at[bad]] = False
            k += 8
            at = at[(length[at] > k) & ~bad]
        return np.flatnonzero(~same)


def joined_encoder(tok, join: int = 2000):
    """``encode`` of a lower-casing byte-level BPE tokenizer with word ends, many plain units a call.

    Plain units are lower-cased pre-tokens, so the merges alone are run on them.
    The last id of a unit, and no other, ends a word; the ids of units joined by
    spaces are cut there.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    vocab = tok.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    merges = Tokenizer(tok.model)
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]     # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    sign = np.arange(256, dtype="<u4")
    sign[hidden] = 0x100 + np.arange(len(hidden))
    sign[0x20] = 0x20
    encode = lambda t, texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def run(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" ".join(units), np.uint8)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        start = np.cumsum(lengths + 1) - lengths - 1
        kind, low = _kinds(data)
        odd = np.append(0, np.cumsum(((kind == 0) & (data != 0x20)) | (low != data)))
        whole = odd[start + lengths] > odd[start]
        plain = [u for u, w in zip(units, whole.tolist()) if not w]
        joined = [np.frombuffer(b" ".join(plain[k: k + join]), np.uint8) for k in range(0, len(plain), join)]
        ids = encode(merges, [sign[x].tobytes().decode("utf-32-le") for x in joined])
        flat = np.array([i for x in ids for i in x], np.int32)
        last = np.flatnonzero(ends[flat])
        if len(last) != len(plain):
            raise ValueError("a unit is more than one pre-token of this tokenizer")
        sizes = np.zeros(len(units), np.int64)
        sizes[~whole] = np.diff(last, prepend=-1)
        own = encode(tok, [u.decode("utf-8", "replace") for u, w in zip(units, whole.tolist()) if w])
        sizes[whole] = [len(x) for x in own]
        out = np.zeros(int(sizes.sum()), np.int32)
        of_whole = np.repeat(whole, sizes)
        out[~of_whole] = flat
        out[of_whole] = [i for x in own for i in x]
        return out, sizes

    return run


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """Cached tokens of the lower-casing word-end BPE file at ``path``; one per Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _LOADED[path] = WordTokens(joined_encoder(tok), word_units)
    return _LOADED[path]

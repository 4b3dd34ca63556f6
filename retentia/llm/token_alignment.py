"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and corpus-wide link counts.

Every text, with a space before it, is tokenised by a byte-level BPE file (A)
and, without it, by a SentencePiece model (B, which adds the space).  The byte
offsets at which the tokens end are two rising lists.  The shorter list of a
document drives: each of its ends is sought in the longer one by galloping
(doubling steps from where the last search ended, then binary search between
the last two probes).  Ends found in both cut the tokens into groups, and the
ranks of neighbouring ends bound the range of longer-list tokens that a
driving token overlaps.  Runs of ``RUN`` driving tokens are searched side by
side.

The count of a pair of ids is the number of documents that hold it linked.  A
chunk of texts keeps its distinct pairs once and refers to them by number, so
one row per chunk and pair is counted by Spark, joined with the counts and sent
back to the chunk; no pair has more rows than there are chunks.

Defined results: a null or empty text, and one whose joined token bytes differ
from space + text (as with U+2581 in it), has no tokens; repeated rows are
documents of their own; an empty table gives no rows; a very long text is a
chunk of its own (some hundred bytes of memory a byte while it is aligned).
``align`` passes other columns through and replaces those named like its
outputs; ``corpus_alignment`` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm import _text
from retentia.llm._columns import add_columns
from retentia.llm._store import stored, tidy
from retentia.llm._tokens import WordTokens

CHUNK = 2 << 20     # bytes of text whose distinct pairs are numbered together
RUN = 32            # driving tokens searched one after the other
JOINED = 1 << 14    # bytes of units handed to a tokenizer at once
_SPACE = 0x20

# Kinds of bytes for cutting: 1 letters, 2 digits, 3 other printable ASCII signs but for ', 0 all others.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[0x27] = 0
# Bytes after which a space may be followed by white space: ASCII white space and lead bytes of Unicode white space.
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _units(data: np.ndarray, offs: np.ndarray, cut: np.ndarray):
    cut[offs[:-1][np.diff(offs) > 0]] = True
    start = np.flatnonzero(cut)
    return data, start, np.append(start[1:], len(data))[: len(start)], _text.rows_of(offs, start)


def byte_level_units(data: np.ndarray, offs: np.ndarray):
    """Units of a byte-level BPE: cut before a space that a sign follows, and between letters, digits and other signs.

    The pre-tokenizer takes such a space with the sign after it, whatever stands
    before, and ends a run of letters, digits or other signs where the kind
    changes; contractions start with ', at which nothing is cut.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        cut[:-1] = (data[:-1] == _SPACE) & ~_MAYBE_WHITE[data[1:]]
        kind = _KIND[data]
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return _units(data, offs, cut)


def spaced_units(data: np.ndarray, offs: np.ndarray):
    """Units of a SentencePiece model no piece of which crosses a space: a run of spaces and what follows."""
    cut = data == _SPACE
    cut[1:] &= data[:-1] != _SPACE
    return _units(data, offs, cut)


def _by_bytes(encode, size_of, joins):
    """``encode`` for WordTokens: units for which ``joins`` holds are tokenised end to end and cut by token bytes."""
    def run(units: list[bytes]):
        ids, sizes = [], np.zeros(len(units), np.int64)
        out: list = [None] * len(units)
        together = [i for i, u in enumerate(units) if joins(u)]
        alone = [i for i, u in enumerate(units) if not joins(u)]
        texts, groups, size = [], [], JOINED
        for i in together:
            if size >= JOINED:
                groups.append([])
                size = 0
            groups[-1].append(i)
            size += len(units[i])
        texts = [b"".join(units[i] for i in g) for g in groups]
        for g, text, found in zip(groups, texts, encode(texts) if texts else []):
            found = np.asarray(found, np.int32)
            at = np.cumsum(size_of[found])
            ends = np.cumsum([len(units[i]) for i in g])
            where = np.searchsorted(at, ends)
            if len(at) and at[-1] == len(text) and (at[where] == ends).all():
                for i, part in zip(g, np.split(found, where[:-1] + 1)):
                    out[i] = part
            else:
                alone += g
        if alone:
            for i, found in zip(alone, encode([units[i] for i in alone])):
                out[i] = np.asarray(found, np.int32)
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        sizes[:] = [len(x) for x in out]
        return ids, sizes

    return run


class _Bytes:
    """Bytes of every id of a vocabulary, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_text.flat_index(self.start[ids], self.size[ids])]


def _byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, others follow 0x100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _byte_level(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True                 # their strings are plain text
    alphabet = _byte_alphabet()
    pieces = [b""] * (max(tok.get_vocab().values()) + 1)
    for token, i in tok.get_vocab().items():
        if all(c in alphabet for c in token):
            pieces[i] = bytes(alphabet[c] for c in token)
    table = _Bytes(pieces)

    def encode(texts):
        return [e.ids for e in tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts],
                                                     add_special_tokens=False)]

    joins = lambda u: len(u) > 1 and u[0] == _SPACE and not _MAYBE_WHITE[u[1]]
    return table, WordTokens(_by_bytes(encode, table.size, joins), byte_level_units)


def _sentence_pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        pieces.append(bytes([int(text[1:-1], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode())
        if b" " in pieces[-1].lstrip(b" "):
            raise ValueError(f"piece {i} crosses a space")
    table = _Bytes(pieces)

    one_space = [model.piece_to_id("▁")]             # a last space: the model adds none to the empty text

    def encode(texts):                               # the model adds the first space
        found = model.encode([t[1:].decode("utf-8", "replace") for t in texts], num_threads=1)
        return [one_space if t == b" " else f for t, f in zip(texts, found)]

    joins = lambda u: u[0] == _SPACE and u[-1] != _SPACE
    return table, WordTokens(_by_bytes(encode, table.size, joins), spaced_units)


def gallop(ends: np.ndarray, want: np.ndarray, low: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """First index from ``low`` at which ``ends`` reaches ``want``; ends[limit - 1] does."""
    low, high = low.copy(), low.copy()
    todo = np.flatnonzero(ends[high] < want)
    step = 1
    while len(todo):                                 # doubling steps
        low[todo] = high[todo] + 1
        high[todo] = np.minimum(high[todo] + step, limit[todo] - 1)
        step *= 2
        todo = todo[ends[high[todo]] < want[todo]]
    todo = np.flatnonzero(low < high)
    while len(todo):                                 # binary search between the last two probes
        mid = (low[todo] + high[todo]) >> 1
        less = ends[mid] < want[todo]
        low[todo] = np.where(less, mid + 1, low[todo])
        high[todo] = np.where(less, high[todo], mid)
        todo = todo[low[todo] < high[todo]]
    return low


def _drive(short: np.ndarray, s_from, s_to, longer: np.ndarray, l_from, l_to):
    """Galloping intersection of documents whose shorter lists are ``short[s_from:s_to]``.

    Returns per driving token (index, first and last overlapping token of the
    longer list, whether both end alike).
    """
    n = s_to - s_from
    runs = -(-n // RUN)
    doc = np.repeat(np.arange(len(n)), runs)
    begin = _text.flat_index(np.zeros(len(n), np.int64), runs) * RUN + s_from[doc]
    stop = np.minimum(begin + RUN, s_to[doc])
    at, limit = l_from[doc].copy(), l_to[doc]
    place = np.zeros(len(short), np.int64)
    for k in range(RUN):
        live = np.flatnonzero(begin + k < stop)
        if not len(live):
            break
        token = begin[live] + k
        at[live] = gallop(longer, short[token], at[live], limit[live])
        place[token] = at[live]
    token = _text.flat_index(s_from, n)
    last = place[token]
    alike = longer[last] == short[token]
    first = np.empty_like(last)
    first[1:] = last[:-1] + alike[:-1]
    head = np.cumsum(n) - n
    first[head[n > 0]] = l_from[n > 0]
    return token, first, last, alike


class Alignment:
    """Tokens, groups and links of a chunk of texts; flat arrays over all its rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, path_a: str, path_b: str):
        (bytes_a, tokens_a), (bytes_b, tokens_b) = _loaded(path_a, _byte_level), _loaded(path_b, _sentence_pieces)
        rows = len(offs) - 1
        length = np.diff(offs)
        full = length > 0
        new_offs = np.append(0, np.cumsum(length + full))
        spaced = np.full(new_offs[-1], _SPACE, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.cumsum(full), length)] = data
        whole = np.ones(rows, bool)
        sides = []
        for table, tokens in ((bytes_a, tokens_a), (bytes_b, tokens_b)):
            ids, n = tokens.ids(spaced, new_offs)
            row = np.repeat(np.arange(rows), n)
            size = table.size[ids]
            whole &= np.bincount(row, size, rows).astype(np.int64) == np.diff(new_offs)
            sides.append((table, ids, row, n))
        for table, ids, row, _ in sides:
            kept = ids[whole[row]]
            same = table.joined(kept) == spaced[np.repeat(whole, np.diff(new_offs))]
            if not same.all():
                of = np.repeat(np.flatnonzero(whole), np.diff(new_offs)[whole])
                whole[of[~same]] = False
        self.ids, self.n, ends, begin = [], [], [], []
        for table, ids, row, n in sides:
            kept = whole[row]
            self.ids.append(ids[kept].astype(np.int64))
            self.n.append(np.where(whole, n, 0))
            ends.append(np.cumsum(table.size[self.ids[-1]]))
            begin.append(np.cumsum(self.n[-1]) - self.n[-1])
        (n_a, n_b), (a0, b0) = self.n, begin
        links, groups = [], []
        for lead, other, mine in ((0, 1, n_a <= n_b), (1, 0, n_a > n_b)):
            s0, l0 = begin[lead][mine], begin[other][mine]
            token, first, last, alike = _drive(ends[lead], s0, s0 + self.n[lead][mine], ends[other], l0,
                                               l0 + self.n[other][mine])
            n = last - first + 1
            pair = np.repeat(token, n), _text.flat_index(first, n)
            links.append((pair[lead], pair[other]))
            end = token[alike] + 1, last[alike] + 1
            groups.append((end[lead], end[other]))
        #: Index of the A and the B token of every link.
        self.link_a, self.link_b = (np.concatenate(x) for x in zip(*links))
        end_a, end_b = (np.concatenate(x) for x in zip(*groups))
        order = np.argsort(end_a)
        #: Ends (exclusive) of the groups in the A and the B tokens.
        self.end_a, self.end_b = end_a[order], end_b[order]
        row_a = np.repeat(np.arange(rows), n_a)
        self.link_row = row_a[self.link_a]
        self.group_row = row_a[self.end_a - 1]
        self.n_links = np.bincount(self.link_row, minlength=rows)
        self.n_groups = np.bincount(self.group_row, minlength=rows)
        self.rows, self.begin = rows, begin

    def group_texts(self) -> tuple[bytes, np.ndarray]:
        """(all rows' groups as ``a1,a2|b1;a3|b2,b3;``, ends of the rows in it)."""
        n = len(self.ids[0]), len(self.ids[1])
        in_a, in_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        place_a = np.arange(n[0]) + (self.end_b - in_b)[group_a]
        place_b = np.arange(n[1]) + self.end_a[group_b]
        value, mark = np.zeros(sum(n), np.int64), np.full(sum(n), ord(","), np.uint8)
        value[place_a], value[place_b] = self.ids[0], self.ids[1]
        mark[place_a[self.end_a - 1]] = ord("|")
        mark[place_b[self.end_b - 1]] = ord(";")
        width = len(str(int(value.max(initial=0))))
        text = np.zeros((len(value), width + 1), np.uint8)
        rest = value
        for k in range(width - 1, -1, -1):
            rest, text[:, k] = rest // 10, rest % 10 + 48
        text[:, width] = mark
        shown = np.ones(text.shape, bool)
        for k in range(width - 1):
            shown[:, k] = value >= 10 ** (width - 1 - k)
        ends = np.append(0, np.cumsum(shown.sum(1)))
        return text[shown].tobytes(), ends[np.cumsum(self.n[0] + self.n[1])]

    def pairs(self):
        """(distinct pairs a << 32 | b, rows holding each, per row and pair: number of the pair, links; per row: pairs)."""
        code = (self.ids[0][self.link_a] << 32) + self.ids[1][self.link_b]
        pair, number = np.unique(code, return_inverse=True)
        held, links = np.unique(self.link_row * max(1, len(pair)) + number, return_counts=True)
        row, number = np.divmod(held, max(1, len(pair)))
        return pair, np.bincount(number, minlength=len(pair)), number, links, np.bincount(row, minlength=self.rows)


_LOADED: dict = {}


def _loaded(path: str, load):
    if path not in _LOADED:
        _LOADED[path] = load(path)
    return _LOADED[path]


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``documents`` plus a_ids, b_ids array<int> and a_ends, b_ends array<int>.

    Group g of a document holds its tokens from a_ends[g - 1] to a_ends[g]
    (exclusive, 0 before the first) and likewise of B.
    """
    def compute(text):
        parts: list = [[], [], [], []]
        for _, _, data, offs in _text.chunks(text, CHUNK):
            al = Alignment(data, offs, path_a, path_b)
            for k in (0, 1):
                parts[k].append((al.ids[k], al.n[k]))
                parts[2 + k].append(((al.end_a, al.end_b)[k] - al.begin[k][al.group_row], al.n_groups))
        empty = np.zeros(0, np.int64)
        return [_text.int_lists(*(np.concatenate([p[i] for p in part] or [empty]) for i in (0, 1)), pa.int32())
                for part in parts]

    return add_columns(documents, ["text"], compute,
                       "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _chunk_rows(documents: DataFrame, path_a: str, path_b: str, hashed: bool) -> DataFrame:
    """One row per chunk: its documents, its distinct pairs, and per document the pairs it links by number."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def lists(values, sizes, t):
        return _text.int_lists(np.asarray(values), np.asarray(sizes), t)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offs in _text.chunks(batch.column(1), CHUNK):
                al = Alignment(data, offs, path_a, path_b)
                text, ends = al.group_texts()
                begin = np.append(0, ends[:-1])
                shown = [text[a: b - 1] if b > a else b"" for a, b in zip(begin.tolist(), ends.tolist())]
                if hashed:
                    shown = [hashlib.sha256(s).hexdigest() if s else "" for s in shown]
                pair, docs, number, links, per_row = al.pairs()
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 36) + seq]), one(batch.column(0).slice(lo, hi - lo))]
                    + [one(pa.array(x.astype(np.int64))) for x in (*al.n, al.n_groups, al.n_links)]
                    + [one(pa.array(shown, pa.string())), one(pa.array(pair, pa.int64())),
                       one(pa.array(docs, pa.int32())), one(pa.array(number, pa.int32())),
                       one(pa.array(links, pa.int32())), one(pa.array(per_row, pa.int32()))],
                    ["chunk", "doc_id", *_NUMBERS, "groups", "pair", "n_docs", "number", "links", "n_pairs"])
                seq += 1

    return documents.select("doc_id", "text").mapInArrow(
        run, f"chunk long, doc_id array<{kind}>, " + ", ".join(f"{c} array<long>" for c in _NUMBERS)
        + ", groups array<string>, pair array<long>, n_docs array<int>, number array<int>, links array<int>, n_pairs array<int>")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether that is the most of its A id."""
    counts = stored(chunks.select(F.explode(F.arrays_zip("pair", "n_docs")).alias("p"))
                    .groupBy(F.col("p.pair").alias("pair"))
                    .agg(F.sum(F.col("p.n_docs").cast("long")).alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))       # one row per id of A
    return counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


@tidy
def corpus_alignment(documents: DataFrame, path_a: str, path_b: str, hashed: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of every document.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` (its sha256 in hexadecimal with
    ``hashed``, which spares the corpus from travelling as decimals; empty
    without tokens).  n_best: links whose pair has the highest count of its A
    id; count_sum: counts summed over the links.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    chunks = stored(_chunk_rows(documents, path_a, path_b, hashed), "aligned-chunks")
    asked = chunks.select("chunk", F.explode("pair").alias("pair"))
    found = (asked.join(pair_counts(chunks), "pair").groupBy("chunk")       # distinct pairs of one chunk of texts
             .agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("found")))
    names = ["doc_id", *_NUMBERS, "groups", "n_best", "count_sum"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].values  # noqa: B023, E731
                docs = get("doc_id")
                links = get("links").to_numpy().astype(np.int64)
                number, per_row = get("number").to_numpy(), get("n_pairs").to_numpy()
                row = np.repeat(np.arange(len(docs)), per_row)
                n_best = count_sum = np.zeros(len(docs), np.int64)
                if len(number):
                    found = get("found")
                    n, best = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
                    begin = np.flatnonzero(np.diff(row, prepend=-1))
                    n_best, count_sum = n_best.copy(), count_sum.copy()
                    n_best[row[begin]] = np.add.reduceat(links * best[number], begin)
                    count_sum[row[begin]] = np.add.reduceat(links * n[number], begin)
                yield pa.RecordBatch.from_arrays([docs, *(get(c) for c in _NUMBERS), get("groups"), pa.array(n_best),
                                                  pa.array(count_sum)], names)

    kept = chunks.select("chunk", "doc_id", *_NUMBERS, "groups", "number", "links", "n_pairs")
    return (kept.join(found, "chunk", "left").drop("chunk")
            .mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _NUMBERS)
                        + ", groups string, n_best long, count_sum long"))

"""Suffix-array deduplication: bytes covered by a string of a given length that also starts elsewhere go.

The length is a parameter (``LENGTH`` bytes unless told otherwise); below,
WIDE is the number of window starts around an anchor.

Sorting every suffix of a corpus would move it many times over, so only the
suffixes that can decide are sorted:

1. Equal texts are one text with a number of copies.
2. Anchors: in every window the least-hashed string of a fraction of its length
   (leftmost if equal).  Equal windows have their anchor at the same place, so
   each repeated window lies around an anchor whose string repeats.
3. For each repeated anchor a task takes the suffix from the anchor (as long
   as a window) and the bytes before it, sorts its suffixes and sends them as
   front-coded runs (common prefix with the one before, rest) to the partition
   of their first bytes.  Equal suffixes of a run are one entry.
4. A partition merges its runs with a loser tree that keeps the common prefix
   of every entry with the last one given out: entries are compared from that
   point on, known prefixes never again.  The merge yields the sorted order
   with common prefixes; with those and the common bytes before the anchor it
   follows which windows around an anchor also start elsewhere.
5. The spans go back to their text, which is cut once.

An anchor string with many occurrences is handled in blocks of window starts,
the more occurrences the smaller; a block is keyed by the bytes that all its
windows share, so a passage with a huge number of copies is spread over
partitions and its equal suffixes are merged before they are sent.

Defined results: a null text is empty; texts shorter than a window keep all;
repeated rows and equal texts lose all bytes if they are as long or longer;
matches never cross documents; a very long text is read by one task, 8 MB of
it at a time (some tens of bytes of memory a byte of the text for its hashes);
an empty table gives no rows; other columns
pass through ``clean``, and cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm import _text
from retentia.llm._columns import fresh
from retentia.llm._store import SALTS, shuffle_width, stored, tidy

LENGTH = 400
GRAM = 64                       # longest anchor string
PER_BLOCK = 256                 # occurrences of an anchor string that one block handles whole
_PLACE = 24                     # bits for the place in a segment
_SEGMENT = 1 << 23


def gram_of(length: int) -> int:
    """Length of the anchor strings of windows of ``length`` bytes."""
    return min(GRAM, max(1, length // 4))


def wide_of(length: int) -> int:
    """Window starts around an anchor."""
    return length - gram_of(length) + 1


def anchors_of(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the anchor string) of the anchors of a chunk, in order."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram, wide = gram_of(length), wide_of(length)
    hashes = _text.RollingHash(data)
    places = []
    for lo in range(0, len(data) - length + 1, _SEGMENT):
        hi = min(lo + _SEGMENT, len(data) - length + 1)          # window starts lo .. hi-1
        at = np.arange(lo, hi + wide - 1)
        least = (hashes.spans(at, at + gram) >> np.uint64(_PLACE) << np.uint64(_PLACE)) | (at - lo).astype(np.uint64)
        span = 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: hi - lo], least[wide - span: wide - span + hi - lo])
        start = np.arange(lo, hi)
        whole = start + length <= offs[_text.rows_of(offs, start) + 1]
        places.append(np.unique(least[whole] & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + lo)
    place = np.unique(np.concatenate(places))
    return place, hashes.spans(place, place + gram)


def distinct_texts(documents: DataFrame) -> DataFrame:
    """(id, h, g, copies, text): one row per distinct text; (h, g) is a 128-bit hash of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (documents.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
            .select(F.monotonically_increasing_id().alias("id"), F.xxhash64("text").alias("h"),
                    F.xxhash64(F.lit(1), F.col("text")).alias("g"), "copies", "text"))


def anchors(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, place, gram): places count bytes from the start of the text."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in _text.chunks(batch.column(1)):
                place, gram = anchors_of(data, offs, length)
                row = _text.rows_of(offs, place)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(place - offs[row]),
                     pa.array(gram.view(np.int64))], ["id", "place", "gram"])

    return texts.select("id", "text").mapInArrow(run, "id long, place long, gram long")


def block_size(count: int, wide: int = wide_of(LENGTH)) -> int:
    """Window starts per block for an anchor string with ``count`` occurrences."""
    blocks = min(wide, max(1, -(-count // PER_BLOCK)))
    return -(-wide // blocks)


def entries_of(raw: bytes, place: int, size: int, length: int = LENGTH):
    """(block size, suffix, bytes before it reversed, place) for each block of window starts of an anchor."""
    wide = wide_of(length)
    for first in range(0, wide, size):
        here = place - first
        if here < 0:
            return
        width = min(size, wide - first)
        suffix = raw[here: here + length]
        before = raw[max(0, here - width + 1): here]
        if len(suffix) + len(before) >= length:
            yield width, suffix, before[::-1], here


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(x), len(y))
    step = 64
    while known < n and x[known: known + step] == y[known: known + step]:
        known += step
    if known >= n:
        return n
    while known < n and x[known] == y[known]:
        known += 1
    return known


class Run:
    """A sorted run of (key, before, members) entries, front-coded for the exchange.

    ``key`` is two bytes of block size and the suffix; members are (id, place).
    """

    @staticmethod
    def encode(entries: list) -> bytes:
        head, rest, last = [], [], b""
        ids, places = [], []
        for key, before, members in entries:
            lcp = common(last, key)
            head.append((lcp, len(key) - lcp, len(before), len(members)))
            rest.append(key[lcp:])
            rest.append(before)
            ids.extend(m[0] for m in members)
            places.extend(m[1] for m in members)
            last = key
        return b"".join([np.int64(len(entries)).tobytes(), np.int64(len(ids)).tobytes(),
                         np.array(head, np.int32).reshape(-1, 4).T.tobytes(), np.array(ids, np.int64).tobytes(),
                         np.array(places, np.int64).tobytes(), *rest])

    @staticmethod
    def decode(blob: bytes):
        """Yield (common prefix with the entry before, key, before, members)."""
        n, m = np.frombuffer(blob, np.int64, 2).tolist()
        head = np.frombuffer(blob, np.int32, 4 * n, 16).reshape(4, n).T.tolist()
        at = 16 + 16 * n
        ids = np.frombuffer(blob, np.int64, m, at).tolist()
        places = np.frombuffer(blob, np.int64, m, at + 8 * m).tolist()
        at, mem, key = at + 16 * m, 0, b""
        for lcp, rest, before, members in head:
            key = key[:lcp] + blob[at: at + rest]
            at += rest
            yield lcp, key, blob[at: at + before], list(zip(ids[mem: mem + members], places[mem: mem + members]))
            at += before
            mem += members


def merge_runs(blobs: list[bytes]):
    """Yield (common prefix with the last entry given out, key, before, members) over all runs in order.

    Loser tree: an inner node holds the run that lost there and the common
    prefix of its head with the winner that passed.  When the head of the
    winning run is replaced, its common prefix with the old head is known from
    the front coding, and every loser on its path is measured against that same
    old head: the longer common prefix wins without looking at bytes, and equal
    ones are compared from there on.
    """
    streams = [Run.decode(b) for b in blobs]
    size = 1
    while size < len(streams):
        size *= 2
    heads = [next(s, None) for s in streams] + [None] * (size - len(streams))
    known = [0] * size                    # common prefix of each head with what it was last measured against

    def beats(i: int, j: int) -> bool:
        """True if head i goes first; the loser's ``known`` becomes its common prefix with the winner."""
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return y is None and x is not None
        if known[i] != known[j]:
            return known[i] > known[j]
        p, q = x[1], y[1]
        c = common(p, q, known[i])
        first = p[c:c + 1] <= q[c:c + 1]
        known[j if first else i] = c
        return first

    losers = [0] * size
    winners = [0] * (2 * size)
    for i in range(size):
        winners[size + i] = i
    for node in range(size - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        first = beats(i, j)
        winners[node], losers[node] = (i, j) if first else (j, i)
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        _, key, before, members = heads[top]
        yield known[top], key, before, members
        heads[top] = next(streams[top], None)
        if heads[top] is not None:
            known[top] = heads[top][0]
        node = (size + top) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def _reach(group: list, width: int, length: int) -> list:
    """For each entry of a group [(common prefix with the one before, suffix length, before, members)]:

    (bytes before, bytes after) of the union of its repeated windows, or None.
    Entries are distinct, sorted by suffix; all agree on the bytes every window of the block has.
    """
    m = len(group)
    left, right = [-1] * m, [-1] * m

    def whole(k):
        _, n, before, _ = group[k]
        return min(len(before), width - 1), min(n, length)

    if m * m <= 40 * width:
        for i in range(m):
            least = length
            for j in range(i + 1, m):
                least = min(least, group[j][0])
                back = common(group[i][2], group[j][2])
                if least + back >= length:
                    for k in (i, j):
                        left[k], right[k] = max(left[k], back), max(right[k], least)
    else:
        lcp = np.array([0] + [g[0] for g in group[1:]])
        sizes, backs = np.array([g[1] for g in group]), np.array([len(g[2]) for g in group])
        order = sorted(range(m), key=lambda k: group[k][2])
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        blcp = np.array([0] + [common(group[order[k - 1]][2], group[order[k]][2]) for k in range(1, m)])
        far, near = np.full(m, -1), np.full(m, -1)
        for t in range(width):
            ok = np.flatnonzero((sizes >= length - t) & (backs >= t))
            key = np.cumsum(lcp < length - t)[ok] * (m + 1) + np.cumsum(blcp < t)[place][ok]
            _, of, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = ok[count[of] > 1]
            far[hit] = t
            near[hit] = np.where(near[hit] < 0, t, near[hit])
        left, right = far.tolist(), np.where(near >= 0, length - near, -1).tolist()
    out = []
    for k in range(m):
        if len(group[k][3]) > 1:
            out.append(whole(k))
        else:
            out.append((left[k], right[k]) if right[k] >= 0 else None)
    return out


def merged_spans(blobs: list[bytes], length: int = LENGTH):
    """(id, start, end) spans covered by repeated windows, from the runs of one partition."""
    group, width = [], 0

    def close():
        if len(group) > 1 or (group and len(group[0][3]) > 1):
            for reach, (_, _, _, members) in zip(_reach(group, width, length), group):
                if reach:
                    for text, place in members:
                        yield text, place - reach[0], place + reach[1]

    last_key = last_before = None
    fresh = []                                       # entries with one suffix, by the bytes before
    for lcp, key, before, members in merge_runs(blobs):
        lcp = max(0, lcp - 2)
        w = int.from_bytes(key[:2], "big")
        if group and (w != width or lcp < length - w + 1):
            yield from close()
            group, fresh = [], []
        width = w
        if key != last_key or not group:
            fresh = []
        same = next((e for e in fresh if e[2] == before), None) if len(fresh) < 8 else _find(fresh, before)
        if same is not None and group:
            same[3].update(members)
        else:
            entry = (lcp, len(key) - 2, before, set(members))
            group.append(entry)
            fresh.append(entry)
        last_key = key
    yield from close()


def _find(entries: list, before: bytes):
    table = getattr(_find, "table", None)
    if table is None or table[0] is not entries or table[1] != len(entries):
        known = table[2] if table is not None and table[0] is entries else {}
        for e in entries[len(known):]:
            known[e[2]] = e
        _find.table = table = (entries, len(entries), known)
    return table[2].get(before)


def runs(texts: DataFrame, wanted: DataFrame, n_parts: int, length: int = LENGTH) -> DataFrame:
    """(part, run): the front-coded runs of the wanted anchors (id, places, counts)."""
    def run(batches):
        for batch in batches:
            entries: dict = {}
            raws = batch.column(1).cast(pa.binary())
            for text, raw, places, counts in zip(batch.column(0).to_pylist(), raws, batch.column(2).to_pylist(),
                                                 batch.column(3).to_pylist()):
                raw = raw.as_py()
                for place, count in zip(places, counts):
                    for width, suffix, before, here in entries_of(raw, place, block_size(count, wide_of(length)), length):
                        key = width.to_bytes(2, "big") + suffix
                        entries.setdefault((key, before), set()).add((text, here))
            parts: dict = {}
            for (key, before), members in sorted(entries.items(), key=lambda e: e[0]):
                width = int.from_bytes(key[:2], "big")
                core = hashlib.blake2b(key[: 2 + length - width + 1], digest_size=8).digest()
                parts.setdefault(int.from_bytes(core, "big") % n_parts, []).append((key, before, sorted(members)))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(parts), pa.int32()), pa.array([Run.encode(e) for e in parts.values()], pa.binary())],
                    ["part", "run"])

    return (texts.select("id", "text").join(wanted.hint("merge"), "id")       # the same plan at every size.select("id", "text", "places", "counts")
            .mapInArrow(run, "part int, run binary"))


def spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, starts, ends): spans of each text that repeated windows cover; they may overlap."""
    n = shuffle_width(texts.sparkSession)
    found = stored(anchors(texts, length), "anchors")
    often = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    many = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wanted = (found.withColumn("salt", F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int"))
              .join(many.hint("merge"), ["gram", "salt"]).groupBy("id")
              .agg(F.collect_list(F.struct("place", "n")).alias("a"))     # anchors of one text
              .select("id", F.col("a.place").alias("places"), F.col("a.n").alias("counts")))

    def merge(key, pdf):
        rows = list(merged_spans(list(pdf["run"]), length))
        return pd.DataFrame(rows, columns=["id", "start", "end"]).astype("int64")

    return (runs(texts, wanted, n, length).groupBy("part").applyInPandas(merge, "id long, start long, end long")
            .groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("s"))
            .select("id", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")))


def _cut(raw: bytes, starts, ends) -> tuple[bytes, int]:
    """(bytes outside the spans, number of maximal spans)."""
    kept, at, n = [], 0, 0
    end = None
    for s, e in sorted(zip(starts, ends)):
        if end is None or s > end:
            n += 1
            kept.append(raw[at: s])
            end = e
        else:
            end = max(end, e)
        at = end
    kept.append(raw[at:])
    return b"".join(kept), n


def deduplicate(documents: DataFrame, with_text: bool = False, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(distinct texts, results): results has h, g, n_bytes, n_removed, n_spans, kept_sha256[, kept_text] per text."""
    texts = stored(distinct_texts(documents), "texts")

    def run(batches):
        for batch in batches:
            raws = batch.column(3).cast(pa.binary())
            out = []
            for copies, raw, starts, ends in zip(batch.column(2).to_pylist(), raws, batch.column(4).to_pylist(),
                                                 batch.column(5).to_pylist()):
                raw = raw.as_py()
                if copies > 1 and len(raw) >= length:
                    starts, ends = [0], [len(raw)]
                kept, n = _cut(raw, starts or [], ends or [])
                row = (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            cols = list(zip(*out)) if out else [[]] * (4 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)]
                                             + [pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "h long, g long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_text string" * with_text
    names = [f.split()[0] for f in schema.split(", ")]
    results = (texts.join(stored(spans(texts, length), "spans").hint("merge"), "id", "left")
               .select("h", "g", "copies", "text", "starts", "ends").mapInArrow(run, schema))
    return texts, results


def _joined(documents: DataFrame, results: DataFrame, salts: int = SALTS) -> DataFrame:
    """Documents with the results of their text; a text that a third of all rows share is spread by salts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h, g, salt, dh, dg, dsalt = fresh(documents.columns + results.columns, "key_h", "key_g", "key_salt", "text_h",
                                      "text_g", "text_salt")
    many = (results.withColumnsRenamed({"h": h, "g": g})
            .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    rows = documents.withColumns({dh: F.xxhash64(text), dg: F.xxhash64(F.lit(1), text),
                                  dsalt: F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")}).drop("text")
    return rows.join(many.hint("merge"), (F.col(dh) == F.col(h)) & (F.col(dg) == F.col(g)) & (F.col(dsalt) == F.col(salt))
                     ).drop(h, g, salt, dh, dg, dsalt)


@tidy
def report(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    _, results = deduplicate(documents, length=length)
    return _joined(documents.select("doc_id", "text"), stored(results, "cut-texts"))


@tidy
def clean(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the remaining text; bytes of a character that was cut in two are left out too."""
    _, results = deduplicate(documents, True, length)
    (name,) = fresh(documents.columns, "kept_text")
    kept = stored(results.select("h", "g", F.col("kept_text").alias(name)), "cut-texts")
    # texts are not replicated for salts; Spark splits a text that very many rows share on the side of the rows
    out = _joined(documents, kept, salts=1).withColumnRenamed(name, "text")
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)

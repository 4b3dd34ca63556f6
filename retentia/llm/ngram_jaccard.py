"""N-gram Jaccard join with signature trees: documents whose word 5-gram sets are 75 % alike.

1. Every text becomes the set of hashes of its 5-word windows; texts with equal
   sets are one set.
2. Two sets that link have 75 % of either in common, so in any fixed order the
   first n - ceil(0.75 n) + k shingles of each hold k common ones.  With k = n/8
   the corpus is asked once, per bucket of shingles, which of these occur in
   another text; a set with too few of them links with nothing and is done.
   Ordinary texts, also those with a passage or boilerplate in common, end here.
   The sets that are left are asked once more among each other with all their
   shingles: 75 % of them must occur in another of these sets.
   For the others the same bound with k = 1, and rare shingles first, says which
   sets must meet: those that share a prefix shingle form a block (connected
   components).  Shingles are ordered by how far the count of their slot, one of
   a fixed number, stands out of the mean, so shared passages come last.
3. Blocks are cut into tiles of ``TILE`` sets.  A task gets one block or one
   pair of tiles and builds a signature tree per tile: a leaf holds the token
   bitmap of a set, a node the OR of its children's bitmaps and their range of
   sizes.  Both trees are walked together; a pair of nodes is dropped if the
   sizes are too far apart, if the bits they share bound the overlap below
   what the smallest sizes need, or if all their sets are connected already.
   Pairs of sets that are left are compared exactly.
4. A large block first meets itself tile by tile and against its first tile;
   after that only sets outside the block's main component still meet the
   others.  There the trees get the signatures alone, and only pairs that they
   leave over, in different components, are looked up and compared.  Links go
   back as edges of a spanning forest.

Defined results: texts without words (null, empty) have an empty set, link with
nothing and are components of their own; texts with one to four words have one
shingle, the whole sequence; repeated rows have equal sets; a null doc_id has a
null component unless it links with a document that has one; an empty table
gives no rows.  Only doc_id and text are read, other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm import _text
from retentia.llm._columns import add_columns, fresh, slices
from retentia.llm._components import components
from retentia.llm._store import salted_join, shuffle_width, stored, tidy

WORDS = 5
PERCENT = 75
TILE = 128
SLOT_BITS = 22
BITS = 4096
LEAF, FANOUT = 8, 8
WIDE = 4             # tiles of the second round hold so many times TILE sets: signatures are small
SLICE = 1 << 14


def _parts(batches):
    """The batches in parts of a few MB: the working arrays of a task hold several times the bytes of one."""
    for batch in batches:
        yield from slices(batch)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """(row of each shingle, shingle) over a batch: distinct per row, sorted by row and hash."""
    rows, shingles = [], []
    for lo, _, data, offs in _text.chunks(column):
        low = _text.LOWER[data]
        start, end, row = _text.words(low, offs)
        h = _text.RollingHash(low).spans(start, end)
        at = _text.window_starts(row, WORDS)
        n = np.bincount(row, minlength=len(offs) - 1)
        few = np.flatnonzero((n > 0) & (n < WORDS))
        first = np.cumsum(n) - n
        whole = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            more = n[few] > k
            whole[more] = _text.mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[few[more]] + k])
        s = np.concatenate([_text.window_hash(h, at, WORDS), whole])
        r = np.concatenate([row[at], few])
        order = np.lexsort((s, r))
        s, r = s[order], r[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])] if len(s) else np.zeros(0, bool)
        shingles.append(s[new])
        rows.append(r[new] + lo)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(shingles)


def _set_keys(rows, shingles, n):
    """One 64-bit key per row: a hash of its set (0 for the empty set)."""
    size = np.bincount(rows, minlength=n)
    first = np.cumsum(size) - size
    key = np.zeros(n, np.uint64)
    full = size > 0
    if full.any():
        key[full] = _text.mix(np.add.reduceat(_text.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), first[full])
                              + size[full].astype(np.uint64))
    return key.view(np.int64), size


def prefix_length(n, k=1):
    """Shingles of a set of n, in any order, that hold k of every set it links with."""
    return np.minimum(n, n - (PERCENT * n + 99) // 100 + k)


def signed(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, set_key (null without words)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in _parts(batches):
            key, size = _set_keys(*shingle_sets(batch.column(1)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(key, mask=size == 0)],
                                             ["doc_id", "n_shingles", "set_key"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key long")


def _eighth(size):
    """Length of the first filter's prefix: it holds size / 8 shingles of every set that links."""
    return prefix_length(size, np.maximum(1, size // 8))


_SENT = "bucket int, tokens binary, sizes binary, keys binary, key_counts binary"


def _packed(rows) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                      [f.split()[0] for f in _SENT.split(", ")])


def _sets_of_texts(batch):
    rows, s = shingle_sets(batch.column(0))
    return rows, s, *_set_keys(rows, s, batch.num_rows)


def _sets_of_sets(batch):
    lists = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
    size = np.array([len(x) for x in lists], np.int64)
    s = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(lists)), size), s, batch.column(0).to_numpy(), size


def _sent_rows(rows, s, key, size, share, n_buckets: int) -> list[tuple]:
    """Rows of ``_SENT`` for a chunk of sets: its shingles by bucket, and the counts it knows itself."""
    if not len(s):
        return []
    first = np.cumsum(size) - size
    _, once = np.unique(key, return_index=True)              # equal sets of the chunk go as one
    copies = np.bincount(np.searchsorted(key[once], key[size > 0]), minlength=len(once))
    is_once = np.zeros(len(size), bool)
    is_once[once] = True
    at = np.arange(len(s)) - first[rows]
    use = is_once[rows] & (at < share(size)[rows])
    t, r = s[use], rows[use]
    order = np.argsort(t, kind="stable")
    t, r = t[order], r[order]
    new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    times = np.diff(np.r_[new, len(t)])
    count = np.zeros(len(size), np.int64)
    many = np.repeat(times > 1, times)
    count += np.bincount(r[many], minlength=len(size))
    held = once[copies > 1]                                  # copies share everything
    count[held] = size[held]
    alone = ~many                                            # counted by the bucket if another chunk has it
    marker = new[times > 1]
    token = np.r_[t[alone], t[marker]]
    owner = np.r_[r[alone], np.full(len(marker), len(size))]
    bucket = (token >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    order = np.lexsort((owner, bucket))
    token, owner, bucket = token[order], owner[order], bucket[order].astype(np.int64)
    small = (token & np.uint64(2**32 - 1)).astype(np.uint32)
    keys = np.append(key, 0)
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    out = []
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        o = owner[cut[b]: cut[b + 1]]
        start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        out.append((b, small[cut[b]: cut[b + 1]].tobytes(),
                    np.diff(np.r_[start, len(o)]).astype(np.uint32).tobytes(), keys[o[start]].tobytes(), None))
    known = np.flatnonzero(count)
    if len(known):
        out.append((int(key[known[0]] % n_buckets), None, None, key[known].tobytes(),
                    count[known].tobytes()))
    return out


def shared_counts(source: DataFrame, sets_of, share, n_buckets: int) -> DataFrame:
    """(set_key, n): at least as many of its first ``share(size)`` shingles as occur in another set.

    ``sets_of`` gives (row of each shingle, shingle, set key and size of each
    row) of a batch of ``source``.
    A chunk sends each of its shingles once: what occurs twice within the chunk
    is counted there.  Shingles travel as 32 bits within their bucket; two that
    look alike only let a set through.
    """
    def local(batches):
        for batch in _parts(batches):
            rows = _sent_rows(*sets_of(batch), share, n_buckets)
            if rows:
                yield _packed(rows)

    def merge(key, pdf):
        done = pdf[pdf["tokens"].isna()]
        sent = pdf[pdf["tokens"].notna()]
        keys = [np.frombuffer(b, np.int64) for b in done["keys"]]
        counts = [np.frombuffer(b, np.int64) for b in done["key_counts"]]
        if len(sent):
            t = np.concatenate([np.frombuffer(b, np.uint32) for b in sent["tokens"]])
            k = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32))
                                for a, b in zip(sent["keys"], sent["sizes"])])
            order = np.argsort(t, kind="stable")
            t, k = t[order], k[order]
            new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            times = np.diff(np.r_[new, len(t)])
            owners, n = np.unique(k[np.repeat(times > 1, times)], return_counts=True)
            keys.append(owners[owners != 0])                         # 0 marks what a chunk has counted itself
            counts.append(n[owners != 0])
        # the bucket's sums go on as one row per part of the sets
        key, n = np.concatenate(keys), np.concatenate(counts)
        part = key % n_buckets
        order = np.argsort(part, kind="stable")
        key, n, part = key[order], n[order], part[order]
        cut = np.searchsorted(part, np.arange(n_buckets + 1))
        used = np.flatnonzero(cut[1:] > cut[:-1])
        return pd.DataFrame({"part": used.astype(np.int32), "keys": [key[cut[u]: cut[u + 1]].tobytes() for u in used],
                             "counts": [n[cut[u]: cut[u + 1]].astype(np.uint32).tobytes() for u in used]})

    def total(key, pdf):
        owners, of = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in pdf["keys"]]), return_inverse=True)
        n = np.bincount(of, np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["counts"]]), len(owners))
        return pd.DataFrame({"set_key": owners, "n": n.astype(np.int64)})

    return (source.mapInArrow(local, _SENT).groupBy("bucket")
            .applyInPandas(merge, "part int, keys binary, counts binary")
            .groupBy("part").applyInPandas(total, "set_key long, n long"))


def slot_ranks(sets: DataFrame) -> np.ndarray:
    """Rank of each of 2^SLOT_BITS shingle slots: standard deviations of its count above the mean, 0 if in the noise.

    Only the slots that stand out come to the driver, at most 2^SLOT_BITS.
    """
    def run(batches):
        slots = [np.zeros(0, np.int64)]
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            slots.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
        used, n = np.unique(np.concatenate(slots), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n.astype(np.int32))], ["slot", "n"])

    counts = stored(sets.select("shingles").mapInArrow(run, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")),
                    "slots")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mean = max(total / (1 << SLOT_BITS), 1.0)
    got = counts.where(F.col("n") > mean + 4 * float(np.sqrt(mean))).toArrow()
    rank = np.zeros(1 << SLOT_BITS, np.uint16)
    rank[got["slot"].to_numpy()] = np.clip((got["n"].to_numpy() - mean) / np.sqrt(mean) - 3, 0, 65535)
    return rank


def _stars(tokens, keys):
    """Edges from every set to one set with the same token; tokens that one set has alone give none."""
    order = np.lexsort((keys, tokens))
    t, k = tokens[order], keys[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(t)])
    least = np.repeat(k[first], count) if len(t) else k
    many = k != least
    edges = np.unique(np.column_stack([k[many], least[many]]), axis=0) if many.any() else np.zeros((0, 2), np.int64)
    return edges, t[first] if len(t) else t, k[first] if len(t) else k


_EDGE = "bucket int, tokens binary, keys binary, edges binary"


def blocks(sets: DataFrame, ranks, n_buckets: int) -> DataFrame:
    """(vertex = set_key, component = block) of the sets that share a prefix shingle with another set."""
    def local(batches):
        for batch in _parts(batches):
            lists = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            size = np.array([len(x) for x in lists])
            s, rows = np.concatenate(lists), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((s, ranks.value[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], rows))
            s = s[order]
            use = np.arange(len(s)) - (np.cumsum(size) - size)[rows] < prefix_length(size)[rows]
            tokens, keys = s[use], batch.column(0).to_numpy()[rows[use]]
            edges, t, k = _stars(tokens, keys)
            bucket = ((t >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1))       # t is sorted, so is the bucket
            used = np.flatnonzero(cut[1:] > cut[:-1])
            columns = [used.tolist(), [t[cut[u]: cut[u + 1]].tobytes() for u in used],
                       [k[cut[u]: cut[u + 1]].tobytes() for u in used], [None] * len(used)]
            if len(edges):
                extra = [int(edges[0, 0] % n_buckets), None, None, edges.astype(np.int64).tobytes()]
                columns = [c + [x] for c, x in zip(columns, extra)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.binary(), pa.binary(), pa.binary()])],
                ["bucket", "tokens", "keys", "edges"])

    def merge(key, pdf):
        sent = pdf[pdf["tokens"].notna()]
        pairs = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in pdf["edges"].dropna()]
        if len(sent):
            pairs.append(_stars(np.concatenate([np.frombuffer(b, np.uint64) for b in sent["tokens"]]),
                                np.concatenate([np.frombuffer(b, np.int64) for b in sent["keys"]]))[0])
        return pd.DataFrame(np.unique(np.concatenate(pairs), axis=0), columns=["a", "b"]).astype("int64")

    edges = (sets.select("set_key", "shingles").mapInArrow(local, _EDGE)
             .groupBy("bucket").applyInPandas(merge, "a long, b long"))
    return components(edges, "blocks")


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of a set: one of BITS bits per shingle."""
    bits = np.zeros(BITS // 64, np.uint64)
    b = np.unique(shingles >> np.uint64(64 - BITS.bit_length() + 1))
    np.bitwise_or.at(bits, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    return bits


class SignatureTree:
    """Levels of nodes over sets ordered by size: bitmap, least and largest size, most hidden shingles."""

    def __init__(self, sizes, bits: np.ndarray):
        n = np.asarray(sizes, np.int64)
        slack = n - np.bitwise_count(bits).sum(1).astype(np.int64)    # shingles that share a bit with another
        self.levels = [(bits, n, n, slack)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))
            fan = FANOUT
        self.fans = [1, LEAF] + [FANOUT] * len(self.levels)

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> "SignatureTree":
        return cls([len(s) for s in sets], np.stack([signature(s) for s in sets]))

    def children(self, level: int, node: int) -> np.ndarray:
        fan = self.fans[level]
        return np.arange(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0])))


def _possible(left, right, a, b) -> np.ndarray:
    """Pairs of nodes (a of left, b of right) whose sets may overlap enough."""
    b1, lo1, hi1, s1 = left
    b2, lo2, hi2, s2 = right
    lo1, lo2 = lo1[a], lo2[b]
    fits = (100 * hi1[a] >= PERCENT * lo2) & (100 * hi2[b] >= PERCENT * lo1)
    shared = np.minimum(s1[a], s2[b])
    for lo in range(0, len(a), SLICE):                               # bitmaps of so many pairs at a time
        at = slice(lo, lo + SLICE)
        shared[at] += np.bitwise_count(b1[a[at]] & b2[b[at]]).sum(1).astype(np.int64)
    return fits & ((100 + PERCENT) * shared >= PERCENT * (lo1 + lo2))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact test of two sorted sets."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def tree_candidates(left: SignatureTree, right: SignatureTree | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (of left, of right) that no node above them rules out; right None: within left, first < second.

    Pairs of nodes are opened level by level, both at once in equal levels,
    else the taller tree's.
    """
    own = right is None
    right = left if own else right
    level = [len(left.levels) - 1, len(right.levels) - 1]
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(left.levels[level[0]], right.levels[level[1]], a, b)
        if own:
            keep &= a <= b if level[0] else a < b
        a, b = a[keep], b[keep]
        if not len(a) or level == [0, 0]:
            break
        go = [lv == max(level) for lv in level]
        firsts, seconds = [], []
        for i, j in zip(a.tolist(), b.tolist()):
            x = left.children(level[0], i) if go[0] else np.array([i])
            y = right.children(level[1], j) if go[1] else np.array([j])
            firsts.append(np.repeat(x, len(y)))
            seconds.append(np.tile(y, len(x)))
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        level = [lv - g for lv, g in zip(level, go)]
    # neighbours in size first: copies join early and later pairs are skipped
    order = np.argsort(np.abs(left.levels[0][1][a] - right.levels[0][1][b]), kind="stable")
    return a[order], b[order]


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Spanning links between sets ordered by size: (index in left, index in right); right None: within left."""
    tree = SignatureTree.of(left)
    a, b = tree_candidates(tree, None if right is None else SignatureTree.of(right))
    base, others = (0, left) if right is None else (len(left), right)
    parent = list(range(base + len(others)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        ri, rj = root(i), root(base + j)
        if ri != rj and similar(left[i], others[j]):
            parent[rj] = ri
            out.append((i, j))
    return out


def _links_task(pdf):
    a, b = [], []
    for _, part in pdf.groupby(["block", "tile_a", "tile_b"]):
        part = part.sort_values(["side", "n_shingles", "set_key"])
        keys, side = part["set_key"].to_numpy(), part["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        cut = int((side == 0).sum())
        if part["tile_a"].iloc[0] == part["tile_b"].iloc[0]:
            found = tree_links(sets, None)
            b_keys = keys
        elif 0 < cut < len(sets):
            found = tree_links(sets[:cut], sets[cut:])
            b_keys = keys[cut:]
        else:
            continue
        a.extend(int(keys[i]) for i, _ in found)
        b.extend(int(b_keys[j]) for _, j in found)
    return pd.DataFrame({"a": a, "b": b}).astype("int64")


def _pairs_task(pdf):
    """Pairs of sets in different components that the signature trees of two tiles leave over."""
    a, b, task = [], [], pdf["task"].iloc[0]
    for _, part in pdf.groupby(["block", "tile_a", "tile_b"]):
        part = part.sort_values(["side", "n_shingles", "set_key"])
        keys, comp, side = (part[c].to_numpy() for c in ("set_key", "component", "side"))
        bits = np.stack([np.frombuffer(x, np.uint64) for x in part["bits"]])
        n, cut = part["n_shingles"].to_numpy(), int((side == 0).sum())
        if part["tile_a"].iloc[0] == part["tile_b"].iloc[0]:
            i, j = tree_candidates(SignatureTree(n, bits), None)
        elif 0 < cut < len(n):
            i, j = tree_candidates(SignatureTree(n[:cut], bits[:cut]), SignatureTree(n[cut:], bits[cut:]))
            j = j + cut
        else:
            continue
        apart = comp[i] != comp[j]
        a.append(keys[i[apart]])
        b.append(keys[j[apart]])
    z = [np.zeros(0, np.int64)]
    out = pd.DataFrame({"a": np.concatenate(a or z), "b": np.concatenate(b or z)}).astype("int64")
    return out.assign(task=task).astype("int64")


def _tile_pairs(tiled: DataFrame, partners: DataFrame, n_groups: int) -> DataFrame:
    """Rows of ``tiled`` (set_key, block, tile, n_tiles, ..) for each pair of tiles in ``partners`` (block, tile, other, side).

    Column task: blocks of one tile share groups, a pair of tiles of a large block is a group of its own.
    """
    work = tiled.join(partners.hint("merge"), ["block", "tile"]).withColumns({
        "tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
    return work.withColumn("task", F.when(F.col("n_tiles") == 1, F.pmod(F.xxhash64("block"), F.lit(n_groups))).otherwise(
        F.xxhash64("block", "tile_a", "tile_b")))


def _joined(tiled: DataFrame, partners: DataFrame, texts: DataFrame, n_groups: int) -> DataFrame:
    """Spanning links within and between the tiles, compared exactly."""
    work = _tile_pairs(tiled, partners, n_groups).join(texts.hint("merge"), "set_key")     # the same plan at every size
    return (work.select("task", "block", "tile_a", "tile_b", "side", "set_key", "n_shingles", "shingles")
            .groupBy("task").applyInPandas(_links_task, "a long, b long"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar; a set goes once to each task (pair of tiles) that needs it."""
    none = F.lit(None).cast("long")
    need = (pairs.select("task", F.col("a").alias("set_key"), F.col("b").alias("other"))
            .union(pairs.select("task", F.col("b").alias("set_key"), none))
            .groupBy("task", "set_key").agg(F.collect_set("other").alias("others")))     # at most two tiles

    def run(pdf):
        sets = {k: np.frombuffer(x, np.uint64) for k, x in zip(pdf["set_key"], pdf["shingles"])}
        found = [(a, b) for a, others in zip(pdf["set_key"], pdf["others"]) for b in others
                 if similar(sets[a], sets[b])]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return need.join(texts.select("set_key", "shingles").hint("merge"), "set_key").groupBy("task").applyInPandas(run, "a long, b long")


FILTER_BITS = 24


def _slot(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS))


def _bitmap(rows: DataFrame, *columns: str) -> np.ndarray:
    """2^FILTER_BITS bits; those of the rows' column values are set."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    used = (rows.select(_slot(*columns).alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word"))
            .agg(F.bit_or(bit).alias("bits")).toArrow())              # at most 2^FILTER_BITS / 64 rows
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[used["word"].to_numpy()] = used["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return bitmap


def _in_bitmap(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_key, n_shingles, shingles) of the wanted sets (set_key, at_doc: a document that has it).

    A bitmap of 2^FILTER_BITS bits over the documents' ids, sent to the tasks,
    leaves most other documents out and nothing is shuffled.  Some sets that
    are not wanted, and repeated rows, may come along.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_bitmap(wanted, "at_doc"))

    def run(batches):
        for batch in _parts(batches):
            text = batch.column(0).filter(pa.array(_in_bitmap(shared.value, batch.column(1).to_numpy())))
            rows, s = shingle_sets(text)
            key, size = _set_keys(rows, s, len(text))
            first = np.cumsum(size) - size
            full = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[full]), pa.array(size[full]),
                 pa.array([s[first[i]: first[i] + size[i]].tobytes() for i in full.tolist()], pa.binary())],
                ["set_key", "n_shingles", "shingles"])

    found = documents.select("text", _slot("doc_id").alias("slot")).mapInArrow(
        run, "set_key long, n_shingles long, shingles binary")
    return found


def join(documents: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n_shingles, set_key; one row per linked set: set_key, component)."""
    spark = documents.sparkSession
    n = shuffle_width(spark)
    docs = documents.select("doc_id", "text")
    light = stored(signed(docs), "signed")
    sets = light.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("at_doc"),
                                                                    F.max("n_shingles").alias("size"))
    overlap = F.ceil(F.col("size") * PERCENT / 100)
    need = F.greatest(F.lit(1), F.floor(overlap / 8))
    shared = shared_counts(docs.select("text"), _sets_of_texts, _eighth, n)
    wanted = stored(sets.join(shared.hint("merge"), "set_key").where(F.col("n") >= need).select("set_key", "at_doc"), "wanted")
    texts = stored(full_sets(docs, wanted), "full-sets")
    # the same once more among these, with all their shingles
    shared = shared_counts(texts.select("set_key", "shingles"), _sets_of_sets, lambda size: size, n)
    mutual = (stored(shared, "mutual").join(texts.select("set_key", F.col("n_shingles").alias("size")).hint("merge"), "set_key")
              .where(F.col("n") >= overlap).select("set_key").distinct())
    texts = stored(texts.join(stored(mutual, "candidates").hint("merge"), "set_key").dropDuplicates(["set_key"]),
                   "candidate-sets")
    ranks = spark.sparkContext.broadcast(slot_ranks(texts))
    in_block = stored(blocks(texts, ranks, n).select(F.col("vertex").alias("set_key"), F.col("component").alias("block")),
                      "in-block")
    sizes = in_block.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles"))
    tiled = salted_join(in_block, sizes.hint("merge"), "block", ["set_key"], "inner").withColumn(
        "tile", F.pmod("set_key", F.col("n_tiles")).cast("int"))
    each = sizes.select("block", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("t"))
    own = each.select("block", F.col("t").alias("tile"), F.col("t").alias("other"), F.lit(0).alias("side"))
    hub = each.where("t > 0")
    star = (hub.select("block", F.lit(0).alias("tile"), F.col("t").alias("other"), F.lit(0).alias("side"))
            .union(hub.select("block", F.col("t").alias("tile"), F.lit(0).alias("other"), F.lit(1).alias("side"))))
    first = stored(_joined(tiled, own.union(star), texts, 4 * n), "links")
    linked = components(first, "set-components").withColumnRenamed("vertex", "set_key")
    large = tiled.where("n_tiles > 2").select("set_key", "block")     # of two tiles all pairs have met
    if not large.isEmpty():
        linked = stored(linked, "linked")
        first = first.union(stored(_second_round(large, linked, texts, tile, n), "links-2"))
        linked = components(first, "set-components").withColumnRenamed("vertex", "set_key")
    return light, linked


def _second_round(large: DataFrame, linked: DataFrame, texts: DataFrame, tile: int, n: int) -> DataFrame:
    """Links between sets of a large block of which one at least is outside the block's main component."""
    tile *= WIDE
    member = large.join(linked.hint("merge"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    member = stored(member, "members")
    per = member.groupBy("block", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("block").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    main = main.select("block", F.col("m.component").alias("main"), F.ceil(F.col("m.n") / tile).cast("int").alias("n_in"),
                       F.ceil((F.col("all") - F.col("m.n")) / tile).cast("int").alias("n_out")).where("n_out > 0")
    # tiles 0 .. n_out-1 hold the others, n_out .. n_out+n_in-1 the main component
    is_out = F.col("component") != F.col("main")
    tiled = salted_join(member, main.hint("merge"), "block", ["set_key"], "inner").withColumn(
        "tile", F.when(is_out, F.pmod("set_key", F.col("n_out"))).otherwise(
            F.pmod("set_key", F.col("n_in")) + F.col("n_out")).cast("int"))
    tiled = tiled.select("set_key", "block", "component", "tile", F.lit(2).alias("n_tiles"))
    pair = (main.select("block", "n_in", "n_out", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("x"))
            .select("block", "x", F.explode(F.sequence(F.col("x"), F.col("n_out") + F.col("n_in") - 1)).alias("y")))
    sides = (pair.select("block", F.col("x").alias("tile"), F.col("y").alias("other"), F.lit(0).alias("side"))
             .union(pair.where("x != y").select("block", F.col("y").alias("tile"), F.col("x").alias("other"),
                                                F.lit(1).alias("side"))))
    def run(batches):
        for batch in batches:
            bits = [signature(np.frombuffer(x, np.uint64)).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())],
                                             ["set_key", "n_shingles", "bits"])

    signatures = texts.select("set_key", "n_shingles", "shingles").mapInArrow(
        run, "set_key long, n_shingles long, bits binary")
    work = _tile_pairs(tiled.join(signatures.hint("merge"), "set_key"), sides, 4 * n)
    pairs = (work.select("task", "block", "tile_a", "tile_b", "side", "set_key", "component", "n_shingles", "bits")
             .groupBy("task").applyInPandas(_pairs_task, "a long, b long, task long"))
    return _verified(stored(pairs, "pairs"), texts)


@tidy
def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links), set_key, component."""
    light, linked = join(documents)
    least = (light.where("set_key is not null").groupBy("set_key")
             .agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    # a set that one document has and that links with nothing needs no lookup
    named = (least.join(linked.hint("merge"), "set_key", "left").where(F.col("component").isNotNull() | (F.col("n") > 1))
             .withColumn("component", F.coalesce("component", "set_key")))
    named = stored(named.drop("n"), "named-sets")
    top = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_set = stored(salted_join(named, top.hint("merge"), "component", ["set_key"], "inner")
                     .select("set_key", "component_id", "component"), "set-ids")
    out = salted_join(light, per_set.hint("merge"), "set_key", ["doc_id"])
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                      .alias("component_id"), "set_key", F.coalesce("component", "set_key").alias("component"))


@tidy
def keep_one(documents: DataFrame) -> DataFrame:
    """The documents of which one row per component stays: its least doc_id; documents without words all stay.

    Repeated rows with that doc_id and set are one document: one of them stays.
    """
    doc, chosen, key, slot, row = fresh(documents.columns, "winner_doc", "winner_set", "set_key", "slot", "copy")
    light = stored(near_duplicates(documents).where("set_key is not null")
                   .groupBy("component", "component_id", "doc_id", "set_key").agg(F.count("*").alias("n")), "keep")
    winners = (light.where("doc_id <=> component_id").groupBy("component")
               .agg(F.min(F.struct("doc_id", "set_key")).alias("w")).select("w.doc_id", "w.set_key"))
    winners = stored(winners, "winners")
    losers = light.join(winners, light["doc_id"].eqNullSafe(winners["doc_id"]) & (light["set_key"] == winners["set_key"]),
                        "left_anti")
    # most documents are neither losers nor repeated rows: a bitmap lets those through where they are
    suspects = losers.union(light.where("n > 1"))
    shared = documents.sparkSession.sparkContext.broadcast(_bitmap(suspects, "doc_id", "set_key"))

    def compute(text):
        keys, size = _set_keys(*shingle_sets(text), len(text))
        return [pa.array(keys, mask=size == 0)]

    keyed = add_columns(documents, ["text"], compute, f"{key} long").withColumn(slot, _slot("doc_id", key))

    def suspected(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                keep = _in_bitmap(shared.value, batch.column(batch.schema.get_field_index(slot)).to_numpy())
                empty = batch.column(batch.schema.get_field_index(key)).is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array((keep & ~empty) == wanted))

        return keyed.mapInArrow(run, keyed.schema)

    won = winners.withColumnsRenamed({"doc_id": doc, "set_key": chosen})
    one = suspected(True).join(won, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(chosen)))
    order = Window.partitionBy(doc, chosen).orderBy(*[F.col(c) for c, t in documents.dtypes if "map<" not in t])
    one = one.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return suspected(False).select(*documents.columns).union(one.select(*documents.columns))

"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a short vector of counts and shares; each feature is cut
into quantile bins.  Shallow trees over the bins of one feature at a time are
boosted in turn (cyclic, small steps) and summed into one lookup table per
feature; then the pairs of features whose joint bins explain most of what is
left get a two-dimensional table, boosted the same way.  A score is the
logistic of the sum of table entries, so scoring is bin search plus additions.

Only fitting is local, on at most ``FIT_ROWS`` labelled rows (the bound is a
parameter; rows are taken in the order of a hash of their id).  Features and
scores are computed by Spark over all rows and whole texts.

Defined results: null and empty texts are scored as texts without words;
labels that are null, or whose id is null or not in the documents, are not
used; an id labelled twice counts with its lowest label; with no usable label,
or only one class, every score is the smoothed share of label 1.  Repeated
documents get equal scores.  Other columns pass through; columns named like
the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm import _text
from retentia.llm._columns import add_columns

FIT_ROWS = 40_000
FEATURES = ["log_words", "word_length", "upper", "symbol", "exclaim", "bar", "digit", "high", "stop", "comma",
            "distinct", "same_as_last", "repeat_window", "dup_line", "line_words", "odd_end", "cap_word", "long_word"]

_CLASS = {name: np.zeros(256, bool) for name in ("upper", "letter", "symbol", "exclaim", "bar", "digit", "high",
                                                 "stop", "comma", "cont")}
_CLASS["upper"][65:91] = True
_CLASS["letter"][65:91] = True
_CLASS["letter"][97:123] = True
_CLASS["symbol"][list(b"#*$%&|<>@^~{}[]\\=+_")] = True
_CLASS["exclaim"][list(b"!")] = True
_CLASS["bar"][list(b"|")] = True
_CLASS["digit"][48:58] = True
_CLASS["high"][0x80:] = True
_CLASS["stop"][list(b".?")] = True
_CLASS["comma"][list(b",;:")] = True


def _chunk_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    size = np.maximum(np.diff(offs), 1)

    def total(flags):   # per row
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[offs[1:]] - c[offs[:-1]]

    start, end, row = _text.words(data, offs)
    n_words = np.bincount(row, minlength=n)
    per_word = np.maximum(n_words, 1)
    share = {k: total(_CLASS[k][data]) for k in ("upper", "letter", "symbol", "exclaim", "bar", "digit", "high",
                                                 "stop", "comma")}
    h = _text.RollingHash(data).spans(start, end)
    by_row = lambda flags: np.bincount(row[flags], minlength=n) / per_word
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    at = _text.window_starts(row, 4)
    wh = np.sort((row[at].astype(np.uint64) << np.uint64(40)) | (_text.window_hash(h, at, 4) >> np.uint64(24)))
    again = np.r_[False, wh[1:] == wh[:-1]] if len(wh) else np.zeros(0, bool)
    repeats = np.bincount((wh[again] >> np.uint64(40)).astype(np.int64), minlength=n)
    ls, le, lrow = _text.lines(data, offs, start)
    lh = np.sort((lrow.astype(np.uint64) << np.uint64(40)) | (_text.RollingHash(data).spans(ls, le) >> np.uint64(24)))
    ldup = np.r_[False, lh[1:] == lh[:-1]] if len(lh) else np.zeros(0, bool)
    n_lines = np.bincount(lrow, minlength=n)
    last, first = data[end - 1], data[start]
    out[:] = np.column_stack([
        np.log1p(n_words), np.minimum(total(~_CLASS["cont"][data]) / per_word, 60),
        share["upper"] / np.maximum(share["letter"], 1), share["symbol"] / size, share["exclaim"] / size,
        share["bar"] / per_word, share["digit"] / size, share["high"] / size, share["stop"] / per_word,
        share["comma"] / per_word, distinct / per_word, by_row(same), repeats / per_word,
        np.bincount((lh[ldup] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(n_lines, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)),
        by_row(~(_CLASS["letter"][last] | _CLASS["high"][last] | _CLASS["stop"][last] | _CLASS["comma"][last])),
        by_row(_CLASS["upper"][first]), by_row(end - start > 15)])
    out[n_words == 0, 1] = 0
    return out


def features_of(column) -> np.ndarray:
    """Feature matrix of a batch of whole texts."""
    parts = [_chunk_features(data, offs) for _, _, data, offs in _text.chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class Model:
    """Bin edges and lookup tables; ``pairs`` maps (feature, feature) to a table over coarse bins."""

    def __init__(self, bias, edges=(), tables=(), coarse=(), pairs=None):
        self.bias, self.edges, self.tables, self.coarse, self.pairs = bias, edges, tables, coarse, pairs or {}

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), float(self.bias))
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for (a, b), t in self.pairs.items():
            z += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf_values(g, h, depth=2, lam=1.0):
    """Tree over ordered bins: each split maximises the gain of its two sides; one value per bin."""
    values = np.zeros(len(g))

    def grow(lo, hi, left):
        gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
        if left and hi - lo > 1:
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gain = gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                grow(lo, lo + k + 1, left - 1)
                grow(lo + k + 1, hi, left - 1)
                return
        values[lo:hi] = gs / (hs + lam)

    grow(0, len(g), depth)
    return values


def _quadrants(g, h, lam=1.0):
    """Best cut of a two-dimensional grid into four blocks: (gain, value per cell)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right, down = cg[:-1, -1:] - a, cg[-1:, :-1] - a
    hright, hdown = ch[:-1, -1:] - b, ch[-1:, :-1] - b
    blocks = [(a, b), (right, hright), (down, hdown), (gt - a - right - down, ht - b - hright - hdown)]
    gain = sum(x**2 / (np.maximum(y, 0) + lam) for x, y in blocks) - gt**2 / (ht + lam)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.empty_like(g)
    for (x, y), where in zip(blocks, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1:], np.s_[i + 1:, : j + 1],
                                      np.s_[i + 1:, j + 1:])):
        value[where] = x[i, j] / (max(y[i, j], 0) + lam)
    return gain[i, j], value


def boost(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6,
          pair_bins: int = 8, pair_rounds: int = 60) -> Model:
    """Fit the model to a feature matrix and 0/1 labels."""
    n1, n = float(y.sum()), len(y)
    bias = float(np.log((n1 + 1) / (n - n1 + 1)))
    if n1 in (0.0, float(n)):
        return Model(bias)
    edges = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(n, bias)
    for _ in range(rounds):
        for b, t in zip(binned, tables):
            if len(t) == 1:
                continue
            p = 1 / (1 + np.exp(-z))
            step = rate * _leaf_values(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += step
            z += step[b]
    coarse = [_cuts(x[:, j], pair_bins) for j in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(a, b, w):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(small[a] * shape[1] + small[b], w, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    usable = [j for j in range(x.shape[1]) if len(coarse[j])]
    gains = sorted(((_quadrants(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b)
                    for i, a in enumerate(usable) for b in usable[i + 1:]), reverse=True)
    pairs = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), t in pairs.items():
            p = 1 / (1 + np.exp(-z))
            step = rate * _quadrants(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            t += step
            z += step[small[a], small[b]]
    return Model(bias, edges, tables, coarse, pairs)


def held_out(doc_id):
    """True for the ids kept out of fitting: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled documents that are not held out, ``fit_rows`` at most."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").cast("double").alias("_label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = documents.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "_label")

    def run(batches):
        for batch in batches:
            x = features_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = (rows.mapInArrow(run, "x array<double>, y double").orderBy(F.xxhash64("x", "y")).limit(fit_rows).toPandas())
    if not len(got):
        return Model(0.0)
    return boost(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``documents`` plus score double and predicted int (1 if score >= threshold)."""
    def compute(text):
        s = model.score(features_of(text))
        return pa.array(s), pa.array((s >= threshold).astype(np.int32))

    return add_columns(documents, ["text"], compute, "score double, predicted int")

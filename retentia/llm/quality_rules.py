"""Quality rules: word, symbol, line and repetition counts, then n-gram perplexity bands per language.

The perplexity comes from modified Kneser-Ney models over the bytes of the
lower-cased text (order ``ORDER``).  Spark counts the n-grams of all
documents;
counts of counts give the three discounts of the highest order, lower orders
use continuation counts.  The interpolated log-probabilities are kept in sorted
hash arrays, one per order; a context that is not in them backs off to the next
lower order.  Up to ``MOST`` n-grams of the highest order are sent to the tasks;
more stay in a partitioned table, in which the distinct n-grams of each chunk of
texts are looked up (``_ngrams.Parted``), with the same log-probabilities.

No text is scored by a model that has counted it: texts are split in two halves
by their crc32, so copies are in the same half, and each half is scored by the
model of the other one, in which every distinct text counts once.  Texts with
many copies are therefore not predicted better than others and do not bend the
model that scores the others.

A document's log-perplexity per byte is judged against the band of its
language, taken over all documents of the language that pass the rules, copies
(equal perplexity and counts) once: it reaches from the median down ``BELOW``
times the distance to the 16th percentile and up ``ABOVE`` times the distance to
the 84th, each distance at least ``LEAST_SPREAD``.  Both ends reject: lists and
random letters lie above, generated repetition and symbol noise below.

Defined results: null and empty texts have no words and fail the rules; a null
language is a language of its own; repeated rows are judged alike; an empty
table gives no rows; other columns pass through, columns named like the outputs
are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm import _ngrams, _text
from retentia.llm._columns import add_columns, fresh
from retentia.llm._store import stored, tidy

ORDER = 5
MOST = 4_000_000
WINDOW = 8
ABOVE = 3.5
BELOW = 3.5
LEAST_SPREAD = 0.02
SALTS = 16
FEW_BANDS = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ROW = np.uint64(0x9E3779B97F4A7C15)


def _by_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal items of the same row."""
    return _text.mix(h ^ ((row + 1).astype(np.uint64) * _ROW))


def base_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offs) - 1
    out = np.zeros((n, 5), np.int64)
    if not len(data):
        return out
    start, end, row = _text.words(data, offs)

    def prefix(flags):
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c

    chars = prefix((data & 0xC0) != 0x80)
    hashes = _text.RollingHash(data)
    out[:, 0] = np.bincount(row, minlength=n)
    out[:, 1] = np.bincount(row, chars[end] - chars[start], n)
    symbols = prefix(_SYMBOL[data])
    out[:, 2] = symbols[offs[1:]] - symbols[offs[:-1]]
    ls, le, lrow = _text.lines(data, offs, start)
    key = np.sort(_by_row(hashes.spans(ls, le), lrow))
    if len(key) and (key[1:] == key[:-1]).any():
        key, of = np.unique(_by_row(hashes.spans(ls, le), lrow), return_index=True)
        out[:, 3] = np.bincount(lrow, minlength=n) - np.bincount(lrow[of], minlength=n)
    at = _text.window_starts(row, WINDOW)
    wh = _by_row(_text.window_hash(hashes.spans(start, end), at, WINDOW), row[at])
    order = np.argsort(wh)
    wh = wh[order]
    same = np.flatnonzero(wh[1:] == wh[:-1])
    if len(same):
        again = at[order[np.union1d(same, same + 1)]]
        cover = np.zeros(len(row) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        out[:, 4] = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _discounts(coc) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the counts of counts."""
    d = np.zeros(4)
    if coc[1] + 2 * coc[2] == 0:
        return np.array([0, 0.5, 0.75, 0.75])
    y = coc[1] / (coc[1] + 2 * coc[2])
    for i in (1, 2, 3):
        raw = i - (i + 1) * y * coc[i + 1] / coc[i] if coc[i] else 0.75
        d[i] = min(max(raw, 0.05), i)
    return d


class Model:
    """Sorted hash arrays per order: log-probability of n-grams and log back-off weight of contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, coc, order: int = ORDER, pairs=None, middle=None):
        """``pairs``, ``middle``: for ``keys`` that are only a part of the corpus (``Parted``).

        ``pairs`` holds the n-grams of two bytes with their continuation counts and
        ``middle`` the counts of counts of the orders between 2 and ``order``.
        """
        self.order = order
        levels = [(keys, counts)]
        for k in range(order - 1, 0, -1):      # continuation counts of the next lower order
            shorter = np.unique(levels[0][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
            levels.insert(0, pairs if k == 2 and pairs is not None else shorter)
        below_keys, below = None, None
        self.grams, self.contexts = [], []
        for k, (ks, cs) in enumerate(levels, 1):
            of_order = coc if k == order else (middle or {}).get(k)
            d = _discounts(np.bincount(np.minimum(cs, 5), minlength=6)[:5] if of_order is None else of_order)
            ctx, of = np.unique(ks >> np.uint64(8), return_inverse=True)
            total = np.bincount(of, cs, len(ctx))
            taken = d[np.minimum(cs, 3)]
            gamma = np.bincount(of, taken, len(ctx)) / np.maximum(total, 1)
            if k == 1:
                lower = np.full(len(ks), 1 / 257)
            else:
                lower = below[np.searchsorted(below_keys, ks & np.uint64((1 << 8 * (k - 1)) - 1))]
            p = (cs - taken) / np.maximum(total[of], 1) + gamma[of] * lower
            below_keys, below = ks, p
            grams, contexts = _ngrams.SortedHash(ks), _ngrams.SortedHash(ctx)
            self.grams.append((grams, grams.aligned(np.log(p))))
            self.contexts.append((contexts, contexts.aligned(np.log(np.maximum(gamma, 1e-9)))))
            grams.drop_order(), contexts.drop_order()

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        """Natural log-probability of each packed n-gram's last byte after the bytes before it."""
        out = np.zeros(len(keys))
        todo, keys = np.arange(len(keys)), keys
        for k in range(self.order, 0, -1):
            grams, value = self.grams[k - 1]
            at = grams.find(keys)
            hit = at >= 0
            if hit.all():
                out[todo] += value[at]
                return out
            out[todo[hit]] += value[at[hit]]
            todo, keys = todo[~hit], keys[~hit]
            contexts, weight = self.contexts[k - 1]
            out[todo] += weight[contexts.find(keys >> np.uint64(8))]      # unknown context: index -1 holds 0
            keys = keys & np.uint64((1 << 8 * (k - 1)) - 1)
        out[todo] += np.log(1 / 257)
        return out


def _counts_of_counts(counts: DataFrame) -> np.ndarray:
    few = {int(r[0]): int(r[1]) for r in counts.where("n <= 4").groupBy("n").agg(F.count("*")).collect()}
    return np.array([0] + [few.get(i, 0) for i in range(1, 5)])


def _half(text):
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % 2


def fit(documents: DataFrame, order: int = ORDER, most: int = MOST) -> list[Model] | list[_ngrams.Parted]:
    """For each half of the texts the model that scores it, counted over the distinct texts of the other half.

    They are ``Parted`` if both have over ``most`` n-grams of the highest order together.
    """
    halves = [documents.where(_half(F.col("text")) == 1 - half).select("text").distinct() for half in (0, 1)]
    counts = [stored(_ngrams.count_ngrams(texts, "text", order, 0, _text.LOWER), "kn-counts") for texts in halves]
    small = sum(c.count() for c in counts) <= most
    return [_whole(c, order) if small else _parted(c, order) for c in counts]


def _whole(counts: DataFrame, order: int) -> Model:
    return Model(*_ngrams.collected(counts), _counts_of_counts(counts), order)


def _parted(counts: DataFrame, order: int) -> _ngrams.Parted:
    coc, middle, shorter = _counts_of_counts(counts), {}, counts
    for k in range(order - 1, 2, -1):
        shorter = stored(_ngrams.suffixes(shorter, k, F.count("*")), "kn-shorter")
        middle[k] = _counts_of_counts(shorter)
    pairs = _ngrams.collected(_ngrams.suffixes(shorter, 2, F.count("*")))
    return _ngrams.Parted(counts, lambda keys, n: Model(keys, n, coc, order, pairs, middle))


def annotate(documents: DataFrame, models: list, order: int = ORDER) -> DataFrame:
    """``documents`` plus the base columns and log_ppl (natural log per byte; null without bytes)."""
    parted = isinstance(models[0], _ngrams.Parted)
    shared = None if parted else documents.sparkSession.sparkContext.broadcast(models)

    def keys_of(data, offs):
        return _ngrams.packed(_text.LOWER[data], offs, order, 0)

    def by_halves(data, offs):
        """Log-probabilities of a chunk, each row's from the model of its half."""
        half = np.array([zlib.crc32(data[a:b]) & 1 for a, b in zip(offs[:-1], offs[1:])], bool)
        keys, second = keys_of(data, offs), np.repeat(half, np.diff(offs))
        out = np.zeros(len(data))
        for model, mine in zip(shared.value, (~second, second)):
            out[mine] = model.log_prob(keys[mine])
        return out

    def compute(text, find=None):
        counts, ppl = [], []
        for _, _, data, offs in _text.chunks(text):
            counts.append(base_counts(data, offs))
            lp = np.zeros(len(data) + 1)
            np.cumsum(find(keys_of(data, offs)) if find else by_halves(data, offs), out=lp[1:])
            with np.errstate(invalid="ignore"):
                ppl.append(-(lp[offs[1:]] - lp[offs[:-1]]) / np.diff(offs))
        c = np.concatenate(counts) if counts else np.zeros((0, 5), np.int64)
        failed = (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])
        p = np.concatenate(ppl) if ppl else np.zeros(0)
        return [*(pa.array(c[:, k]) for k in range(5)), pa.array(failed), pa.array(p, mask=np.isnan(p))]

    fields = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, log_ppl double")
    if parted:
        first, second = (m.add_columns(documents.where(_half(F.col("text")) == half), "text", keys_of, compute, fields)
                         for half, m in enumerate(models))
        return first.union(second)
    return add_columns(documents, ["text"], compute, fields)


def bands(annotated: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(lang, low, high): the language's band of log-perplexity; one row per language."""
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)), F.lit(1000))
    down = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))
    up = F.greatest(F.col("q")[2] - F.col("q")[1], F.lit(LEAST_SPREAD))
    alike = [c for c in ("lang", "log_ppl", "n_words", "word_chars") if c in annotated.columns]
    once = annotated.where(~F.col("base_failed")).select(*alike).distinct()
    return (once.groupBy("lang").agg(q.alias("q"))
            .select("lang", (F.col("q")[1] - below * down).alias("low"), (F.col("q")[1] + above * up).alias("high")))


def judge(annotated: DataFrame, bands: DataFrame) -> DataFrame:
    """``annotated`` plus kept.

    The bands are sent to the tasks if they are ``FEW_BANDS`` at most; with more
    languages both sides are shuffled, salted because a language may hold any
    share of the rows.
    """
    lang, low, high, salt, row_salt = fresh(annotated.columns, "band_lang", "low", "high", "salt", "row_salt")
    bands = stored(bands, "bands").withColumnsRenamed({"lang": lang, "low": low, "high": high})
    annotated = annotated.drop("kept")
    same = F.col("lang").eqNullSafe(F.col(lang))
    if bands.limit(FEW_BANDS + 1).count() <= FEW_BANDS:
        joined = annotated.join(F.broadcast(bands), same, "left")
    else:
        many = bands.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = annotated.withColumn(row_salt, F.pmod(F.xxhash64("doc_id", "log_ppl"), F.lit(SALTS)).cast("int"))
        joined = salted.join(many, same & (F.col(row_salt) == F.col(salt)), "left")
    inside = ~F.col("base_failed") & F.col("log_ppl").between(F.col(low), F.col(high))
    return joined.withColumn("kept", F.coalesce(inside, F.lit(False))).drop(lang, low, high, salt, row_salt)


@tidy
def apply_rules(documents: DataFrame, order: int = ORDER, most: int = MOST) -> DataFrame:
    """``documents`` (with text, lang, doc_id) plus base columns, log_ppl and kept."""
    annotated = stored(annotate(documents, fit(documents, order, most), order), "rules")
    return judge(annotated, bands(annotated))

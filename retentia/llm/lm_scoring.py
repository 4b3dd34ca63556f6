"""Language-model scoring by prediction by partial matching, and an add-one unigram base score.

The model is a trie of byte contexts up to ``ORDER`` bytes long, pretrained on
all training texts: Spark counts every (context, byte) of the corpus.  A byte
seen in the longest context has the share n / (total + distinct); otherwise the
escape share distinct / (total + distinct) is paid and the next shorter context
predicts among the bytes that the longer one has not seen (symbol exclusion),
down to the uniform share over bytes seen nowhere.  A context that was never
seen costs nothing.  Every text ends with one end symbol (0xFF, no UTF-8 byte),
so the shares of all texts add up to at most one.  All counted nodes are kept.
Up to ``MOST`` of the longest are sent to the tasks in sorted hash arrays; more
stay in a partitioned table, in which the distinct nodes of each chunk of texts
are looked up (``_ngrams.Parted``), with the same scores.

The unigram base needs the counts of all distinct words, a table without a
bound, so it is never broadcast: each task sends its distinct words (hash,
training count, rows that hold it) to the word's bucket, buckets sum the counts
over the corpus and return one array of partial sums per chunk of documents,
and the chunk adds them up.  A word that every document uses costs one entry
per chunk.

Defined results: null and empty texts have the end token only; a null doc_id
counts as not held out; repeated rows are learnt and scored each; without
training texts the base counts nothing and every byte costs log10(256); an
empty table gives no rows.  Only doc_id and text are read, other columns cannot
clash.  Documents must be a stored table (rows in the same order when a task is
run again).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm import _ngrams, _text
from retentia.llm._store import shuffle_width, stored

ORDER = 5
MOST = 4_000_000
END = 0xFF
WORD_CHUNK = 3 << 20


def trained_on(doc_id):
    """True for training documents: crc32 of the id as text, modulo 7, is not 2."""
    return ~held_out(doc_id)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _with_end(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offs) - 1
    out = np.full(len(data) + n, END, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offs))] = data
    return out, offs + np.arange(n + 1)


class Model:
    """Per order: n-gram nodes with their count, and contexts with total, distinct and excluded mass."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, pairs=None):
        """``pairs``: nodes of two bytes with their counts, if ``keys`` are only a part of the corpus (``Parted``)."""
        self.order = order
        self.levels = []     # from order 0 up
        ks, cs = keys, counts
        levels = []
        for k in range(order, -1, -1):
            if k == 1 and pairs is not None:
                ks, cs = pairs
            levels.insert(0, (ks, cs))
            if k:
                low = ks & np.uint64((1 << 8 * k) - 1)
                ks, of = np.unique(low, return_inverse=True)
                cs = np.bincount(of, cs, len(ks))
        for k, (ks, cs) in enumerate(levels):
            ctx, of = np.unique(ks >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, cs, len(ctx)), np.bincount(of, minlength=len(ctx))
            # mass in the next shorter context of the bytes seen in this one
            out_mass = np.zeros(len(ctx))
            if k:
                low_keys, low_counts = levels[k - 1]
                at = np.searchsorted(low_keys, ks & np.uint64((1 << 8 * k) - 1))
                out_mass = np.bincount(of, low_counts[at], len(ctx))
            grams, contexts = _ngrams.SortedHash(ks), _ngrams.SortedHash(ctx)
            direct = np.log10(cs / (total + distinct)[of])
            self.levels.append({"grams": grams, "count": grams.aligned(cs), "direct": grams.aligned(direct),
                                "contexts": contexts, "total": contexts.aligned(total),
                                "distinct": contexts.aligned(distinct), "excluded": contexts.aligned(out_mass)})
            grams.drop_order(), contexts.drop_order()

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the share of each packed n-gram's last byte after the bytes before it."""
        level = self.levels[-1]
        at = level["grams"].find(keys)
        out = level["direct"][at]
        todo = np.flatnonzero(at < 0)
        out[todo] = self._escaped(keys[todo])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        gone_mass, gone = np.zeros(len(keys)), np.zeros(len(keys))   # excluded at the present order
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            ctx = level["contexts"].find(keys >> np.uint64(8))
            total = level["total"][ctx].astype(np.float64) - gone_mass
            distinct = level["distinct"][ctx].astype(np.float64) - gone
            at = level["grams"].find(keys)
            known = (ctx >= 0) & (distinct > 0)
            hit = known & (at >= 0)
            out[todo[hit]] += np.log10(level["count"][at[hit]] / (total + distinct)[hit])
            escape = known & ~hit
            out[todo[escape]] += np.log10(distinct[escape] / (total + distinct)[escape])
            # bytes seen here are seen in every shorter context too; an unknown context excludes nothing new
            gone_mass = np.where(ctx >= 0, level["excluded"][ctx], 0)[~hit]
            gone = np.where(ctx >= 0, level["distinct"][ctx], 0)[~hit]
            todo, keys = todo[~hit], keys[~hit]
            keys = keys & np.uint64((1 << 8 * max(k, 1)) - 1)
            if not len(todo):
                return out
        out[todo] -= np.log10(256 - gone)
        return out


def fit(training: DataFrame, order: int = ORDER, most: int = MOST) -> Model | _ngrams.Parted:
    """Count every (context, byte) of the training texts and build the trie; ``Parted`` if it has over ``most`` nodes."""
    ended = training.select(F.concat(F.coalesce(F.col("text"), F.lit("")).cast("binary"),
                                     F.unhex(F.lit("FF"))).alias("bytes"))
    counts = stored(_ngrams.count_ngrams(ended, "bytes", order + 1, END, np.arange(256)), "ppm-counts")
    if counts.count() <= most:
        return Model(*_ngrams.collected(counts), order)
    pairs = _ngrams.collected(_ngrams.suffixes(counts, 2, F.sum("n")))
    return _ngrams.Parted(counts, lambda keys, n: Model(keys, n, order, pairs))


def _keys(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    ended, eo = _with_end(data, offs)
    return _ngrams.packed(ended, eo, order + 1, END)


def _row_sums(data: np.ndarray, offs: np.ndarray, order: int, log_prob) -> np.ndarray:
    """Score of each row of a chunk."""
    ends = offs + np.arange(len(offs))
    lp = np.zeros(len(data) + len(offs))
    np.cumsum(log_prob(_keys(data, offs, order)), out=lp[1:])
    return lp[ends[1:]] - lp[ends[:-1]]


def _looked_up(documents: DataFrame, model: _ngrams.Parted, order: int) -> DataFrame:
    """``documents`` plus score, for a model that is not sent to the tasks."""
    def compute(texts, find):
        sums = [_row_sums(data, offs, order, find) for _, _, data, offs in _text.chunks(texts)]
        return [np.concatenate(sums) if sums else np.zeros(0)]

    return model.add_columns(documents, "text", lambda data, offs: _keys(data, offs, order), compute, "score double")


def _blobs(start: np.ndarray, end: np.ndarray, values: np.ndarray, kind) -> list[bytes]:
    return [values[a:b].astype(kind).tobytes() for a, b in zip(start, end)]


_SENT = ("bucket int, chunk long, words binary, trained binary, n_rows binary, rows binary, times binary, "
         "ids binary, held binary, n_tokens binary, score binary")


def _id_column(values) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([values], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _sent(documents: DataFrame, model, n_buckets: int) -> DataFrame:
    """Rows for the buckets: the words of each chunk by bucket, and one row with the chunk's documents.

    Without a ``model`` the documents bring their score.
    """
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offs in _text.chunks(batch.column(1), WORD_CHUNK):
                chunk = (part << 32) + seq
                seq += 1
                ids, held = batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)
                held = held.to_numpy(zero_copy_only=False).astype(bool)
                n = hi - lo
                hashes, rows = [], []
                score = np.zeros(n) if model is not None else batch.column(3).slice(lo, n).to_numpy()
                column = batch.column(1).slice(lo, n)
                for a, b, d, o in _text.chunks(column):
                    if model is not None:
                        score[a:b] = _row_sums(d, o, model.value.order, model.value.log_prob)
                    low = _text.LOWER[d]
                    s, e, r = _text.words(low, o)
                    hashes.append(_text.RollingHash(low).spans(s, e))
                    rows.append(r + a)
                h = np.concatenate([*hashes, np.full(n, 0, np.uint64)])      # hash 0: the end token
                r = np.concatenate([*rows, np.arange(n)])
                n_tokens = np.bincount(r, minlength=n)
                order = np.argsort(h, kind="stable")
                h, r = h[order], r[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
                times = np.diff(np.r_[first, len(h)])
                ph, pr = h[first], r[first]                                  # distinct (word, row)
                wfirst = np.flatnonzero(np.r_[True, ph[1:] != ph[:-1]])
                word = ph[wfirst]
                per_word = np.diff(np.r_[wfirst, len(ph)])
                trained = np.add.reduceat(np.where(held[pr], 0, times), wfirst)
                bucket = ((word >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rcut = np.r_[wfirst, len(ph)][cut]
                used = np.flatnonzero(cut[1:] > cut[:-1])
                ws, we, rs, re = cut[used], cut[used + 1], rcut[used], rcut[used + 1]
                small = np.uint16 if n <= 65536 else np.uint32
                none = [None] * len(used)
                cols = [used.astype(np.int32), np.full(len(used), chunk), _blobs(ws, we, word, np.uint64),
                        _blobs(ws, we, trained, np.uint32), _blobs(ws, we, per_word, np.uint32),
                        _blobs(rs, re, pr, small), _blobs(rs, re, times, np.uint32), none, none, none, none]
                meta = [[chunk % n_buckets], [chunk], [None], [None], [None], [None], [None], [_id_column(ids)],
                        [held.tobytes()], [n_tokens.astype(np.int64).tobytes()], [score.tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c) + m, t) for c, m, t in zip(cols, meta, [pa.int32(), pa.int64()] + [pa.binary()] * 9)],
                    [f.split()[0] for f in _SENT.split(", ")])

    scored = [] if model is not None else ["score"]
    return documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"), *scored).mapInArrow(run, _SENT)


_SUMS = "chunk long, part int, sums binary, known binary, tokens long, kinds long, ids binary, held binary, n_tokens binary, score binary"


def _bucket(key, pdf):
    """Corpus counts of one bucket's words, and per chunk the partial sums of its rows."""
    meta, sent = pdf[pdf["ids"].notna()], pdf[pdf["ids"].isna()]
    out = [meta[["chunk", "ids", "held", "n_tokens", "score"]].assign(part=-1)]
    if len(sent):
        words = [np.frombuffer(b, np.uint64) for b in sent["words"]]
        flat = np.concatenate(words)
        uniq, of = np.unique(flat, return_inverse=True)
        count = np.bincount(of, np.concatenate([np.frombuffer(b, np.uint32) for b in sent["trained"]]), len(uniq))
        log_count = np.log10(count + 1)
        lo, rows = 0, []
        for w, chunk, per_word, r, t in zip(words, sent["chunk"], sent["n_rows"], sent["rows"], sent["times"]):
            mine = np.repeat(of[lo: lo + len(w)], np.frombuffer(per_word, np.uint32))
            lo += len(w)
            times = np.frombuffer(t, np.uint32)
            row = np.frombuffer(r, np.uint16 if len(r) == 2 * len(times) else np.uint32)
            rows.append((chunk, np.bincount(row, times * log_count[mine]).tobytes(),
                         np.bincount(row, times * (count[mine] > 0)).astype(np.uint32).tobytes()))
        out.append(pd.DataFrame(rows, columns=["chunk", "sums", "known"]).assign(part=int(key[0])))
        out.append(pd.DataFrame({"chunk": [-1 - int(key[0])], "part": [-2], "tokens": [int(count.sum())],
                                 "kinds": [int((count > 0).sum())]}))
    columns = [f.split()[0] for f in _SUMS.split(", ")]
    got = pd.concat([o.reindex(columns=columns) for o in out], ignore_index=True)
    got[["tokens", "kinds"]] = got[["tokens", "kinds"]].fillna(0).astype("int64")
    return got.astype({"chunk": "int64", "part": "int32"}).where(got.notna(), None)


def _chunk_rows(id_type):
    def run(key, table):
        parts = table.column("part").to_pylist()
        if parts == [-2]:
            return pa.table({"doc_id": pa.nulls(1, id_type), "held_out": pa.nulls(1, pa.bool_()),
                             "n_tokens": pa.nulls(1, pa.int64()), "n_known": pa.nulls(1, pa.int64()),
                             "sums": pa.nulls(1, pa.float64()), "score": pa.nulls(1, pa.float64()),
                             "tokens": table.column("tokens"), "kinds": table.column("kinds")})
        m = parts.index(-1)
        get = lambda name, i: table.column(name)[i].as_py()
        ids = pa.ipc.open_stream(get("ids", m)).read_all().column(0)
        n = len(ids)
        sums, known = np.zeros(n), np.zeros(n, np.int64)
        for i in sorted((i for i in range(len(parts)) if parts[i] >= 0), key=lambda i: parts[i]):
            x, y = np.frombuffer(get("sums", i)), np.frombuffer(get("known", i), np.uint32)
            sums[: len(x)] += x
            known[: len(y)] += y
        return pa.table({"doc_id": ids, "held_out": pa.array(np.frombuffer(get("held", m), bool)),
                         "n_tokens": pa.array(np.frombuffer(get("n_tokens", m), np.int64)), "n_known": pa.array(known),
                         "sums": pa.array(sums), "score": pa.array(np.frombuffer(get("score", m))),
                         "tokens": pa.nulls(n, pa.int64()), "kinds": pa.nulls(n, pa.int64())})

    return run


def score(documents: DataFrame, order: int = ORDER, most: int = MOST) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    model = fit(docs.where(trained_on(F.col("doc_id"))), order, most)
    if isinstance(model, _ngrams.Parted):
        docs, model = stored(_looked_up(docs, model, order), "lm-texts"), None
    else:
        model = spark.sparkContext.broadcast(model)
    n_buckets = shuffle_width(spark)
    id_field = documents.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    summed = _sent(docs, model, n_buckets).groupBy("bucket").applyInPandas(_bucket, _SUMS)
    rows = summed.groupBy("chunk").applyInArrow(
        _chunk_rows(to_arrow_type(id_field)),
        f"doc_id {id_field.simpleString()}, held_out boolean, n_tokens long, n_known long, sums double, score double, "
        "tokens long, kinds long")
    rows = stored(rows, "lm-scores")
    n, v = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    return rows.where("n_tokens is not null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("sums") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), "score")

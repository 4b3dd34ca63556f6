"""Byte n-grams packed into integers and counted over the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm import _text
from retentia.llm._store import shuffle_width, stored

HELD = 1 << 21   # distinct keys a task holds before it passes its counts on
SENT_BYTES = 3 << 20   # text of a chunk whose n-grams are looked up in a Parted model


def packed(data: np.ndarray, offs: np.ndarray, order: int, pad: int) -> np.ndarray:
    """One key per byte: the byte and the ``order - 1`` before it in its row (``pad`` before the row's start).

    The key is the big-endian integer of those bytes; the newest byte is lowest.
    """
    n = len(data)
    at = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    out = data.astype(np.uint64)
    for back in range(1, order):
        prev = np.full(n, pad, np.uint64)
        if back < n:
            prev[back:] = data[:-back]
        prev[at < back] = pad
        out |= prev << np.uint64(8 * back)
    return out


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count_ngrams(texts: DataFrame, column: str, order: int, pad: int, fold) -> DataFrame:
    """(key long, n long): how often each packed n-gram of the folded texts occurs.

    Every task counts its own rows with sorted arrays and hands on one row per
    distinct key, so the shuffle carries distinct n-grams per task only.
    """
    fold = np.asarray(fold, np.uint8)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offs in _text.chunks(batch.column(0)):
                keys = np.sort(packed(fold[data], offs, order, pad))
                if not len(keys):
                    continue
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                parts.append((keys[first], np.diff(np.r_[first, len(keys)])))
                held += len(first)
                if held > HELD:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield _batch(*parts.pop())
                        held = 0
        if parts:
            yield _batch(*_merge(parts))

    def _batch(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                                          ["key", "n"])

    return (texts.select(column).mapInArrow(run, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


class SortedHash:
    """Set of integer keys as a sorted array of their 64-bit hashes with an index of leading bits.

    The hash is a bijection, so equal hashes mean equal keys.  ``find`` gives
    positions that index arrays made by ``aligned`` (-1: not a member).
    """

    def __init__(self, keys: np.ndarray):
        h = _text.mix(keys.astype(np.uint64))
        self.order, self.size = np.argsort(h), len(keys)
        self._h = np.append(h[self.order], np.uint64(2**64 - 1))
        bits = max(8, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self._shift = np.uint64(64 - bits)
        self._first = np.searchsorted(self._h[:-1], np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)

    def aligned(self, values: np.ndarray) -> np.ndarray:
        """Values of the keys as float32 in the order ``find`` uses, and 0 at -1."""
        return np.append(np.asarray(values, np.float32)[self.order], np.float32(0))

    def drop_order(self) -> "SortedHash":
        self.order = None
        return self

    def find(self, keys: np.ndarray) -> np.ndarray:
        h = _text.mix(keys.astype(np.uint64))
        at = self._first[(h >> self._shift).astype(np.int64)]
        there = self._h[at]
        out = np.where(there == h, at, np.int32(-1))
        todo = np.flatnonzero(there < h)
        while len(todo):
            at[todo] += 1
            ok = at[todo] < self.size
            todo = todo[ok]
            there = self._h[at[todo]]
            hit = there == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[there < h[todo]]
        out[out >= self.size] = -1
        return out


def collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of an n-gram table, by key."""
    table = counts.orderBy("key").toArrow()
    return table["key"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy().astype(np.int64)


def suffixes(counts: DataFrame, size: int, n) -> DataFrame:
    """(key, n): the last ``size`` bytes of the n-grams, ``n`` aggregated over those that end alike."""
    return counts.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("key")).agg(n.alias("n"))


class Parted:
    """A model of more n-grams than one task should hold: they stay in a stored table (key, n).

    A probability needs the n-grams whose context ends with the same two bytes,
    and the n-grams of one and two bytes (65,536 at most).  So the table is dealt
    by those two bytes; ``build(keys, counts)`` makes the model of one part and
    gives the value of every n-gram asked for there.  Texts are cut into chunks;
    a chunk sends its distinct n-grams to buckets by hash and gets their values.
    """

    def __init__(self, counts: DataFrame, build):
        self.counts, self.build = counts, build

    def values(self, asked: DataFrame, n_buckets: int) -> DataFrame:
        """(bucket, key, value) of the distinct keys ``asked``."""
        build = self.build

        def run(table):
            keys, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
            held, want = n > 0, keys[n == 0]
            order = np.argsort(keys[held])
            value = build(keys[held][order], n[held][order]).log_prob(want)
            return pa.table({"bucket": pa.array(_bucket(want, n_buckets), pa.int32()),
                             "key": pa.array(want.view(np.int64)), "value": pa.array(value, pa.float64())})

        ends = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
        return (self.counts.select("key", "n").union(asked.select("key", F.lit(0).cast("long")))
                .groupBy(F.pmod(F.xxhash64(ends), F.lit(n_buckets)).alias("part"))
                .applyInArrow(run, "bucket int, key long, value double"))

    def add_columns(self, df: DataFrame, column: str, keys_of, compute, fields: str) -> DataFrame:
        """``df`` plus the columns of the DDL ``fields``; a column of the same name is replaced.

        ``keys_of(bytes, offsets)`` gives the packed n-grams of a chunk of texts and
        ``compute(texts, find)`` the new columns, where ``find`` gives the values of n-grams.
        """
        extra = T.StructType.fromDDL(fields)
        kept = [f for f in df.schema.fields if f.name not in extra.names]
        names = [f.name for f in kept]
        n_buckets = shuffle_width(df.sparkSession)

        def send(batches):
            part, seq = TaskContext.get().partitionId(), 0
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(column))
                rows = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names]
                                                  + [texts], [str(i) for i in range(len(names) + 1)])
                for lo, hi, data, offs in _text.chunks(texts, SENT_BYTES):
                    chunk = (part << 32) + seq
                    seq += 1
                    keys = np.unique(keys_of(data, offs))
                    bucket = _bucket(keys, n_buckets)
                    order = np.argsort(bucket, kind="stable")
                    cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                    used = np.flatnonzero(cut[1:] > cut[:-1])
                    blobs = [keys[order[cut[b]: cut[b + 1]]].tobytes() for b in used]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*used, -1], pa.int32()), pa.array([chunk] * (len(used) + 1), pa.int64()),
                         pa.array([*blobs, None], pa.binary()),
                         pa.array([None] * len(used) + [_packed_rows(rows.slice(lo, hi - lo))], pa.binary())],
                        ["bucket", "chunk", "keys", "rows"])

        def unpack(batches):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, np.int64))], ["key"])

        def answer(asked, values):
            keys, value = values["key"].to_numpy().view(np.uint64), values["value"].to_numpy()
            order = np.argsort(keys)
            keys, value = keys[order], value[order]
            blobs = asked["keys"].to_pylist()
            got = [value[np.searchsorted(keys, np.frombuffer(b, np.uint64))].tobytes() for b in blobs]
            return pa.table({"chunk": asked["chunk"], "keys": asked["keys"], "found": pa.array(got, pa.binary()),
                             "rows": pa.nulls(len(blobs), pa.binary())})

        def finish(table):
            blobs = list(zip(table["keys"].to_pylist(), table["found"].to_pylist()))
            keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in blobs if k is not None] or [np.zeros(0, np.uint64)])
            value = np.concatenate([np.frombuffer(v) for _, v in blobs if v is not None] or [np.zeros(0)])
            order = np.argsort(keys)
            keys, value = keys[order], value[order]
            rows = pa.ipc.open_stream(next(r for r in table["rows"].to_pylist() if r is not None)).read_all().combine_chunks()
            texts = rows.column(rows.num_columns - 1).combine_chunks()
            made = compute(texts, lambda asked: value[np.searchsorted(keys, asked)])
            return pa.Table.from_arrays([rows.column(i) for i in range(len(names))]
                                        + [x if isinstance(x, pa.Array) else pa.array(x) for x in made], names + extra.names)

        sent = stored(df.mapInArrow(send, "bucket int, chunk long, keys binary, rows binary"), "ngrams-sent")
        asked = sent.where("keys is not null").select("bucket", "chunk", "keys")
        values = self.values(asked.select("keys").mapInArrow(unpack, "key long").distinct(), n_buckets)
        answers = (asked.groupBy("bucket").cogroup(values.groupBy("bucket"))
                   .applyInArrow(answer, "chunk long, keys binary, found binary, rows binary"))
        whole = sent.where("rows is not null").select("chunk", "keys", F.lit(None).cast("binary").alias("found"), "rows")
        return answers.union(whole).groupBy("chunk").applyInArrow(finish, T.StructType(kept + extra.fields))


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((_text.mix(keys) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)


def _packed_rows(batch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()

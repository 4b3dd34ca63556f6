"""Token ids of documents in compressed binary files: static range asymmetric numeral system.

``write`` tokenises texts, sorts the documents by doc_id into shards (range
partitions) and writes the ids of a shard as one stream cut into blocks of
``BLOCK`` ids.  All blocks share one frequency table, counted over the whole
corpus and scaled to a power of two.  A block stands alone: id k of it goes to
lane k mod ``LANES``, the lanes are coded backwards into one stream of 32-bit
words, and after every ``SEGMENT`` ids the lane states and the word position
are kept as a checkpoint, with a crc32 of the segment's ids.  A reader may
start at any checkpoint, so segments of all blocks are decoded side by side,
and documents cut by a block border are fetched by their segments alone.

Files below the path: ``ids`` (one row per block: its place in the shard, which
pieces of documents it holds, and the payload described at ``_HEADER``),
``table`` (id, frequency) and ``shards`` (ids before each shard).

Defined results: a null or empty text has the end id alone; equal doc_ids keep
the order of the input table, null ones come first; repeated rows are written
each; an empty table gives files without rows; a very long text is one row of
ids (about 1.5 bytes of memory a byte) and spans many blocks.  Only doc_id and
text are read, other columns cannot clash.  A damaged payload raises
ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm import _text
from retentia.llm._store import stored, tidy
from retentia.llm._tokens import word_tokens

END_ID = 1
BLOCK = 1 << 16          # ids of a block
SEGMENT = 1 << 13        # ids between checkpoints
LANES = 32
TOGETHER = 32            # blocks that are coded side by side
SHARD_BYTES = 64 << 20   # uncompressed ids of a shard
_LOW = np.uint64(1 << 31)                    # lane states lie in [_LOW, 2^32 * _LOW)
_MAGIC, _VERSION = b"TIDR", 1

#: Payload, little-endian: magic, version, scale bits, lanes, ids of a segment, ids, segments, words, crc32 of the
#: table; per segment its first word (u32), the crc32 of its ids (u32) and the lane states (u64); the words (u32).
_HEADER = struct.Struct("<4sHHIIIIII")


class Table:
    """Frequencies of all ids that occur, scaled to ``2**bits``."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.freq = ids[order].astype(np.int64), freq[order].astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        size = int(self.ids[-1]) + 1 if len(ids) else 1
        start = np.cumsum(self.freq) - self.freq
        self.freq_of, self.start_of = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq_of[self.ids], self.start_of[self.ids] = self.freq, start
        self.id_at = np.repeat(self.ids, self.freq.astype(np.int64)).astype(np.uint32)
        self.crc = zlib.crc32(self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def scaled(cls, ids: np.ndarray, counts: np.ndarray) -> "Table":
        """Every id gets a frequency of 1 at least; what is left over or missing goes to the most frequent ids."""
        if not len(ids):
            return cls(ids, counts)
        bits = max(12, int(len(ids) - 1).bit_length() + 4)
        total = 1 << bits
        freq = np.maximum(1, (counts.astype(float) * (total / counts.sum())).astype(np.int64))
        order = np.lexsort((ids, -counts))
        left = total - int(freq.sum())
        for k in order.tolist():                  # one step unless rounding took more than the top id has
            change = max(left, 1 - int(freq[k]))
            freq[k] += change
            left -= change
            if not left:
                break
        return cls(ids, freq)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Payloads of blocks of equal size: ``ids`` is (blocks, ids of a block)."""
    n_blocks, n = ids.shape
    steps = -(-n // LANES)
    padded = np.full((n_blocks, steps * LANES), table.ids[int(np.argmax(table.freq))], np.uint32)
    padded[:, :n] = ids
    lanes = padded.reshape(n_blocks, steps, LANES)
    per_segment = SEGMENT // LANES
    n_segments = -(-steps // per_segment)
    bits, top = np.uint64(table.bits), np.uint64(63 - table.bits)
    x = np.full((n_blocks, LANES), _LOW)
    room = steps * LANES
    words = np.zeros(n_blocks * room, np.uint32)
    at = np.full(n_blocks, room, np.int64)
    base = np.arange(n_blocks) * room - 1
    states, first = np.zeros((n_segments, n_blocks, LANES), np.uint64), np.zeros((n_segments, n_blocks), np.int64)
    for t in range(steps - 1, -1, -1):
        s = lanes[:, t]
        f = table.freq_of[s]
        out = x >> top >= f                      # x >= f * 2^(63 - bits), without overflow
        rank = np.cumsum(out, 1)
        at -= rank[:, -1]
        hit = np.flatnonzero(out)
        words[(rank + (base + at)[:, None]).ravel()[hit]] = x.ravel()[hit].astype(np.uint32)
        x = x >> (out.astype(np.uint64) << np.uint64(5))
        q = x // f
        x = (q << bits) + (x - q * f) + table.start_of[s]
        if t % per_segment == 0:
            states[t // per_segment], first[t // per_segment] = x, at
    words = words.reshape(n_blocks, room)
    payloads = []
    for b in range(n_blocks):
        head = _HEADER.pack(_MAGIC, _VERSION, table.bits, LANES, SEGMENT, n, n_segments, steps * LANES - int(at[b]),
                            table.crc)
        raw = np.ascontiguousarray(ids[b], "<u4")
        crc = [zlib.crc32(raw[k: k + SEGMENT].tobytes()) for k in range(0, n, SEGMENT)]
        payloads.append(b"".join([head, (first[:, b] - at[b]).astype("<u4").tobytes(), np.array(crc, "<u4").tobytes(),
                                  states[:, b].astype("<u8").tobytes(), words[b, at[b]:].astype("<u4").tobytes()]))
    return payloads


class Payload:
    """One parsed block."""

    def __init__(self, raw: bytes, table: Table):
        try:
            magic, version, bits, self.lanes, self.segment, self.n, k, n_words, crc = _HEADER.unpack_from(raw)
            if (magic, version, bits, crc) != (_MAGIC, _VERSION, table.bits, table.crc):
                raise ValueError("not a block of this table")
            at = _HEADER.size
            self.first = np.frombuffer(raw, "<u4", k, at).astype(np.int64)
            self.crc = np.frombuffer(raw, "<u4", k, at + 4 * k)
            self.states = np.frombuffer(raw, "<u8", k * self.lanes, at + 8 * k).reshape(k, self.lanes).astype(np.uint64)
            self.words = np.frombuffer(raw, "<u4", n_words, at + 8 * k + 8 * k * self.lanes)
        except struct.error as e:
            raise ValueError("damaged block") from e

    def length(self, segment: int) -> int:
        return min(self.segment, self.n - segment * self.segment)


def decode_segments(wanted: list[tuple[Payload, int]], table: Table) -> list[np.ndarray]:
    """Ids of segments, those of equal length decoded side by side from their checkpoints."""
    out: list = [None] * len(wanted)
    groups: dict[tuple, list[int]] = {}
    for i, (p, k) in enumerate(wanted):
        groups.setdefault((p.lanes, p.length(k)), []).append(i)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for (lanes, n), members in groups.items():
        blocks = {id(wanted[i][0]): wanted[i][0] for i in members}
        sizes = np.array([len(p.words) for p in blocks.values()])
        begin = dict(zip(blocks, (np.cumsum(sizes) - sizes).tolist()))
        words = np.concatenate([p.words for p in blocks.values()] + [np.zeros(lanes, np.uint32)]).astype(np.uint64)
        x = np.array([wanted[i][0].states[wanted[i][1]] for i in members])
        at = np.array([begin[id(wanted[i][0])] + wanted[i][0].first[wanted[i][1]] for i in members], np.int64)
        steps = -(-n // lanes)
        made = np.zeros((len(members), steps, lanes), np.uint32)
        for t in range(steps):
            slot = x & mask
            s = table.id_at[slot.astype(np.int64)]
            made[:, t] = s
            x = table.freq_of[s] * (x >> bits) + slot - table.start_of[s]
            take = x < _LOW
            rank = np.cumsum(take, 1)
            word = words[np.minimum(at[:, None] + np.maximum(rank - 1, 0), len(words) - 1)]
            x = np.where(take, (x << np.uint64(32)) | word, x)
            at += rank[:, -1]
        flat = made.reshape(len(members), -1)[:, :n]
        for m, i in enumerate(members):
            p, k = wanted[i]
            ids = np.ascontiguousarray(flat[m], "<u4")
            if zlib.crc32(ids.tobytes()) != int(p.crc[k]):
                raise ValueError("checksum of a segment does not match")
            out[i] = ids
    return out


def id_type(tokenizer_path: str, end_id: int = END_ID) -> str:
    """Unsigned type that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab().values()])
    return "<u2" if most < 1 << 16 else "<u4"


def token_rows(documents: DataFrame, tokenizer_path: str, width: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, seq, n, ids): the ids of every document as bytes of type ``width``; seq numbers rows in input order."""
    size = np.dtype(width).itemsize
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = word_tokens(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, offs in _text.chunks(batch.column(1)):
                ids, per_row = tokens.ids(data, offs)
                total = per_row + 1
                flat = np.full(int(total.sum()), end_id, width)
                flat[_text.flat_index(np.cumsum(total) - total, per_row)] = ids
                ends = np.append(0, np.cumsum(total) * size)
                rows = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)),
                                                                          pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array((part << 36) + seq + np.arange(hi - lo)),
                     pa.array(total), rows.cast(pa.binary())], ["doc_id", "seq", "n", "ids"])
                seq += hi - lo

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, seq long, n long, ids binary")


def id_counts(tokens: DataFrame, width: str) -> DataFrame:
    """(id, n): how often each id occurs; a task hands on one row per id."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(_text.text_buffers(batch.column(0))[0].tobytes(), width)
            if len(ids):
                size = max(len(total), int(ids.max()) + 1)
                total = np.pad(total, (0, size - len(total))) + np.bincount(ids, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _block_schema(kind: str) -> str:
    return (f"shard int, block int, first long, n_ids int, doc_id array<{kind}>, doc_tokens array<long>, "
            "offset array<long>, length array<int>, payload binary")


def _pieces(doc_ids: list, size: np.ndarray, begin: np.ndarray, lo: int, hi: int) -> tuple:
    """(doc_ids, sizes, offsets, lengths) of the parts of documents in ids lo .. hi of a stream."""
    a = int(np.searchsorted(begin + size, lo, "right"))
    b = int(np.searchsorted(begin, hi, "left"))
    start, end = np.maximum(begin[a:b], lo), np.minimum(begin[a:b] + size[a:b], hi)
    return doc_ids[a:b], size[a:b].tolist(), (start - begin[a:b]).tolist(), (end - start).tolist()


def blocks(tokens: DataFrame, table: Table, n_shards: int, width: str) -> DataFrame:
    """The rows of ``ids``: tokens sorted by (doc_id, seq) over ``n_shards`` shards and coded."""
    kind = tokens.schema["doc_id"].dataType
    schema = _block_schema(kind.simpleString())
    shared = tokens.sparkSession.sparkContext.broadcast((table.ids, table.freq))   # one entry per id of the vocabulary
    order = [F.col("doc_id").asc_nulls_first(), F.col("seq").asc()]

    def run(batches):
        coder = Table(*shared.value)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, parts, held = [], [], [], 0          # documents not yet written whole; held: their ids
        done = 0                                             # ids of the first of them that are written

        def flush(everything):
            nonlocal block, first, done, held, doc_ids, sizes, parts
            stream = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            size = np.array(sizes, np.int64)
            begin = np.cumsum(size) - size - done
            n_full = len(stream) // BLOCK
            cuts = [(k * BLOCK, (k + 1) * BLOCK) for k in range(n_full)]
            payloads = [p for k in range(0, n_full, TOGETHER) for p in
                        encode_blocks(stream[k * BLOCK: min(n_full, k + TOGETHER) * BLOCK].reshape(-1, BLOCK), coder)]
            used = n_full * BLOCK
            if everything and used < len(stream):
                cuts.append((used, len(stream)))
                payloads += encode_blocks(stream[used:].reshape(1, -1), coder)
                used = len(stream)
            rows = []
            for (lo, hi), payload in zip(cuts, payloads):
                rows.append((shard, block, first, hi - lo, *_pieces(doc_ids, size, begin, lo, hi), payload))
                block, first = block + 1, first + hi - lo
            whole = int(np.searchsorted(begin + size, used, "right"))
            done = used - int(begin[whole]) if whole < len(size) else 0
            doc_ids, sizes, parts, held = doc_ids[whole:], sizes[whole:], [stream[used:]], len(stream) - used
            return rows

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = None
        for batch in batches:
            if id_type is None:
                id_type = batch.schema.field(0).type
                names = ["shard", "block", "first", "n_ids", "doc_id", "doc_tokens", "offset", "length", "payload"]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()),
                         pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            for lo, hi, data, _ in _text.chunks(batch.column(2), BLOCK * TOGETHER):
                doc_ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                sizes += batch.column(1).slice(lo, hi - lo).to_pylist()
                parts.append(np.frombuffer(data.tobytes(), width).astype(np.uint32))
                held += len(parts[-1])
                if held >= BLOCK * TOGETHER:
                    rows = flush(False)
                    for k in range(0, len(rows), TOGETHER):
                        yield batch_of(rows[k: k + TOGETHER])
        if held:
            yield batch_of(flush(True))

    return (tokens.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)
            .select("doc_id", "n", "ids").mapInArrow(run, schema))


@tidy
def write(documents: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of ``documents`` below ``path`` in ascending order of doc_id."""
    spark = documents.sparkSession
    width = id_type(tokenizer_path, end_id)
    tokens = stored(token_rows(documents, tokenizer_path, width, end_id), "token-rows")
    counts = id_counts(tokens, width).toArrow()                   # at most one row per id of the vocabulary
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    table = Table.scaled(ids, n)
    n_shards = max(1, -(-int(n.sum()) * 4 // SHARD_BYTES))
    rows = [(int(i), int(f)) for i, f in zip(table.ids, table.freq)]
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    blocks(tokens, table, n_shards, width).write.option("compression", "none").parquet(f"{path}/ids")
    per_shard = spark.read.parquet(f"{path}/ids").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)     # one row per SHARD_BYTES of ids
    (per_shard.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
     .write.parquet(f"{path}/shards"))


def _decoded(block_rows: DataFrame, table: Table, kind: str, whole: bool, hashed: bool = False) -> DataFrame:
    """(doc_id, start, offset, doc_tokens, ids) of the pieces in blocks: whole documents, or only parts of documents.

    For parts only the segments that hold them are decoded.  With ``hashed`` the
    crc32 of the ids (as 32-bit numbers) stands in their place.
    """
    shared = block_rows.sparkSession.sparkContext.broadcast((table.ids, table.freq))

    def run(batches):
        coder = Table(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(lo, TOGETHER).to_pylist()
                wanted, places = [], []
                for r in rows:
                    payload = Payload(r["payload"], coder)
                    length = np.array(r["length"], np.int64)
                    begin = np.cumsum(length) - length
                    mine = np.flatnonzero((length == np.array(r["doc_tokens"])) == whole)
                    segments = np.unique(np.concatenate(
                        [np.arange(begin[i] // payload.segment, (begin[i] + length[i] - 1) // payload.segment + 1)
                         for i in mine] or [np.zeros(0, np.int64)]))
                    places.append((r, payload, begin, length, mine, segments, len(wanted)))
                    wanted += [(payload, int(k)) for k in segments]
                ids = decode_segments(wanted, coder)
                out = []
                for r, payload, begin, length, mine, segments, at in places:
                    for i in mine.tolist():
                        a, b = int(begin[i]), int(begin[i] + length[i])
                        k0 = a // payload.segment
                        first = at + int(np.searchsorted(segments, k0))
                        last = at + int(np.searchsorted(segments, (b - 1) // payload.segment))
                        flat = ids[first] if first == last else np.concatenate(ids[first: last + 1])
                        out.append((r["doc_id"][i], r["start"] + r["first"] + a - r["offset"][i], r["offset"][i],
                                    r["doc_tokens"][i], flat[a - k0 * payload.segment: b - k0 * payload.segment]))
                if out:
                    doc_id, start, offset, total, lists = zip(*out)
                    if hashed:
                        ids = pa.array([zlib.crc32(x) for x in lists], pa.int64())
                    else:
                        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                        ids = _text.int_lists(np.concatenate(lists).astype(np.int32), sizes, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_id, batch.schema.field("doc_id").type.value_type), pa.array(start, pa.int64()),
                         pa.array(offset, pa.int64()), pa.array(total, pa.int64()), ids],
                        ["doc_id", "start", "offset", "doc_tokens", "ids"])

    return block_rows.mapInArrow(run, f"doc_id {kind}, start long, offset long, doc_tokens long, ids {'long' if hashed else 'array<int>'}")


def _opened(spark, path: str):
    """(frequency table, block rows with the ids before their shard, type of doc_id)."""
    table = spark.read.parquet(f"{path}/table").toArrow()      # at most one row per id of the vocabulary
    stream = spark.read.parquet(f"{path}/ids")
    placed = stream.join(spark.read.parquet(f"{path}/shards").select("shard", "start"), "shard")
    return (Table(table["id"].to_numpy(), table["freq"].to_numpy()), placed,
            stream.schema["doc_id"].dataType.elementType.simpleString())


def _joined_parts(placed: DataFrame, table: Table, kind: str) -> DataFrame:
    """(doc_id, start, ids) of the documents that lie in several blocks."""
    return (_decoded(placed, table, kind, False).groupBy("start")
            .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("doc_id", "start", F.flatten("p.ids").alias("ids")))


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of all documents of the files at ``path``; start: ids of the documents before."""
    table, placed, kind = _opened(spark, path)
    whole = _decoded(placed, table, kind, True).select("doc_id", "start", "ids")
    return whole.union(_joined_parts(placed, table, kind))


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents; ids leave the decoding task for cut documents only."""
    table, placed, kind = _opened(spark, path)
    whole = _decoded(placed, table, kind, True, hashed=True)
    return (whole.select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), F.col("ids").alias("ids_crc32"))
            .union(digests(_joined_parts(placed, table, kind))))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents as ``read`` gives them."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            ends = (np.cumsum(sizes) * 4).tolist()
            crc = [zlib.crc32(raw[b - 4 * n: b]) for b, n in zip(ends, sizes.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int64)),
                                              pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.select("doc_id", "start", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")

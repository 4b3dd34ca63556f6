"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Texts are tokenised once; a document longer than a sequence is cut at whole
sequences and its rest is one piece.  The histogram of piece lengths has at
most ``size`` entries, so packing it is small and exact at any corpus size:
lengths are taken longest first, and all pieces of a length go at once into the
open packs with the most room, which are kept as patterns with a count.  The
patterns then give every (length, rank) a sequence and an offset, and the
pieces are joined to them by their rank among the pieces of equal length.
Ranks are taken within ``CELLS`` hashed parts of a length, so a length that a
third of all pieces share is ranked by many tasks.

Defined results: a null text is empty; an empty document is the end id alone;
repeated rows are packed each; equal pieces may take each other's place; an
empty table gives no pieces.  Only doc_id and text are read, other columns
cannot clash.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm import _text
from retentia.llm._store import stored
from retentia.llm._tokens import word_tokens

SIZE = 2048
END_ID = 1
CELLS = 256
_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    kind = documents.schema["doc_id"].dataType
    schema = _PIECES.format(id=kind.simpleString())

    def run(batches):
        words = word_tokens(tokenizer_path)
        for batch in batches:
            for lo, hi, data, offs in _text.chunks(batch.column(1)):
                ids, per_row = words.ids(data, offs)
                total = per_row + 1
                n_cut = -(-total // size)
                row = np.repeat(np.arange(hi - lo), n_cut)
                start = _text.flat_index(np.zeros(hi - lo, np.int64), n_cut) * size
                length = np.minimum(size, total[row] - start)
                flat = np.full(int(total.sum()), end_id, np.uint32)
                first = np.cumsum(total) - total
                flat[_text.flat_index(first, per_row)] = ids
                raw = memoryview(flat.astype("<u4").tobytes())
                at = (first[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(total[row])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple]]:
    """Patterns (count, lengths) that hold every piece of the histogram {length: pieces}."""
    open_packs: dict[int, list] = {}     # room -> patterns
    rooms: list[int] = []                # heap of -room
    full = []

    def put(room, count, lengths):
        if room == 0:
            full.append((count, lengths))
            return
        if not open_packs.get(room):
            open_packs[room] = []
            heapq.heappush(rooms, -room)
        open_packs[room].append((count, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                put(size - length, left, (length,))
                break
            room = -rooms[0]
            count, lengths = open_packs[room].pop()
            if count > left:
                open_packs[room].append((count - left, lengths))
            took = min(count, left)
            put(room - length, took, lengths + (length,))
            left -= took
    return full + [p for room in sorted(open_packs) for p in open_packs[room]]


def places(patterns: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """Runs of ranks: pieces ``rank .. `` of ``length`` lie in sequences from ``sequence`` at ``offset``."""
    rows, seen, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = seen.get(length, 0)
            rows.append((length, rank, sequence, offset))
            seen[length] = rank + count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2],
            "offset": table[:, 3]}


def pack(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces with sequence_id and offset; sequences are gapless from 0 and hold at most ``size`` ids."""
    spark = documents.sparkSession
    cell = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(CELLS)).cast("int")
    cut = stored(pieces(documents, tokenizer_path, size, end_id).withColumn("cell", cell), "pieces")
    sizes = stored(cut.groupBy("length", "cell").agg(F.count("*").alias("n")), "piece-cells")   # size * CELLS rows
    histogram = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    table = spark.sparkContext.broadcast(places(pack_histogram(histogram, size)))
    before = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = W.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = (cut.withColumn("rank", F.row_number().over(rank) - 1)
              .join(firsts, ["length", "cell"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("first") + F.col("rank")).cast("long").alias("rank")))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = _PIECES.format(id=cut.schema["doc_id"].dataType.simpleString()) + ", sequence_id long, offset long"

    def run(batches):
        t = table.value
        for batch in batches:
            length = batch.column(2).to_numpy()
            of = batch.column(5).to_numpy()
            at = np.searchsorted(t["key"], (length << 48) + of, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(5)]
                + [pa.array(t["sequence"][at] + of - t["rank"][at]), pa.array(t["offset"][at])],
                kept + ["sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)

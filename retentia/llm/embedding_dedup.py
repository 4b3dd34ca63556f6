"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class.  Classes are dealt into tiles of at
most about ``TILE`` by their projection on a fixed direction (two vectors with
cosine >= t are at most sqrt(2 - 2t) apart, so only tiles whose projections are
that close are paired).  A task gets one pair of tiles, quantises each unit
vector to int8 and multiplies the tiles as integers.  With e the length of a
vector's quantisation error, two cosines differ by at most
e1 + e2 + e1 * e2 from the product of the quantised vectors; only pairs whose
product plus that bound reaches the threshold are computed again in double
precision.  A task returns link counts per class and the edges of a spanning
forest, never the pairs; connected components join the edges.

Tiles have a bounded size, so a label that holds a third of all rows is many
tasks.  The number of tile pairs of a label still grows with the square of its
distinct vectors within the projection band: that is the method.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without a label, link with nothing and are components of
their own; vectors of different length do not link; repeated rows are vectors
of their own that link with each other; a null vec_id has a null component
unless it links with a row that has one; an empty table gives no rows.  Only
vec_id, embedding and label are read, other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm._components import components
from retentia.llm._store import salted_join, stored

THRESHOLD = 0.98
TILE = 512


def _units(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)       # scaled first: no overflow or underflow of squares
    v = vectors / top
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _direction(size: int) -> np.ndarray:
    d = np.random.default_rng(7).normal(size=size)
    return d / np.sqrt((d * d).sum())


def classes(embeddings: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their class key, distinct vectors): key is null for vectors that link with nothing."""
    x = F.col("embedding")
    usable = (F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
              & F.exists(x, lambda v: v != 0))
    plain = F.transform(x, lambda v: v + F.lit(0).cast("float"))     # one form of zero
    rows = embeddings.select("vec_id", "label", F.when(F.coalesce(usable, F.lit(False)), plain).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    distinct = (rows.where("key is not null").groupBy("key", "label", "v")
                .agg(F.min("vec_id").alias("least"), F.count("*").alias("n")))

    def cells(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                m = flat[(ends[at] - size)[:, None] + np.arange(size)]
                cell[at] = np.floor(_units(m) @ _direction(size) / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    schema = f"{distinct._jdf.schema().toDDL()}, cell int"
    return rows, distinct.mapInArrow(cells, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each index over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of left, row of right) with cosine >= threshold; right None: pairs within left."""
    def prepared(v):
        u = _units(v)
        scale = np.abs(u).max(1) / 127
        q = np.rint(u / scale[:, None])
        err = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1))
        kind = np.float32 if v.shape[1] * 127 * 127 < 2**24 else np.float64      # products stay exact
        return u, q.astype(np.int8).astype(kind), scale, err

    u1, q1, s1, e1 = prepared(left)
    u2, q2, s2, e2 = (u1, q1, s1, e1) if right is None else prepared(right)
    found = []
    near = (q1 @ q2.T) * s1[:, None] * s2[None, :]
    near += e1[:, None] + e2[None, :] + e1[:, None] * e2[None, :] + 1e-5
    i, j = np.nonzero(near >= threshold)
    if right is None:
        i, j = i[i < j], j[i < j]
    for lo in range(0, len(i), 65536):
        a, b = i[lo: lo + 65536], j[lo: lo + 65536]
        ok = np.einsum("ij,ij->i", u1[a], u2[b]) >= threshold
        found.append((a[ok], b[ok]))
    z = np.zeros(0, np.int64)
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (z, z)


def _pair_task(threshold):
    def run(pdf):
        out = []
        for size, part in pdf.groupby(pdf["v"].map(len)):
            part = part.sort_values("key")
            vectors = np.stack(part["v"].to_numpy()).astype(np.float64).reshape(-1, size)
            side = part["side"].to_numpy()
            keys, n = part["key"].to_numpy(), part["n"].to_numpy()
            at1 = np.flatnonzero(side == 1)
            at0 = np.flatnonzero(side == 0)
            if not len(at0):
                continue
            alone = bool((part["tile_a"] == part["tile_b"]).iloc[0])
            if not alone and not len(at1):
                continue
            i, j = tile_links(vectors[at0], None if alone else vectors[at1], threshold)
            if not len(i):
                continue
            a, b = at0[i], (at0 if alone else at1)[j]
            links = np.bincount(a, n[b], len(part)) + np.bincount(b, n[a], len(part))
            root = _roots(len(part), a, b)
            hit = links > 0
            out.append(pd.DataFrame({"key": keys[hit], "root": keys[root[hit]], "links": links[hit].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "root": [], "links": []}).astype("int64")

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    steps = 4
    width = reach / steps * (1 + 1e-6) + 1e-9
    rows, distinct = classes(embeddings, width)
    distinct = stored(distinct, "vectors")
    counts = distinct.groupBy("label", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles"))
    tiles = counts.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("sub"), "n_tiles")
    tiles = stored(tiles.withColumn("tile", F.xxhash64("label", "cell", "sub")), "tiles")
    # a tile meets the tiles of its own cell from itself on, and all tiles of the next cells
    ahead = tiles.select("label", "cell", "sub", "tile", "n_tiles",
                         F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    other = tiles.select("label", (F.col("cell")).alias("cell_b"), F.col("sub").alias("sub_b"), F.col("tile").alias("tile_b"))
    pairs = (ahead.withColumn("cell_b", F.col("cell") + F.col("step")).join(other, ["label", "cell_b"])
             .where("step > 0 or sub_b >= sub").select(F.col("tile").alias("tile_a"), "tile_b"))
    sides = (pairs.select("tile_a", "tile_b", F.lit(0).alias("side"), F.col("tile_a").alias("tile"))
             .union(pairs.where("tile_a != tile_b").select("tile_a", "tile_b", F.lit(1), "tile_b")))
    placed = (salted_join(distinct.withColumn("cell_key", F.xxhash64("label", "cell")),
                          counts.select(F.xxhash64("label", "cell").alias("cell_key"), "n_tiles"), "cell_key", ["key"],
                          "inner")
              .withColumn("tile", F.xxhash64("label", "cell", F.pmod("key", F.col("n_tiles")).cast("int"))))
    work = placed.select("tile", "key", "v", "n").join(sides, "tile")
    found = stored(work.select("tile_a", "tile_b", "side", "key", "v", "n").groupBy("tile_a", "tile_b")
                   .applyInPandas(_pair_task(threshold), "key long, root long, links long"), "links")
    comp = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), "vector-components")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    per_class = (distinct.select("key", "least", "n").join(links, "key", "left")
                 .join(comp.withColumnRenamed("vertex", "key"), "key", "left")
                 .withColumn("component", F.coalesce("component", "key")))
    least = per_class.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = salted_join(per_class, least, "component", ["key"], "inner").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = salted_join(rows.select("vec_id", "key"), per_class, "key", ["vec_id"])
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

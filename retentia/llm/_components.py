"""Connected components of an edge table by local contraction and alternating large-star and small-star steps.

A round first replaces the edges that a task reads by stars: each vertex with
the least vertex that these edges connect it to.  Tables that one task reads are
done with that, others are smaller and flatter.  The rest is one aggregate per
star step (smallest neighbour, combined before the shuffle) and one join back
onto the edges.  The join is salted: a vertex with very many edges (the smallest
member of a huge group) is spread over ``SALTS`` tasks.  No step ever raises a
vertex' least neighbour, and stars stay as they are, so the rounds end.
The edge table is written to the shared folder after every step, so lineage
stays short and a lost executor recomputes one step at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm._store import stored

SALTS = 16
CHUNK = 1 << 18      # edges that a task contracts at a time


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) of the edges (a, b); the least vertices themselves are left out."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a):]
    root = np.arange(len(ids))
    while len(u):
        x, y = root[u], root[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))       # roots hang below smaller ones
        while not np.array_equal(root, up := root[root]):
            root = up
    low = root != np.arange(len(ids))
    return ids[low], ids[root[low]]


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Edges with the same components: those of each task as stars, ``chunk`` edges at a time."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= chunk:
                stars = forest(*map(np.concatenate, zip(*held)))
                held, size = [stars], len(stars[0])
                if size > chunk // 2:                                 # little to merge here
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, stars)), ["a", "b"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, forest(*map(np.concatenate, zip(*held))))), ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex a has one b only, which is no a itself."""
    none = F.lit(None).cast("long")
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("to")),
                                         F.struct(F.col("b").alias("v"), none.alias("to")))))
    each = ends.groupBy("v").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.count("to").alias("ups"),
                                 F.count("*").alias("n"))
    return each.agg(F.count_if((F.col("lo") != F.col("hi")) | ((F.col("ups") > 0) & (F.col("ups") < F.col("n"))))).first()[0] == 0


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (a, b) plus m = least b of each a."""
    least = (edges.groupBy("a").agg(F.min("b").alias("m"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["a", "salt"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    star = _with_min(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return star.where("a != b")            # repeated edges go with those of the small star


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    out = _with_min(down).select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                  F.struct(F.col("a"), F.col("m").alias("b")))))
    return out.where("a != b").distinct()


def components(edges: DataFrame, name: str = "components", chunk: int = CHUNK) -> DataFrame:
    """Edges (a long, b long) -> (vertex, component): component is the least vertex reachable.

    Self loops, repeated edges and nulls are ignored; a vertex without an edge
    to another vertex does not appear.
    """
    now = stored(_contracted(edges.where("a != b"), chunk), name)
    while True:
        tasks = -(-now.count() // chunk)                      # small files of many tasks are read together
        now = stored(_contracted(now.coalesce(max(1, tasks)), chunk), name)
        if _are_stars(now):
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct()
        now = stored(_small_star(_large_star(now)), name)

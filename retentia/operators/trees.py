"""Fitted tree ensembles as a node table, walked by joins: an independent reading of forests and boosted trees.

The node table has one row per node of every tree.  ``walk`` takes rows down all
trees, one join per level on the place (tree, node) a row has reached; leaf
values are then added up per row.  ``split_audit`` recomputes, for every inner
node, the impurity and the gain of its split from the rows that reach it.

All rows start at the same few roots, so the joins are salted by the row's key.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.operators.skew import salted_join
from retentia.session import scratch_path

_PLACE_BITS = 32


def _place(tree, node):
    return F.shiftleft(tree.cast("long"), _PLACE_BITS) + node


def node_table(model) -> DataFrame:
    """Nodes of a fitted forest or boosted ensemble.

    Columns: tree, node, place (both as one long), weight of the tree,
    prediction, counts (training weight per class), impurity, gain, left and
    right child (-1 at a leaf), feature, categorical, cut (threshold, or the
    values that go left).  The model is saved below the shared folder and its
    own tables are read back.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "ensemble")
    model.write().save(path)
    n = F.col("nodeData")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").select("treeID", "weights")
    return (spark.read.parquet(f"{path}/data").join(weights, "treeID")
            .select(F.col("treeID").alias("tree"), n["id"].alias("node"), _place(F.col("treeID"), n["id"]).alias("place"),
                    F.col("weights").alias("weight"), n["prediction"].alias("prediction"),
                    n["impurityStats"].alias("counts"), n["impurity"].alias("impurity"), n["gain"].alias("gain"),
                    n["leftChild"].alias("left"), n["rightChild"].alias("right"),
                    n["split"]["featureIndex"].alias("feature"),
                    (n["split"]["numCategories"] >= 0).alias("categorical"),
                    n["split"]["leftCategoriesOrThreshold"].alias("cut")))


def _start(rows: DataFrame, nodes: DataFrame, key: str, features: str) -> tuple[DataFrame, DataFrame]:
    """(inner nodes, rows x trees at the roots)."""
    inner = nodes.where("left >= 0").select("place", "left", "right", "feature", "categorical", "cut")
    last = nodes.agg(F.max("tree")).first()[0]
    at = rows.select(key, vector_to_array(features).alias("_x")).withColumns(
        {"tree": F.explode(F.sequence(F.lit(0), F.lit(int(last)))), "node": F.lit(0)})
    return inner, at


def _depth(nodes: DataFrame) -> int:
    """Number of joins that bring every row to a leaf (one small job per level)."""
    edges = nodes.where("left >= 0").select("tree", "node", F.explode(F.array("left", "right")).alias("child")).cache()
    try:
        level, depth = nodes.where("node = 0 and left >= 0").select("tree", "node"), 0
        while level.limit(1).count():
            depth += 1
            level = (level.join(edges, ["tree", "node"]).select("tree", F.col("child").alias("node"))
                     .join(nodes.where("left >= 0").select("tree", "node"), ["tree", "node"], "left_semi"))
        return depth
    finally:
        edges.unpersist()


def _goes_left():
    value = F.get("_x", F.col("feature"))
    return F.when(F.col("categorical"), F.array_contains("cut", value)).otherwise(value <= F.get("cut", F.lit(0)))


def _step(at: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Rows x trees joined with the inner node they stand on (null columns: a leaf)."""
    return salted_join(at.withColumn("place", _place(F.col("tree"), F.col("node"))), inner, "place", (key,), "left")


def walk(rows: DataFrame, nodes: DataFrame, key: str = "userId", features: str = "features") -> DataFrame:
    """(key, tree, weight, prediction, counts): the leaf that each row reaches in each tree."""
    inner, at = _start(rows, nodes, key, features)
    for _ in range(_depth(nodes)):
        step = F.when(F.col("left").isNull(), F.col("node")).when(_goes_left(), F.col("left")).otherwise(F.col("right"))
        at = _step(at, inner, key).select(key, "_x", "tree", step.alias("node"))
    leaves = nodes.select("place", "weight", "prediction", "counts")
    there = at.select(key, "tree", _place(F.col("tree"), F.col("node")).alias("place"))
    return salted_join(there, leaves, "place", (key,)).select(key, "tree", "weight", "prediction", "counts")


def boosted_scores(rows: DataFrame, nodes: DataFrame, key: str = "userId", features: str = "features") -> DataFrame:
    """(key, margin, prediction) of boosted trees: weighted leaf values added up, class 1 above 0."""
    margin = F.sum(F.col("weight") * F.col("prediction"))
    return (walk(rows, nodes, key, features).groupBy(key).agg(margin.alias("margin"))
            .withColumn("prediction", (F.col("margin") > 0).cast("double")))


def forest_scores(rows: DataFrame, nodes: DataFrame, n_classes: int = 2, key: str = "userId",
                  features: str = "features") -> DataFrame:
    """(key, probability array, prediction) of a forest: every tree votes with the class shares of its leaf."""
    total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    votes = walk(rows, nodes, key, features).groupBy(key).agg(
        *[F.sum(F.get("counts", F.lit(k)) / total).alias(f"_v{k}") for k in range(n_classes)], F.count("*").alias("_n"))
    out = votes.select(key, F.array(*[F.col(f"_v{k}") / F.col("_n") for k in range(n_classes)]).alias("probability"))
    best = F.array_position("probability", F.array_max("probability")) - 1
    return out.withColumn("prediction", best.cast("double"))


def _impurity(kind: str, counts: list, total):
    shares = [F.when(total > 0, c / total).otherwise(0.0) for c in counts]
    if kind == "gini":
        return 1.0 - sum(s * s for s in shares)
    return -sum(F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in shares)


def split_audit(rows: DataFrame, nodes: DataFrame, impurity: str, label: str = "label", n_classes: int = 2,
                key: str = "userId", features: str = "features") -> DataFrame:
    """Inner nodes with what the rows say: tree, node, n, impurity, gain, their recomputed values, best_gain.

    ``best_gain`` is the highest gain that any threshold which the ensemble uses
    for the node's feature has at this node.  The rows at a node are first
    counted per class between neighbouring thresholds, so only those counts are
    sorted.  Values agree with the fitted ones if the trees saw the rows as they
    are (no bootstrap).
    """
    inner, at = _start(rows.select(key, label, features), nodes, key, features)
    labels = rows.select(key, F.col(label).cast("int").alias("_y"))
    at = at.join(labels, key)
    used = (nodes.where("left >= 0 and not categorical").groupBy("feature")
            .agg(F.sort_array(F.collect_set(F.get("cut", F.lit(0)))).alias("cuts")))     # thresholds of one feature
    inner = inner.join(used, "feature", "left")
    value = F.get("_x", F.col("feature"))
    counts = None
    for _ in range(_depth(nodes)):
        here = _step(at, inner, key).where("left is not null").withColumn("_left", _goes_left())
        bucket = F.when(F.col("categorical"), F.when(F.col("_left"), 0).otherwise(1)).otherwise(
            F.size(F.filter("cuts", lambda t: t < value)))
        seen = here.groupBy("place", bucket.alias("bucket")).agg(
            *[F.sum((F.col("_y") == k).cast("long")).alias(f"c{k}") for k in range(n_classes)])
        counts = seen if counts is None else counts.union(seen)
        at = here.select(key, "_x", "_y", "tree", F.when(F.col("_left"), F.col("left")).otherwise(F.col("right")).alias("node"))
    upto, every = W.partitionBy("place").orderBy("bucket"), W.partitionBy("place")
    parts = counts
    for k in range(n_classes):
        parts = parts.withColumns({f"l{k}": F.sum(f"c{k}").over(upto), f"t{k}": F.sum(f"c{k}").over(every)})
    total, low = sum(F.col(f"t{k}") for k in range(n_classes)), sum(F.col(f"l{k}") for k in range(n_classes))
    node_impurity = _impurity(impurity, [F.col(f"t{k}") for k in range(n_classes)], total)
    left_impurity = _impurity(impurity, [F.col(f"l{k}") for k in range(n_classes)], low)
    right_impurity = _impurity(impurity, [F.col(f"t{k}") - F.col(f"l{k}") for k in range(n_classes)], total - low)
    gain = node_impurity - (low * left_impurity + (total - low) * right_impurity) / total
    parts = parts.select("place", "bucket", total.alias("n"), node_impurity.alias("impurity_of_rows"), gain.alias("g"))
    fitted = nodes.where("left >= 0").join(used, "feature", "left").select(
        "tree", "node", "place", "impurity", "gain",
        F.when(F.col("categorical"), 0).otherwise(F.array_position("cuts", F.get("cut", F.lit(0))) - 1).alias("chosen"))
    found = fitted.join(parts, "place")
    # the counts up to a threshold are those of the last bucket at or below it
    mine = F.max(F.when(F.col("bucket") <= F.col("chosen"), F.struct("bucket", "g")))["g"]
    return (found.groupBy("tree", "node", "impurity", "gain", "n", "impurity_of_rows")
            .agg(mine.alias("gain_of_rows"), F.max("g").alias("best_gain")))

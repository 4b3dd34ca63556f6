"""Optimality certificate of an elastic-net logistic regression: gradient and subgradient conditions from row sums.

The objective is the mean log loss plus reg * (enet * |b| + (1 - enet) / 2 * b^2)
over the coefficients b of standardised features (less their mean, by their
standard deviation on the training rows).  At the optimum the
gradient g of the mean log loss satisfies, for every class and feature,
|g| <= reg * enet where b is 0, and g + reg * (1 - enet) * b + reg * enet * sign(b) = 0
elsewhere.  One aggregate over (row, feature) gives all gradients; nothing of
the solver is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4


def optimality(model: LogisticRegressionModel, encoded: DataFrame, digits: int = 6,
               tolerance: float = TOLERANCE) -> DataFrame:
    """class, i, coefficient (standardised), gradient, bound, optimal per class and feature, on the rows of the fit.

    A feature that is constant there has gradient 0.  ``optimal`` allows
    ``tolerance`` for the solver's stopping rule.
    """
    spark = encoded.sparkSession
    reg, enet = float(model.getRegParam()), float(model.getElasticNetParam())
    classes = range(model.numClasses)
    weights = model.coefficientMatrix.toArray().tolist()
    features, label = model.getFeaturesCol(), F.col(model.getLabelCol())
    x = model.transform(encoded).select(
        label.alias("_y"), vector_to_array(model.getProbabilityCol()).alias("_p"),
        F.posexplode(vector_to_array(features)).alias("i", "_x"))
    error = [F.col("_p")[k] - (F.col("_y") == k).cast("double") for k in classes]
    sums = x.groupBy("i").agg(
        F.count("*").alias("_n"), F.avg("_x").alias("_mean"), F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("_sd"),
        *[F.sum(e * F.col("_x")).alias(f"_g{k}") for k, e in enumerate(error)],
        *[F.sum(e).alias(f"_e{k}") for k, e in enumerate(error)])
    per_class = reduce(DataFrame.union, [
        sums.select(F.lit(k).alias("class"), "i", "_sd",
                    F.when(F.col("_sd") > 0, (F.col(f"_g{k}") - F.col("_mean") * F.col(f"_e{k}")) / F.col("_n")
                           / F.col("_sd")).otherwise(0.0).alias("g"))
        for k in classes])
    held = spark.createDataFrame([(k, i, float(w)) for k, row in enumerate(weights) for i, w in enumerate(row)],
                                 "class int, i int, w double")           # one row per class and feature
    b, g = F.col("w") * F.col("_sd"), F.col("g")
    miss = F.when(b == 0, F.greatest(F.abs(g) - reg * enet, F.lit(0.0))).otherwise(
        F.abs(g + reg * (1 - enet) * b + reg * enet * F.signum(b)))
    return per_class.join(held, ["class", "i"]).select(
        "class", "i", F.round(b, digits).alias("coefficient"), F.round(g, digits).alias("gradient"),
        F.round(F.lit(reg * enet), digits).alias("bound"), (miss <= tolerance).alias("optimal"))

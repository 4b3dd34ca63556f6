"""Classification metrics as DataFrame aggregates.

Scored rows are reduced to the confusion matrix (at most classes^2 rows per
group, a hash aggregate with map-side combine); per-class precision, recall
and F1 and the support-weighted F1 are arithmetic on that tiny table, still
inside Spark -- no rows travel to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     keys: tuple[str, ...] = ()) -> DataFrame:
    return (pred.groupBy(*keys, F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(cm: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., label, support, precision, recall, f1) for each class present as a label.

    Each confusion cell contributes (support, tp) to its label's class and
    ``predicted`` to its prediction's class; one aggregate sums them.
    """
    zero = F.lit(0).cast("bigint")
    cell = F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("tp"),
                 zero.alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("support"), zero.alias("tp"),
                 F.col("n").alias("predicted"))))
    j = (cm.select(*keys, cell).groupBy(*keys, F.col("cls").alias("label"))
         .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
         .where(F.col("support") > 0))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.col("tp") / F.col("support")
    j = j.withColumns({"precision": p, "recall": r})
    pr = F.col("precision") + F.col("recall")
    f1 = F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(F.lit(0.0))
    return j.withColumn("f1", f1).select(*keys, "label", "support", "precision", "recall", "f1")


def weighted_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                digits: int = 9, keys: tuple[str, ...] = ()) -> DataFrame:
    """Support-weighted F1: one row, or one row per combination of ``keys``."""
    pc = per_class(confusion_matrix(pred, label, prediction, keys), keys)
    wf1 = F.round(F.sum(F.col("support") * F.col("f1")) / F.sum("support"), digits).alias("weighted_f1")
    return pc.groupBy(*keys).agg(wf1)


def f1_value(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """The weighted F1 as a Python float (a one-row action)."""
    return float(weighted_f1(pred, label, prediction, digits=12).first()["weighted_f1"])

"""Category frequencies, top-k with skipped leaders, collapsing rare values."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "OTHER"


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def top_categories(df: DataFrame, column: str, k: int = 10, skip: int = 1) -> DataFrame:
    """Categories at ranks skip+1 .. skip+k by count desc, value asc.

    The default (k=10, skip=1) keeps ranks 2-11: the most frequent value is
    not in the list and is collapsed like the rare ones.  The ranking is a
    bounded top-(k+skip) (TakeOrderedAndProject); the window only numbers
    those k+skip rows.
    """
    ranked = (category_counts(df, column)
              .orderBy(F.col("count").desc(), F.col(column).asc_nulls_first())
              .limit(k + skip))
    w = Window.orderBy(F.col("count").desc(), F.col(column).asc_nulls_first())
    return (ranked.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") > skip))


def collapse_rare(df: DataFrame, column: str, top: DataFrame, other: str = OTHER) -> DataFrame:
    """Replace values not in ``top`` (at most k rows, so broadcast) by ``other``."""
    keep = F.broadcast(top.select(F.col(column).alias("_keep")))
    j = df.join(keep, F.col(column) == F.col("_keep"), "left")
    return j.withColumn(column, F.when(F.col("_keep").isNotNull(), F.col(column)).otherwise(F.lit(other))
                        ).drop("_keep")


def _literal(value: str) -> str:
    """SQL string literal; backslashes and quotes are escaped."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def collapse_stage(df: DataFrame, column: str, k: int = 10, skip: int = 1, output: str | None = None,
                   other: str = OTHER) -> SQLTransformer:
    """Fit the top list on ``df`` and return it as a persistable pipeline stage.

    The list has at most k entries, so bringing it to the driver is bounded;
    the stage inlines it as a CASE expression and is saved with the pipeline.
    """
    values = [r[column] for r in top_categories(df, column, k, skip).select(column).collect()
              if r[column] is not None]
    out = output or column
    col, target = _name(column), _name(out)
    kept = ", ".join(_literal(v) for v in values) or "NULL"
    expr = f"CASE WHEN {col} IN ({kept}) THEN {col} ELSE {_literal(other)} END"
    if out == column:
        stmt = f"SELECT * EXCEPT ({col}), {expr} AS {col} FROM __THIS__"
    else:
        stmt = f"SELECT *, {expr} AS {target} FROM __THIS__"
    return SQLTransformer(statement=stmt)

"""Persisted scoring pipeline: save, load, batch score, decision text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators.train import fit_model
from retentia.schema import NUMERIC


def fit_scoring_model(data: DataFrame, name: str = "Random Forest", refined: bool = True,
                      collapse_on: DataFrame | None = None) -> PipelineModel:
    """Whole train-to-serve pipeline: collapse, index ('keep'), encode, normalise, learner.

    Unseen category values get an all-zero slot; the vector has as many entries
    as in training.  The assembler keeps a row with a NULL number, so one bad
    row cannot fail a job over millions of users; ``batch_score`` then gives
    that row no answer.
    """
    return fit_model(data, name, refined=refined, handle_invalid="keep", assemble_invalid="keep",
                     collapse_on=collapse_on)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def prepare_requests(df: DataFrame) -> DataFrame:
    """Normalise request rows: lower-case level; the label is not needed."""
    return df.withColumn("last_level", F.lower(F.col("last_level")))


def batch_score(model: PipelineModel, requests: DataFrame, key: str = "userId") -> DataFrame:
    """(key, probability, prediction, decision) for every request row.

    A row with a NULL or NaN number cannot be scored: its probability,
    prediction and decision are NULL.
    """
    scored = model.transform(prepare_requests(requests))
    usable = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in NUMERIC])
    return scored.select(
        key,
        F.when(usable, vector_to_array("probability")).alias("probability"),
        F.when(usable, F.col("prediction")).alias("prediction"),
        F.when(usable, F.when(F.col("prediction") == 1.0, F.lit("churn")).otherwise(F.lit("stay"))).alias("decision"),
    )

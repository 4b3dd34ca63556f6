"""Reproducible splits and the categorical/numeric encoding stages."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Normalizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.columns import hash_bucket
from retentia.operators.category import collapse_stage
from retentia.schema import NUMERIC

# Input and output column names of the encoding stages.
INDEX_IN = ["gender", "last_level", "last_state"]
INDEX_OUT = ["genderIndex", "levelIndex", "stateIndex"]
VEC_OUT = ["genderVec", "levelVec", "stateVec"]
RAW_FEATURES = "rawFeatures"
FEATURES = "features"


def split_assign(df: DataFrame, key: str = "userId", train: int = 6, test: int = 2) -> DataFrame:
    """Add ``bucket`` (0-9, md5 of the key) and ``split`` (train/test/valid).

    Buckets 0..train-1 train, then test, the rest valid (60/20/20 by
    default).  Stable across runs, partitionings and row orders.
    """
    b = hash_bucket(key, 10)
    split = (F.when(b < train, F.lit("train")).when(b < train + test, F.lit("test")).otherwise(F.lit("valid")))
    return df.withColumns({"bucket": b, "split": split})


def fold_assign(df: DataFrame, key: str = "userId", folds: int = 3) -> DataFrame:
    """Add ``fold`` (0..folds-1) from the md5 of key + '#fold' (independent of the split)."""
    return df.withColumn("fold", hash_bucket(F.concat(F.col(key).cast("string"), F.lit("#fold")), folds))


def labelled(features: DataFrame) -> DataFrame:
    """Feature table with a double ``label`` (churn), split and fold columns."""
    return fold_assign(split_assign(features.withColumn("label", F.col("churn").cast("double"))))


def indexer(handle_invalid: str = "skip") -> StringIndexer:
    """One multi-column indexer: most frequent value first, ties by value."""
    return StringIndexer(inputCols=INDEX_IN, outputCols=INDEX_OUT, handleInvalid=handle_invalid,
                         stringOrderType="frequencyDesc")


def one_hot(index_invalid: str = "skip") -> OneHotEncoder:
    """One slot per category seen in training, under every index policy.

    After a 'keep' indexer the last index stands for unseen values; dropLast
    drops that one, so an unseen value is an all-zero slot.  After 'skip' or
    'error' there is no such index: handleInvalid='keep' adds a slot and
    dropLast removes it again.
    """
    return OneHotEncoder(inputCols=INDEX_OUT, outputCols=VEC_OUT, dropLast=True,
                         handleInvalid="error" if index_invalid == "keep" else "keep")


def assembler(output: str = FEATURES, handle_invalid: str = "error") -> VectorAssembler:
    """handle_invalid='keep' puts NaN for a NULL number instead of failing the job (used for scoring)."""
    return VectorAssembler(inputCols=VEC_OUT + NUMERIC, outputCol=output, handleInvalid=handle_invalid)


def l1_normalizer(input_col: str = RAW_FEATURES, output: str = FEATURES) -> Normalizer:
    return Normalizer(inputCol=input_col, outputCol=output, p=1.0)


def preprocess_stages(train: DataFrame | None, refined: bool, handle_invalid: str = "skip",
                      k: int = 10, skip: int = 1, collapse_on: DataFrame | None = None,
                      assemble_invalid: str = "error") -> list:
    """Stages up to the feature vector.

    raw:     index -> one-hot -> assemble into ``features``
    refined: collapse rare states -> index -> one-hot -> assemble into
             ``rawFeatures`` -> L1-normalise into ``features``.  The top list
             is fitted on ``train`` unless ``collapse_on`` is given (pass all
             rows to reproduce a list computed before the split).
    """
    if not refined:
        return [indexer(handle_invalid), one_hot(handle_invalid), assembler(FEATURES, assemble_invalid)]
    top_source = collapse_on if collapse_on is not None else train
    return [collapse_stage(top_source, "last_state", k, skip), indexer(handle_invalid), one_hot(handle_invalid),
            assembler(RAW_FEATURES, assemble_invalid), l1_normalizer()]


def fit_preprocess(train: DataFrame, refined: bool, handle_invalid: str = "skip",
                   collapse_on: DataFrame | None = None, assemble_invalid: str = "error"):
    stages = preprocess_stages(train, refined, handle_invalid, collapse_on=collapse_on,
                               assemble_invalid=assemble_invalid)
    return Pipeline(stages=stages).fit(train)


def vector_entries(df: DataFrame, vec: str, key: str = "userId", digits: int | None = None) -> DataFrame:
    """Long form (key, i, v) of the non-zero entries of a vector column."""
    out = (df.select(key, F.posexplode(vector_to_array(vec)).alias("i", "v"))
           .where(F.col("v") != 0))
    if digits is not None:
        out = out.withColumn("v", F.round("v", digits))
    return out

"""Corpus pipeline: documents to packed training sequences, one operator of ``retentia.llm`` per stage.

Each stage gets all rows that the one before it kept, and its decisions take
effect: rejected documents and further members of near-duplicate groups are
gone, repeated passages are cut out of the texts.  All stages but the last
return the columns of documents.

Defined results: null and empty texts are rejected by the rules; repeated rows
are near duplicates of each other; other columns pass through unchanged, also
those named like an operator's outputs, up to the last stage, which returns
pieces; an empty table gives no pieces.

The rules stage judges the corpus it is given, so its language bands come from
the documents that the classifier kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.llm import ngram_jaccard, packing, quality_classifier, quality_rules, suffix_dedup
from retentia.llm._columns import fresh
from retentia.llm._store import stored
from retentia.llm.queries import WORD_TOKENIZER, table

#: Bytes of a repeated passage: about forty words, so that one of over fifty is found wherever it starts.
PASSAGE = 200

#: Columns that the two filtering operators add.
OUTPUTS = ("score", "predicted", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "log_ppl", "kept")


def _filtered(docs, apply, condition):
    """Rows for which ``condition`` holds after ``apply`` has added its columns; given columns of those names survive."""
    clash = [c for c in docs.columns if c.lower() in OUTPUTS]
    aside = dict(zip(clash, fresh([*docs.columns, *OUTPUTS], *clash)))
    out = apply(docs.withColumnsRenamed(aside)).where(condition)
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def classify(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda d: quality_classifier.score(d, model), "predicted = 1")


def rules(spark, docs, sf_dir):
    """Documents that pass the quality rules and lie in the perplexity band of their language."""
    return _filtered(docs, quality_rules.apply_rules, "kept")


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return ngram_jaccard.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """The documents without passages of ``PASSAGE`` bytes that also occur elsewhere."""
    return suffix_dedup.clean(docs, PASSAGE)


def pack(spark, docs, sf_dir):
    """Pieces of the tokenised documents with their sequence and offset."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", pack),
]

#: SQL cannot express the classifier, the Kneser-Ney model or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Result of the last stage over the documents of ``sf_dir``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs

"""Named queries of the training-data operators: (spark, sf_dir) -> DataFrame.

Each query applies its operator with production parameters to its whole table
and derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from retentia.llm import (embedding_dedup, embedding_whitening, lm_scoring, ngram_jaccard, packing, quality_classifier,
                          quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_alignment, token_files,
                          url_filters)
from retentia.session import scratch_path

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return (quality_classifier.score(docs, model)
            .select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


def op2_sentencepiece(spark, sf_dir):
    """Ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece_codec.encode_and_decode(docs, PIECE_MODEL)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "ids_crc32",
                       (F.col("decoded") == F.coalesce(F.replace("text", F.lit("\u2581"), F.lit(" ")), F.lit("")))
                       .alias("round_trip"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    annotated = quality_rules.stored(quality_rules.annotate(docs, quality_rules.fit(docs)).drop("text"), "rules")
    return quality_rules.judge(annotated, quality_rules.bands(annotated)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "log_ppl")


def op5_url_filters(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op10_sharding(spark, sf_dir):
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op11_token_alignment(spark, sf_dir):
    aligned = token_alignment.corpus_alignment(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL, hashed=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), WORD_TOKENIZER, path)
    return token_files.read_digests(spark, path)


def op13_embedding_whitening(spark, sf_dir):
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_embedding_dedup, op4_quality_rules,
                                    op5_url_filters, op6_packing, op7_suffix_dedup, op8_lm_scoring, op9_ngram_jaccard,
                                    op10_sharding, op11_token_alignment, op12_token_files, op13_embedding_whitening)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Closure of the links (x, y): the least id reachable from each id.
_REACH = """links2 AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, x FROM links2 UNION SELECT r.a, l.y FROM reach r JOIN links2 l ON r.b = l.x),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

_OP3 = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
{_REACH},
n AS (SELECT x, count(*) AS n FROM links2 GROUP BY x)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(l.m, t.vec_id) AS component_id,
  coalesce(l.m, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN n ON n.x = t.vec_id LEFT JOIN least l ON l.a = t.vec_id"""

_OP9 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
  WHERE 100 * c >= 75 * (len(a.s) + len(b.s) - c)),
{_REACH}
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.m, s.doc_id) AS component_id FROM s LEFT JOIN least l ON l.a = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express whole; the tests compare the others with brute force."""
    return {"op3_embedding_dedup": _OP3, "op9_ngram_jaccard": _OP9}

"""The corpus pipeline, each stage against brute force on what the stage before it kept."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retentia.llm import packing, quality_classifier, quality_rules
from retentia.llm._store import stored
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_group_operators import TOKENIZER, cut_brute, jaccard_links, shingles
from tests.llm.test_text_operators import base_of
from tests.llm.conftest import roots

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    """Documents (with junk to reject and clashing columns) and labels as an sf folder."""
    path = str(tmp_path_factory.mktemp("sf"))
    junk = spark.createDataFrame([(2000 + i, " ".join(f"W{k}{i}!!" for k in range(40)), "en", "s", 1) for i in range(60)],
                                 SCHEMA)
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars").union(junk)
    docs = docs.withColumns({"score": F.lit("mine"), "kept": F.lit("mine"), "n_words": F.lit("mine"),
                             "set_key": F.lit("mine"), "copy": F.lit("mine"), "length": F.lit("mine")})
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1) for i in range(140)] + [(2000 + i, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    step = stored(STAGES["quality_classifier"](spark, docs, folder), "t1")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    keep = {(r.doc_id, r.text) for r in quality_classifier.score(docs, model).where("predicted = 1").collect()}
    assert step.columns == columns and rows_of(step) == collections.Counter(
        {r: n for r, n in rows_of(docs).items() if r[:2] in keep})
    ids = {r.doc_id for r in step.collect()}
    assert not any(i is not None and i >= 2000 for i in ids) and set(range(80)) <= ids

    before, step = step, stored(STAGES["quality_rules"](spark, step, folder), "t2")
    ruled = {(r.doc_id, r.text): r.kept for r in quality_rules.apply_rules(before).collect()}
    assert step.columns == columns and rows_of(step) == collections.Counter(
        {r: n for r, n in rows_of(before).items() if ruled[r[:2]]})
    assert not any(base_of(r[1])[5] for r in rows_of(step))
    passing = [r for r in rows_of(before) if not base_of(r[1])[5]]
    assert len(rows_of(step)) >= 0.95 * len(passing)

    before, step = step, stored(STAGES["ngram_jaccard"](spark, step, folder), "t3")
    rows = sorted(rows_of(before), key=lambda r: (r[0] is None, r[0] or 0))
    root = roots(len(rows), jaccard_links([shingles(r[1]) for r in rows]))
    assert step.columns == columns and rows_of(step) == collections.Counter(rows[k] for k in set(root))

    before, step = step, stored(STAGES["suffix_dedup"](spark, step, folder), "t4")
    was, now = before.collect(), {(r.doc_id): r for r in step.collect()}
    cut = dict(zip((r.doc_id for r in was), cut_brute([r.text for r in was], corpus_pipeline.PASSAGE)))
    assert step.columns == columns and len(now) == len(was)
    assert all(len(now[r.doc_id].text.encode()) == cut[r.doc_id][0] - cut[r.doc_id][1] for r in was)
    assert any(c[1] for c in cut.values()) and all(r.n_chars == len(r.text) and r.score == "mine" for r in now.values())

    pieces = STAGES["packing"](spark, step, folder).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for r in now.values():
        t = [*tok.encode(r.text, add_special_tokens=False).ids, packing.END_ID]
        for s in range(0, len(t), packing.SIZE):
            part = np.array(t[s:s + packing.SIZE], "<u4")
            want[(r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(t))] += 1
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want


def test_passages_of_51_words_are_cut(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(51)) for _ in range(4)]
    docs = [(i, " ".join(word() for _ in range(60)) + " " + passages[i % 4] + " " + " ".join(word() for _ in range(40)))
            for i in range(12)] + [(100 + i, " ".join(word() for _ in range(120))) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, str(tmp_path)).collect()}
    for i, text in docs:
        if i >= 100:
            assert out[i] == text
        else:
            assert passages[i % 4][4:-4] not in out[i] and len(out[i]) < len(text) - 200
            assert out[i].startswith(text[:150]) and out[i].endswith(text[-100:])


def test_run_equals_the_stages(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() > 80 and whole.agg(F.max("length")).first()[0] <= packing.SIZE
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(len(words(docs[r.doc_id])) >= 20 for r in whole.select("doc_id").distinct().collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

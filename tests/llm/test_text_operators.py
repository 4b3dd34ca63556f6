"""Quality classifier, quality rules, SentencePiece, language-model scoring against brute force and odd inputs."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from retentia.llm import _ngrams, _text, lm_scoring, quality_classifier, quality_rules, sentencepiece_codec
from tests.conftest import SF_MID
from tests.llm.conftest import WORD, lower, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def by_id(rows, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in rows), key=repr)


# -- quality classifier ---------------------------------------------------------------

def test_classifier_learns_held_out_junk(spark):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)]
        bad = i % 3 == 0
        docs.append((i, " ".join(x + "%%%" for x in w) if bad else " ".join(w).capitalize() + "."))
        labels.append((i, 0 if bad else 1))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_classifier.fit(d, lab)
    rows = quality_classifier.score(d, model).withColumn("h", quality_classifier.held_out(F.col("doc_id"))).collect()
    assert any(r.h for r in rows) and all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all((r.predicted == 1) == (r.doc_id % 3 != 0) for r in rows if r.h)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_ignores_held_out_labels(spark, documents):
    ids = [(i, i % 2) for i in range(100)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in ids]
    a, b = (quality_classifier.fit(documents, spark.createDataFrame(x, "doc_id long, quality int")) for x in (ids, flipped))
    x = np.random.default_rng(1).random((20, len(quality_classifier.FEATURES)))
    assert (a.score(x) == b.score(x)).all()


def test_classifier_odd_inputs(spark, documents, no_documents):
    none = spark.createDataFrame([(None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(documents, none)
    rows = quality_classifier.score(documents, model).collect()
    assert len(rows) == documents.count() and all(r.score == 0.5 for r in rows)
    assert quality_classifier.score(no_documents, model).count() == 0
    twice = spark.createDataFrame([(i, q) for i in range(60) for q in (0, 1)], "doc_id long, quality int")
    assert quality_classifier.fit(documents, twice).bias < 0      # the lowest label of an id counts


def test_pair_tables_learn_interactions():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.boost(x, y)
    test = rng.random((1000, 3))
    assert (0, 1) in model.pairs
    assert ((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.85


# -- quality rules -------------------------------------------------------------------

def base_of(text):
    w = words(text)
    win = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i:i + 8])] > 1:
            cover.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover),
            n < 20 or 100 * len(cover) > 30 * n)


def test_base_counts_equal_brute_force(spark, corpus, documents):
    rows = quality_rules.apply_rules(documents).collect()
    got = by_id(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((d[0], *base_of(d[1])) for d in corpus), key=repr)
    assert all(r.kept is False for r in rows if r.base_failed) and all(r.kept in (True, False) for r in rows)
    assert {c for c in documents.columns} <= set(rows[0].asDict())


def test_rules_on_empty_table(no_documents):
    assert quality_rules.apply_rules(no_documents).count() == 0


def brute_kn(texts, order, k_gram, coc_of):
    """Modified Kneser-Ney probability by recursion over dictionaries."""
    grams = collections.Counter(k_gram(t, i) for t in texts for i in range(len(t)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / 257
        level = levels[k]
        followers = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        if not followers:
            return prob(g[1:])
        d = coc_of(level)
        total = sum(followers.values())
        gamma = sum(d[min(c, 3)] for c in followers.values()) / total
        c = level.get(g, 0)
        return (c - d[min(c, 3)] if c else 0) / total + gamma * prob(g[1:])

    return prob


def test_kneser_ney_equals_brute_force():
    texts = [b"abracadabra", b"abba cab", b"cadabra abra"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    keys, counts = np.unique(_ngrams.packed(data, offs, 3, 0), return_counts=True)
    coc = np.bincount(np.minimum(counts, 5), minlength=6)[:5]
    model = quality_rules.Model(keys, counts, coc, 3)
    gram = lambda t, i: (bytes(3) + t)[i + 1: i + 4]
    disc = lambda level: quality_rules._discounts(
        np.bincount(np.minimum(list(level.values()), 5), minlength=6)[:5])
    prob = brute_kn(texts, 3, gram, disc)
    probe = [gram(t, i) for t in [*texts, b"zebra cab", b"bbbb"] for i in range(len(t))]
    got = model.log_prob(np.array([int.from_bytes(g, "big") for g in probe], np.uint64))
    assert np.allclose(got, [math.log(prob(g)) for g in probe], atol=1e-4)
    context = b"ab"
    everything = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
    assert 0.9 < np.exp(model.log_prob(everything)).sum() <= 1 + 1e-6


def test_bands_reject_both_ends(spark):
    rows = [(i, "en", False, 1.5 + (i % 7 - 3) / 100) for i in range(200)] + [(900, "en", False, 3.0), (901, "en", False, 0.1),
                                                                           (902, None, False, 9.0), (903, "en", True, 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, log_ppl double")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(df, quality_rules.bands(df)).collect()}
    assert all(kept[i] for i in range(200)) and not kept[900] and not kept[901] and kept[902] and not kept[903]


def test_rules_of_a_parted_model_are_the_same(spark, documents):
    """A corpus of more n-grams than are sent to the tasks is judged by its whole Kneser-Ney model."""
    columns = ("n_words", "n_repeat_words", "base_failed", "text", "_salt")
    whole, parted = (quality_rules.apply_rules(documents, most=m).collect() for m in (quality_rules.MOST, 100))
    assert by_id(parted, *columns) == by_id(whole, *columns)
    for a, b in zip(by_id(parted, "text", "log_ppl", "kept"), by_id(whole, "text", "log_ppl", "kept")):
        assert a[2] == (b[2] and pytest.approx(b[2], abs=1e-6)) and a[3] == b[3]


def test_both_ends_reject_junk_and_keep_copies(spark):
    """Both ends of the bands reject labelled junk, few good documents; copies of a good one stay."""
    read = lambda t: spark.read.parquet("%s/%s.parquet" % (SF_MID, t))
    docs = read("documents").select("doc_id", "lang", "text")
    good = docs.join(read("labels").where("quality = 1"), "doc_id").orderBy("doc_id").first()
    copies = spark.range(10**6, 10**6 + 300).select(F.col("id").alias("doc_id"), F.lit(good.lang).alias("lang"),
                                                    F.lit(good.text).alias("text"))
    annotated = quality_rules.stored(quality_rules.annotate(docs.union(copies), quality_rules.fit(docs.union(copies))), "rules")
    rows = (quality_rules.judge(annotated, quality_rules.bands(annotated)).where("not base_failed")
            .join(quality_rules.bands(annotated), "lang").join(read("labels"), "doc_id", "left").collect())
    assert all(r.kept for r in rows if r.doc_id >= 10**6 or r.text == good.text)
    share = lambda q, out: np.mean([out(r) for r in rows if r.quality == q])
    low, high = (lambda r: r.log_ppl < r.low), (lambda r: r.log_ppl > r.high)
    assert share(0, low) > 0.05 and share(0, high) > 0.05
    assert share(1, low) + share(1, high) < 0.05


def test_sorted_hash_finds_members_only():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**40, 5000, dtype=np.uint64))
    table = _ngrams.SortedHash(keys)
    values = table.aligned(np.arange(len(keys)))
    found = table.find(keys)
    assert (values[found] == np.arange(len(keys))).all()
    other = keys + np.uint64(2**41)
    assert (table.find(other) == -1).all()
    assert (_ngrams.SortedHash(np.zeros(0, np.uint64)).find(keys) == -1).all()


# -- SentencePiece -------------------------------------------------------------------

def test_sentencepiece_equals_library(spark, corpus, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(documents.drop("ids"), PIECES), PIECES).collect()
    want = sorted(((d[0], model.encode(d[1] or ""), (d[1] or "").replace("\u2581", " ")) for d in corpus), key=repr)
    assert by_id(back, "ids", "decoded") == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back)
    once = sentencepiece_codec.encode_and_decode(documents.drop("ids"), PIECES).collect()
    assert by_id(once, "ids", "decoded", "ids_crc32") == by_id(back, "ids", "decoded", "ids_crc32")


def test_long_units_use_the_heap():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec, _ = sentencepiece_codec._loaded(PIECES)
    units = [b" " + ("ab" * 700 + "ing" * 200).encode(), b" short", b" " + b"\xc3\xa9" * 400, b" " * 50]
    assert codec.encode_units(units) == [model.encode(u.decode()[1:]) for u in units]


def test_sentencepiece_empty_table(no_documents):
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(no_documents, PIECES), PIECES).count() == 0


# -- language-model scoring -----------------------------------------------------------

def brute_ppm(texts, order):
    """log10 share of a text under the trie of all texts, by the definition."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in texts:
        ended = bytes([255] * order) + t + b"\xff"
        for i in range(order, len(ended)):
            for k in range(order + 1):
                seen[k][ended[i - k:i]][ended[i]] += 1

    def score(t):
        ended, total = bytes([255] * order) + t + b"\xff", 0.0
        for i in range(order, len(ended)):
            gone = set()
            for k in range(order, -2, -1):
                if k < 0:
                    total -= math.log10(256 - len(gone))
                    break
                ctx = {s: c for s, c in seen[k].get(ended[i - k:i], {}).items() if s not in gone}
                if not ctx:
                    continue
                n, d = sum(ctx.values()), len(ctx)
                if ended[i] in ctx:
                    total += math.log10(ctx[ended[i]] / (n + d))
                    break
                total += math.log10(d / (n + d))
                gone |= set(ctx)
        return total

    return score


def test_lm_scores_equal_brute_force(spark, corpus, documents):
    rows = lm_scoring.score(documents).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter()
    for d in corpus:
        if not held(d[0]):
            count.update([*WORD.findall(lower(d[1])), None])
    n, v = sum(count.values()), len(count)
    ppm = brute_ppm([(d[1] or "").encode() for d in corpus if not held(d[0])], lm_scoring.ORDER)
    want = []
    for d in corpus:
        t = [*WORD.findall(lower(d[1])), None]
        want.append((d[0], held(d[0]), len(t), sum(count[x] > 0 for x in t), n,
                     round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t), 5),
                     ppm((d[1] or "").encode()) if len(d[1] or "") < 5000 else None))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score)
                  for r in rows), key=repr)
    want.sort(key=repr)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert any(w[1] for w in want)
    for g, w in zip(got, want):
        assert w[6] is None or g[6] == pytest.approx(w[6], rel=1e-4)


def test_lm_scores_of_a_parted_model_are_the_same(spark, documents):
    """A trie of more nodes than are sent to the tasks scores with all of them."""
    columns = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    whole, parted = (by_id(lm_scoring.score(documents, most=m).collect(), *columns) for m in (lm_scoring.MOST, 100))
    assert len(parted) == len(whole) == documents.count()
    for a, b in zip(parted, whole):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_lm_without_training_texts(spark, no_documents):
    assert lm_scoring.score(no_documents).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0) and row.score == pytest.approx(-4 * math.log10(256))


def test_chunks_and_words_of_slices():
    column = pa.array(["a b", None, "", " é\tx", "tail"])[1:]
    seen = []
    for lo, _, data, offs in _text.chunks(column, 4):
        s, e, r = _text.words(data, offs)
        seen += [(int(k) + lo, data[a:b].tobytes().decode()) for a, b, k in zip(s, e, r)]
    assert seen == [(2, "é"), (2, "x"), (3, "tail")]

"""Token alignment, token files and whitening against brute force, libraries and odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retentia.llm import _text, _tokens, embedding_whitening, token_alignment, token_files
from retentia.session import scratch_path
from tests.llm.conftest import SCHEMA

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "abAZ09 '\"|<>.,-\n\t\x00\x1c\x7fé\xd7\xc9\xa0\x85　 “中🎉 s t re d't 's 'LL 're<|endoftext|> ́"


def thue_morse(n, first="a"):
    return first if n == 0 else thue_morse(n - 1, first) + thue_morse(n - 1, "b" if first == "a" else "a")


def odd_texts(n=400, seed=5):
    rng = random.Random(seed)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return [*made, None, "", " ", "  ", "x  ", " x", "<|endoftext|>a1b22 c<|STARTOFTEXT|>", "don't I'LL ''s 'tis x'x", "a▁b",
            "x" * 9000, "no rhyme " * 3000, thue_morse(10), thue_morse(10, "b"), "ÀÉ× ÷ß École l'été"]


# -- shared helpers ------------------------------------------------------------------------------

def test_hashes_tell_thue_morse_words_apart():
    a, b = thue_morse(11), thue_morse(11, "b")
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    n = len(a)
    for h in (_text.RollingHash(data).spans(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])),
              _text.span_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))):
        assert h[0] == h[2] != h[1]


def test_rolling_hash_is_the_polynomial():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    p, base = 2**61 - 1, _text._BASE
    spans = [(0, 500), (3, 9), (17, 400), (5, 5)]
    got = _text.RollingHash(data).spans(*map(np.array, zip(*spans)))
    want = [sum((int(data[i]) + 1) * pow(base, i - s, p) for i in range(s, e)) % p for s, e in spans]
    want = np.array(want, np.uint64) + np.array([e - s for s, e in spans], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (got == _text.mix(want)).all()


def test_word_ids_equal_the_tokenizer():
    texts = [t or "" for t in odd_texts(1500, 6)]
    words, tok = _tokens.word_tokens(WORD), Tokenizer.from_file(WORD)
    for _ in range(2):                   # the second time from the cache
        ids = []
        for _, _, data, offs in _text.chunks(pa.array(texts)):
            flat, n = words.ids(data, offs)
            ids += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert ids == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_units_with_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(_text, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    words, tok = _tokens.WordTokens(_tokens.joined_encoder(Tokenizer.from_file(WORD)), _tokens.word_units), Tokenizer.from_file(WORD)
    for text in ("one two three", "four one", "three"):
        flat, _ = words.ids(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert flat.tolist() == tok.encode(text, add_special_tokens=False).ids


# -- op11 ----------------------------------------------------------------------------------------

def aligned_brute(texts):
    """Per text (a ids, b ids, groups text, links) or None."""
    a_tok, b_tok = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_tok.encode_special_tokens = True
    # the published byte alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ...
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False), b_tok.encode(t)
        x = [bytes(sign[c] for c in a_tok.id_to_token(i)) for i in a.ids]
        y = [bytes([int(b_tok.id_to_piece(i)[1:-1], 16)]) if b_tok.is_byte(i) else
             b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(x) == b"".join(y) == (" " + t).encode():
            out.append(None)
            continue
        ends = [np.cumsum([len(p) for p in side]) for side in (x, y)]
        owner = [np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in ends]      # token of every byte
        links = sorted(set(zip(owner[0].tolist(), owner[1].tolist())))
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        groups, at = [], (0, 0)
        for c in cuts:
            to = int(np.searchsorted(ends[0], c)) + 1, int(np.searchsorted(ends[1], c)) + 1
            groups.append(",".join(map(str, a.ids[at[0]:to[0]])) + "|" + ",".join(map(str, b[at[1]:to[1]])))
            at = to
        out.append((a.ids, b, groups, [(a.ids[i], b[j]) for i, j in links]))
    return out


def test_alignment_equals_brute_force(spark, corpus):
    texts = [*odd_texts(), *(d[1] for d in corpus)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumns(
        {"pair": F.lit(1), "chunk": F.lit("x"), "groups": F.lit(None).cast("string")})
    want = aligned_brute(texts)
    n_docs = collections.Counter(pair for w in want if w for pair in set(w[3]))
    most = collections.defaultdict(int)
    for (a, _), n in n_docs.items():
        most[a] = max(most[a], n)
    for hashed in (True, False):
        got = {r.doc_id: r for r in token_alignment.corpus_alignment(docs, BYTE, PIECE, hashed).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            g = got[i]
            if w is None:
                assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.n_best, g.count_sum, g.groups) == (0, 0, 0, 0, 0, 0, "")
                continue
            a, b, groups, links = w
            text = ";".join(groups)
            assert (g.n_a, g.n_b, g.n_groups, g.n_links) == (len(a), len(b), len(groups), len(links)), texts[i]
            assert g.groups == (hashlib.sha256(text.encode()).hexdigest() if hashed else text)
            assert g.count_sum == sum(n_docs[x] for x in links)
            assert g.n_best == sum(n_docs[x] == most[x[0]] for x in links)
    assert sum(w is None for w in want) >= 3


def test_aligned_groups_of_each_document(spark, documents):
    out = token_alignment.align(documents, BYTE, PIECE)
    assert out.columns == [*documents.columns, "a_ids", "b_ids", "a_ends", "b_ends"]
    seen = out.collect()
    assert len(seen) == documents.count()
    for r, w in zip(seen, aligned_brute([r.text for r in seen])):
        a, b, groups, _ = w or ([], [], [], [])
        assert (list(r.a_ids), list(r.b_ids)) == (a, b) and len(r.a_ends) == len(groups)
        cut = zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends)
        assert groups == [",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])) for i, j, k, m in cut]


def test_alignment_of_nothing(spark, no_documents):
    assert token_alignment.corpus_alignment(no_documents, BYTE, PIECE).count() == 0
    only = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert [(r.n_a, r.count_sum, r.groups) for r in token_alignment.corpus_alignment(only, BYTE, PIECE).collect()] == [(0, 0, "")] * 3


def test_gallop_finds_the_first_end_at_or_after():
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(1, 9, 3000))
    want = np.sort(rng.integers(1, ends[-1] + 1, 500))
    got = token_alignment.gallop(ends, want, np.zeros(500, np.int64), np.full(500, 3000))
    assert (got == np.searchsorted(ends, want)).all()


# -- op12 ----------------------------------------------------------------------------------------

def test_files_hold_the_ids_in_order(spark, corpus, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 1 << 17)      # several shards
    texts = [*(d[1] for d in corpus), *odd_texts(60), "no rhyme " * 50000]      # the last spans blocks
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(150)]) if i % 3 else 1000 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"ids": F.lit("x"), "start": F.lit(1)})
    path = scratch_path(spark, "t-files")
    token_files.write(docs, WORD, path)
    tok = Tokenizer.from_file(WORD)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):      # stable: equal ids keep their order
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    back = token_files.read(spark, path)
    got = [(r.doc_id, r.start, r.ids) for r in back.orderBy("start").collect()]
    assert got == [(w[0], w[1], w[4]) for w in want]
    assert [tuple(r) for r in token_files.digests(back).orderBy("start").collect()] == [w[:4] for w in want]
    assert [tuple(r) for r in token_files.read_digests(spark, path).orderBy("start").collect()] == [w[:4] for w in want]
    stream = spark.read.parquet(f"{path}/ids")
    assert stream.select("shard").distinct().count() > 2 and max(r.block for r in stream.collect()) > 0


@pytest.mark.parametrize("n_ids", [1, 31, 32, 33, 5000, 70000, 200001])
def test_blocks_decode_from_every_checkpoint(n_ids):
    rng = np.random.default_rng(n_ids)
    ids = (rng.zipf(1.3, n_ids) % 40000).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    table = token_files.Table.scaled(seen, counts)
    assert int(table.freq.sum()) == 1 << table.bits and (table.freq > 0).all()
    (raw,) = token_files.encode_blocks(ids[None], table)
    block = token_files.Payload(raw, table)
    n = -(-n_ids // token_files.SEGMENT)
    parts = token_files.decode_segments([(block, k) for k in range(n)], table)
    assert (np.concatenate(parts) == ids).all()
    (last,) = token_files.decode_segments([(block, n - 1)], table)       # alone, from its own checkpoint
    assert (last == parts[-1]).all()
    if n_ids >= 5000:
        damaged = bytearray(raw)
        damaged[-9] ^= 64
        with pytest.raises(ValueError):
            token_files.decode_segments([(token_files.Payload(bytes(damaged), table), n - 1)], table)
        entropy = -(counts / n_ids * np.log2(counts / n_ids)).sum() / 8
        assert len(raw) < n_ids * entropy * 1.2 + 2000


def test_files_of_nothing_and_of_other_tables(spark, no_documents):
    path = scratch_path(spark, "t-files")
    token_files.write(no_documents, WORD, path)
    assert token_files.read(spark, path).count() == 0 and token_files.read_digests(spark, path).count() == 0
    one = token_files.Table(np.array([1]), np.array([4096]))
    other = token_files.Table(np.array([2]), np.array([4096]))
    (raw,) = token_files.encode_blocks(np.ones((1, 10), np.uint32), one)
    for bad in (raw[:20], b"XXXX" + raw[4:]):
        with pytest.raises(ValueError):
            token_files.Payload(bad, one)
    with pytest.raises(ValueError):
        token_files.Payload(raw, other)


# -- op13 ----------------------------------------------------------------------------------------

def matrices():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 5, 17, 64):
        b = rng.normal(size=(2 * d, d))
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        yield b.T @ b
        yield np.eye(d) * 3
        yield np.diag(np.r_[np.ones(d - d // 2), np.zeros(d // 2)])
        yield np.outer(b[0], b[0]) * 1e8
        yield (q * (5 + 1e-9 * rng.random(d))) @ q.T
        yield (q * np.r_[[5.0] * min(3, d), rng.random(max(0, d - 3))]) @ q.T


def test_leading_components_of_any_symmetric_matrix():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = embedding_whitening.leading_components(a, 4)
        scale = max(np.abs(a).max(), 1e-300)
        want = np.linalg.eigvalsh(a)[::-1][:4]
        assert np.abs(values - want).max() < 1e-12 * scale * len(a)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale * len(a)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        diag, off, q = embedding_whitening.tridiagonal(a)
        t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
        assert np.abs(q @ t @ q.T - a).max() < 1e-12 * scale * len(a)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(2, 0.2, 12) + 1
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[8][1]), (7, rows[7][1])]      # copies are fitted once
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * 12), (2003, [None] + [1.0] * 11), (2004, [float("-inf")] * 12),
           (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns(
        {"n": F.lit("x"), "component": F.lit("y")}).repartition(4)
    got = embedding_whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = collections.Counter((r.vec_id, r.component) for r in got.collect())
    assert out == collections.Counter((i, c) for i, _ in rows for c in (1, 2, 3, 4))
    x = np.floor(256 * np.array([np.array(v, np.float32).astype(float) for _, v in rows])).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    centred = u - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4])
    by_id = {i: k for k, (i, _) in enumerate(rows)}
    sign = {}
    for r in sorted(got.collect(), key=lambda r: r.component):
        k, c = by_id[r.vec_id], r.component - 1
        sign.setdefault(c, np.sign(r.whitened * white[k, c]))
        assert r.n == n and r.deviation == int(((n * x[k] - s) ** 2).sum())
        assert abs(r.whitened - sign[c] * white[k, c]) < 1e-9
        assert abs(r.explained - values[c] / values.sum()) < 1e-12 and r.identity_error < 1e-9


def test_whitening_of_few_and_flat_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_whitening.whiten(none).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    out = embedding_whitening.whiten(same).collect()
    assert len(out) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    out = embedding_whitening.whiten(line).collect()
    assert {r.component for r in out if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in out)


def test_whitening_of_huge_entries(spark):
    big = spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 5.0])], "vec_id long, embedding array<float>")
    out = embedding_whitening.whiten(big).collect()
    assert len(out) == 6 and all(r.deviation is None for r in out if r.vec_id != 2)

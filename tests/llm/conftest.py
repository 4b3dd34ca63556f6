import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def roots(n, links):
    """Least index reachable from each index."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _thue_morse(n, first="a"):
    """Words that polynomial hashes modulo a power of two do not tell from their complement."""
    return first if n == 0 else _thue_morse(n - 1, first) + _thue_morse(n - 1, "b" if first == "a" else "a")


ODD = [
    (1001, None, "en", "s", 0), (1002, "", "en", "s", 0), (1003, "  \t\n ", None, None, None),
    (1004, "one two three", "en", "s", 13), (1005, "one two three", "en", "s", 13), (1006, "One  two\nTHREE", "xx", "s", 1),
    (1007, "no rhyme " * 4000, "en", "s", None), (1008, "é中🎉 ß\u2581x <|endoftext|> \x00 end", "fr", "s", 1),
    (1009, "same line\nsame line\n same line\nother", "en", "s", 1), (None, "an id is missing here", "en", "s", 2),
    (None, None, None, None, None), (1010, "x" * 30000, "de", "s", 1),
    (1011, _thue_morse(10), "en", "s", 1), (1012, _thue_morse(10, "b"), "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """About 160 documents: odd ones, random ones, exact copies, near copies, a shared passage, repeated rows."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(90)
    docs = [(i, text(rng.randrange(5, 160)).capitalize() + ".", rng.choice(["en", "fr"]), "s", 1) for i in range(80)]
    base = text(120).split()
    for i in range(80, 110):
        near = list(base)
        for _ in range(rng.randrange(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        docs.append((i, " ".join(near), "en", "s", 1))
    docs += [(i, text(30) + "\n" + passage + "\n" + text(20), "en", "s", 1) for i in range(110, 125)]
    docs += [(i, docs[3][1], "en", "s", 1) for i in range(125, 140)]
    docs += [docs[5], docs[5]]
    return docs + ODD


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names clash with outputs and helpers."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3, "doc_id")
    return df.withColumns({"score": F.lit("x"), "ids": F.lit(1), "block": F.lit(2), "component": F.lit(3),
                           "length": F.lit(4), "kept": F.lit("no"), "_salt": F.lit(5)})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

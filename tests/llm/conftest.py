import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, bucket int"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return ws


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, junk, nulls, empties, repeats and a long one."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(30, 160)) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(base[i % 5]) for i in range(12)]
    texts += [" ".join(edited(rng, base[i % 6], rng.randrange(1, 9))) for i in range(50)]
    texts += [" ".join(words(rng, 20) + base[7][5:60] + words(rng, 15)) for _ in range(10)]
    texts += ["  " + texts[0].replace(" ", "\n"), texts[1].upper(), "a b c", "a b c", "one", "", " \n ", None, None]
    texts += ["Write to Joe.a@mail1.example.com or +49 (30) 123-4567\n10.0.0.1 4539 1488 0343 6467 \U0001f600 end", "x@y.z@a.b-c.d +1 2 999.1.1.1 1.2.3.4.5"]
    texts += ["spam spam spam ham " * 200, " ".join(words(rng, 6000)), "naïve Ünïcode\tßtraße\x0bfoo\x0cbar\rbaz " * 9]
    return [(i, t, "en", None if i % 17 == 3 else f"s{i % 4 if i % 3 else 0}", len(t or ""), "x", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows, ties."""
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(None, long), (None, long), (1, long), (1, long), (2, long + " tail"), (3, None), (3, None), (None, None), (4, "")]
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)

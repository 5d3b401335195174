import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, id long, score double, th int, key string, word string"


def extra(i):
    return ("en", None if i % 5 == 0 else f"s{i % 3}", None, "x", 7, 0.5, 1, "k", "w")


@pytest.fixture(scope="session")
def texts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 3 + i % 6)) for i in range(400)]
    make = lambda n: " ".join(rng.choice(words, n))
    base, shared = make(120), make(60)
    near = base.split()
    near[50] = "changed"
    long = make(20_000)
    out = [(0, base), (1, " ".join(near)), (2, base), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, make(4)), (8, make(4).upper()), (9, long), (10, long[: len(long) // 2]), (11, "aé漢🎌 " * 100), (12, make(50) + " " + shared), (13, shared + " " + make(40)), (14, "a" * 500), (15, "ONE")]
    out += [(i, make(30 + i)) for i in range(16, 40)]
    out += [(40, base), (40, base), (40, make(80)), (None, make(70)), (None, base), (None, None)]
    return out


@pytest.fixture(scope="session")
def nasty(spark, texts):
    """Null, empty and long texts, repeated rows and ids, null ids, and columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, *extra(k)) for k, (i, t) in enumerate(texts)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2, "x") for i in range(45)] + [(None, 1, 1, "x"), (3, None, None, "x"), (5, 7, 9, "x")], "doc_id long, quality int, toxic int, text string")

import random

import pytest

WORDS = "the of and a to in house river stone bright walk under cloud table paper seven green quick lamp forest engine copper violet marble".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, repeated, near-copied and very long texts."""
    base = prose(1, 120)
    near = base.replace("house", "home", 1)
    lines = "\n".join(prose(k, 30) for k in range(5, 9))
    return [None, "", " \n\t ", "word", "Two words", base, base, near, base.upper(), lines, lines.split("\n")[1], prose(2, 80), "x" * 5000, prose(3, 3000), "ünï çødé 漢字   z", "a b c d e f", "A  b\tC d\ne f", "!!! ### ???", prose(4, 200) + "\n" + base]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts under ids with gaps, one repeated row, one id with two texts, and columns whose names could clash."""
    rows = [(10 * i + i % 3, t, "en", "s", 1, 2, 3.0, "k", 5, 6) for i, t in enumerate(texts)]
    rows += [rows[5], (rows[11][0], "another text under the same id, of some length", *rows[11][2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, part int, rank double, key string, row long, length long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, hits string, row string, key string, batch string, n_words string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and other columns with names that operators use."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    near = [*base[:60], "other", *base[61:]]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    texts = [" ".join(base), " ".join(near), None, "", " \n\t ", "one", "A b\nA b\nÄ c", " ".join(base), long, long + " more", "x " * 300, " ".join(base[10:90]), "É #|& " * 9]
    rows = [(i, t, "en", "s1" if i % 3 else None, 1, "a", "b", "c", "d", "e", "f", "g") for i, t in enumerate(texts)]
    rows += [rows[0], rows[2], (None, " ".join(base), None, None, None, *["z"] * 7), (None, None, None, None, None, *[None] * 7), (3, "another text of the same id", "de", "s2", 5, *["z"] * 7)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

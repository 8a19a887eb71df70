import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, node int, sig string, bucket int, entry int, score string, t int, slice int, label string"
EXTRA = ("x", 1, "s", 2, 3, "0.5", 4, 5, "l")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, very short and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Überfluß", "ñandú", "日本"]) + str(rng.randrange(50)) for _ in range(30_000))
    texts = [None, "", " ", "\n\n", "one", "two words", "a" * 60_000, long, long, "1234567890123456", "😀 é", "\x00\x1c", "same text here for all", "same text here for all"]
    rows = [(i if i != 5 else None, t, None if i % 3 == 0 else "en", None, None, *(EXTRA if i % 2 else (None,) * 9)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], rows[0]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

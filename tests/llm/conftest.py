import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use for themselves.
CLASH = ["rid", "_rid", "key", "fp", "root", "size", "_score", "score", "_sha", "_n", "_h", "ref", "slot", "h", "copies", "_kept", "_at", "_drop", "_spans", "_row", "_taken", "_times", "drop"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base, long = words(rng, 80), words(rng, 60_000)
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),  # a repeated row
        (2, base + " ", "en", "b", None),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\x0c\r", "en", "c", 6),
        (6, long, "en", "a", len(long)),
        (7, long.replace(" ", "\n"), "en", None, len(long)),
        (8, "é  ß　漢字 😀 \u0000 x", "fr", "b", 12),
        (None, base, "en", "a", 1),  # no id
        (None, words(rng, 30), "en", "d", 1),
        (9, "word", "en", "a", 4),
        (10, "Two words", "en", "a", 9),
    ]
    return rows + [(100 + i, words(rng, rng.randint(1, 60)) + "\n" + words(rng, 10), "en", "abc"[i % 3], None) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with every extra column that an operator might stumble on."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

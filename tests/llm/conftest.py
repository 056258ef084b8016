"""Small tables with the cases that every operator must survive."""

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# Names that operators use inside.
CLASHES = ("row", "node", "size", "id", "doc", "score", "component", "name", "word", "n", "place", "target", "at", "part")
SF = "/root/testdata/sf0.001"


def words(rng: random.Random, count: int) -> str:
    """Invented prose."""
    parts = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(count)]
    return " ".join(parts)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table like `documents` from rows of (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, one long word, special characters."""
    rng = random.Random(4)
    prose = [words(rng, rng.randint(1, 60)) for _ in range(12)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(prose)]
    rows += [(20, prose[0], "s1"), (21, "  " + prose[0] + "\n", "s1"), (3, prose[3], "s0"), (3, prose[3], "s0")]
    rows += [(30, None, "s1"), (31, "", "s1"), (32, " \t\n\x0b\x0c\r ", "s2"), (None, prose[5], None), (None, None, None)]
    rows += [(40, words(rng, 30_000), "s2"), (41, "x" * 50_000, "s2"), (42, "AİΣ 中文 \U0001f600́  x", None)]
    return rows


@pytest.fixture(scope="session")
def odd(documents, odd_rows):
    """The odd rows as documents with columns whose names clash."""
    frame = documents(odd_rows)
    for name in CLASHES:
        frame = frame.withColumn(name, frame["lang"])
    return frame


@pytest.fixture(scope="session")
def nothing(documents):
    """No documents."""
    return documents([])

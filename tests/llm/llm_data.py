from __future__ import annotations

import random

import pytest

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def words(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


EDGE_TEXTS = [(9090, None), (9091, ""), (9092, " \n\t "), (9093, "one"), (9094, "one two three four"), (None, prose(7, 40)), (9095, "é\u2003x \x1cy")]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)

    return make

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "straße", "o'clock", "x9", "MIXED", "end."]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = ["", None, " ", "\n\n", "one", "one two", "One TWO three four five", "One  TWO\nthree four five", long, long, long + " tail", "a" * 5000, "tab\tand\xa0space", "привет мир", "<|endoftext|> 12 34", "é" * 70 + " \x01\x00 z"]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)] + [(3, "\n\n", 0), (4, "one", 1), (4, "one", 1), (None, "no id here at all", None), (None, None, None)]
    schema = "doc_id long, text string, row int"
    df = spark.createDataFrame(rows, schema)
    for name in ("key", "fp", "h", "n", "ids", "recipe", "component_id", "base", "lang"):
        df = df.selectExpr("*", f"cast(null as string) as {name}")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def rows(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")

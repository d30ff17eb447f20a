import random

import pytest


def prose(rng: random.Random, n: int, words: int = 3000) -> list[str]:
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and blank texts, a very long text, ties, repeated rows and a column that clashes with results."""
    rng = random.Random(5)
    long = " ".join(prose(rng, 20_000))
    some = " ".join(prose(rng, 60))
    return [
        (1, some, "x"), (2, some, None), (2, some, None), (3, None, "x"), (4, "", "x"), (5, " \n\t ", "x"),
        (6, long, "x"), (None, some, "x"), (None, None, None), (7, "one", "x"), (8, "one two", "x"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows; the extra columns have names that operators use inside."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, score string")
    for name in ("key", "mark", "words", "row", "component_id", "n_words", "host"):
        df = df.withColumn(name, df["score"])
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")

import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeats and ties, columns whose names clash with the operators' own."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(50)]
    long = " ".join(rng.choice(words) for _ in range(9000))
    rows = [
        (1, "plain text here", "en", "s", 15), (2, None, "en", None, None), (3, "", None, "s", 0), (4, long, "en", "s", len(long)), (5, long, "en", "s", len(long)),
        (6, "plain text here", "en", "s", 15), (7, " \n\t ", "de", "s", 4), (8, "1234 5678 !!", "de", "s", 12), (9, "é" * 300, "fr", "s", 300), (10, "x" * 5000, "fr", "s", 5000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "'clash' as score", "1 as component_id", "'t' as spans", "2 as kind", "'w' as word", "3 as fp", "'h' as value")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

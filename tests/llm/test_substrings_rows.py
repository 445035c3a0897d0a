"""Substring removal where ids are null or repeated."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import substrings

from .test_pairs import removed


@pytest.mark.parametrize("heavy", [2, 2000])
def test_null_and_repeated_ids(spark, heavy, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [own(60) for _ in range(4)]
    texts = [own(rng.randrange(0, 60)) + rng.choice(shared)[rng.randrange(0, 90) :] + own(rng.randrange(0, 90)) for _ in range(40)]
    ids = [None] * 12 + [5] * 8 + list(range(10, 30))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([*rows, rows[0], rows[14]], "doc_id long, text string")
    keys = df.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(substrings.NOBODY)), "text")).collect()
    order = sorted({(-1 if r.doc_id is None else r.doc_id, r.row, r.text) for r in keys})
    brute = removed([(i, t) for i, (_, _, t) in enumerate(order)])
    want = sorted((d, *brute[i]) for i, (d, _, _) in enumerate(order))
    got = substrings.deduplicated(df).select(
        F.coalesce("doc_id", F.lit(-1)), "n_bytes", (F.col("n_bytes") - F.length("kept")), F.size("spans"), F.sha2("kept", 256)
    )
    got = sorted(tuple(r) for r in got.collect())
    assert len(got) == 42 and sorted(set(got)) == want

"""Near-duplicate classes, top-k search and substring removal against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termloom.llm import common, simhash, substrings, topk

from .conftest import SF


def classes(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fps)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(fps))}


def test_fingerprint_by_hand():
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d")]
    expected = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 2)
    assert simhash.fingerprint("A b\tC\nd") == expected
    assert simhash.fingerprint("É b") == xxhash.xxh64_intdigest("É b".encode(), 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_classes_on_documents(spark):
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, SF).collect()}
    ids = sorted(got)
    assert {i: got[i].component_id for i in ids} == classes(ids, [int(got[i].fingerprint, 16) for i in ids])


@pytest.mark.parametrize("heavy", [3, 500])
def test_links_keep_classes(spark, heavy):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for c in centres for _ in range(60)} | {0, 7, (1 << 64) - 1})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df, heavy)
    found = {r.node: r.root for r in common.components(edges).collect()}
    ids = [int(np.uint64(f).view(np.int64)) for f in fps]
    expected = classes(ids, fps)
    assert {i: found.get(i, i) for i in ids} == expected


def test_flipping_finds_the_same_forest():
    rng = random.Random(6)
    base = rng.getrandbits(40) << 24
    fps = np.array(sorted({base | rng.getrandbits(12) for _ in range(200)}), np.uint64)
    for edges in (simhash.forest(fps), simhash._forest_by_flips(fps)):
        assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in edges)
    assert len(simhash.forest(fps)) == len(simhash._forest_by_flips(fps))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_simhash_odd_inputs(odd_docs, no_docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert got[6] == 1 and got[5] == 4 and got[3] == got[7] == got[2] == 2
    assert simhash.near_duplicates(no_docs).collect() == []


def test_top_k_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.sql(topk.ORACLES["op5_topk"]).fetchall())
    assert sorted(tuple(r) for r in topk.op5_topk(spark, SF).collect()) == want


@pytest.mark.parametrize("scale", [0.3, 40.0, 3e7])
def test_top_k_blocks_and_ties(spark, scale, monkeypatch):
    rng = random.Random(3)
    vectors = [[round(rng.uniform(-scale, scale), 1) for _ in range(5)] for _ in range(40)]
    rows = [(i, vectors[i % 40]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as block", "3 as id")
    data = topk.quantised(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(data, data.where("id % 20 = 0"), 5, rows_in_block=33).collect())
    x = {i: np.floor(np.array(v) * 256).astype(np.int64) for i, v in rows if i < 200}
    x[204] = np.zeros(5, np.int64)
    want = []
    for q in [i for i in x if i % 20 == 0]:
        best = sorted(((-int(x[q] @ x[i]), i) for i in x if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    data = topk.quantised(df, "vec_id", "embedding")
    assert sorted(tuple(r) for r in topk.top_k(data, data).collect()) == [(0, 1, 50, 512 * 256), (50, 1, 0, 512 * 256)]
    assert topk.top_k(data.limit(0), data.limit(0)).collect() == []


def removed(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def digest(df):
    found = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("r"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h"))
    return {r.doc_id: tuple(r)[1:] for r in found.collect()}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    shared = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))]
        if rng.random() < 0.6:
            a = rng.randrange(0, 60)
            parts += [rng.choice(shared)[a : a + rng.randrange(80, 200)], " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))]
        if rng.random() < 0.2:
            parts.append("as " * rng.randrange(10, 100))
        rows.append((i * 7 % 1000, rng.choice([" ", "\n", ""]).join(parts)))
    return [*rows, (2001, None), (2002, ""), (2003, "a" * 99), (2004, rows[3][1]), (2005, rows[3][1] + "tail"), (2006, "x" * 300)]


@pytest.mark.parametrize("heavy", [2, 2000])
def test_substrings(spark, passages, heavy, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    assert digest(substrings.deduplicated(spark.createDataFrame(passages, "doc_id long, text string"))) == removed(passages)


def test_substrings_odd_inputs(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert digest(substrings.deduplicated(odd_docs)) == removed(rows)
    assert substrings.deduplicated(no_docs).collect() == []


def test_shards_agree_with_spark(spark):
    ids = [0, 1, -5, 1 << 60, -(1 << 63)]
    df = spark.createDataFrame([(i,) for i in ids], "d long").select("d", F.pmod(F.xxhash64("d"), F.lit(97)).alias("s"))
    assert {r.d: r.s for r in df.collect()} == dict(zip(ids, substrings.shard_of(np.array(ids), 97).tolist()))

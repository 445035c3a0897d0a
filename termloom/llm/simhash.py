"""SimHash near-duplicate classes.

Byte-position inverted index with count filtering. Two 64-bit fingerprints that
differ in at most three bits agree in at least five of their eight bytes. Every
five positions hold three within one half, so the index posts each distinct
fingerprint under the four byte triples of either half (eight postings) and
loses no pair. A posting list longer than ``heavy`` is posted anew under two
further positions, ten ways: the list then fixes five bytes and holds at most
2^24 fingerprints whatever the corpus. In a list shared positional bytes are
tallied per pair, pairs below five are dropped, the rest are verified on bits.
Lists return a spanning forest, not their pairs.

Defined cases: null, empty and blank texts have no word and the fingerprint
zero, linked like any other; fewer words than a shingle are one shingle; equal
fingerprints are one node, so copies never multiply pairs; every row is returned,
repeated ids too, and a null id names a component only where it has no other; an
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, sliced, table, written

BITS, NEAR, LEAST = 64, 3, 5
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority vote of XXH64 (seed 42) over word shingles, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < words:
        each = [h(b" ".join(w), 42)]
    else:
        each = [h(b" ".join(t), 42) for t in zip(*(w[i:] for i in range(words)))]
    return majority(np.array(each, np.uint64))


def majority(each: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(each), 65536):
        block = each[at : at + 65536].astype(">u8")
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(each)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp``; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def posting(fps: np.ndarray, positions) -> np.ndarray:
    """Keys of posting lists of signed fingerprints: which positions, and the bytes there."""
    u = fps.view(np.uint64)
    key = np.full(len(u), sum(1 << k for k in positions), np.uint64)
    for k in positions:
        key = (key << np.uint64(8)) | ((u >> np.uint64(56 - 8 * k)) & np.uint64(255))
    return key.view(np.int64)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of 'differ in at most three bits' among distinct uint64."""
    m = len(fps)
    if m < 2:
        return []
    if m > 5000:
        return _forest_by_flips(fps)
    as_bytes = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
    left, edges, queue = np.arange(m), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        u = queue.pop()
        shared = (as_bytes[left] == as_bytes[u]).sum(axis=1)
        some = np.flatnonzero(shared >= LEAST)
        near = some[np.bitwise_count(fps[left[some]] ^ fps[u]) <= NEAR]
        if len(near):
            found = left[near]
            edges += [(u, int(v)) for v in found]
            queue += found.tolist()
            left = np.delete(left, near)
    return edges


def _forest_by_flips(fps: np.ndarray) -> list[tuple[int, int]]:
    """The same for long lists: look flipped values up, so the work stays linear."""
    order = np.argsort(fps)
    fps_sorted = fps[order]
    free = [b for b in range(64) if len(np.unique((fps_sorted >> np.uint64(b)) & np.uint64(1))) > 1]
    masks = np.array([sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(free, n)], np.uint64)
    label = np.arange(len(fps))
    edges: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return int(x)

    for mask in masks:
        want = fps_sorted ^ mask
        at = np.searchsorted(fps_sorted, want)
        at[at == len(fps_sorted)] = 0
        hit = np.flatnonzero((fps_sorted[at] == want) & (at > np.arange(len(at))))
        for x in hit.tolist():
            a, b = root(x), root(int(at[x]))
            if a != b:
                label[max(a, b)] = min(a, b)
                edges.append((int(order[x]), int(order[at[x]])))
    return edges


def _lists_to_links(posted: DataFrame) -> DataFrame:
    """posted: key, fp. One forest for each posting list."""

    def run(batches):
        keys, fps = [], []
        for batch in batches:
            keys.append(batch.column("key").to_numpy(zero_copy_only=False))
            fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
        if not keys:
            return
        key, fp = np.concatenate(keys), np.concatenate(fps).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order].view(np.uint64)
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            part = fp[s:e]
            for u, v in forest(part):
                a.append(int(part[u]))
                b.append(int(part[v]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    n = partitions(posted.sparkSession)
    return posted.repartition(n, "key").mapInArrow(run, "a long, b long")


def links(distinct_fps: DataFrame, heavy: int = 500) -> DataFrame:
    """``a, b``: links that connect exactly the near fingerprints of column fp."""

    def post(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for t, positions in enumerate(TRIPLES):
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(posting(fp, positions)), pa.array(np.full(len(fp), t))], ["fp", "key", "t"])

    def refine(batches):
        for batch in batches:
            fp, key, t, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "t", "n"))
            fps, keys = [fp[n <= heavy]], [key[n <= heavy]]
            for i in np.unique(t[n > heavy]).tolist():
                own = np.ascontiguousarray(fp[(n > heavy) & (t == i)])
                for pair in combinations([k for k in range(8) if k not in TRIPLES[i]], 2):
                    fps.append(own)
                    keys.append(posting(own, (*TRIPLES[i], *pair)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(keys))], ["fp", "key"])

    posted = distinct_fps.select("fp").mapInArrow(post, "fp long, key long, t long")
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return _lists_to_links(posted.join(counts, "key").select("fp", "key", "t", "n").mapInArrow(refine, "fp long, key long"))


def near_duplicates(docs: DataFrame, words: int = 3, heavy: int = 500) -> DataFrame:
    """``doc_id, fp, component_id`` for every document."""
    each = written(fingerprints(docs, words), "fps")
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), heavy))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = written(named.join(low, "root").select("fp", "component_id"), "names")
    return each.join(names, "fp", "left").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}

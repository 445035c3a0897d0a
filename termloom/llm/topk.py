"""Exact top-k inner-product search over a bit-sliced index.

Rows are packed in blocks. In a block every component is stored as bitmaps, one
for each of its most significant bits (offset by the block's least value, so
bits are unsigned). A query adds the slices with bitmap arithmetic: a carry
chain over bitmaps, all queries of a query block at once, a component with a
negative weight entering by its complement. The result is a bit-sliced lower
bound of every row's score. Going from the most significant slice downward
finds the k-th bound; rows that the dropped low bits could still lift over it
are the boundary rows, and their scores are computed exactly.

Queries are broadcast in batches of ``BATCH`` bytes at most, one alive at a time:
each batch scans the stored index once, and a task keeps a running top k of its
index blocks, so neither the broadcast nor what is shuffled (k rows a query and
task) grows with the table. Rows are dealt to blocks by their place, so rows that
share an id or a value never pile up in one block.

Defined cases: vectors that are null or hold a null, NaN or infinite component
take no part, neither as query nor as candidate; shorter vectors count as
padded with zeros; equal scores go to the smaller id; fewer candidates than k
give fewer rows; of rows that share an id all are candidates for other ids, and
the first by value is the query; an empty table gives no row. Scores are longs:
sums that a long cannot hold wrap around, and where they may, all rows of a block
are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, written

#: Rows of an index block and of a query block; bits of a component that are sliced; bytes of a batch of queries.
ROWS, QUERIES_IN_BLOCK, SLICES, BATCH = 8192, 256, 8, 32 << 20
WORD = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(df: DataFrame, id_col: str, vector_col: str, factor: float = 256.0) -> DataFrame:
    """``id, v``: rows that take part, components as floor(factor * x)."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(~bad).select("id", F.transform("v", lambda x: F.floor(x * F.lit(factor)).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (n, ...) along the first axis -> bitmaps of 64-bit words (..., words)."""
    flat = np.moveaxis(bits, 0, -1)
    pad = -flat.shape[-1] % 64
    flat = np.pad(flat, [(0, 0)] * (flat.ndim - 1) + [(0, pad)])
    return np.ascontiguousarray(np.packbits(flat, axis=-1, bitorder="little")).view("<u8")


def index_blocks(rows: DataFrame, width: int, blocks: int) -> DataFrame:
    """One row for each block: ids, exact values, and the slices (of values less the block's least)."""

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        m = _matrix(group.column("v"), width)
        order = np.lexsort((*m.T[::-1], ids)) if width else np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        low = m.min(axis=0) if width else np.zeros(0, np.int64)
        span = (m.max(axis=0) - low) if width else low
        bits = np.array([int(s).bit_length() for s in span], np.int64)
        shift = np.maximum(bits - SLICES, 0)
        top = (m - low) >> shift
        slices = np.stack([_pack((top >> b) & 1 == 1) for b in range(SLICES)]) if width else np.zeros((SLICES, 0, 0), np.uint64)
        blob = [x.tobytes() for x in (ids, m, bits, shift, slices)]
        return pa.table({"block": group.column("block")[:1], "n": pa.array([len(ids)], pa.int64()), **{k: pa.array([b], pa.binary()) for k, b in zip(("ids", "m", "bits", "shift", "slices"), blob)}})

    schema = "block long, n long, ids binary, m binary, bits binary, shift binary, slices binary"
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))  # rows are a written table: places do not change
    n = max(partitions(rows.sparkSession), -(-blocks // 8))
    return rows.withColumn("block", spread).repartition(n, "block").groupBy("block").applyInArrow(build, schema)


def _add(acc: list[np.ndarray], part: np.ndarray, at: int) -> None:
    """acc += part << at, both bit-sliced; part: (slices, 1 or queries, words)."""
    carry = None
    i = at
    for s in part:
        while len(acc) <= i:
            acc.append(np.zeros_like(acc[0]))
        a = acc[i]
        half = a ^ s
        out = a & s
        if carry is not None:
            out |= half & carry
            half ^= carry
        acc[i], carry = half, out
        i += 1
    while carry is not None and carry.any():
        if len(acc) <= i:
            acc.append(carry)
            return
        acc[i], carry = acc[i] ^ carry, acc[i] & carry
        i += 1


def bounds(slices: np.ndarray, bits: np.ndarray, shift: np.ndarray, weights: np.ndarray, words: int, valid: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit-sliced sums of |w| times the (complemented) sliced components, and how much the dropped bits can add."""
    nq = len(weights)
    acc = [np.zeros((nq, words), np.uint64)]
    size = np.abs(weights)
    for d in np.flatnonzero(bits > 0):
        have = min(int(bits[d]), SLICES)
        flip = np.where(weights[:, d] < 0, WORD, np.uint64(0))[:, None]
        part = (slices[:have, d][:, None, :] ^ flip[None]) & valid
        for j in range(int(size[:, d].max()).bit_length()):
            on = np.where((size[:, d] >> j) & 1 == 1, WORD, np.uint64(0))[:, None]
            if on.any():
                _add(acc, part & on[None], j + int(shift[d]))
    return acc, size.astype(object) @ np.array([(1 << s) - 1 for s in shift.tolist()], object)


def at_least(acc: list[np.ndarray], k: np.ndarray, slack: np.ndarray, valid: np.ndarray, n: int) -> np.ndarray:
    """Bitmap of rows whose sum is within slack of the k-th largest, slice by slice from the top."""
    nq = acc[0].shape[0]
    sure = np.zeros_like(acc[0])
    tied = np.broadcast_to(valid, acc[0].shape).copy()
    kth = [0] * nq
    want = np.minimum(k, n)
    for i in range(len(acc) - 1, -1, -1):
        on = tied & acc[i]
        count = np.bitwise_count(sure | on).sum(axis=1)
        full = (count >= want)[:, None]
        sure = np.where(full, sure, sure | on)
        tied = np.where(full, on, tied & ~acc[i])
        for q in np.flatnonzero(full[:, 0]):
            kth[q] |= 1 << i
    floor = [max(0, t - int(s)) for t, s in zip(kth, slack)]
    above, same = np.zeros_like(acc[0]), np.broadcast_to(valid, acc[0].shape).copy()
    for i in range(len(acc) - 1, -1, -1):
        one = np.array([WORD if f >> i & 1 else 0 for f in floor], np.uint64)[:, None]
        above |= same & acc[i] & ~one
        same &= ~(acc[i] ^ one)
    return above | same


def cell(row: dict, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids and scores of some queries in an index block, at most k for each query."""
    width = q.shape[1]
    n = row["n"]
    ids = np.frombuffer(row["ids"], np.int64)
    m = np.frombuffer(row["m"], np.int64).reshape(n, width)
    bits, shift = (np.frombuffer(row[c], np.int64) for c in ("bits", "shift"))
    words = -(-n // 64)
    valid = _pack(np.ones(n, bool))
    slices = np.frombuffer(row["slices"], np.uint64).reshape(SLICES, width, words) if width else np.zeros((SLICES, 0, words), np.uint64)
    repeats = int(np.unique(ids, return_counts=True)[1].max())  # a query's own rows may stand before the k-th
    # the complement of an offset x is 2^bits - 1 - x: every row moves by one constant, so the order holds
    most = np.abs(q).astype(object) @ np.abs(m).max(axis=0, initial=0).astype(object)
    if most.size and max(most) >= 1 << 63:
        near = np.broadcast_to(valid, (len(qids), words))  # products may wrap around: only they tell
    else:
        acc, slack = bounds(slices, bits, shift, q, words, valid)
        near = at_least(acc, np.full(len(qids), k + repeats), slack, valid, n)
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(len(qids)):
        rows = np.flatnonzero(np.unpackbits(np.ascontiguousarray(near[i]).view(np.uint8), bitorder="little", count=n))
        rows = rows[ids[rows] != qids[i]]
        score = m[rows] @ q[i]
        best = np.lexsort((ids[rows], -score))[:k]
        out[0].append(np.full(len(best), qids[i]))
        out[1].append(ids[rows][best])
        out[2].append(score[best])
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, rows_in_block: int = ROWS, batch_bytes: int = BATCH) -> DataFrame:
    """``query_id, rank, vec_id, score`` of quantised ``id, v`` frames."""
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    facts = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(facts[1] or 0, (queries.agg(F.max(F.size("v"))).first()[0]) or 0)
    nb = max(1, -(-facts[0] // rows_in_block))
    index = written(index_blocks(rows, width, nb), "index").select("n", "ids", "m", "bits", "shift", "slices")
    n = max(1, -(-queries.count() * (8 * width + 16) // batch_bytes))
    asked = written(queries.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n))).repartition(n, "batch"), "asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for i in range(n):
        own = asked.where(F.col("batch") == i).select("id", "v").toArrow().sort_by("id")
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own.column("v"), width)))
        scored = index.mapInArrow(_searcher(shared, k), "query_id long, vec_id long, score long")
        one = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n > 1:  # the batch's results are kept, its queries are not
            one = written(one, "batch")
            shared.unpersist()
        found = one if found is None else found.unionByName(one)
    return found  # type: ignore[return-value]


def _searcher(shared, k: int):
    """Running top k of a task's index blocks."""

    def run(batches):
        qids, q = shared.value
        best: pd.DataFrame | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                for at in range(0, len(qids), QUERIES_IN_BLOCK):
                    new = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cell(row, qids[at : at + QUERIES_IN_BLOCK], q[at : at + QUERIES_IN_BLOCK], k))))
                    best = new if best is None else pd.concat([best, new])
                    if len(best) > max(200_000, 4 * k * len(qids)):
                        best = _kept(best, k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_pandas(_kept(best, k), preserve_index=False)

    return run


def _kept(best: pd.DataFrame, k: int) -> pd.DataFrame:
    best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return best.groupby("query_id", sort=False).head(k).reset_index(drop=True)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where("id % 50 = 0"), k=5)


QUERIES = {"op5_topk": op5_topk}
ORACLES = {
    "op5_topk": """
with v as (
  select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where embedding is not null and vec_id is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(coalesce(list_sum([a.x * a.y for a in [{'x': q.e[i], 'y': c.e[i]} for i in range(1, len(q.e) + 1)]]), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from s)
select query_id, cast(rn as integer) as rank, vec_id, score from r where rn <= 5
"""
}

"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session that names none (tests, a laptop) gets a local one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back. The driver's end removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches, rows: int = 512):
    """Arrow batches cut to a few hundred rows, so what Python makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as text, the fold function of all held-out splits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int):
    """Whether a row is held out; a null id never is."""
    return F.coalesce(id_crc() % modulus == remainder, F.lit(False)).alias("held_out")


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps, until nothing changes.

    ``edges`` has long columns ``a`` and ``b``; returns ``node, root`` (root:
    the smallest node of the component) for every node that has an edge. Hubs
    are never gathered into one task: a star is a partial minimum and a join
    that adaptive execution can split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        # small-star: the larger end keeps its least neighbour, the others are hung on it
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(hung.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

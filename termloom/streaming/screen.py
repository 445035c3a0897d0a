"""Screening a stream of texts, with the audit log as its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify
from ..sources.sinks import audit_lines


def screen_stream(texts: DataFrame, terms: DataFrame, rules: DataFrame, results: str, audit: str, checkpoint: str, safe: DataFrame | None = None, fuzzy: bool = False):
    """Start a query that classifies each micro-batch of ``id, text``.

    Matching joins a batch with itself (texts with their own tokens), so it
    runs in ``foreachBatch``. Results and audit lines go to a folder named by
    the batch, written over if a batch is retried: a restart repeats none.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = classify(df.select("id", "text"), terms, rules, safe, fuzzy).join(df.select("id", "text"), "id")
        done.write.mode("overwrite").parquet(f"{results}/batch={number}")
        spark = df.sparkSession
        audit_lines(spark.read.parquet(f"{results}/batch={number}")).write.mode("overwrite").text(f"{audit}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_actions(results: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of actions by time window of a stream of ``ts, action``, late rows bounded by a watermark."""
    return results.withWatermark("ts", late).groupBy(F.window("ts", width), "action").agg(F.count("*").alias("n"))

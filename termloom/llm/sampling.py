"""Bounded samples of labelled texts for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep, limit: int) -> list[tuple[int, str, int]]:
    """At most ``limit`` (doc_id, text, label), whole texts, chosen by a hash of the id.

    ``keep`` is the condition on doc_id that marks the training fold. Rows with
    a null id or label do not count; of an id's repeated labels the largest
    does; a null text is an empty one, and of an id's repeated texts the least.
    """
    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    picked = clean.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    y = {r.doc_id: r.y for r in picked}
    if not y:
        return []
    rows = docs.where(F.col("doc_id").isin(list(y))).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    return sorted((r.doc_id, r.text, y[r.doc_id]) for r in rows)

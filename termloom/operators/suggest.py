"""Autocomplete: suggestion list, prefix index, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens
from ..sources.lexicon import in_order
from .build import keep_first

SHORTEST, LONGEST, CAP = 2, 24, 200


def suggestions(approved: DataFrame, white: DataFrame, black: DataFrame) -> DataFrame:
    """``display_term, normalized_term, source_type, ord``: approved names, then white terms, without blacklisted norms."""
    names = approved.where("action = 'ALLOW'").select(F.col("resource_name").alias("display_term"), F.lit("approved_example").alias("source_type"), "ord")
    terms = white.select(F.col("term").alias("display_term"), F.lit("whitelist").alias("source_type"), "ord")
    rows = in_order(names, terms).withColumn("normalized_term", normalize_text(F.col("display_term"))).where("normalized_term <> ''")
    rows = rows.join(black.select("normalized_term").distinct(), "normalized_term", "left_anti")
    return keep_first(rows, ["normalized_term", "source_type"]).select("display_term", "normalized_term", "source_type", "ord")


def prefix_index(listed: DataFrame, cap: int = CAP) -> DataFrame:
    """``prefix, rk, display_term, normalized_term, source_type``: the first ``cap`` of every prefix of a term or of a token.

    The cap is part of the index's meaning (a top-k for each prefix).
    """
    whole = F.array_union(F.array("normalized_term"), tokens(F.col("normalized_term")))
    cut = F.flatten(F.transform(F.filter(whole, lambda c: F.length(c) >= SHORTEST), lambda c: F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(c), F.lit(LONGEST))), lambda n: F.substring(c, F.lit(1), n))))
    posted = listed.select("*", F.explode(F.array_distinct(cut)).alias("prefix"))
    first = posted.groupBy("prefix", "normalized_term").agg(F.min_by(F.struct("display_term", "source_type"), "ord").alias("s"), F.min("ord").alias("ord"))
    ranked = first.withColumn("rk", F.row_number().over(Window.partitionBy("prefix").orderBy("ord"))).where(F.col("rk") <= cap)
    return ranked.select("prefix", "rk", "s.display_term", "normalized_term", "s.source_type")


def suggest(index: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """``display_term, normalized_term, source_type`` of at most ``limit`` suggestions, in order of rk."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie between 1 and 50")
    spark = index.sparkSession
    q = spark.range(1).select(normalize_text(F.lit(query or "")).alias("q")).first()[0]
    if len(q) < SHORTEST:
        return index.limit(0).select("rk", "display_term", "normalized_term", "source_type")
    found = index.where(F.col("prefix") == q[:LONGEST])
    if len(q) > LONGEST:
        t = F.col("normalized_term")
        found = found.where(t.startswith(q) | F.exists(tokens(t), lambda w: w.startswith(q)))
    return found.orderBy("rk").limit(limit).select("rk", "display_term", "normalized_term", "source_type")

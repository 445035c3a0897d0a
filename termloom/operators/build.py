"""Lexicon build: tagging, deduplication, partition, combinations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokens
from ..sources.lexicon import TERM_FIELDS, in_order, levels


@dataclass(frozen=True)
class Labels:
    """Names and notes a build writes into its rows; a category follows the two pattern notes."""

    seed_black: str = "seed_blacklist"
    seed_promoted: str = "seed_promoted_blacklist"
    seed_white: str = "seed_whitelist"
    approved_token: str = "approved_examples+approved_token"
    safe: str = "approved_label"
    heuristic_black: str = "heuristic_blacklist"
    heuristic_grey: str = "heuristic_greylist"
    default_white: str = "default_whitelist"
    seed_combination: str = "seed_combinations"
    generated_combination: str = "generated_combinations"
    general: str = "general_whitelist"
    token_note: str = "Single token of an approved name"
    safe_note: str = "Approved as a label"
    black_note: str = "Sensitive pattern category: "
    grey_note: str = "Context pattern category: "
    white_note: str = "No sensitive pattern"


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row by ord of every key, as a partial aggregate: hot keys cost one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*").select(df.columns)


def keep_last(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*")


def deduplicate(rows: DataFrame) -> DataFrame:
    return keep_first(rows, ["normalized_term", "action", "source"])


def approved_tokens(approved: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """Tokens of ALLOW examples, first by (row, position), as white rows. approved: resource_name, action, ord."""
    words = tokens(normalize_text(F.col("resource_name")))
    each = approved.where("action = 'ALLOW'").select(levels(approved).alias("ord"), F.posexplode(words).alias("pos", "term"))
    each = each.withColumn("normalized_term", normalize_text(F.col("term"))).where("normalized_term <> ''")
    first = each.groupBy("normalized_term").agg(F.min(F.struct("ord", "pos", "term")).alias("f"))
    return first.select(
        F.col("f.term").alias("term"), "normalized_term", F.lit("approved_token").alias("category"), F.lit(labels.approved_token).alias("source"), F.lit(0).alias("risk_level"),
        F.lit("ALLOW").alias("action"), F.lit(0.9).alias("confidence"), F.lit(labels.token_note).alias("notes"), F.concat("f.ord", F.array(F.col("f.pos").cast("long"))).alias("ord"),
    )


def pattern_hits(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """``normalized_term, category``: first category, in rule order, with a pattern that hits.

    A pattern of up to three characters hits an equal term only, a longer one
    any term it starts. Terms post their prefixes of the lengths patterns have,
    so this is an equi-join. patterns: rule_ord, category, pattern.
    """
    longest = patterns.agg(F.max(F.length("pattern"))).first()[0] or 0
    t = F.col("normalized_term")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length(t), F.lit(longest))), lambda i: F.substring(t, F.lit(1), i))
    posted = words.select("normalized_term").where("normalized_term <> ''").distinct().select("normalized_term", F.explode(prefixes).alias("pattern"))
    hit = posted.join(patterns, "pattern").where((t == F.col("pattern")) | (F.length("pattern") > 3))
    return hit.groupBy("normalized_term").agg(F.min_by("category", "rule_ord").alias("category"))


def tag_external(external: DataFrame, curated: DataFrame, safe: DataFrame, black: DataFrame, grey: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """Each external row: the curated row of its norm, else safe, black pattern, grey pattern, or default white.

    safe has a column normalized_term; black and grey are pattern relations.
    """
    last = keep_last(curated.select(*TERM_FIELDS, "ord"), ["normalized_term"]).select("normalized_term", F.struct(*[c for c in TERM_FIELDS if c != "normalized_term"]).alias("curated"))
    rows = external.join(last, "normalized_term", "left").join(safe.select("normalized_term").distinct().withColumn("is_safe", F.lit(True)), "normalized_term", "left")
    rows = rows.join(pattern_hits(external, black).withColumnRenamed("category", "black"), "normalized_term", "left")
    rows = rows.join(pattern_hits(external, grey).withColumnRenamed("category", "grey"), "normalized_term", "left")

    def tagged(category: Column, mark: str, risk: int, action: str, confidence: float, notes: Column) -> Column:
        return F.struct(
            F.col("term").alias("term"), category.alias("category"), F.concat("source", F.lit("+" + mark)).alias("source"),
            F.lit(risk).alias("risk_level"), F.lit(action).alias("action"), F.lit(confidence).alias("confidence"), notes.alias("notes"),
        )

    pick = (
        F.when(F.col("curated").isNotNull(), F.col("curated"))
        .when(F.col("is_safe"), tagged(F.lit("approved_label"), labels.safe, 0, "ALLOW", 0.92, F.lit(labels.safe_note)))
        .when(F.col("black").isNotNull(), tagged(F.col("black"), labels.heuristic_black, 90, "BLOCK", 0.72, F.concat(F.lit(labels.black_note), "black")))
        .when(F.col("grey").isNotNull(), tagged(F.col("grey"), labels.heuristic_grey, 64, "MANUAL_REVIEW", 0.64, F.concat(F.lit(labels.grey_note), "grey")))
        .otherwise(tagged(F.lit(labels.general), labels.default_white, 0, "ALLOW", 0.55, F.lit(labels.white_note)))
    )
    return rows.select("normalized_term", "ord", pick.alias("p")).select("p.term", "normalized_term", "p.category", "p.source", "p.risk_level", "p.action", "p.confidence", "p.notes", "ord")


def split_black_white(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BLOCK rows; ALLOW rows whose norm no BLOCK row has. Rows of any other action are in neither."""
    black = rows.where("action = 'BLOCK'")
    white = rows.where("action = 'ALLOW'").join(black.select("normalized_term").distinct(), "normalized_term", "left_anti")
    return black, white.select(rows.columns)


def build_lexicon(seeds: DataFrame, approved: DataFrame, external: DataFrame, safe: DataFrame, black: DataFrame, grey: DataFrame, labels: Labels = Labels()) -> tuple[DataFrame, DataFrame]:
    """Black and white lists of one build. seeds: term rows with ord."""
    curated = in_order(seeds.select(*TERM_FIELDS, "ord"), approved_tokens(approved, labels))
    traced = tag_external(external, curated, safe, black, grey, labels)
    return split_black_white(deduplicate(in_order(curated, traced.select(*TERM_FIELDS, "ord"))))


def combinations(seeded: DataFrame, anchors: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """Seeded phrases, then anchor x target phrases whose norm is new, the first of equal ones.

    seeded: phrase, risk, risk_level, notes, ord; anchors: anchor, targets
    (array), risk, risk_level, notes, ord.
    """
    fixed = seeded.select(F.col("phrase").alias("combination"), F.lit("problematic_combination").alias("category"), F.lit(labels.seed_combination).alias("source"), "risk", "risk_level", F.lit(0.9).alias("confidence"), "notes", levels(seeded).alias("ord"))
    made = anchors.select("*", F.posexplode("targets").alias("pos", "target")).select(
        F.concat_ws(" ", "anchor", "target").alias("combination"), F.lit("generated_problematic_combination").alias("category"), F.lit(labels.generated_combination).alias("source"),
        "risk", "risk_level", F.lit(0.78).alias("confidence"), "notes", F.concat(levels(anchors), F.array(F.col("pos").cast("long"))).alias("ord"),
    )
    norm = normalize_text(F.col("combination"))
    fixed, made = fixed.withColumn("normalized_combination", norm), made.withColumn("normalized_combination", norm)
    new = keep_first(made, ["normalized_combination"]).join(fixed.select("normalized_combination").distinct(), "normalized_combination", "left_anti")
    whole = in_order(fixed, new.select(fixed.columns))
    action = F.when(F.col("risk_level") >= 90, "BLOCK").otherwise("MANUAL_REVIEW")
    return whole.select("combination", "normalized_combination", "category", "source", "risk", F.col("risk_level").cast("int").alias("risk_level"), action.alias("action"), "confidence", "notes", "ord")

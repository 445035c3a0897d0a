"""Second-pass review labels of every term."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .build import Labels, pattern_hits


#: Reasons a review gives; a category follows those that end in an equals sign.
REASONS = {
    "black_explicit": "Blocked by an explicit source; category=",
    "black_pattern": "Blocked by a sensitive pattern; category=",
    "black_other": "Blocked by the final list",
    "user_override": "Approved by policy",
    "approved_token": "Token of an approved name",
    "curated": "Curated routine term",
    "sensitive_in_white": "Still resembles sensitive category=",
    "false_positive": "Known false-positive family",
    "general": "General term without a sensitive pattern",
    "unknown": "Source matched no marker",
}


@dataclass(frozen=True)
class Policy:
    """Source markers and term sets a review goes by."""

    black_sources: list[str] = field(default_factory=lambda: [Labels.seed_black, Labels.heuristic_black, Labels.seed_promoted])
    safe_sources: list[str] = field(default_factory=lambda: [Labels.seed_white, Labels.default_white, "approved_token"])
    token_source: str = "approved_token"
    curated_source: str = Labels.seed_white
    approved_terms: list[str] = field(default_factory=list)
    false_positives: list[str] = field(default_factory=list)
    reasons: dict[str, str] = field(default_factory=lambda: dict(REASONS))


def review(black: DataFrame, white: DataFrame, patterns: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``term, normalized_term, decision, confidence, review_bucket, reason, source``: first rule that holds."""
    rows = black.withColumn("decision", F.lit("BLOCK")).unionByName(white.withColumn("decision", F.lit("ALLOW")))
    rows = rows.join(pattern_hits(rows, patterns).withColumnRenamed("category", "hit"), "normalized_term", "left")
    source, norm, hit = F.coalesce("source", F.lit("")), F.col("normalized_term"), F.col("hit")
    why = policy.reasons
    family = contains_any(norm, policy.false_positives)

    def label(confidence: str, bucket: str, reason):
        return F.struct(F.lit(confidence).alias("confidence"), F.lit(bucket).alias("review_bucket"), (reason if not isinstance(reason, str) else F.lit(reason)).alias("reason"))

    blocked = (
        F.when(contains_any(source, policy.black_sources), label("high", "reviewed_black_explicit", F.concat(F.lit(why["black_explicit"]), F.coalesce("category", F.lit("")))))
        .when(hit.isNotNull(), label("medium", "reviewed_black_pattern", F.concat(F.lit(why["black_pattern"]), hit)))
        .otherwise(label("medium", "reviewed_black_other", why["black_other"]))
    )
    allowed = (
        F.when(F.col("term").isin(policy.approved_terms) if policy.approved_terms else F.lit(False), label("high", "reviewed_white_user_override", why["user_override"]))
        .when(contains_any(source, [policy.token_source]), label("high", "reviewed_white_approved_resource_token", why["approved_token"]))
        .when(contains_any(source, [policy.curated_source]), label("high", "reviewed_white_curated", why["curated"]))
        .when(hit.isNotNull() & ~family, label("low", "needs_second_pass_sensitive_pattern_in_white", F.concat(F.lit(why["sensitive_in_white"]), hit)))
        .when(family, label("medium", "reviewed_white_false_positive_family", why["false_positive"]))
        .when(contains_any(source, policy.safe_sources), label("medium", "reviewed_white_general_lexicon", why["general"]))
        .otherwise(label("low", "needs_second_pass_unknown_source", why["unknown"]))
    )
    picked = rows.withColumn("r", F.when(F.col("decision") == "BLOCK", blocked).otherwise(allowed))
    return picked.select("term", "normalized_term", "decision", "r.confidence", "r.review_bucket", "r.reason", source.alias("source"))

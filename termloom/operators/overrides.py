"""List overrides as an append-only log; the newest entry of a norm wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..sources.lexicon import TERM_FIELDS, in_order


@dataclass(frozen=True)
class Wording:
    """Names and notes an override writes, for allowing and for blocking."""

    category: tuple[str, str] = ("user_whitelist_override", "user_blacklist_override")
    source: tuple[str, str] = ("user_whitelist", "user_blacklist")
    notes: tuple[str, str] = ("User override: force allow", "User override: force block")


def override_rows(requests: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """Requests (term, action, created_at) as override rows; requests without normalized content are dropped."""
    allow = F.col("action") == "ALLOW"
    rows = requests.withColumn("term", F.trim("term")).withColumn("normalized_term", normalize_text(F.col("term"))).where("normalized_term <> ''")
    return rows.select(
        "term", "normalized_term", F.when(allow, wording.category[0]).otherwise(wording.category[1]).alias("category"),
        F.when(allow, wording.source[0]).otherwise(wording.source[1]).alias("source"), F.when(allow, 0).otherwise(95).alias("risk_level"), "action",
        F.lit(0.99).alias("confidence"), F.when(allow, wording.notes[0]).otherwise(wording.notes[1]).alias("notes"), "created_at",
    )


def latest(log: DataFrame) -> DataFrame:
    """Newest row of each norm (by created_at, then the larger term): a partial aggregate, so hot norms do not pile up."""
    rest = [c for c in log.columns if c != "normalized_term"]
    return log.groupBy("normalized_term").agg(F.max_by(F.struct(*rest), F.struct("created_at", "term", "action")).alias("r")).select("normalized_term", "r.*").select(log.columns)


def apply_overrides(black: DataFrame, white: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists after the overrides: every variant of an overridden norm goes, its override row comes.

    Lists with ord keep their order, and override rows follow in order of time.
    """
    new = latest(log)
    keys = new.select("normalized_term")
    fields = [c for c in TERM_FIELDS if c in black.columns]
    out = []
    for rows, action in ((black, "BLOCK"), (white, "ALLOW")):
        kept, come = rows.join(keys, "normalized_term", "left_anti"), new.where(F.col("action") == action)
        if "ord" in rows.columns:
            out.append(in_order(kept.select(*fields, "ord"), come.select(*fields, F.unix_micros(F.col("created_at").cast("timestamp")).alias("ord"))))
        else:
            out.append(kept.select(*fields).unionByName(come.select(*fields)))
    return out[0], out[1]


def override(black: DataFrame, white: DataFrame, term: str, action: str, wording: Wording = Wording()) -> tuple[DataFrame, DataFrame, dict]:
    """One request: the new lists and an acknowledgement."""
    if action not in ("ALLOW", "BLOCK"):
        raise ValueError("action is ALLOW or BLOCK")
    log = override_rows(black.sparkSession.createDataFrame([(term, action)], "term string, action string").withColumn("created_at", F.current_timestamp()), wording)
    row = log.first()
    if row is None:
        raise ValueError(f"nothing is left of {term!r} after normalization")
    black, white = apply_overrides(black, white, log)
    name = "whitelist" if action == "ALLOW" else "blacklist"
    return black, white, {"status": "ok", "message": f"Term added to {name} override list", "term": row.term, "normalized_term": row.normalized_term, "action": action}

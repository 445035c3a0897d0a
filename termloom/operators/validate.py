"""Token-level validation: segments, overall status, matches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RAW, normalize_text, normalized_raw, raw_tokens
from . import inplace, match
from .build import keep_last
from .classify import row_key


def lookup(rows: DataFrame) -> DataFrame:
    """Term rows by norm, the last one wins; empty norms are left out. rows carry ord."""
    return keep_last(rows.where("coalesce(normalized_term, '') <> ''").select("normalized_term", "term", "ord"), ["normalized_term"]).select("normalized_term", "term")


#: Reasons of a segment: blocked (its term follows), approved, unknown.
REASONS = ("Blocked term: ", "Approved term", "Unknown term")


def segments(docs: DataFrame, black: DataFrame, white: DataFrame, reasons: tuple[str, str, str] = REASONS) -> DataFrame:
    """``id, pos, value, status, reason`` for every raw token of every text."""
    each = docs.select("id", F.posexplode(raw_tokens(F.col("text"))).alias("pos", "value"))
    words = each.select("value").distinct().withColumn("normalized_term", normalize_text(F.col("value")))
    b, w = lookup(black).withColumnRenamed("term", "black"), lookup(white).select("normalized_term", F.lit(True).alias("white"))
    status = F.when(F.col("black").isNotNull(), "BLOCK").when(F.col("white"), "ALLOW").otherwise("UNKNOWN")
    reason = F.when(F.col("black").isNotNull(), F.concat(F.lit(reasons[0]), "black")).when(F.col("white"), reasons[1]).otherwise(reasons[2])
    known = words.join(b, "normalized_term", "left").join(w, "normalized_term", "left").select("value", status.alias("status"), reason.alias("reason"))
    return each.join(known, "value").select("id", "pos", "value", "status", "reason")


def validate_detailed(docs: DataFrame, black: DataFrame, white: DataFrame, rules: DataFrame, threshold: float | None = match.TOKEN_RATIO, reasons: tuple[str, str, str] = REASONS) -> DataFrame:
    """``id, text, normalized_text, overall_status, segments, matched_terms, matched_combinations``.

    Every row has its own result; ids may be null or repeated. With a
    threshold, lists of up to ``inplace.MOST`` rows and rules of up to
    ``inplace.FEW`` words (both are checked) go to every batch of texts, whose
    tokens never leave their row. Otherwise tokens and phrases are met by joins.
    """
    found = None if threshold is None else _in_place(docs, black, white, rules, threshold, reasons)
    if found is not None:
        return found
    keyed = docs.select(row_key(docs).alias("id"), "text")
    each = segments(keyed.distinct(), black, white, reasons)
    listed = F.sort_array(F.collect_list(F.struct("pos", "value", "status", "reason")))
    by_doc = each.groupBy("id").agg(
        F.transform(listed, lambda s: F.struct(s["value"].alias("value"), s["status"].alias("status"), s["reason"].alias("reason"))).alias("segments"),
        F.bool_or(F.col("status") == "BLOCK").alias("block"),
        F.bool_or(F.col("status") == "UNKNOWN").alias("unknown"),
        F.array_sort(F.collect_set(F.when(F.col("status") != "UNKNOWN", F.col("value")))).alias("matched_terms"),
    )
    base = keyed.withColumn("nx", normalize_text(F.coalesce("text", F.lit(""))))
    hit = match.combination_matches(base.select("id", "nx"), rules, threshold).join(rules.select("tid", "phrase"), "tid")
    by_rule = hit.groupBy("id").agg(F.array_sort(F.collect_set("phrase")).alias("matched_combinations"))
    whole = base.join(by_doc, "id", "left").join(by_rule, "id", "left").withColumn("id", F.col("id.id"))
    overall = F.when(F.col("block") | F.col("matched_combinations").isNotNull(), "BLOCK").when(F.col("unknown"), "UNKNOWN").otherwise("ALLOW")
    none = F.array().cast("array<string>")
    return whole.select(
        "id", "text", F.col("nx").alias("normalized_text"), overall.alias("overall_status"),
        F.coalesce("segments", F.array().cast("array<struct<value:string,status:string,reason:string>>")).alias("segments"),
        F.coalesce("matched_terms", none).alias("matched_terms"), F.coalesce("matched_combinations", none).alias("matched_combinations"),
    )


def _in_place(docs: DataFrame, black: DataFrame, white: DataFrame, rules: DataFrame, threshold: float, reasons: tuple[str, str, str]) -> DataFrame | None:
    """The same in one pass over the texts; None if a list is too long for that."""
    black_ = inplace.few_rows(lookup(black))
    white_ = None if black_ is None else inplace.few_rows(white.select("normalized_term").where("normalized_term <> ''").distinct())
    rules_ = None if white_ is None else inplace.few_rows(rules.select("tid", "phrase", "normalized_phrase"))
    if black_ is None or white_ is None or rules_ is None:
        return None
    matches = inplace.Rules([(r.tid, r.normalized_phrase) for r in rules_], threshold, match.WINDOW)
    if not matches.few:
        return None
    phrases: dict = {}
    for r in rules_:
        phrases.setdefault(r.tid, set()).update([] if r.phrase is None else [r.phrase])
    # the kinds of segments: unknown, approved, one for each blocked term
    blocked = [r for r in black_ if r.term is not None]
    kinds = {r.normalized_term: 1 for r in white_} | {r.normalized_term: k + 2 for k, r in enumerate(blocked)}
    statuses = ["UNKNOWN", "ALLOW", *["BLOCK"] * len(blocked)]
    said = [reasons[2], reasons[1], *[reasons[0] + r.term for r in blocked]]
    words = pa.list_(pa.string())

    def run(batches):
        values_of = re.compile(RAW).findall
        status, reason = pa.array(statuses, pa.string()), pa.array(said, pa.string())
        for batch, part in inplace.sliced_texts(batches, "nx"):
            each = [values_of(t) if t else [] for t in batch.column("text").to_pylist()]
            kind = {v: kinds.get(normalized_raw(v), 0) for v in set().union(*each)}
            of = [[kind[v] for v in values] for values in each]
            ends = np.cumsum([0, *map(len, each)])
            flat = pa.array([k for x in of for k in x], pa.int32())
            parts = pa.StructArray.from_arrays([pa.array([v for x in each for v in x], pa.string()), status.take(flat), reason.take(flat)], ["value", "status", "reason"])
            hit = matches.of(part)
            overall = ["BLOCK" if row in hit or max(x, default=0) > 1 else "UNKNOWN" if 0 in x else "ALLOW" for row, x in enumerate(of)]
            matched = [sorted({v for v, k in zip(values, x) if k}) for values, x in zip(each, of)]
            met = [sorted(set().union(*[phrases[t] for t in hit.get(row, ())])) for row in range(len(each))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), batch.column("nx"), pa.array(overall, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.array(matched, words), pa.array(met, words)],
                ["id", "text", "normalized_text", "overall_status", "segments", "matched_terms", "matched_combinations"],
            )

    base = docs.select("id", F.col("text").cast("string").alias("text"), normalize_text(F.coalesce("text", F.lit(""))).alias("nx"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, text string, normalized_text string, overall_status string, segments array<struct<value:string,status:string,reason:string>>"
    return base.mapInArrow(run, f"{schema}, matched_terms array<string>, matched_combinations array<string>")

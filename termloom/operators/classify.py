"""Classification: score, action, explanation of every document."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from . import inplace, match

REASON_TERM = "Matched sensitive military terminology"
REASON_COMBINATION = "Matched problematic term combination"
REASON_NONE = "No sensitive terminology detected"


def row_key(docs: DataFrame):
    """Id and a hash of the text: rows that share it have equal results, and a null id is a value like others."""
    return F.struct(F.col("id").alias("id"), F.xxhash64("text").alias("text"))


def classify(docs: DataFrame, terms: DataFrame, rules: DataFrame, safe: DataFrame | None = None, fuzzy: bool = True, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id, risk_score, action, matched_terms, matched_combination, normalized_text, reason``.

    docs: id, text. terms: tid, term, normalized_term, risk_level, action.
    rules: tid, phrase, normalized_phrase, risk_score. Texts without any match
    score 0 and are ALLOW. ``fuzzy=False`` keeps to exact and substring matches
    and equal-token windows; then no Python runs. Every row has its own result,
    ids may be null or repeated; other columns of docs are left out. With
    ``fuzzy``, lists of up to ``inplace.MOST`` rows and ``inplace.FEW`` fuzzy
    targets (both are checked) go to every batch of texts, whose matches never
    leave their row. Otherwise matches are met by joins and every kind of match
    reads the normalized texts: ``hold`` may keep them meanwhile, such as
    ``DataFrame.persist`` or a write into a shared folder.
    """
    if fuzzy:
        found = _in_place(docs, terms, rules, safe)
        if found is not None:
            return found
    base = docs.select(row_key(docs).alias("id"), normalize_text(F.coalesce(F.col("text"), F.lit(""))).alias("nx"))
    base = base if hold is None else hold(base)
    if fuzzy and safe is None:
        safe = docs.sparkSession.createDataFrame([], "normalized_term string")
    found = match.term_matches(base, terms, safe if fuzzy else None).join(terms.select("tid", "term", "risk_level", "action"), "tid")
    risk, white = F.col("action") != "ALLOW", F.col("action") == "ALLOW"
    by_term = found.groupBy("id").agg(
        F.max(F.when(risk, F.col("risk_level"))).alias("risk"),
        F.max(F.when(white, F.col("risk_level"))).alias("white"),
        F.bool_or(F.col("action") == "BLOCK").alias("block"),
        F.array_sort(F.collect_set("term")).alias("matched_terms"),
    )
    hit = match.combination_matches(base, rules, match.TOKEN_RATIO if fuzzy else None).join(rules.select("tid", "phrase", "risk_score"), "tid")
    by_rule = hit.groupBy("id").agg(F.max("risk_score").alias("rule"), F.array_sort(F.collect_set("phrase")).alias("matched_combination"))
    none = F.array().cast("array<string>")
    whole = base.join(by_term, "id", "left").join(by_rule, "id", "left").withColumn("id", F.col("id.id"))
    score = F.coalesce(F.greatest("risk", "rule"), F.col("white"), F.lit(0)).cast("int")
    reason = F.concat_ws("; ", F.when(F.col("block"), REASON_TERM), F.when(F.col("rule").isNotNull(), REASON_COMBINATION))
    return whole.select(
        "id",
        score.alias("risk_score"),
        F.when(F.col("risk").isNotNull() | F.col("rule").isNotNull(), "BLOCK").otherwise("ALLOW").alias("action"),
        F.coalesce("matched_terms", none).alias("matched_terms"),
        F.coalesce("matched_combination", none).alias("matched_combination"),
        F.col("nx").alias("normalized_text"),
        F.when(reason == "", REASON_NONE).otherwise(reason).alias("reason"),
    )


def _in_place(docs: DataFrame, terms: DataFrame, rules: DataFrame, safe: DataFrame | None) -> DataFrame | None:
    """The same in one pass over the texts; None if a list is too long for that."""
    terms_ = inplace.few_rows(terms.select("tid", "term", "normalized_term", "risk_level", "action"))
    rules_ = None if terms_ is None else inplace.few_rows(rules.select("tid", "phrase", "normalized_phrase", "risk_score"))
    safe_ = [] if safe is None or rules_ is None else inplace.few_rows(safe.select("normalized_term"))
    if terms_ is None or rules_ is None or safe_ is None:
        return None
    term_matches = inplace.Terms([(r.tid, r.normalized_term, r.action) for r in terms_], {r.normalized_term for r in safe_}, match.TERM_RATIO, match.MIN_FUZZY)
    rule_matches = inplace.Rules([(r.tid, r.normalized_phrase) for r in rules_], match.TOKEN_RATIO, match.WINDOW)
    if not term_matches.few or not rule_matches.few:
        return None
    term_rows, rule_rows = {}, {}
    for r in terms_:
        term_rows.setdefault(r.tid, []).append((r.term, r.risk_level, r.action))
    for r in rules_:
        rule_rows.setdefault(r.tid, []).append((r.phrase, r.risk_score))

    def top(levels):
        return max((x for x in levels if x is not None), default=None)

    def judged(tids, rule_tids):
        found = [r for t in tids for r in term_rows[t]]
        hit = [r for t in rule_tids for r in rule_rows[t]]
        risk = top(level for _, level, action in found if action is not None and action != "ALLOW")
        white, rule = top(level for _, level, action in found if action == "ALLOW"), top(level for _, level in hit)
        score = next((x for x in (top((risk, rule)), white) if x is not None), 0)
        reason = "; ".join([REASON_TERM] * any(action == "BLOCK" for _, _, action in found) + [REASON_COMBINATION] * (rule is not None))
        action = "ALLOW" if risk is None and rule is None else "BLOCK"
        return int(score), action, sorted({t for t, _, _ in found if t is not None}), sorted({p for p, _ in hit if p is not None}), reason or REASON_NONE

    def run(batches):
        for batch, part in inplace.sliced_texts(batches, "nx"):
            by_term, by_rule = term_matches.of(part), rule_matches.of(part)
            score, action, matched, combination, reason = zip(*[judged(by_term.get(row, ()), by_rule.get(row, ())) for row in range(batch.num_rows)])
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score, pa.int32()), pa.array(action, pa.string()), pa.array(matched, words), pa.array(combination, words), batch.column("nx"), pa.array(reason, pa.string())],
                ["id", "risk_score", "action", "matched_terms", "matched_combination", "normalized_text", "reason"],
            )

    base = docs.select("id", normalize_text(F.coalesce(F.col("text"), F.lit(""))).alias("nx"))
    return base.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, risk_score int, action string, matched_terms array<string>, matched_combination array<string>, normalized_text string, reason string")


def classify_text(text: str, terms: DataFrame, rules: DataFrame, safe: DataFrame | None = None) -> dict:
    """One text's result as a dictionary."""
    if not text:
        raise ValueError("text must not be empty")
    docs = terms.sparkSession.createDataFrame([(0, text)], "id long, text string")
    return classify(docs, terms, rules, safe).drop("id").first().asDict(recursive=True)

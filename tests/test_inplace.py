"""One pass over the texts: the joins' results, without a join or an exchange of texts."""

import random

import pytest

from termloom.functions.similarity import ratio_of
from termloom.functions.text import normalize_text, normalized_raw
from termloom.operators import inplace
from termloom.operators.classify import classify
from termloom.operators.validate import validate_detailed

from .test_matching import frame

WORDS = ["alpha", "alphas", "alphax", "bravo", "bravos", "delta", "del", "tabr", "avo", "x", "of", "charlie", "Char־lie", "לשכת", "ולמבצעים"]


def texts(seed: int, n: int = 60):
    rng = random.Random(seed)
    return [(i // 2 if i % 7 else None, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))) for i in range(n)] + [(1000, None), (1001, "")]


def exchanges_of_texts(df) -> int:
    """Exchanges that any text goes through: those of the plan after its last step over Arrow."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join") + plan.count("Aggregate") + plan.count("RepartitionBy")


def lists(spark):
    terms = [(k, w, w.lower(), 50 + k, ("BLOCK", "ALLOW", "MANUAL_REVIEW", None)[k % 4]) for k, w in enumerate(["alpha", "bravo", "delta", "charlie", "alpha bravo", "delta alphas x", "bravo charlie", "avo x", "alphas", "tabr avo", "del tabravo", "alpha"])]
    rules = [(k, p, p, 60 + k) for k, p in enumerate(["alpha bravo", "delta alpha bravo", "rav", "charlie x", "bravo of alpha del"])]
    return frame(spark, terms, "tid long, term string, normalized_term string, risk_level int, action string"), frame(spark, rules, "tid long, phrase string, normalized_phrase string, risk_score int")


def rows(df):
    return sorted(map(repr, (r.asDict(recursive=True) for r in df.collect())))


def test_classify_as_by_joins(spark, monkeypatch):
    docs, (terms, rules) = frame(spark, texts(3), "id long, text string"), lists(spark)
    safe = frame(spark, [("alphax",)], "normalized_term string")
    found = classify(docs, terms, rules, safe)
    assert exchanges_of_texts(found) == 0
    got = rows(found)
    monkeypatch.setattr(inplace, "few_rows", lambda *_: None)
    assert got == rows(classify(docs, terms, rules, safe))


def test_validate_as_by_joins(spark, monkeypatch):
    docs, (terms, rules) = frame(spark, texts(4), "id long, text string"), lists(spark)
    listed = terms.withColumn("ord", terms["tid"])
    black, white = listed.where("action <> 'ALLOW'"), listed.where("action = 'ALLOW'")
    found = validate_detailed(docs, black, white, rules)
    assert exchanges_of_texts(found) == 0
    got = rows(found)
    monkeypatch.setattr(inplace, "few_rows", lambda *_: None)
    assert got == rows(validate_detailed(docs, black, white, rules))


def test_raw_tokens_normalized_alike(spark):
    raw = ["Ab", "תת־אלוף", "־", "ללשכה", "לשכת", "רַע״נ", "aׇֿ", "ולמבצעים־בדם", "8200", "֐x", "חמ״ל"]
    got = frame(spark, [(t,) for t in raw], "t string").select("t", normalize_text("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: normalized_raw(t) for t in raw}


@pytest.mark.parametrize("width", [2, 3])
def test_near_runs_lose_nothing(width):
    rng = random.Random(width)
    letters = "abcd"
    vocabulary = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(150)})
    targets = [" ".join(rng.choice(vocabulary) for _ in range(width)) for _ in range(40)]
    text = " ".join(w for t in targets for w in (rng.choice(vocabulary), t[: len(t) // 2], t.replace(rng.choice(letters), "", 1), t))
    text = " ".join(text.split())
    words = text.split(" ")
    grams = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
    targets = list(dict.fromkeys(targets))
    expected = {k for k, t in enumerate(targets) for g in grams if ratio_of(g, t) >= 0.7}
    part = inplace.Slice([text, None, ""])
    assert inplace.NearRuns(targets, 0.7).of(part) == {(0, k) for k in expected}
    from termloom.functions.similarity import near_runs
    import numpy as np

    runs = np.array([part.ids[i : i + width] for i in range(len(words) - width + 1)])
    pairs = {(" ".join(part.vocabulary[w] for w in runs[i]), t) for i, t in near_runs(part.vocabulary, runs, targets, 0.7)}
    assert pairs == {(g, t) for g in grams for t in targets if ratio_of(g, t) >= 0.7}

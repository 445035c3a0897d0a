import random

import pytest

from termloom.functions.similarity import ratio_of
from termloom.operators import match
from termloom.operators.classify import classify, classify_text


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return {(r.id, r.tid) for r in df.collect()}


def greedy(words, parts, near, window=4):
    for s in [i for i, w in enumerate(words) if near(w, parts[0])]:
        at = s + 1
        for p in parts[1:]:
            nxt = next((i for i in range(at, min(len(words), at + window)) if near(words[i], p)), None)
            if nxt is None:
                break
            at = nxt + 1
        else:
            return True
    return False


def test_substring_phrases(spark):
    docs = frame(spark, [(1, "xx alpha beta"), (2, "alphab etax"), (3, "wwalpha betaww q"), (4, ""), (5, "a b c"), (6, None)], "id long, nx string")
    phrases = frame(spark, [(1, "alpha beta"), (2, "a b"), (3, "b c"), (4, "pha be")], "tid long, phrase string")
    texts = {1: "xx alpha beta", 2: "alphab etax", 3: "wwalpha betaww q", 4: "", 5: "a b c"}
    expected = {(i, t) for i, x in texts.items() for t, p in ((1, "alpha beta"), (2, "a b"), (3, "b c"), (4, "pha be")) if p in x}
    assert pairs(match.containing(docs, phrases)) == expected


def test_greedy_window_does_not_backtrack(spark):
    # p1 stands at 1 and 4; the nearest is taken and p2 at 8 is then too far
    docs = frame(spark, [(1, "p0 p1 x x p1 x x x p2"), (2, "p0 p1 x x x p2"), (3, "p0 x x x p1 p2"), (4, "p0 x x x x p1 p2")], "id long, nx string")
    rules = frame(spark, [(7, "p0 p1 p2")], "tid long, normalized_phrase string")
    assert pairs(match.ordered_windows(docs, rules, None)) == {(2, 7), (3, 7)}


@pytest.mark.parametrize("threshold", [None, 0.82])
def test_windows_against_loop(spark, threshold):
    rng = random.Random(9)
    vocabulary = ["alpha", "alphas", "bravo", "bravos", "delta", "x", "y"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    rules = [(k, " ".join(rng.choice(vocabulary[:5]) for _ in range(rng.randrange(1, 4)))) for k in range(12)]
    near = (lambda a, b: a == b) if threshold is None else (lambda a, b: ratio_of(a, b) >= threshold)
    expected = {(i, k) for i, x in docs for k, p in rules if len(p.split()) > 1 and greedy(x.split(), p.split(), near)}
    found = match.ordered_windows(frame(spark, docs, "id long, nx string"), frame(spark, rules, "tid long, normalized_phrase string"), threshold)
    assert pairs(found) == expected


TERMS = [
    (1, "אלוף", "אלוף", 95, "BLOCK"), (2, "חמ\"ל", "חמל", 93, "BLOCK"), (3, "מרפאה", "מרפאה", 10, "ALLOW"), (4, "פיקוד הצפון", "פיקוד הצפון", 94, "BLOCK"),
    (5, "modular", "modular", 70, "MANUAL_REVIEW"), (6, "open sesame door", "open sesame door", 80, "BLOCK"),
]
RULES = [(1, "לשכת אלוף", "לשכה אלוף", 97), (2, "חדר מצב", "חדר מצב", 82)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return frame(spark, TERMS, "tid long, term string, normalized_term string, risk_level int, action string"), frame(spark, RULES, "tid long, phrase string, normalized_phrase string, risk_score int")


def test_classification(spark, lexicon):
    texts = ["לשכת אלוף", "תור למרפאה ובדיקת דם", "צריך חדר גדול עבור מצב חירום", "נא לפתוח חמל צפוני", "modularx", "open sesame doors", None, "", "modular מרפאה"]
    docs = frame(spark, list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in classify(docs, *lexicon).collect()}
    assert len(got) == len(texts)
    assert (got[0].action, got[0].risk_score, got[0].matched_terms, got[0].matched_combination) == ("BLOCK", 97, ["אלוף"], ["לשכת אלוף"])
    assert (got[1].action, got[1].risk_score, got[1].matched_terms) == ("ALLOW", 10, ["מרפאה"])
    assert got[2].action == "BLOCK" and got[2].matched_combination == ["חדר מצב"]
    assert got[3].matched_terms == ['חמ"ל']
    assert got[4].action == "BLOCK" and got[4].matched_terms == ["modular"] and got[4].reason == "No sensitive terminology detected"
    assert got[5].matched_terms == ["open sesame door"]
    assert got[6].risk_score == got[7].risk_score == 0 and got[6].action == "ALLOW"
    assert got[8].risk_score == 70 and got[8].matched_terms == ["modular", "מרפאה"]
    exact = {r.id: r for r in classify(docs, *lexicon, fuzzy=False).collect()}
    assert exact[4].action == "ALLOW" and exact[0].action == "BLOCK"


def test_safe_tokens_are_not_fuzzy(spark, lexicon):
    safe = frame(spark, [("modularx",)], "normalized_term string")
    docs = frame(spark, [(0, "modularx")], "id long, text string")
    assert classify(docs, *lexicon, safe=safe).first().action == "ALLOW"


def test_single_text(spark, lexicon):
    assert classify_text("לשכת אלוף", *lexicon)["action"] == "BLOCK"
    with pytest.raises(ValueError):
        classify_text("", *lexicon)


def test_empty_tables(spark, lexicon):
    terms, rules = lexicon
    docs = frame(spark, [(0, "אלוף")], "id long, text string")
    assert classify(docs, terms.limit(0), rules.limit(0)).first().action == "ALLOW"
    assert classify(docs.limit(0), terms, rules).collect() == []

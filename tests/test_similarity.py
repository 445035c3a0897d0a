import random

from termloom.functions.similarity import candidate_pairs, ratio_of, similar_pairs


def test_candidates_lose_no_pair(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(250)})
    targets = list({w[:k] + rng.choice("abcd") + w[k + 1 :] for w in words[:80] for k in (0, 2)} | set(words[80:120]))
    texts, wanted = spark.createDataFrame([(w,) for w in words], "text string"), spark.createDataFrame([(w,) for w in targets], "target string")
    for t in (0.82, 0.86):
        expected = {(a, b) for a in words for b in targets if ratio_of(a, b) >= t}
        assert expected <= {tuple(r) for r in candidate_pairs(texts, wanted, t).collect()}
        for few in (0, 5000):  # by the join, and by the bound on shared letters
            assert expected == {tuple(r) for r in similar_pairs(texts, wanted, t, few).collect()}


def test_no_targets(spark):
    none = spark.createDataFrame([], "target string")
    assert similar_pairs(spark.createDataFrame([("a",)], "text string"), none, 0.8).collect() == []


def test_bounds_lose_no_pair():
    from termloom.functions.similarity import _near

    rng = random.Random(2)
    for letters, longest in (("ab", 8), ("abcdé", 90), ("abכלם", 90), ("abcdefgh", 12)):
        words = list({"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(60)})
        targets = list({w[:-1] + rng.choice(letters) for w in words[:30]} | set(words[30:40]))
        for t in (0.6, 0.82):
            assert set(_near(words, targets, t)) == {(a, b) for a in words for b in targets if ratio_of(a, b) >= t}


def test_matched_letters_are_those_of_the_library():
    from difflib import SequenceMatcher

    from termloom.functions.similarity import _matched

    rng = random.Random(1)
    for _ in range(3000):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 16))) for _ in range(2))
        assert _matched(a, b) == sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())


def test_words_are_compared_once():
    from termloom.functions import similarity

    calls, near = [], similarity._near
    similarity._near = lambda texts, *rest: calls.append(sorted(texts)) or near(texts, *rest)
    try:
        like = similarity.Resembling(["delta", "alpha"], 0.8, hold=3)
        for words in ({"delta", "deltas"}, {"delta", "omega", ""}, {"delta", "sigma"}, {"delta", "deltas"}):
            got = like.of(words)
            assert {w: got[w] for w in words} == {w: ("delta",) if w.startswith("delta") else () for w in words}
    finally:
        similarity._near = near
    assert calls == [["delta", "deltas"], ["omega"], ["sigma"]]

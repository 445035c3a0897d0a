"""Fuzzy windows: both ways hold the loop's result, and a word's variants do not multiply rules."""

import random

import pytest

from termloom.functions.similarity import ratio_of
from termloom.operators import match

from .test_matching import frame, greedy, pairs


def most_rows(df):
    """The largest number of rows that a node of the plan made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


@pytest.mark.parametrize("few", [0, 5000])
def test_ways_agree(spark, few):
    rng = random.Random(5)
    vocabulary = ["alpha", "alphas", "bravo", "bravos", "delta", "deltas", "x", "y"]
    docs = [(i // 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14)))) for i in range(80)]  # every id twice
    rules = [(k, " ".join(rng.choice(vocabulary[:6]) for _ in range(rng.randrange(1, 5)))) for k in range(16)]
    near = lambda a, b: ratio_of(a, b) >= 0.82
    expected = {(i, k) for i, x in docs for k, p in rules if len(p.split()) > 1 and greedy(x.split(), p.split(), near)}
    found = match.ordered_windows(frame(spark, [*docs, (None, "alpha x bravo"), (99, None)], "id long, nx string"), frame(spark, [*rules, (77, "alpha bravo")], "tid long, normalized_phrase string"), 0.82, few=few)
    rows = [(r.id, r.tid) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert {r for r in rows if r[0] is not None and r[1] != 77} == expected
    assert (None, 77) in rows


@pytest.mark.parametrize("ways", [{}, {"few": 0}])
def test_variants_do_not_multiply(spark, ways):
    # 200 variants of either word: their product is 40,000
    letters = "abcdefghijklmnopqrstuvwxyz"
    ends = [a + b for a in letters for b in letters][:200]
    docs = frame(spark, [(i, f"watermelon{e} x pineapples{e}") for i, e in enumerate(ends)], "id long, nx string")
    found = match.ordered_windows(docs, frame(spark, [(1, "watermelon pineapples")], "tid long, normalized_phrase string"), 0.82, **ways)
    assert pairs(found) == {(i, 1) for i in range(200)}
    assert most_rows(found) < 40_000

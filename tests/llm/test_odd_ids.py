"""Null and repeated ids, clashing columns and empty tables through every operator and stage."""

import pytest

import corpus_pipeline
from termloom.llm import bpe, decontaminate, langid, licences, pii, quality, simhash, substrings, toxicity

from .conftest import SF

CLASH = "'clash' as score", "1 as component_id", "'t' as spans", "2 as kind", "'w' as word", "3 as fp", "'h' as value", "4 as row", "5 as node", "6 as h"
ROWS = [
    (None, "mail me at bob@x.org now, my friend of many years", "en", "s", 49), (None, "another text with other words and no address at all", "en", "s", 51), (None, None, None, None, None),
    (7, "first text of the id, write to al@y.org please", "en", "s", 47), (7, "second text of the id without any address in it", "en", "s", 48), (7, "second text of the id without any address in it", "en", "s", 48), (8, "", "en", None, 0),
]


@pytest.fixture(scope="module")
def odd_ids(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASH)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize(
    "apply",
    [
        lambda d: toxicity.score(d, toxicity.Model([])), lambda d: quality.score(d, quality.Model([])), lambda d: langid.identify(d, langid.fit(d)), licences.licences, pii.find,
        simhash.near_duplicates, lambda d: bpe.encoded(d, *bpe.public_vocabulary()), lambda d: substrings.deduplicated(d),
    ],
    ids="op1 op6 op4 op8 op7 op9 op3 op2".split(),
)
def test_operators_keep_every_row(odd_ids, apply, empty):
    got = [r.doc_id for r in apply(odd_ids.limit(0) if empty else odd_ids).collect()]
    assert sorted(got, key=str) == ([] if empty else sorted((r[0] for r in ROWS), key=str))


def test_contaminated_null_ids(spark, odd_ids):
    bench = spark.createDataFrame([(1, "another text with other words"), (1, "second text of the id")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_ids, bench).collect()} == {(None, 1), (7, 1)}


def test_held_out_is_never_null(spark):
    from termloom.llm.common import held_out

    df = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select(held_out(3, 1))
    assert all(r.held_out is not None for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_with_odd_rows(spark, odd_ids, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd_ids, SF)
    assert got.columns == odd_ids.columns
    texts = sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None and r.text)
    first, second = "first text of the id, write to al@y.org please", "second text of the id without any address in it"
    want = {"pii": [(7, first.replace("al@y.org", "[EMAIL]")), (7, second), (7, second)], "near_dedup": [(7, first), (7, second)]}.get(name, [(7, first), (7, second), (7, second)])
    assert texts == sorted(want)
    assert sum(r.doc_id is None and bool(r.text) for r in got.collect()) == 2
    assert stage(spark, odd_ids.limit(0), SF).collect() == []


def test_last_stage_with_odd_rows(spark, odd_ids):
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd_ids, SF).count() == len(ROWS) and last(spark, odd_ids.limit(0), SF).count() == 0

"""Order of nested and many-file lists, identity of rows, lists by version, the entry without the optional package."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom.operators import store
from termloom.operators.build import keep_first, keep_last
from termloom.operators.classify import classify
from termloom.operators.validate import validate_detailed
from termloom.sources import lexicon as src

ROOT = Path(__file__).resolve().parents[1]
TERM = "term string, normalized_term string, category string, source string, risk_level int, action string, confidence double, notes string, ord long"


def frame(spark, words):
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, ord long")


def test_nested_unions_keep_order(spark):
    a, b, c, d = (frame(spark, [f"{x}{i}" for i in range(3)]) for x in "abcd")
    flat = [f"{x}{i}" for x in "abcd" for i in range(3)]
    for nested in (src.in_order(src.in_order(a, b, c), d), src.in_order(a, src.in_order(b, src.in_order(c, d))), src.in_order(a, b, c, d)):
        assert [r.term for r in nested.orderBy("ord").collect()] == flat
    twice = src.in_order(src.in_order(a, b), src.in_order(a.withColumn("term", F.upper("term")), d)).withColumn("key", F.lower("term"))
    assert sorted(r.term for r in keep_first(twice, ["key"]).where("key like 'a%'").collect()) == ["a0", "a1", "a2"]
    assert sorted(r.term for r in keep_last(twice, ["key"]).where("key like 'a%'").collect()) == ["A0", "A1", "A2"]


def test_files_in_order_of_name(spark, tmp_path):
    for name, words in (("2.txt", [f"m{i}" for i in range(500)]), ("1.txt", ["first"]), ("3 ä.txt", ["last"])):
        (tmp_path / name).write_text("\n".join(words), encoding="utf-8")
    rows = src.read_words(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 1
    assert [r.term for r in rows.orderBy("ord").collect()] == ["first", *(f"m{i}" for i in range(500)), "last"]


def test_many_blocks_of_one_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("\n".join(f"w{i:05d}" for i in range(20_000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = src.read_words(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        assert [r.term for r in rows.orderBy("ord").collect()] == [f"w{i:05d}" for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_have_their_own_results(spark):
    terms = spark.createDataFrame([(1, "secret place", "secret place", 90, "BLOCK"), (2, "calm", "calm", 1, "ALLOW")], "tid long, term string, normalized_term string, risk_level int, action string")
    rules = spark.createDataFrame([(1, "base 82", "base 82", 80)], "tid long, phrase string, normalized_phrase string, risk_score int")
    docs = spark.createDataFrame([(None, "a secret place"), (None, "calm"), (None, None), (5, "a secret place"), (5, "nothing"), (5, "nothing")], "id long, text string")
    for fuzzy in (False, True):
        got = sorted((str(r.id), r.normalized_text, r.action) for r in classify(docs, terms, rules, fuzzy=fuzzy).collect())
        assert got == [("5", "a secret place", "BLOCK"), ("5", "nothing", "ALLOW"), ("5", "nothing", "ALLOW"), ("None", "", "ALLOW"), ("None", "a secret place", "BLOCK"), ("None", "calm", "ALLOW")]
    lists = spark.createDataFrame([("calm", "calm", "c", "s", 0, "ALLOW", 0.9, "", 1)], TERM)
    got = sorted((str(r.id), r.normalized_text, r.overall_status, len(r.segments)) for r in validate_detailed(docs, lists.limit(0), lists, rules).collect())
    assert got == [("5", "a secret place", "UNKNOWN", 3), ("5", "nothing", "UNKNOWN", 1), ("5", "nothing", "UNKNOWN", 1), ("None", "", "ALLOW", 0), ("None", "a secret place", "UNKNOWN", 3), ("None", "calm", "ALLOW", 1)]


def test_versions_and_catalog(spark, tmp_path):
    row = lambda w, a, i: (w, w, "c", "seed", 90 if a == "BLOCK" else 0, a, 0.9, "", i)
    black, white = spark.createDataFrame([row("alpha", "BLOCK", 1)], TERM), spark.createDataFrame([row(w, "ALLOW", i) for i, w in enumerate(["beta", "bela", "berta"])], TERM)
    combos = spark.createDataFrame([("a b", "a b", "c", "s", "High", 90, "BLOCK", 0.9, "")], src.COMBINATION)
    path = str(tmp_path)
    assert store.current(spark, path) == 0
    assert store.ensure(spark, path, lambda: (black, white, combos)) and not store.ensure(spark, path, lambda: None)
    catalog = store.Catalog(spark, path)
    assert [r.display_term for r in catalog.suggest("be").collect()] == ["beta", "bela", "berta"] and not catalog.refresh()
    assert catalog.classify_text("beta a b")["action"] == "BLOCK" and catalog.browse("blacklist")["total"] == 1
    answer = catalog.override("Beta", "BLOCK")
    assert answer["version"] == store.current(spark, path) == 2
    assert [r.display_term for r in catalog.suggest("be").collect()] == ["bela", "berta"]
    assert [r.term for r in store.lists(spark, path)["blacklist"].orderBy("ord").collect()] == ["alpha", "Beta"]
    assert [(r.term, r.action) for r in store.history(spark, path).collect()] == [("Beta", "BLOCK")]
    docs = spark.createDataFrame([(1, "beta")], "id long, text string")
    assert catalog.validate(docs).first().overall_status == "BLOCK" and catalog.classify(docs, False).first().action == "BLOCK"
    assert src.read_csv(spark, f"{path}/versions/2/blacklist_words", "term string").count() == 2
    patterns = spark.createDataFrame([(0, "x", "zzz")], "rule_ord int, category string, pattern string")
    assert src.read_csv(spark, store.review_file(spark, path, patterns), src.REVIEW).count() == 4
    with pytest.raises(ValueError):
        catalog.override("--", "BLOCK")
    with pytest.raises(KeyError):
        catalog.browse("nope")


def test_entry_and_bench_without_the_optional_package(tmp_path):
    """A copy without the training-data package, its tests and the pipeline imports and keeps its queries."""
    code = """
import sys, importlib.abc
class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("termloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name == "corpus_pipeline" or name.startswith("termloom.llm") else real(name, package)
import __spark_entry__ as e, bench
names = set(e.queries())
assert len(names) >= 60 and not any(n.startswith("op") or n == "pipeline" for n in names - {"overrides_applied"}), names
assert set(e.oracle_sql()) <= names
assert not [m for m in sys.modules if m.startswith("termloom.llm")]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"}, timeout=120)

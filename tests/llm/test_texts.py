"""Scoring and extracting operators: held-out quality, brute force, round trips, odd inputs."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import tiktoken

from termloom.llm import bpe, decontaminate, langid, licences, pii, quality, toxicity

from .conftest import SF

SF2 = "/root/testdata/sf0.01"


def read(sf, name):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def auc(score, y):
    p, n = score[y == 1].to_numpy(), score[y == 0].to_numpy()
    return ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2).item()


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op1_toxicity, "toxic", 0.9), (quality.op6_quality, "quality", 0.97)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    got = query(spark, SF2).toPandas()
    assert len(got) == len(read(SF2, "documents")) and got.score.between(0, 1).all()
    held = got[got.held_out].merge(read(SF2, "labels"), on="doc_id")
    assert auc(held.score, held[label]) >= least


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels(odd_docs, no_docs, module, label):
    model = module.Model([])
    got = {r.doc_id: r.score for r in module.score(odd_docs, model).collect()}
    assert len(got) == 10 and all(0 <= v <= 1 for v in got.values()) and got[2] == got[3]
    assert module.score(no_docs, model).collect() == []
    one = module.Model([(1, "a", 1), (2, "b", 1)])
    assert len(set(one.scores(["x", None, ""]).tolist())) == 1


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=300)
    knots, values = toxicity.isotonic(raw, (raw + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()


def test_language_on_held_out_rows(spark):
    got = langid.op4_langid(spark, SF2).toPandas().merge(read(SF2, "documents"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98 and got.score.between(0, 1).all()


def test_language_odd_inputs(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert [got[i].lang_pred for i in (2, 3, 7, 8)] == ["und"] * 4 and got[2].rejected and got[2].score == 0
    assert got[1].lang_pred == "en" and not got[4].rejected
    assert langid.identify(no_docs, model).collect() == [] and langid.accepted(odd_docs, model).columns == odd_docs.columns
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    alphabet = langid.Alphabet("abc")
    text = alphabet.symbols("abc cab bca abc aab")
    counts = [[tuple(np.unique(langid.grams(text, n, alphabet.size), return_counts=True)) for n in range(1, langid.ORDER + 1)]]
    model = langid.Model(["xx"], alphabet, counts)
    for context in ("abc ", "a", "cc"):
        total = 0.0
        base = np.concatenate([alphabet.symbols(context)[:-1]])
        for s in range(alphabet.size):
            row = np.append(base, np.uint64(s)).astype(np.uint64)
            whole, head = model.entropies(row) * (len(row) - 1), (model.entropies(base) * (len(base) - 1) if len(base) > 1 else 0)
            total += float(np.exp(-(whole - head))[0])
        assert abs(total - 1) < 1e-3


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.read_ranks(path)
    return path, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("words", [5, 1 << 12])
def test_bpe_against_library(spark, vocabulary, words):
    path, pattern, enc = vocabulary
    rng = random.Random(1)
    letters = "abcdefgh ééß日本\n\t  '\x1c\x85　᠎1²Ⅷ👍.,!?__ЖﬁŁ̀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", "a" * 3000 + "!" * 700, "the " * 50 + "  \n\n x's 'll <|endoftext|>", *read(SF, "documents").text.head(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as n", "'y' as word")
    got = {r.doc_id: r for r in bpe.digests(bpe.encoded(df, path, pattern, words)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_empty_table(vocabulary, no_docs):
    assert bpe.encoded(no_docs, *vocabulary[:2]).collect() == []


def test_merges_agree(vocabulary):
    ranks = bpe.read_ranks(vocabulary[0])
    rng = random.Random(2)
    for _ in range(500):
        w = bytes(rng.choice(b"abcdeinorst \xc3\xa9") for _ in range(rng.randrange(1, 40)))
        assert bpe.merged(w, ranks) == bpe.merged_short(w, ranks)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            g, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in g.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii_scanners():
    rng = random.Random(3)
    for _ in range(20_000):
        s = "".join(rng.choice("a1@.+- (4)2.0@b5%_é") for _ in range(rng.randrange(1, 40)))
        assert pii.base(s) == brute(s), s
    for t in read(SF2, "documents").text:
        assert pii.base(t) == brute(t)
    assert pii.base("1" * 200_000) == [] and pii.base("a@" * 50_000) == [] and pii.base("+1(" * 50_000) == []


def test_pii_query(spark):
    got = pii.op7_pii(spark, SF).toPandas().merge(read(SF, "documents"), on="doc_id")
    for r in got.itertuples():
        spans = brute(r.text)
        listed = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""} and r.n_email == sum(k == "email" for k, _, _ in spans)


def test_pii_learns_contexts(spark):
    docs = [(i, f"please email me at user{i}@site.org today") for i in range(8)] + [(100, "please email me at bob99999(at)site.org today"), (101, "weight 1234567 kg")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.find(df).collect() if r.added}
    assert added == {100: [("email", 19, 39)]}
    assert pii.masked("a bob@x.org b", [("email", 2, 11)]) == "a [EMAIL] b"


def test_pii_odd_inputs(odd_docs, no_docs):
    assert {r.doc_id for r in pii.find(odd_docs).collect()} == set(range(1, 11)) and pii.find(no_docs).collect() == []


def test_licences(spark, odd_docs, no_docs):
    texts = [
        "Some prose.\nReleased under the MIT License.\nMore.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "He lost his driving license in version three of the test.", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(f.family, f.start, f.end) for f in r.findings] for r in licences.licences(df).collect()}
    assert got == {0: [("mit", 12, 43)], 1: [("proprietary", 0, 20)], 2: [("gpl-3.0", 0, 70)], 3: [("cc-by-nc", 0, 28), ("apache-2.0", 29, 76)], 4: [], 5: [], 6: []}
    assert all(not r.findings for r in licences.licences(odd_docs).collect()) and licences.licences(no_docs).collect() == []


def test_licences_on_documents(spark):
    got = licences.op8_licences(spark, SF2).toPandas().merge(read(SF2, "documents"), on="doc_id")
    lines = ["Released under the MIT License.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3."]
    assert ((got.n_licences > 0) == got.text.map(lambda t: any(x in t for x in lines))).all()


def edits(a, b):
    """Least edits of a to a substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contamination_against_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((1, 3, 5, 8, 12, 25, 40))] + [(90, ""), (91, None)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(60)]
        part = (rng.choice(items[:7])[1]).split()
        for _ in range(rng.randrange(0, max(1, len(part) // 3 + 1))):
            p = rng.randrange(len(part))
            part[p : p + 1] = rng.choice([[], ["zzz"], [part[p], "yyy"]])
            part = part or ["zzz"]
        docs.append((i, " ".join(w[:30] + part + w[30:])))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    want = {}
    for i, t in docs:
        for k, x in items:
            n = len((x or "").split())
            if n and (e := edits(x.split(), t.split())) <= int(0.2 * n):
                want[i, k] = e
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.02 * len(want)
    assert all(got[p] >= want[p] for p in got)


def test_contamination_odd_inputs(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "plain text here"), (None, "x"), (2, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, bench).collect()} == {(1, 1), (6, 1)}
    assert decontaminate.contaminated(no_docs, bench).collect() == [] and decontaminate.contaminated(odd_docs, bench.limit(0)).collect() == []
    assert decontaminate.tables(0.99, 0.5, 1) == 7

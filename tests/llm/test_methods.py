"""The methods inside the operators: transforms and their merge, recall of the LSH, batches, linear scanners, licence notices."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from termloom.llm import decontaminate, langid, licences, nearcopies, pii, substrings, topk, toxicity

from .conftest import SF


def contexts(bodies, h=0, c=None):
    n = len(bodies)
    own = {"h": np.full(n, h, np.uint64), "c": np.arange(n, dtype=np.uint64) if c is None else np.array(c, np.uint64), "doc": np.arange(n), "row": np.arange(n), "pos": np.array([len(b) - 100 for b in bodies])}
    return own | {"lo": np.zeros(n, np.uint8), "hi": np.array([len(b) - 100 for b in bodies], np.uint8)}


def repeats(bodies):
    seen, rows = set(), []
    for i, b in enumerate(bodies):
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                rows.append((i, s, s + 100))
            seen.add(b[s : s + 100])
    return substrings.union_of({k: np.array([r[j] for r in rows], np.int64) for j, k in enumerate(("row", "start", "end"))})


def some_contexts(rng):
    base = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(100, 169))) for _ in range(rng.randrange(1, 12))]
    return [rng.choice(base)[: rng.randrange(100, 169)] for _ in range(rng.randrange(1, 40))]


def test_transforms_invert_and_merge():
    rng = random.Random(1)
    for _ in range(30):
        bodies = some_contexts(rng)
        edges = [0, *sorted(rng.randrange(0, len(bodies) + 1) for _ in range(3)), len(bodies)]
        shards = [bodies[a:b] for a, b in zip(edges, edges[1:]) if b > a]
        merge = substrings.Merge(contexts(bodies), [len(s) for s in shards], np.concatenate([substrings.transforms(s, np.zeros(len(s), np.int64))[0] for s in shards]))
        assert [merge.bytes_of(i) for i in range(len(bodies))] == bodies
        got, want = merge.repeated(), repeats(bodies)
        assert all(got[k].tolist() == want[k].tolist() for k in want)


def test_transform_is_the_sorted_order():
    bodies = [b"banana" * 20, b"bandana" * 18]
    bwt, _ = substrings.transforms(bodies, np.zeros(2, np.int64))
    suffixes = sorted((b[i:] + b"\xff", k, i) for k, b in enumerate(bodies) for i in range(len(b) + 1))
    assert bwt.tobytes() == bytes(bodies[k][i - 1] if i else 255 for _, k, i in suffixes)


@pytest.mark.parametrize("first_is_member", [False, True])
def test_equal_hashes_of_different_bytes(first_is_member):
    """Contexts that claim to be copies, all by one hash: only bytes decide."""
    rng = random.Random(3)
    for _ in range(20):
        bodies = [b[:130].ljust(130, b"a") for b in some_contexts(rng)]
        x = contexts(bodies, c=[9] * len(bodies))
        pick = lambda own: substrings.packed(substrings.ANCHOR, {k: x[k][own] for k, _ in substrings.ANCHOR})
        model = substrings.transforms(bodies[:1], np.zeros(1, np.int64))[0].tobytes() if first_is_member else bodies[0]
        kinds = [substrings.MEMBERS if first_is_member else substrings.MODELS, substrings.COPIES]
        got = substrings.resolved(kinds, [pick(slice(0, 1)), pick(slice(1, None))], [model, b"".join(bodies[1:])])
        want = repeats(bodies)
        assert all(got[k].tolist() == want[k].tolist() for k in want)


def test_recall_of_candidates_at_the_edit_limit():
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    rows = list(zip(items.item_id, items.text))
    rng = random.Random(1)
    texts, want = [], []
    for i, t in rows:
        w = decontaminate.WORD.findall(t.lower())
        for _ in range(8):
            v = list(w)
            for _ in range(int(0.2 * len(w))):
                p = rng.randrange(len(v))
                v[p : p + 1] = rng.choice([["zzq"], [v[p], "zzq"], []])
            texts.append("qq " * 30 + " ".join(v) + " qq" * 50)
            want.append((len(texts) - 1, i))
    found = [{(t, i) for t, i, *_ in decontaminate.Index(rows, bound=b).find(texts)} for b in (True, False)]
    assert found[0] == found[1]  # the bound loses nothing
    assert sum(p in found[1] for p in want) >= 0.97 * len(want)


def test_blocks_of_items(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parts = ({tuple(r) for r in decontaminate.contaminated(docs, bench, n).collect()} for n in (20_000, 7))
    assert {r[:2] for r in whole} == {r[:2] for r in parts} and whole


def test_top_k_in_batches(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = topk.quantised(df, "vec_id", "embedding")
    whole, parts = (topk.top_k(rows, rows.where("id % 7 = 0"), 3, batch_bytes=b) for b in (32 << 20, 4000))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Join" not in plan
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}


def test_scanners_take_time_in_proportion():
    texts = ["a." * 500_000, " at ".join(["xxxxx"] * 150_000), "a" * 1_000_000, "x@" * 400_000, "a----" * 200_000, "a(at)" * 200_000 + " dot ", "a1" * 500_000, "a at " * 200_000 + "b dot c", "é" * 1_000_000 + "+4912345678"]
    for t in texts:
        began = time.process_time()
        pii.others(t, pii.base(t))
        toxicity.Features({}).of(t)
        assert time.process_time() - began < 10, t[:20]


def test_contexts_and_long_identifiers():
    assert pii.contexts("call  Office 12: 555", 17) == ["1|:", "2|0 :"]
    assert pii.contexts("line one\nat 555", 12) == ["1|at"] and pii.contexts("555", 0) == []
    long = "x" * 300 + "@" + "y" * 300
    assert pii.others(f"see {long} now", []) == [(4, 4 + len(long))]
    assert pii.contexts("é" * 500 + " 12345", 501) == ["1|" + "é" * 500]


def test_learned_contexts_on_a_corpus(spark):
    """Planted table: contexts of known kinds hold unseen identifiers, random contexts hold numbers that are none."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, want = [], {}
    for i in range(1500):
        lead, kind = rng.choice([("reach us by mail", "email"), ("ring the desk on", "phone"), ("host at address", "ip")])
        known = {"email": f"u{i}@site{i % 90}.org", "phone": f"+49 30 {rng.randrange(10**6, 10**7)}", "ip": f"10.{i % 256}.3.{i % 200}"}[kind]
        odd = {"email": f"u{i} (at) site{i % 90} (dot) org", "phone": f"030 {rng.randrange(10**6, 10**7)}", "ip": f"10-{i % 256}-3-{i % 200}-{rng.randrange(10**4, 10**5)}"}[kind]
        text = f"{word()} {word()} {lead} "
        if i % 5 == 0:
            want[i] = (kind, len(text), len(text) + len(odd))
            rows.append((i, f"{text}{odd} {word()}"))
        elif i % 5 == 1:
            rows.append((i, f"{word()} {word()} {rng.randrange(10**5, 10**6)} {word()}"))
        else:
            rows.append((i, f"{text}{known} {word()}"))
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.added}
    right = sum(found.get(i) == [s] for i, s in want.items())
    assert right >= 0.95 * len(want) and sum(len(f) for i, f in found.items() if i not in want) <= 0.01 * len(rows)


@pytest.fixture(scope="module")
def licence_model():
    return licences.Model()


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("The tool was written by many people. It is released under the MIT License and can be found on the web.", ["mit"]),
        ("MIT License or the Apache License, Version 2.0", ["apache-2.0", "mit"]),
        ("You should have received a copy of the GNU General\nPublic License along with this program. If not, see <http://www.gnu.org/licenses/>.", ["gpl-3.0"]),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", ["bsd-2-clause"]),
        ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available here", ["epl-2.0"]),
        ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it freely", ["zlib"]),
        ("Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, for any purpose, commercial or non-commercial", ["unlicense"]),
        ("a few words and more " * 40 + "Licensed under the Mozilla Public License 2.0 " + "and then other words " * 40, ["mpl-2.0"]),
        ("She lost her licence to drive and paid the fine in two parts.", []),
        ("The public library is free for any person, without restriction, subject to the rules.", []),
        ("Neither party may assign this agreement without prior written consent.", []),
        ("The apache warriors crossed the river at version two of the bridge.", []),
        ("The general public was permitted to copy the notice at the door.", []),
    ],
)
def test_licence_notices(licence_model, text, families):
    assert sorted({f for f, *_ in licence_model.scan(text)}) == families


def test_licences_precision_and_recall(licence_model):
    """Every template inside ordinary sentences; ordinary sentences alone."""
    rng = random.Random(8)
    right = total = 0
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            total += 1
            text = " ".join([*rng.sample(licences.ORDINARY, 2), t, *rng.sample(licences.ORDINARY, 2)])
            right += family in {f for f, *_ in licence_model.scan(text)}
    assert right >= 0.9 * total
    assert not any(licence_model.scan(" ".join(rng.sample(licences.ORDINARY, 3))) for _ in range(100))


def test_language_limits_come_from_uncounted_texts(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 7)))
    rows = [(i, " ".join(word("abcdef" if i % 2 else "uvwxyz") for _ in range(60)), "aa" if i % 2 else "zz") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(" ".join(word("abcdef") for _ in range(80)))[::3] == ("aa", False)
    assert model.predict("qkqk jqjk " * 20)[3]


def test_jaccard_by_words():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.choice([b"a", b"x"])
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
        assert nearcopies.similar(a, b) == (a == b if min(len(a), len(b)) < 5 else 5 * len(x & y) >= 4 * len(x | y))
        assert len(nearcopies.shingles(a)) == len(x)

import hashlib

import pandas as pd
import tiktoken

import corpus_pipeline
from termloom.llm import bpe, pii, simhash

from .conftest import SF
from .test_pairs import classes


def test_stages_keep_columns(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id for r in docs.collect()} == {1, 4, 9, 10}


def test_pipeline_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()
    fps = [simhash.fingerprint(t) for t in docs.text]
    comp = classes(docs.doc_id.tolist(), fps)
    kept = [(d, t) for d, t in zip(docs.doc_id, docs.text) if comp[d] == d and not any(b in t for b in bench)]
    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {d: (len(enc.encode_ordinary(m)), hashlib.sha256(m.encode()).hexdigest()) for d, t in kept for m in [pii.masked(t, pii.base(t))]}
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want

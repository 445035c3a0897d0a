"""The pipeline's rows against brute force, near copies by five-word shingles and Jaccard 0.8."""

import hashlib

import pandas as pd
import tiktoken

import corpus_pipeline
from termloom.llm import bpe, pii

from .conftest import SF
from .test_nearcopies import first_of_classes


def test_pipeline_against_brute_force_jaccard(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    kept = [rows[i] for i in first_of_classes(rows) if not any(b in rows[i][1] for b in bench)]
    path, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {d: (len(enc.encode_ordinary(m)), hashlib.sha256(m.encode()).hexdigest()) for d, t in kept for m in [pii.masked(t, pii.base(t))]}
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want

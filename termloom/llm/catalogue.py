"""Queries of the training-data operators."""

from __future__ import annotations

from . import bpe, decontaminate, langid, licences, pii, quality, simhash, substrings, topk, toxicity

MODULES = [toxicity, substrings, bpe, langid, topk, quality, pii, licences, simhash, decontaminate]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

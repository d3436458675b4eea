"""All queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from motionweave.llm import bpe, decontaminate, fim, html, langid, merkle, ngram_lm, packing, quality_model, quality_rules, shards, simhash, warc

_MODULES = (shards, ngram_lm, decontaminate, simhash, warc, langid, quality_model, quality_rules, bpe, html, fim, packing, merkle)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}

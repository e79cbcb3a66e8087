"""Queries and SQL of this subpackage, and the pipeline over it."""

from __future__ import annotations

from sparkdocket.llm import decontaminate, embed_dedup, exact_dedup, jaccard_join, langid, lexical, pieces, pii, pipeline, quality, spelling, toxicity, url_filter, warc

_MODULES = [quality, toxicity, decontaminate, pieces, warc, langid, jaccard_join, embed_dedup, pii, url_filter, lexical, spelling, exact_dedup]


def queries() -> dict:
    out = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
    out["pipeline"] = pipeline.run
    return out


def oracle_sql() -> dict:
    out = {k: s for m in _MODULES for k, s in m.ORACLE.items() if s}
    if pipeline.ORACLE_SQL:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out

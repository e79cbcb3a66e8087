"""Corpus preparation in five stages, each written as Parquet and read again.

The stages are in ``sparkdocket.llm.pipeline``: language ID, n-gram Jaccard join,
benchmark decontamination, PII, SentencePiece samples.  Each takes ``(spark, docs,
sf_dir)`` and works on all that the stage before it kept.
"""

from __future__ import annotations

from sparkdocket.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

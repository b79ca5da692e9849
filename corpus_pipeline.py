"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination and packing over documents, each stage written as
Parquet and read again by the next one. The stages are in skerry/llm/pipeline.py."""

from __future__ import annotations

from skerry.llm.pipeline import STAGES, run

ORACLE_SQL = None  # held against brute force, stage by stage, in tests/llm/test_pipeline.py

__all__ = ["ORACLE_SQL", "STAGES", "run"]

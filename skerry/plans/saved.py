"""Saved analyses: queries as JSON, run again over whatever revision is current."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame

from skerry.operators.registry import digest
from skerry.plans.adhoc import Filter, Measure, Query, run, validate


def saved(q: Query) -> str:
    return json.dumps(asdict(q), sort_keys=True)


def loaded(text: str) -> Query:
    d = json.loads(text)
    return Query(**d | {"measures": [Measure(**m) for m in d["measures"]], "filters": [Filter(**f) for f in d["filters"]]})


def rerun(df: DataFrame, text: str) -> dict:
    """Rows and their digest: the same data and query give the same digest."""
    q = loaded(text)
    validate(df, q)
    rows = run(df, q).collect()  # 500 rows at most
    return {"rows": [r.asDict() for r in rows], "sha256": digest(rows)}

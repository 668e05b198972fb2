"""Retention plan (H13): what to delete and what that frees. Deleting is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from marktrace.operators.aggregates import retention_totals
from marktrace.operators.windows import retention_marks


def retention_plan(files: DataFrame, keys: Sequence[str], now_ms: Column, max_age_ms: int, max_bytes: int, grace_ms: int) -> tuple[DataFrame, DataFrame]:
    """(one row per file with the rule that removes it, totals per key)."""
    marks = retention_marks(files, keys, now_ms, max_age_ms, max_bytes, grace_ms)
    return marks, retention_totals(marks, keys)

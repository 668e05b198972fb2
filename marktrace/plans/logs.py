"""Log analytics over raw lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.functions.text import log_source, redact
from marktrace.operators.aggregates import log_counters
from marktrace.sources.readers import parse_log_lines


def log_analytics(lines: DataFrame, tags: dict[str, str], modules: dict[str, str], known_secrets: Sequence[str] = (), column: str = "value") -> DataFrame:
    """Parse, categorise and mask; the written source is the module name."""
    logs = parse_log_lines(lines, column)
    return logs.withColumns({"source": log_source(F.col("msg"), F.col("source"), tags, modules), "msg": redact(F.col("msg"), known_secrets)})


def log_report(logs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return log_counters(logs, patterns, ["source"])

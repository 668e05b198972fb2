"""Schema evolution (M1-M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """Integrity columns are absent; ``columns`` lists them."""

    def __init__(self, columns: list[str]):
        super().__init__(f"missing required columns: {', '.join(columns)}")
        self.columns = columns


def ensure_columns(df: DataFrame, spec: T.StructType) -> tuple[DataFrame, list[str]]:
    """M1: add absent optional columns as NULL; returns what was added. Running it twice adds nothing."""
    added = [f for f in spec.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}) if added else df, [f.name for f in added]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M2: refuse to go on without the integrity columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(missing)
    return df


def backfill_session_keys(df: DataFrame, ident: str = "id", key: str = "session_id") -> DataFrame:
    """M3: rows without a key get ``legacy-<id>``; keyed rows stay. Row count is preserved."""
    if key not in df.columns:
        df = df.withColumn(key, F.lit(None).cast("string"))
    legacy = F.concat(F.lit("legacy-"), F.col(ident).cast("string"))
    return df.withColumn(key, F.when(F.coalesce(F.trim(key), F.lit("")) == "", legacy).otherwise(F.col(key)))


def backfill_report(df: DataFrame, key: str = "session_id") -> DataFrame:
    """M3 dry run: what a backfill would change."""
    have = F.coalesce(F.trim(F.col(key)), F.lit("")) != "" if key in df.columns else F.lit(False)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~have).alias("to_fill"))


__all__ = [n for n in dir() if not n.startswith("_")]

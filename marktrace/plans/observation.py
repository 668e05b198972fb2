"""Production observation report (H5): independent scans, each reduced to one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.functions.tags import SENTINELS, is_real
from marktrace.operators import aggregates as A
from marktrace.operators.joins import confusable_conflicts


def observation_report(edges: DataFrame, suppressed: DataFrame, sessions: DataFrame, engines: DataFrame, pairs: DataFrame, planned_hours: float, build: str) -> DataFrame:
    """One metrics row.

    edges: ts_ms, edge_type, decision, since_rising_ms; suppressed: decision; sessions: session_id,
    identifier, status, image_path; engines: session_id, text, latency_ms; pairs: a, b.
    """
    e = A.edge_totals(edges)
    gaps = A.interval_summary(edges, [], "since_rising_ms").select(F.col("min_s").alias("min_interval_s"), F.col("median_s").alias("median_interval_s"), F.col("max_s").alias("max_interval_s"))
    sup = suppressed.agg(F.count(F.lit(1)).alias("suppressed"))
    failed = F.col("status").isin("NO_READ", "TIMEOUT", "OCR_AMBIGUOUS") & (F.coalesce(F.trim("image_path"), F.lit("")) == "")
    s = sessions.agg(F.count(F.lit(1)).alias("records"), F.count_if(failed).alias("missing_evidence"))
    dup = sessions.filter(is_real(F.col("identifier"), SENTINELS)).groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    lat = A.latency_summary(engines, [], "latency_ms").select(F.col("mean").alias("mean_latency_ms"), F.col("p95").alias("p95_latency_ms"))
    clash = confusable_conflicts(engines, ["session_id"], "text", pairs).agg(F.count(F.lit(1)).alias("conflicts"))
    span = A.observation_status(edges, "ts_ms", planned_hours, build)
    out = e
    for part in (gaps, sup, s, dup, lat, clash, span):
        out = out.join(F.broadcast(part))  # every part is one aggregated row
    return out

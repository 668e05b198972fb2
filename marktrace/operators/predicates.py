"""Row filters over sessions, logs, detections and curation items (F1-F3, F5, F7-F12) and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktrace.functions.text import is_strict
from marktrace.functions.times import end_of_bound


@dataclass(frozen=True)
class HistoryFilter:
    """Blank text and 0 mean: no such filter."""

    identifier: str = ""
    tag: str = ""
    model: str = ""
    min_confidence: float = 0.0
    start: str = ""
    end: str = ""


@dataclass(frozen=True)
class HistoryColumns:
    identifier: str = "detected_vin"
    raw: str = "raw_vin"
    tag: str = "rfid_epc"
    tag_raw: str = "rfid_raw"
    model: str = "model"
    confidence: str = "confidence"
    ts: str = "timestamp"


def history(df: DataFrame, f: HistoryFilter, c: HistoryColumns = HistoryColumns()) -> DataFrame:
    """optional predicates combined with AND. Substrings are literal; a date-only end includes its day."""
    out = df
    if f.identifier:
        needle = F.lit(f.identifier.upper())
        out = out.filter(F.contains(F.upper(c.identifier), needle) | F.contains(F.upper(c.raw), needle))
    if f.tag:
        needle = F.lit(f.tag.upper())
        out = out.filter(F.contains(F.upper(c.tag), needle) | F.contains(F.upper(c.tag_raw), needle))
    if f.model:
        out = out.filter(F.col(c.model) == f.model.upper())
    if f.min_confidence:
        out = out.filter(F.col(c.confidence) >= f.min_confidence)
    kind = dict(df.dtypes)[c.ts]
    if f.start:
        out = out.filter(F.col(c.ts) >= F.lit(f.start).cast(kind))
    if f.end:
        out = out.filter(F.col(c.ts) <= F.lit(end_of_bound(f.end)).cast(kind))
    return out


# Log levels in ascending order.
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")


def log_query(logs: DataFrame, source: str = "", level: str = "", text: str = "", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """source ERROR means any level from ERROR up; text matches message or source."""
    out = logs
    if source == "ERROR":
        out = out.filter(level_rank(F.col("level")) >= LEVELS.index("ERROR") + 1)
    elif source:
        out = out.filter(F.col("source") == source)
    if level:
        out = out.filter(F.col("level") == level)
    if text:
        needle = F.lit(text.lower())
        out = out.filter(F.contains(F.lower("msg"), needle) | F.contains(F.lower("source"), needle))
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    return out if end is None else out.filter(F.col("ts") <= end)


@dataclass(frozen=True)
class IdentifierPolicy:
    length: int = 17
    charset: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    min_confidence: float = 0.5
    min_crops: int = 1
    allow_unknown: bool = False


def identifier_reasons(text: Column, confidence: Column, crops: Column, p: IdentifierPolicy) -> Column:
    """reasons why the identifier fails the policy; an empty array means it passes."""
    seq = F.upper(F.coalesce(text, F.lit("")))
    allowed = F.array(*[F.lit(ch) for ch in p.charset])
    chars = F.filter(F.split(seq, ""), lambda ch: ch != "")
    bad = F.array_sort(F.array_except(chars, allowed))
    length = F.when((F.length(seq) != p.length) & F.lit(p.length > 0), F.concat(F.lit("length="), F.length(seq), F.lit(f"!={p.length}")))
    charset = F.when(F.size(bad) > 0, F.concat(F.lit("charset_violation="), F.array_join(bad, "")))
    low = F.when(confidence < p.min_confidence, F.concat(F.lit("confidence="), F.format_string("%.3f", confidence), F.lit(f"<{p.min_confidence:.3f}")))
    few = F.when(crops < p.min_crops, F.concat(F.lit("crops="), crops.cast("string"), F.lit(f"<{p.min_crops}")))
    parts = [length, low, few] if p.allow_unknown else [length, charset, low, few]
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def detector_gate(detections: DataFrame, session: Sequence[str], frame: Sequence[str], conf: str, collect: float, trigger: float, submit: float) -> DataFrame:
    """best detection per frame, whether it triggers, and whether the session's peak may be submitted."""
    kept = detections.filter(F.col(conf) >= collect)
    best = kept.groupBy(*session, *frame).agg(F.max(conf).alias("best_conf"), F.count(F.lit(1)).alias("n_kept"))
    peak = best.groupBy(*session).agg(F.max("best_conf").alias("peak_conf"))
    out = best.join(peak, list(session))
    return out.withColumns({"triggers": F.col("best_conf") >= trigger, "submits": F.col("peak_conf") >= submit})


def pending_review(items: DataFrame) -> DataFrame:
    """F8."""
    return items.filter(F.col("review_status") == "PENDING")


def importable(items: DataFrame, supported: str) -> DataFrame:
    """accepted, trusted label and supported class."""
    c = F.coalesce(F.col("expected_character"), F.lit(""))
    ok = (F.col("review_status") == "ACCEPTED") & (F.col("label_status") == "TRUSTED_LABEL")
    return items.filter(ok & (c != "") & F.contains(F.lit(supported), c))


def label_tiers(rows: DataFrame, include_silver: bool = True) -> DataFrame:
    """gold = verified strict label; silver = accepted, agreeing, strict engine text. Unknown split -> train."""
    split = F.when(F.col("split").isin("train", "validation", "test"), F.col("split")).otherwise("train")
    base = rows.withColumn("split", split)
    gold_ok = F.coalesce(F.col("verification_status").isin("verified", "ok", "train") & is_strict(F.col("verified_vin")), F.lit(False))
    gold = base.filter(gold_ok).withColumns({"label": F.col("verified_vin"), "tier": F.lit("gold")})
    if not include_silver:
        return gold
    silver_ok = (F.col("ocr_status") == "ACCEPT") & (F.col("agreement") == "yes") & is_strict(F.col("ocr_suggested_vin"))
    silver = base.filter(~gold_ok & silver_ok).withColumns({"label": F.col("ocr_suggested_vin"), "tier": F.lit("silver")})
    return gold.unionByName(silver)


def finalised_reviews(rows: DataFrame) -> DataFrame:
    """F11."""
    status = F.lower(F.trim("verification_status"))
    return rows.filter(status.isin("verified", "ok", "train") & is_strict(F.col("verified_vin")))


def missing_evidence(sessions: DataFrame, status: str = "status", path: str = "image_path", failures: Sequence[str] = ("NO_READ", "TIMEOUT", "OCR_AMBIGUOUS")) -> DataFrame:
    """failed sessions without an evidence path."""
    return sessions.filter(F.col(status).isin(list(failures)) & (F.coalesce(F.trim(path), F.lit("")) == ""))


def sorted_page(df: DataFrame, column: str, ascending: bool, tie: str, limit: int, offset: int = 0, allowed: Sequence[str] | None = None) -> DataFrame:
    """One whitelisted sort column with a tiebreak, then a page. Spark plans a top-k, not a full sort."""
    if allowed is not None and column not in allowed:
        raise ValueError(f"cannot sort by {column}")
    key = F.col(column).asc() if ascending else F.col(column).desc()
    ordered = df.orderBy(key, F.col(tie))
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def top_counts(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """L4: the most frequent key combinations."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), *keys).limit(n)


__all__ = [n for n in dir() if not n.startswith("_")]

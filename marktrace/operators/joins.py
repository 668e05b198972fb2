"""Correlation joins (J1-J15). Hot keys are salted after a count; matches are never capped."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.operators.ordered import hot_groups, null_safe_join


def skew_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Keys above the slice size are spread over salts on the left and repeated per salt on the right, for
    those keys only. At most MAX_SLICES keys can be that large, so the salt table is small.
    """
    limit, hot = hot_groups(big, keys)
    if not hot:
        return big.join(lookup, list(keys), how)
    spark = big.sparkSession
    schema = T.StructType([*[big.schema[k] for k in keys], T.StructField("_salts", T.IntegerType())])
    salts = spark.createDataFrame([(*[r[k] for k in keys], math.ceil(r["_n"] / limit)) for r in hot], schema)
    wide = F.coalesce(F.col("_salts"), F.lit(1))
    left = null_safe_join(big, F.broadcast(salts), keys, "left")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), wide).cast("int")).drop("_salts")
    right = null_safe_join(lookup, F.broadcast(salts), keys, "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), wide - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


#: rows a rule table may have to be sent to every task
RULE_ROWS = 100_000


def rule_side(rules: DataFrame) -> DataFrame:
    """A rule table as the side of a join that travels. Its rows are counted: a larger one is sorted and merged.

    Without the hint Spark may take the data for the smaller side, as it does not see how many rows an ``explode`` makes.
    """
    few = rules.limit(RULE_ROWS + 1).count() <= RULE_ROWS
    return F.broadcast(rules) if few else rules.hint("merge")


#: rows dealt to one task
TASK_ROWS = 250_000


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows shuffled by ``keys`` to a number of tasks that follows their number, so that one task's share does not grow."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(df.count() / TASK_ROWS)), *keys)


TERMINAL = ("SUCCESS", "PARTIAL_SUCCESS", "TIMEOUT", "FAILED")


def result_verdict(
    known: Column, finalised_ms: Column, exit_ms: Column, grace_ms: Column, deadline_ms: Column, waiting: Column, active: Column, at_ms: Column, grace_allowed: bool = True
) -> Column:
    """Why a late or foreign result is rejected, or ACCEPTED. A result exactly at a limit still counts."""
    in_grace = F.coalesce(exit_ms <= at_ms, F.lit(False))
    too_late = F.lit(True) if not grace_allowed else at_ms > grace_ms
    return (
        F.when(~known, "UNKNOWN_SESSION")
        .when(F.coalesce(finalised_ms < at_ms, F.lit(False)), "FINALIZED_REJECTED")
        .when(in_grace & too_late, "LATE")
        .when(in_grace, "ACCEPTED")
        .when(F.coalesce(waiting, F.lit(False)), "ACCEPTED")
        .when(~F.coalesce(active, F.lit(True)), "SESSION_MISMATCH")
        .when(at_ms > deadline_ms, "LATE")
        .otherwise("ACCEPTED")
    )


def correlate_results(results: DataFrame, sessions: DataFrame, key: str, grace_allowed: bool = True) -> DataFrame:
    """Join results to their session and classify.

    results: key, at_ms, ...; sessions: key, finalised_ms, exit_ms, grace_ms, deadline_ms, waiting, and
    optionally active_from_ms/active_to_ms (the time the session was the station's active one).
    """
    s = sessions.withColumn("_known", F.lit(True))
    joined = skew_join(results, s, [key], "left")
    active = F.lit(True)
    if "active_to_ms" in sessions.columns:
        active = F.col("at_ms").between(F.col("active_from_ms"), F.col("active_to_ms"))
    verdict = result_verdict(
        F.coalesce(F.col("_known"), F.lit(False)), F.col("finalised_ms"), F.col("exit_ms"), F.col("grace_ms"), F.col("deadline_ms"), F.col("waiting"), active, F.col("at_ms"), grace_allowed
    )
    return joined.withColumn("verdict", verdict).drop("_known")


def verdict_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("verdict")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(v == "ACCEPTED").alias("accepted"),
        F.count_if(v.isin("UNKNOWN_SESSION", "FINALIZED_REJECTED", "LATE")).alias("late"),
        F.count_if(v == "SESSION_MISMATCH").alias("mismatch"),
    )


def range_hits(points: DataFrame, windows: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, bucket_ms: int) -> DataFrame:
    """Points inside windows: equi-join on (keys, time bucket), then the exact bounds. A window is copied
    to the buckets it touches, a point sits in one bucket, hot buckets are salted by ``skew_join``."""
    p = points.withColumn("_bucket", F.floor(F.col(ts) / bucket_ms))
    w = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket_ms), F.floor(F.col(end) / bucket_ms))))
    return skew_join(p, w, [*keys, "_bucket"], "inner").filter(F.col(ts).between(F.col(start), F.col(end))).drop("_bucket")


def strongest_tag(hits: DataFrame, windows: DataFrame, keys: Sequence[str], window_id: str, bucket_ms: int, lead_ms: int = 250, accept: Column | None = None) -> DataFrame:
    """Per window the tag with the highest RSSI among the latest hit of each tag; NULL RSSI ranks last.

    hits: keys, epc, antenna, rssi, ts_ms; windows: keys, window_id, start_ms, end_ms (both inclusive,
    start moved back by ``lead_ms``). Both reductions are partial aggregates.
    """
    good = hits if accept is None else hits.filter(accept)
    w = windows.select(*keys, window_id, (F.col("start_ms") - lead_ms).alias("_from"), F.col("end_ms").alias("_to"))
    inside = range_hits(good, w, keys, "ts_ms", "_from", "_to", bucket_ms)
    row = F.struct("ts_ms", "antenna", "rssi")
    latest = inside.groupBy(*keys, window_id, "epc").agg(F.max_by(row, F.struct("ts_ms", "rssi", "antenna")).alias("h"))
    strength = F.struct(F.coalesce(F.col("h.rssi"), F.lit(float("-inf"))), -F.col("h.ts_ms"), F.col("epc"))
    best = latest.groupBy(*keys, window_id).agg(F.max_by(F.struct("epc", "h"), strength).alias("b"))
    return best.select(*keys, window_id, F.col("b.epc").alias("epc"), F.col("b.h.antenna").alias("antenna"), F.col("b.h.rssi").alias("rssi"), F.col("b.h.ts_ms").alias("ts_ms"))


def stale_reason(read_start: Column, first_seen: Column, tolerance_ms: int) -> Column:
    """STALE when first seen more than the tolerance before the session's read start; 0 disables."""
    if tolerance_ms <= 0:
        return F.lit(None).cast("string")
    return F.when(read_start - first_seen > tolerance_ms, "STALE_RFID_EVENT")


def new_items(batch: DataFrame, known: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """Rows whose key is neither known nor repeated inside the batch (first in ``keep`` order wins)."""
    rest = [c for c in batch.columns if c != key]
    one = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*keep)).alias("_r")).select(key, "_r.*")
    return one.join(known.select(key).distinct(), key, "left_anti")


def accepted_lines(manifest: DataFrame, candidates: DataFrame, key: str, text: str, length: int = 17, n: int | None = None) -> DataFrame:
    """Manifest rows with an accepted candidate of the right length."""
    out = manifest.join(candidates.filter("accepted"), key).filter(F.length(text) == length)
    return out.orderBy(key).limit(n) if n else out


def align_engines(rows: DataFrame, key: str, engine: str, engines: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """One row per session, one column per engine and value (latest by ``order``)."""
    aggs = [
        F.max_by(v, F.when(F.col(engine) == e, F.col(order))).alias(f"{e}_{v}") for e in engines for v in values
    ]
    return rows.groupBy(key).agg(*aggs)


def truth_join(predictions: DataFrame, truth: DataFrame, fallback: Column, name: str = "filename") -> DataFrame:
    """Ground truth by file name, else the truth taken from the name itself."""
    joined = predictions.join(truth.withColumnRenamed("vin", "_truth"), name, "left")
    return joined.withColumn("truth", F.coalesce(F.col("_truth"), F.nullif(fallback, F.lit("")))).drop("_truth")


def rule_flags(chars: DataFrame, rules: DataFrame, keys: Sequence[str] = ("model", "pos", "char")) -> DataFrame:
    """``allowed`` flag per (model, position, character). The rule table is joined by size, not by hint."""
    r = rules.select(*[F.col(a).alias(b) for a, b in zip(("model", "pos", "allowed_char"), keys)]).distinct().withColumn("_hit", F.lit(True))
    return chars.join(r, list(keys), "left").withColumn("allowed", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def symmetric(confusions: DataFrame) -> DataFrame:
    """Confusion neighbours usable in both directions."""
    pairs = confusions.select("char", "alt")
    return pairs.unionByName(pairs.select(F.col("alt").alias("char"), F.col("char").alias("alt"))).distinct()


def expand_confusions(chars: DataFrame, confusions: DataFrame, char: str = "char") -> DataFrame:
    """Each character with its confusable neighbours."""
    c = symmetric(confusions).withColumnRenamed("char", "_from")
    return chars.join(rule_side(c), chars[char] == F.col("_from")).drop("_from")


def confusable_conflicts(engine_texts: DataFrame, keys: Sequence[str], text: str, pairs: DataFrame, ordered: bool = False) -> DataFrame:
    """Positions where two engines read a confusable pair.

    Rows are first counted per (key, position, character): pairs are formed between distinct characters,
    never between rows, so a position yields at most alphabet-many rows however many engines there are.
    """
    chars = engine_texts.select(*keys, F.posexplode(F.split(text, "")).alias("pos", "char")).filter("char <> ''")
    counts = chars.groupBy(*keys, "pos", "char").agg(F.count(F.lit(1)).alias("n"))
    sym = symmetric(pairs.select(F.col("a").alias("char"), F.col("b").alias("alt")))
    left = counts.join(rule_side(sym), "char")
    other = counts.select(*keys, "pos", F.col("char").alias("alt"), F.col("n").alias("n_alt"))
    met = left.join(other, [*keys, "pos", "alt"])
    if not ordered:
        met = met.filter(F.col("char") < F.col("alt"))
    return met.select(*keys, "pos", F.col("char").alias("a"), F.col("alt").alias("b"), (F.col("n") * F.col("n_alt")).alias("clashes"))


FAILED_PRIMARY = ("TIMEOUT", "UNAVAILABLE", "CRASH", "ERROR", "EMPTY")


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, key: str, failures: Sequence[str] = FAILED_PRIMARY) -> DataFrame:
    """The fallback counts only when the primary failed in an enumerated way and the fallback has text."""
    f = fallback.select(key, F.col("status").alias("_fs"), F.col("text").alias("_ft"))
    use = F.col("status").isin(list(failures)) & (F.col("_fs") == "OK") & (F.coalesce(F.col("_ft"), F.lit("")) != "")
    use = F.coalesce(use, F.lit(False))
    return primary.join(f, key, "left").select(
        key,
        F.when(use, F.col("_ft")).otherwise(F.col("text")).alias("text"),
        F.when(use, "OK").otherwise(F.col("status")).alias("status"),
        use.alias("used_fallback"),
        F.coalesce(F.col("text") == F.col("_ft"), F.lit(False)).alias("agree"),
    )


def second_reader_assist(accepted: DataFrame, second: DataFrame, support: DataFrame, key: str, bonus: float = 0.03, enforce: bool = False, min_support: int = 1, shadow: bool = False, fallback: bool = True, support_required: bool = True) -> DataFrame:
    """Agreement raises the score, disagreement keeps or rejects, a failed first reader may be replaced
    by the second one when enough reads support it exactly.

    ``enforce`` rejects on disagreement and replaces without support; ``support_required=False`` only the
    latter; ``fallback=False`` never replaces; ``shadow`` tells the action but leaves text and score alone.

    accepted: key, status, text, score; second: key, second_text, second_avg, usable; support: key, exact_reads.
    """
    j = accepted.join(second, key, "left").join(support, key, "left")
    has = F.coalesce(F.col("usable"), F.lit(False))
    ok = F.col("status") == "ACCEPT"
    same = F.coalesce(F.col("second_text") == F.col("text"), F.lit(False))
    enough = F.coalesce(F.col("exact_reads"), F.lit(0)) >= min_support
    replace = ~ok & has & F.lit(fallback) & (enough | F.lit(enforce or not support_required))
    action = (
        F.when(ok & same, "AGREE")
        .when(ok & has & F.lit(enforce), "REJECT")
        .when(ok, "KEEP")
        .when(replace, "SECOND_ACCEPT")
        .otherwise("NONE")
    )
    score = (
        F.when(ok & same, F.least(F.lit(1.0), F.col("score") + bonus))
        .when(replace, F.least(F.lit(0.99), F.greatest(F.lit(0.55), F.col("second_avg"))))
        .otherwise(F.col("score"))
    )
    if shadow:
        return j.select(key, action.alias("action"), F.col("text").alias("final_text"), F.col("score").alias("final_score"))
    return j.select(key, action.alias("action"), F.when(replace, F.col("second_text")).otherwise(F.col("text")).alias("final_text"), score.alias("final_score"))


def completeness(sessions: DataFrame, ids: DataFrame, tags: DataFrame, key: str, tag_required: bool = True) -> DataFrame:
    """Which results a session has and whether it is complete."""
    a = ids.groupBy(key).agg(F.lit(True).alias("has_id"))
    b = tags.groupBy(key).agg(F.lit(True).alias("has_tag"))
    j = sessions.join(a, key, "left").join(b, key, "left")
    no = F.lit(False)
    j = j.withColumns({"has_id": F.coalesce(F.col("has_id"), no), "has_tag": F.coalesce(F.col("has_tag"), no)})
    return j.withColumn("complete", F.col("has_id") & (F.col("has_tag") | F.lit(not tag_required)))


__all__ = [n for n in dir() if not n.startswith("_")]

"""Reports and evaluation aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktrace.functions.decisions import percent
from marktrace.functions.tags import SENTINELS, is_real
from marktrace.operators.joins import skew_join
from marktrace.operators.ordered import order_rows, running
from marktrace.session import settle


def edge_totals(edges: DataFrame) -> DataFrame:
    """A5 over all stations: one row."""
    d = F.col("decision")
    return edges.agg(
        F.count_if(F.col("edge_type") == "RISING").alias("rising_total"),
        F.count_if(d == "ACCEPTED").alias("accepted"),
        F.count_if(d == "SUSPICIOUS_EARLY_TRIGGER").alias("early"),
        F.count_if(d == "INVALID_PLC_PULSE").alias("invalid_pulse"),
    )


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """A2."""
    return df.groupBy(F.coalesce(F.col(status), F.lit("?")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_excess(df: DataFrame, value: str, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """A3: rows beyond the first per real value."""
    per = df.filter(is_real(F.col(value), list(sentinels))).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def exact_rank_pick(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Exact order statistics: the value at a 1-based rank per key; ``picks`` are rank expressions over ``n``.

    Equal values are counted first and stored, so what is ordered is one row per distinct value and the input is
    read once; ranks come from a running count that also works when one key holds most of the values. The
    result has ``n`` and the mean as ``_mean``.
    """
    values = settle(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    rows = order_rows(values, keys, [value])
    upto = running(rows, sums={"_upto": F.col("_c")}).plain()
    total = values.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("_mean"))
    wanted = total.withColumns({f"_r_{n}": r.cast("long") for n, r in picks.items()})
    joined = skew_join(upto, wanted, keys, "inner") if keys else upto.crossJoin(F.broadcast(wanted))
    # the value whose running count first reaches the rank
    return joined.groupBy(*keys, "n", "_mean").agg(*[F.min(F.when(F.col("_upto") >= F.col(f"_r_{n}"), F.col(value))).alias(n) for n in picks])


def p95_rank(n: Column, rule: str = "floor_n_minus_1") -> Column:
    """Rank of the 95th percentile under either published rule."""
    if rule == "floor_n_minus_1":
        return F.floor(0.95 * (n - 1)) + 1
    return F.greatest(F.floor(0.95 * n), F.lit(1))


def latency_summary(df: DataFrame, keys: Sequence[str], value: str, rule: str = "floor_n_minus_1", digits: int = 1) -> DataFrame:
    """Mean, exact median and p95 per key."""
    n = F.col("n")
    picks = exact_rank_pick(
        df, keys, value, {"lo": F.floor((n + 1) / 2), "hi": F.floor((n + 2) / 2), "p95": p95_rank(n, rule)}
    )
    return picks.select(*keys, "n", F.round("_mean", digits).alias("mean"), F.round((F.col("lo") + F.col("hi")) / 2, digits).alias("p50"), F.round("p95", digits).alias("p95"))


def interval_summary(df: DataFrame, keys: Sequence[str], ms: str) -> DataFrame:
    """Min / median / max of intervals in seconds, blanks skipped."""
    n = F.col("n")
    sec = df.withColumn("_s", F.col(ms).try_cast("double") / 1000.0)
    p = exact_rank_pick(sec, keys, "_s", {"min_s": F.lit(1), "lo": F.floor((n + 1) / 2), "hi": F.floor((n + 2) / 2), "max_s": n})
    return p.select(*keys, F.round("min_s", 2).alias("min_s"), F.round((F.col("lo") + F.col("hi")) / 2, 2).alias("median_s"), F.round("max_s", 2).alias("max_s"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles by rank."""
    n = F.col("n")
    ranks = {}
    for name, p in points.items():
        at = F.lit(p) * (n - 1)
        ranks[f"{name}_lo"] = F.floor(at) + 1
        ranks[f"{name}_hi"] = F.least(F.floor(at) + 2, n)
    picked = exact_rank_pick(df, keys, value, ranks)
    out = []
    for name, p in points.items():
        at = F.lit(p) * (n - 1)
        out.append((F.col(f"{name}_lo") + (at - F.floor(at)) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))).alias(name))
    return picked.select(*keys, *out)


def log_counters(df: DataFrame, patterns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Total, one count per level, one per message pattern."""
    from marktrace.operators.predicates import LEVELS

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("level") == v).alias(f"n_{v.lower()}") for v in LEVELS],
        *[F.count_if(F.col("msg").rlike(p)).alias(n) for n, p in patterns.items()],
    )


def acceptance_report(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Truth, predicted, status -> counts and rates in one pass."""
    accepted = F.col("status") == "ACCEPT"
    right = F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))
    flags = {
        "exact": accepted & right,
        "accepted": accepted,
        "false_accept": accepted & ~right,
        "ambiguous": F.col("status") == "OCR_AMBIGUOUS",
        "no_read": F.col("status") == "NO_READ",
    }
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(n) for n, f in flags.items()])
    return out.withColumns({f"{n}_rate": F.round(F.coalesce(F.col(n) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 4) for n in flags})


def character_confusions(df: DataFrame, truth: str, predicted: str, position: int | None = None) -> DataFrame:
    """(position, truth char, predicted char) error counts over equal-length pairs."""
    pairs = df.filter(F.length(truth) == F.length(predicted)).select(
        F.posexplode(F.arrays_zip(F.split(truth, "").alias("t"), F.split(predicted, "").alias("p"))).alias("pos", "_z")
    )
    out = pairs.select("pos", F.col("_z.t").alias("t"), F.col("_z.p").alias("p")).filter("t <> p")
    if position is not None:
        out = out.filter(F.col("pos") == position)
    return out.groupBy("pos", "t", "p").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from one (truth, predicted) count table."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # each cell feeds its truth class and its predicted class: at most classes^2 small rows
    part = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("as_pred"), F.col("n").alias("as_true")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("as_pred"), F.lit(0).cast("long").alias("as_true")),
    )).alias("x")).select("x.*")
    s = part.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("as_pred").alias("as_pred"), F.sum("as_true").alias("support"))
    zero = F.lit(0.0)
    s = s.withColumns({"precision": F.coalesce(F.col("tp") / F.nullif(F.col("as_pred"), F.lit(0)), zero), "recall": F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), zero)})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero)
    return s.withColumn("f1", f1)


def macro_metrics(per_class: DataFrame, support_policy: str = "in_truth") -> DataFrame:
    """Macro averages over classes present in truth, or over classes seen at all."""
    kept = per_class.filter("support > 0") if support_policy == "in_truth" else per_class.filter("support + as_pred > 0")
    return kept.agg(
        F.round(F.avg("precision"), 6).alias("macro_precision"),
        F.round(F.avg("recall"), 6).alias("balanced_accuracy"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
    )


def top_two(df: DataFrame, truth: str, first: str, second: str, confidence: str) -> DataFrame:
    """Top-1, top-2 accuracy and mean confidence."""
    hit1, hit2 = F.col(truth) == F.col(first), F.col(truth) == F.col(second)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(hit1.cast("double")), 6).alias("top1"),
        F.round(F.avg((hit1 | hit2).cast("double")), 6).alias("top2"),
        F.round(F.avg(confidence), 6).alias("mean_confidence"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row per truth label, one column per predicted label, zeros filled."""
    m = df.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(predicted) == v).alias(str(v)) for v in labels])
    return m


def sequence_metrics(df: DataFrame, truth: str, predicted: str, pattern: str, length: int) -> DataFrame:
    """Exact rate, valid rate, edit-based and position-based character accuracy."""
    from marktrace.functions.text import edit_similarity

    t, p = F.col(truth), F.col(predicted)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(0), lambda a, i: a + F.when((F.substr(t, i, F.lit(1)) == F.substr(p, i, F.lit(1))) & (F.substr(t, i, F.lit(1)) != ""), 1).otherwise(0))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((t == p).cast("double")), 6).alias("exact_rate"),
        F.round(F.avg(p.rlike(pattern).cast("double")), 6).alias("valid_rate"),
        F.round(F.avg(edit_similarity(t, p)), 6).alias("char_accuracy"),
        F.round(F.sum(same) / (F.lit(length) * F.count(F.lit(1))), 6).alias("position_accuracy"),
    )


def plurality(df: DataFrame, keys: Sequence[str], text: str, order: str, min_length: int) -> DataFrame:
    """Most frequent text of at least the given length; ties go to the one seen first."""
    per = df.filter(F.length(text) >= min_length).groupBy(*keys, text).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct(text, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("b"))
    return best.select(*keys, F.col(f"b.{text}").alias("plurality"), F.col("b.n").alias("votes"))


def independent_frames(df: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """A22."""
    return df.groupBy(*keys).agg(F.count_distinct(F.nullif(F.col(digest), F.lit(""))).alias("frames"))


def stage_counters(df: DataFrame, keys: Sequence[str], kind: str, ts: str, kinds: dict[str, str], amount: str | None = None) -> DataFrame:
    """Counters and first occurrence per stage, all in one aggregate."""
    k = F.col(kind)
    one = F.col(amount) if amount else F.lit(1)
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(k == v, one)), F.lit(0)).cast("long").alias(n) for n, v in kinds.items()],
        *[F.min(F.when(k == v, F.col(ts))).alias(f"first_{n}") for n, v in kinds.items()],
    )


def dataset_summary(df: DataFrame, dims: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Counts per value of every dimension by GROUPING SETS in one scan."""
    counted = df.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(e).alias(n) for n, e in (extra or {}).items()], *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return counted.select(name.alias("dimension"), value.alias("value"), "n", *(extra or {}))


def stream_health(df: DataFrame, keys: Sequence[str], ts: str, ok: Column, cost: str) -> DataFrame:
    """Frames, elapsed time, rates, mean cost and failures."""
    span = (F.max(ts) - F.min(ts)) / 1000.0
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return df.groupBy(*keys).agg(
        n.alias("frames"),
        (n - good).alias("failures"),
        F.round(span, 3).alias("elapsed_s"),
        F.round(n / F.nullif(span, F.lit(0.0)), 6).alias("read_rate"),
        F.round(good / F.nullif(span, F.lit(0.0)), 6).alias("decode_rate"),
        F.round(F.avg(cost), 4).alias("mean_ms"),
    )


def task_telemetry(df: DataFrame, keys: Sequence[str], status: str, deadline: Column) -> DataFrame:
    """Task outcomes per job; counts of partial tables can simply be added up."""
    names = {"ok": "OK", "empty": "EMPTY", "timeouts": "TIMEOUT", "crashes": "CRASH", "errors": "ERROR"}
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(n) for n, v in names.items()], F.bool_or(deadline).alias("deadline_hit"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequency, scaled so that the weights sum to the number of classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    scale = counts.agg((F.count(F.lit(1)) / F.sum(1.0 / F.col("n"))).alias("_k"))
    # ``scale`` is a single aggregate row
    return counts.crossJoin(F.broadcast(scale)).select(label, "n", F.round(F.col("_k") / F.col("n"), 6).alias("weight"))


def evidence_signature(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Order-independent digest of the distinct evidence.

    Each distinct item is hashed and the hashes are combined by XOR and by sum, both mergeable, so a key
    with very many items never forms one long list.
    """
    items = df.select(*keys, *parts).distinct()
    h = F.xxhash64(*parts)
    g = F.xxhash64(F.lit(7), *parts)
    combined = items.groupBy(*keys).agg(F.bit_xor(h).alias("_a"), F.bit_xor(g).alias("_b"), F.count(F.lit(1)).alias("items"))
    return combined.select(*keys, "items", F.sha2(F.concat_ws("|", F.hex("_a"), F.hex("_b"), "items"), 256).alias("signature"))


def dashboard_stats(df: DataFrame, ts_day: Column, today: Column, tag: str, status: str) -> DataFrame:
    """A29, A34."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ts_day == today).alias("today"),
        F.count_if(is_real(F.col(tag))).alias("with_tag"),
        percent(F.count_if(F.col(status) == "SUCCESS"), F.count(F.lit(1))).alias("success_percent"),
    )


def acceptance_rate(df: DataFrame, keys: Sequence[str], accepted: Column) -> DataFrame:
    """A34."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), F.count_if(accepted).alias("accepted"), percent(F.count_if(accepted), F.count(F.lit(1))).alias("accept_percent"))


def retention_totals(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A33."""
    gone = F.col("by_age") | F.col("by_size")
    zero = F.lit(0).cast("long")
    return plan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").cast("long").alias("bytes"),
        F.count_if(gone).alias("candidates"),
        F.coalesce(F.sum(F.when(~gone, F.col("size"))), zero).cast("long").alias("kept_bytes"),
    )


def operational_snapshot(sessions: DataFrame, keys: Sequence[str], terminal: Sequence[str]) -> DataFrame:
    """Open and finalising sessions and the last finalised one per key."""
    done = F.col("state").isin(list(terminal))
    last = F.max_by(F.struct("session_id", "failure_stage"), F.when(done, F.struct("finalised_ms", "session_id")))
    return sessions.groupBy(*keys).agg(
        F.count_if(~done).alias("open_sessions"), F.count_if(F.col("state") == "FINALIZING").alias("finalising"), last.alias("_l")
    ).select(*keys, "open_sessions", "finalising", F.col("_l.session_id").alias("last_session"), F.col("_l.failure_stage").alias("last_failure_stage"))


def observation_status(df: DataFrame, ts_ms: str, planned_hours: float, build: str) -> DataFrame:
    """Elapsed against planned hours with the build identity attached."""
    hours = (F.max(ts_ms) - F.min(ts_ms)) / 3_600_000.0
    return df.agg(
        F.round(hours, 4).alias("elapsed_hours"),
        F.when(hours >= planned_hours, "COMPLETED").otherwise("NOT COMPLETED").alias("status"),
        F.lit(build).alias("build"),
    )


__all__ = [n for n in dir() if not n.startswith("_")]

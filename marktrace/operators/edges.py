"""Debounced edges of a sampled 0/1 signal, pulse widths and trigger acceptance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktrace.operators.ordered import Ordered, order_rows, ordered_fold, null_safe_join, previous, ranked, running


@dataclass(frozen=True)
class DebounceParams:
    on_ms: int = 300
    off_ms: int = 300
    pulse_min_ms: float = 2000.0
    pulse_max_ms: float = 4500.0


@dataclass(frozen=True)
class TriggerParams:
    min_interval_ms: int = 90_000
    cycle_ms: int = 0


def debounce_edges(samples: DataFrame, keys: list[str], params: DebounceParams, ts: str = "ts_ms", raw: str = "raw", tie: str | None = None) -> Ordered:
    """One row per confirmed change of the signal.

    A run of equal raw values is confirmed at its first sample that is at least on_ms/off_ms older than
    the run's start. A confirmed value that differs from the previous confirmed value is an edge, and
    the signal starts low.
    """
    order = [ts, tie] if tie else [ts]
    cols = [*keys, *order, raw]
    rows = order_rows(samples.select(*dict.fromkeys(cols)), keys, order)
    rows = previous(rows, {"_raw0": F.col(raw), "_ts0": F.col(ts)}).settle()
    change = F.col("_raw0").isNull() | (F.col("_raw0") != F.col(raw))
    rows = rows.with_df(rows.df.withColumn("_change", change))
    rows = running(rows, maxes={"_start": F.when(F.col("_change"), F.col(ts))}).settle()
    need = F.when(F.col(raw) == 1, F.lit(params.on_ms)).otherwise(F.lit(params.off_ms))
    reached = F.col(ts) - F.col("_start") >= need
    earlier = ~F.col("_change") & (F.col("_ts0") - F.col("_start") >= need)
    confirmed = rows.with_df(
        rows.df.filter(reached & ~earlier).select(*keys, *order, F.col(raw).alias("value"), *(["_slice"] if rows.hot else []))
    )
    confirmed = previous(confirmed, {"_v0": F.col("value")})
    edges = confirmed.df.filter(F.coalesce(F.col("_v0"), F.lit(0)) != F.col("value")).drop("_v0")
    return confirmed.with_df(edges.withColumn("edge_type", F.when(F.col("value") == 1, "RISING").otherwise("FALLING")))


def pulse_widths(edges: Ordered, params: DebounceParams) -> Ordered:
    """Level durations, pulse width with its validity band, interval between rising edges."""
    ts = edges.order[0]
    rising = F.col("value") == 1
    rows = running(
        edges,
        maxes={"_edge0": F.col(ts), "_rise0": F.when(rising, F.col(ts))},
        exclusive=True,
    )
    since_edge = (F.col(ts) - F.col("_edge0")).cast("double")
    width = F.when(~rising, (F.col(ts) - F.col("_rise0")).cast("double"))
    out = rows.df.withColumns(
        {
            "stable_low_ms": F.when(rising, F.round(since_edge, 1)),
            "stable_high_ms": F.when(~rising, F.round(since_edge, 1)),
            "pulse_width_ms": F.round(width, 1),
            "since_rising_ms": F.when(rising, F.round((F.col(ts) - F.col("_rise0")).cast("double"), 1)),
            "pulse_decision": F.when(
                ~rising,
                F.when(width.between(params.pulse_min_ms, params.pulse_max_ms) | width.isNull(), "FALLING").otherwise("INVALID_PLC_PULSE"),
            ),
        }
    ).drop("_edge0", "_rise0")
    return rows.with_df(out)


def ring_context(samples: DataFrame, edges: DataFrame, keys: list[str], span_ms: int = 7000, ts: str = "ts_ms", raw: str = "raw") -> DataFrame:
    """The raw samples of the last ``span_ms`` before each edge, newest last.

    The lookback is bounded, so time buckets of that length suffice: an edge needs its own bucket and
    the one before. Only buckets that contain an edge are joined, and each ring holds one window.
    """
    bucket = F.floor(F.col(ts) / span_ms)
    e = edges.select(*keys, F.col(ts).alias("_edge_ts")).withColumn("_b", F.floor(F.col("_edge_ts") / span_ms))
    e = e.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") - 1)))
    s = samples.select(*keys, F.col(ts).alias("_s_ts"), F.col(raw).alias("_s_raw"), bucket.alias("_b"))
    hit = e.join(s, [*keys, "_b"]).filter(
        (F.col("_s_ts") <= F.col("_edge_ts")) & (F.col("_s_ts") >= F.col("_edge_ts") - span_ms)
    )
    ring = F.array_sort(F.collect_list(F.struct(F.col("_s_ts").alias("ts"), F.col("_s_raw").alias("raw"))))
    return hit.groupBy(*keys, F.col("_edge_ts").alias(ts)).agg(ring.alias("ring"))


def ring_counts(samples: Ordered, span_ms: int, raw: str = "raw") -> DataFrame:
    """W5 as numbers: samples and high samples in the trailing window of every row, by a RANGE frame.

    Works on slices too: the prefix counts are joined by value, not by frame.
    """
    ts = samples.order[0]
    if not samples.hot:
        frame = samples.window()
        frame = Window.partitionBy(*samples.partition).orderBy(ts).rangeBetween(-span_ms, 0)
        return samples.df.withColumns({"ring_n": F.count(F.lit(1)).over(frame), "ring_high": F.sum(raw).over(frame)})
    # A hot key: per-row window start found by an as-of lookup of the prefix counts at ts - span.
    high = F.col(raw).cast("long")
    pre = running(samples, sums={"_n": F.lit(1).cast("long"), "_h": high}).settle()
    at_ts = pre.df.groupBy(*samples.keys, ts).agg(F.max("_n").alias("_n_to"), F.max("_h").alias("_h_to"))
    marks = samples.df.select(*samples.keys, (F.col(ts) - span_ms - 1).alias("_t")).distinct().select(
        *samples.keys, "_t", F.lit(1).alias("_ask"), F.lit(None).cast("long").alias("_n_to"), F.lit(None).cast("long").alias("_h_to")
    )
    facts = at_ts.select(*samples.keys, F.col(ts).alias("_t"), F.lit(0).alias("_ask"), "_n_to", "_h_to")
    line = order_rows(facts.unionByName(marks), list(samples.keys), ["_t", "_ask"])
    line = running(line, maxes={"_n_at": F.col("_n_to"), "_h_at": F.col("_h_to")})
    before = line.df.filter("_ask = 1").select(*samples.keys, (F.col("_t") + span_ms + 1).alias(ts), "_n_at", "_h_at")
    out = null_safe_join(null_safe_join(samples.df, at_ts, [*samples.keys, ts]), before, [*samples.keys, ts])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*samples.df.drop("_slice").columns, (F.col("_n_to") - zero("_n_at")).alias("ring_n"), (F.col("_h_to") - zero("_h_at")).alias("ring_high"))


def trigger_acceptance(rises: Ordered, params: TriggerParams, startup: str | None = None, active: str | None = None) -> DataFrame:
    """Decision per rising edge. Only an accepted trigger moves the reference point.

    Precedence STARTUP_HIGH, DUPLICATE_TRIGGER_IGNORED (cycle still open), SUSPICIOUS_EARLY_TRIGGER
    (closer than the minimum interval to the last accepted one), ACCEPTED.
    """
    ts = rises.order[0]
    gap, cycle = params.min_interval_ms, params.cycle_ms

    def step(state, run):
        t = run[ts].to_numpy(dtype="int64")
        n = len(t)
        started = run[startup].fillna(False).to_numpy(dtype=bool) if startup else np.zeros(n, bool)
        busy = run[active].fillna(False).to_numpy(dtype=bool) if active else np.zeros(n, bool)
        free = ~started & ~busy
        decision = np.full(n, "SUSPICIOUS_EARLY_TRIGGER", dtype=object)
        last = None if state is None else state[0]
        at = 0
        while at < n:
            nxt = at if last is None else max(at, int(np.searchsorted(t, last + max(gap, cycle), side="left")))
            ahead = np.flatnonzero(free[nxt:])
            hit = nxt + int(ahead[0]) if len(ahead) else n
            if last is not None:
                decision[at:hit][t[at:hit] < last + cycle] = "DUPLICATE_TRIGGER_IGNORED"
            if hit < n:
                decision[hit] = "ACCEPTED"
                last = int(t[hit])
            at = hit + 1
        decision[busy] = "DUPLICATE_TRIGGER_IGNORED"
        decision[started] = "STARTUP_HIGH"
        return (None if last is None else (last,)), {"decision": decision}

    return ordered_fold(rises, step, "decision string").drop("_slice")


def trigger_reason(decision: Column) -> Column:
    return F.when(decision == "DUPLICATE_TRIGGER_IGNORED", "ACTIVE_BODY_CYCLE").when(decision != "ACCEPTED", decision)


def throttle(rows: Ordered, interval_ms: int) -> DataFrame:
    """Keep the first row of a key, then the next one at least the interval after the last kept."""
    kept = trigger_acceptance(rows, TriggerParams(min_interval_ms=interval_ms))
    return kept.filter(F.col("decision") == "ACCEPTED").drop("decision")


def trigger_numbers(rows: Ordered, name: str = "trigger_sequence") -> DataFrame:
    """Running trigger number per key."""
    return ranked(rows, name).plain()


def capture_wait(df: DataFrame, triggered: str, started: str, limit_ms: int = 4000) -> DataFrame:
    """Queue wait of a trigger and whether it missed the capture window."""
    wait = F.col(started) - F.col(triggered)
    return df.withColumns(
        {"queue_wait_ms": wait.cast("double"), "capture_class": F.when(wait > limit_ms, "MISSED_CAPTURE_WINDOW").otherwise("IN_TIME")}
    )


def edge_counts(edges: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """A5: decisions counted side by side in one pass."""
    d = F.col(decision)
    return edges.groupBy(*keys).agg(
        F.count_if(F.col("edge_type") == "RISING").alias("rising_total"),
        F.count_if(d == "ACCEPTED").alias("accepted"),
        F.count_if(d == "SUSPICIOUS_EARLY_TRIGGER").alias("early"),
        F.count_if(d == "DUPLICATE_TRIGGER_IGNORED").alias("duplicates"),
        F.count_if(d == "STARTUP_HIGH").alias("startup_high"),
        F.count_if(d == "INVALID_PLC_PULSE").alias("invalid_pulse"),
    )


__all__ = [n for n in dir() if not n.startswith("_")]

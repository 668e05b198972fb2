"""Streaming debounce, trigger acceptance, suppression and health (ST1, ST5, ST6, ST10-ST12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.operators.edges import DebounceParams, TriggerParams
from marktrace.operators.windows import repeat_step
from marktrace.streaming.kernel import stream_fold


def stream_edges(samples: DataFrame, keys: Sequence[str], params: DebounceParams, triggers: TriggerParams | None = None, ts: str = "ts_ms", raw: str = "raw", tie: str = "event_id") -> DataFrame:
    """ST1: debounced edges with pulse widths and, per rising edge, the trigger decision.

    State: raw value, start of its run, confirmed value, last rise, last accepted trigger.
    """
    t = triggers or TriggerParams(0, 0)

    def step(state, run):
        value, since, level, rise, accepted = state if state else (None, None, 0, None, None)
        rows = []
        for at, v, ident, late in zip(run[ts], run[raw], run[tie], run["late"]):
            at, v = int(at), int(v)
            if late:
                rows.append((at, int(ident), v, "LATE_SAMPLE", None, None))
                continue
            if v != value:
                value, since = v, at
            if v != level and at - since >= (params.on_ms if v else params.off_ms):
                level = v
                if v:
                    if accepted is not None and at < accepted + t.cycle_ms:
                        decision = "DUPLICATE_TRIGGER_IGNORED"
                    elif accepted is not None and at < accepted + t.min_interval_ms:
                        decision = "SUSPICIOUS_EARLY_TRIGGER"
                    else:
                        decision, accepted = "ACCEPTED", at
                    rise = at
                    rows.append((at, int(ident), v, "RISING", None, decision))
                else:
                    width = None if rise is None else float(at - rise)
                    fine = width is None or params.pulse_min_ms <= width <= params.pulse_max_ms
                    rows.append((at, int(ident), v, "FALLING", width, "FALLING" if fine else "INVALID_PLC_PULSE"))
        return (value, since, level, rise, accepted), rows

    ddl = f"{ts} bigint, {tie} bigint, value int, edge_type string, pulse_width_ms double, decision string"
    return stream_fold(samples, keys, [ts, tie], step, ddl)


def stream_repeats(rows: DataFrame, keys: Sequence[str], value: str, session: str, window_ms: int, ts: str, tie: str) -> DataFrame:
    """ST6: repeat suppression with state; late rows are judged against the current memory."""
    fold = repeat_step(value, session, ts, window_ms)

    def step(state, run):
        state, cols = fold(state, run)
        return state, list(zip(run[ts], run[tie], run[session], run[value], cols["is_repeat"].tolist()))

    kinds = dict(rows.dtypes)
    ddl = f"{ts} bigint, {tie} bigint, {session} {kinds[session]}, {value} {kinds[value]}, is_repeat boolean"
    return stream_fold(rows, keys, [ts, tie], step, ddl)


def stream_health(events: DataFrame, keys: Sequence[str], ts_ms: str, tie: str, stale_ms: int) -> DataFrame:
    """ST11: one STALE row whenever a feed was silent longer than the limit, at the time it became stale.

    The event-time timer reports silence that is still going on; ``events`` needs a watermark.
    """

    def step(state, run):
        last, told = state if state else (None, False)
        rows = []
        for at, late in zip(run[ts_ms], run["late"]):
            if late:
                continue
            if last is not None and at - last > stale_ms and not told:
                rows.append((int(last), int(last) + stale_ms))
            last, told = int(at), False
        return (last, told), rows

    def on_timer(state, now):
        last, told = state
        rows = [] if told else [(last, last + stale_ms)]
        return (last, True), rows

    def timer_at(state):
        return None if state[1] else state[0] + stale_ms

    return stream_fold(events, keys, [ts_ms, tie], step, "last_ms bigint, stale_ms bigint", on_timer, timer_at)


def stream_latest(hits: DataFrame, keys: Sequence[str], ts: str, ttl: str = "60 seconds") -> DataFrame:
    """ST5: the latest hit of each key, emitted when no newer one came within the time to live.

    Hits of a key less than ``ttl`` apart are one entry of the cache; it holds the newest, and state is dropped
    when the watermark shows that the entry has expired.
    """
    rest = [c for c in hits.columns if c not in keys]
    held = hits.withWatermark(ts, ttl).groupBy(F.session_window(ts, ttl), *keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("_r"))
    return held.select(*keys, "_r.*").select(*hits.columns)


def stream_log_counts(logs: DataFrame, ts: str, keys: Sequence[str], width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """ST10: tumbling counts per level and source."""
    w = logs.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "n")


def stream_presence(events: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    """ST12: presence sessions separated by a time gap."""
    s = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("frames"), F.max(ts).alias("last_seen"))
    return s.select(*keys, F.col("session_window.start").alias("opened"), "last_seen", "frames")


def stream_tag_join(hits: DataFrame, windows: DataFrame, key: str, longest: str, delay: str = "10 seconds") -> DataFrame:
    """ST4: stream-stream interval join of tag hits with read windows, both sides watermarked.

    hits: key, epc, rssi, hit_ts; windows: key, session_id, window_start, window_end. ``longest`` is how long
    windows may be (e.g. "10 minutes"): it bounds the kept state, and a longer window stops the stream with an error.
    """
    h = hits.withWatermark("hit_ts", delay)
    w = windows.withColumnRenamed(key, "_wk").withWatermark("window_start", delay)
    cond = (F.col(key) == F.col("_wk")) & (F.col("hit_ts") >= F.col("window_start")) & (F.col("hit_ts") <= F.col("window_end")) & (F.col("hit_ts") <= F.col("window_start") + F.expr(f"INTERVAL {longest}"))
    too_long = F.col("window_end") > F.col("window_start") + F.expr(f"INTERVAL {longest}")
    w = w.withColumn("window_end", F.when(too_long, F.raise_error(F.lit("window longer than the stated bound")).cast("timestamp")).otherwise(F.col("window_end")))
    return h.join(w, cond).drop("_wk")

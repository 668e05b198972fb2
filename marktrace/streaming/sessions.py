"""Streaming session state machine and snapshot sinks (ST2, ST3, ST7, ST8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from marktrace.operators.edges import TriggerParams
from marktrace.plans.timeline import SessionParams
from marktrace.sources.sinks import upsert
from marktrace.streaming.kernel import stream_fold

DDL = "record string, session_id bigint, start_ms bigint, exit_ms bigint, finalised_ms bigint, status string, identifier string, confidence double, tag string, result_id bigint, verdict string"


def stream_sessions(events: DataFrame, keys: Sequence[str], p: SessionParams, t: TriggerParams, ts: str = "ts_ms", tie: str = "event_id") -> DataFrame:
    """ST2/ST3: sessions opened by accepted triggers, closed exactly once by event time; every rejected
    result becomes its own row with the cause.

    events: keys, ts_ms, event_id, kind (trigger, id, tag, exit; anything else only moves time), value,
    confidence, and a watermarked time column. Records: ``session`` and ``result``.
    """
    # state: last accepted, session id, start, exit, identifier, confidence, id time, tag, tag time, closed
    empty = (None, None, None, None, None, None, None, None, None, True)

    def limit(s):
        return s[3] + p.grace_ms if s[3] is not None else s[2] + p.deadline_ms

    def complete(s):
        return s[4] is not None and (s[7] is not None or not p.tag_required)

    def final_row(s):
        _, sid, start, left, ident, conf, id_ms, tag, tag_ms, _ = s
        full = complete(s)
        moments = [x for x in (id_ms, tag_ms if p.tag_required else None) if x is not None]
        if p.exit_mode:
            end = start + p.deadline_ms if left is None else max([left, *moments]) if full else left + p.grace_ms
            status = "SUCCESS" if full else "PARTIAL_SUCCESS" if ident is not None or tag is not None else "TIMEOUT"
        else:
            end = max(moments) if full and not p.hold_to_deadline else start + p.deadline_ms
            status = "SUCCESS" if full else "TIMEOUT"
        shown = tag if tag is not None else "NO_TAG" if p.tags_enabled else None
        return ("session", sid, start, left, end, status, ident if ident is not None else "NO_READ", conf if ident is not None else 0.0, shown, None, None)

    def closable(s, now):
        if s[9]:
            return False
        if complete(s) and (s[3] is not None if p.exit_mode else not p.hold_to_deadline):
            return True
        return now > limit(s)

    def step(state, run):
        s = list(state or empty)
        rows = []
        for at, ident, kind, value, conf, late in zip(run[ts], run[tie], run["kind"], run["value"], run["confidence"], run["late"]):
            at = int(at)
            if not late and closable(s, at):
                rows.append(final_row(s))
                s[9] = True
            if kind == "trigger":
                if late or (s[0] is not None and at < s[0] + max(t.min_interval_ms, t.cycle_ms)):
                    continue
                if not s[9]:
                    rows.append(final_row(s))
                s = [at, int(ident), at, None, None, None, None, None, None, False]
            elif kind == "exit" and p.exit_mode and not late:
                if not s[9] and s[3] is None and s[2] < at <= s[2] + p.deadline_ms:
                    s[3] = at
            elif kind in ("id", "tag"):
                verdict = "LATE" if late else "UNKNOWN_SESSION" if s[1] is None else "FINALIZED_REJECTED" if s[9] else "ACCEPTED"
                if verdict == "ACCEPTED":
                    if kind == "id" and s[4] is None:
                        s[4], s[5], s[6] = value, float(conf), at
                    elif kind == "tag" and s[7] is None:
                        s[7], s[8] = value, at
                rows.append(("result", s[1], None, None, None, None, None, None, None, int(ident), verdict))
            if not late and closable(s, at):
                rows.append(final_row(s))
                s[9] = True
        return tuple(s), rows

    def on_timer(state, now):
        s = list(state)
        rows = []
        if closable(s, now):
            rows.append(final_row(s))
            s[9] = True
        return tuple(s), rows

    def timer_at(s):
        return None if s is None or s[9] else limit(s)

    return stream_fold(events, keys, [ts, tie], step, DDL, on_timer, timer_at)


def snapshot_writer(spark: SparkSession, root: str, key: str, order: Sequence[str], initial: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """ST8: foreachBatch function that keeps a keyed table as numbered snapshots.

    Batch 0 starts from ``initial``, the table that exists already; batch ``n`` reads snapshot ``n - 1`` and writes
    ``n``, so replaying a batch after a failure rewrites the same folder with the same rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch:
            before = batch.sparkSession.read.parquet(f"{root}/v={epoch - 1}")
        else:
            before = batch.limit(0) if initial is None else initial
        upsert(before, batch, key, order).write.mode("overwrite").parquet(f"{root}/v={epoch}")

    return write


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Newest complete snapshot below ``root``; only folder names are looked at."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(top)]
    complete = [int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS"))]
    return spark.read.parquet(f"{root}/v={max(complete)}")


"""Capture cycles whose sessions may overlap: who owns a result, when and why each session ends (H11, ST2, ST3).

A session holds the capture until its exit signal, its hand-over or its deadline; triggers before that are
duplicates. It may still wait for results (in grace or handed over) while the next one is open, so results
carry the session they belong to. One order of events decides everything: time, then event id; a limit has
passed only for later times, so a result exactly at a limit still counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktrace.functions.decisions import failure_stage, final_status
from marktrace.operators.edges import capture_wait
from marktrace.operators.ordered import order_rows, ordered_fold, previous, running
from marktrace.operators.windows import asof_owner
from marktrace.session import settle

ACCEPTED, DUPLICATE, EARLY = "ACCEPTED", "DUPLICATE_TRIGGER_IGNORED", "SUSPICIOUS_EARLY_TRIGGER"
MISSED = "MISSED_CAPTURE_WINDOW"


@dataclass(frozen=True)
class CycleParams:
    deadline_ms: int = 30_000
    grace_ms: int = 2_500
    min_interval_ms: int = 90_000
    #: a trigger that waited longer closes its session at once
    max_wait_ms: int = 4_000
    #: single-signal hold: how long a read in flight may move the deadline
    inflight_ms: int = 15_000
    exit_mode: bool = True
    hold_to_deadline: bool = False
    tag_required: bool = True
    tags_enabled: bool = True
    #: results may still come between exit signal and the end of grace
    grace_allowed: bool = True
    #: a trigger while a session holds the capture is a duplicate; without it only the interval counts
    cycle_guard: bool = True


def _after(rows: DataFrame, events: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows(keys, start_ms, session_id)`` with ``name``: the first of ``events(keys, at_ms, event_id)`` behind each, as (ms, id).

    One backward pass over both, in slices where a key is hot: the next event is the last value in descending order.
    """
    place = F.struct(F.col("at_ms").alias("ms"), F.col("event_id").alias("id"))
    both = rows.select(*keys, F.col("start_ms").alias("at_ms"), F.col("session_id").alias("event_id"), F.struct(*rows.columns).alias("row")).unionByName(
        events.select(*keys, "at_ms", "event_id"), allowMissingColumns=True
    )
    both = both.withColumns({"_neg": -F.col("at_ms"), "_negid": -F.col("event_id"), "_hit": F.when(F.col("row").isNull(), place)})
    line = order_rows(both, list(keys), ["_neg", "_negid"])
    return running(line, lasts={name: F.col("_hit")}, exclusive=True).plain().filter("row is not null").select("row.*", name)


def accept_cycles(triggers: DataFrame, exits: DataFrame, handovers: DataFrame, keys: Sequence[str], p: CycleParams) -> DataFrame:
    """``triggers(keys, start_ms, session_id, waited_ms)`` with ``decision``, ``free`` and the first exit and hand-over.

    When a session would free the capture follows from the events behind its trigger alone (first exit or
    hand-over, else the deadline, at once if it missed its window), so that is computed for all triggers in
    parallel; only which of them are taken is a fold, and its state is two numbers.
    """
    rows = capture_wait(triggers.withColumn("_triggered", F.col("start_ms") - F.col("waited_ms")), "_triggered", "start_ms", p.max_wait_ms).drop("_triggered")
    rows = _after(_after(rows, exits, keys, "exit"), handovers, keys, "handover")
    limit = F.col("start_ms") + p.deadline_ms
    inside = lambda c: F.when(F.col(c)["ms"] <= limit, F.col(c))
    rows = rows.withColumns({"exit": inside("exit"), "handover": inside("handover")})
    end = F.struct(limit.alias("ms"), F.lit(2**63 - 1).alias("id"))
    own = F.struct(F.col("start_ms").alias("ms"), F.col("session_id").alias("id"))
    rows = rows.withColumn("free", F.when(F.col("capture_class") == MISSED, own).otherwise(F.least(end, F.col("exit"), F.col("handover"))))
    rows = rows.withColumns({"free_ms": F.col("free.ms"), "free_id": F.col("free.id")})

    def step(state, run):
        out = []
        for at, ident, ms, tie in zip(run["start_ms"], run["session_id"], run["free_ms"], run["free_id"]):
            if state is not None and p.cycle_guard and (at, ident) <= (state[1], state[2]):
                out.append(DUPLICATE)
            elif state is not None and at < state[0] + p.min_interval_ms:
                out.append(EARLY)
            else:
                out.append(ACCEPTED)
                state = (int(at), int(ms), int(tie))
        return state, {"decision": np.array(out, dtype=object)}

    return ordered_fold(order_rows(rows, list(keys), ["start_ms", "session_id"]), step, "decision string").drop("_slice", "free_ms", "free_id")


def session_cycles(triggers: DataFrame, exits: DataFrame, handovers: DataFrame, results: DataFrame, keys: Sequence[str], p: CycleParams, stages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H11 in exit mode: (decision per trigger, final row per session, verdict per result).

    results: session_id, kind (id or tag), result_id, at_ms, value, confidence. ``stages`` has the counters of
    ``failure_stage`` per session_id; without it, or for sessions it lacks, no step was reached.
    """
    if not p.exit_mode:
        raise ValueError("in the single-signal modes results end sessions: use the stream")
    decided = settle(accept_cycles(triggers, exits, handovers, keys, p))
    taken = decided.filter(F.col("decision") == ACCEPTED)
    place = F.struct(F.col("start_ms").alias("ms"), F.col("session_id").alias("id"))
    backwards = order_rows(taken.withColumns({"_neg": -F.col("start_ms"), "_negid": -F.col("session_id"), "began": place}), list(keys), ["_neg", "_negid"])
    sessions = previous(backwards, {"_next": F.col("began")}).plain()
    missed = F.col("capture_class") == MISSED
    # an exit belongs to the newest session only, a hand-over to the one that holds the capture
    left = F.when(~missed & (F.col("_next").isNull() | (F.col("exit") < F.col("_next"))), F.col("exit"))
    handed = F.when(~missed & (left.isNull() | (F.col("handover") < left)) & (F.col("_next").isNull() | (F.col("handover") < F.col("_next"))), F.col("handover"))
    limit = F.when(missed, F.col("start_ms")).when(left.isNotNull(), left["ms"] + p.grace_ms).otherwise(F.col("start_ms") + p.deadline_ms)
    sessions = sessions.withColumns({"left": left, "handed": handed, "limit_ms": limit, "missed": missed})
    judged = results.join(sessions.select("session_id", "began", "_next", "left", "handed", "limit_ms", "missed"), "session_id", "left")
    at = F.struct(F.col("at_ms").alias("ms"), F.col("result_id").alias("id"))
    seen = lambda c: F.coalesce(F.col(c) < at, F.lit(False))
    verdict = (
        F.when(F.col("began").isNull() | (at < F.col("began")), "UNKNOWN_SESSION")
        .when(F.col("missed") | (F.col("at_ms") > F.col("limit_ms")), "FINALIZED_REJECTED")
        .when(seen("left"), F.lit(ACCEPTED if p.grace_allowed else "LATE"))
        .when(seen("handed"), ACCEPTED)
        .when(seen("_next"), "SESSION_MISMATCH")
        .otherwise(ACCEPTED)
    )
    judged = settle(judged.select(*results.columns, "left", at.alias("at"), verdict.alias("verdict")))
    first = judged.filter(F.col("verdict") == ACCEPTED).groupBy("session_id", "kind").agg(F.min(F.struct("at", "value", "confidence")).alias("f"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("f")))
    won = first.groupBy("session_id").agg(pick("id").alias("won_id"), pick("tag").alias("won_tag"))
    j = sessions.join(won, "session_id", "left")
    has_id, has_tag = F.col("won_id.value").isNotNull(), F.col("won_tag.value").isNotNull()
    full = has_id & (has_tag | F.lit(not p.tag_required))
    done = F.greatest("left", F.col("won_id.at"), F.col("won_tag.at")) if p.tag_required else F.greatest("left", F.col("won_id.at"))
    done = F.when(full & F.col("left").isNotNull(), done)
    j = j.withColumns({"done": done, "has_id": has_id, "has_tag": has_tag})
    status, reason = final_status(F.col("has_id"), F.col("has_tag"), True, p.tag_required)
    cause = F.when(missed, MISSED).when(F.col("done").isNotNull(), "EXIT_COMPLETE").when(F.col("left").isNotNull(), "GRACE_EXPIRED").otherwise("EXIT_TIMEOUT")
    no_tag = F.lit("NO_TAG") if p.tags_enabled else F.lit(None).cast("string")
    rows = j.select(
        *keys, "session_id", "start_ms", "queue_wait_ms", F.col("left.ms").alias("exit_ms"), F.coalesce("done.ms", "limit_ms").alias("finalised_ms"), cause.alias("close_cause"),
        F.when(missed, MISSED).otherwise(status).alias("status"), F.when(missed, MISSED).otherwise(reason).alias("failure_reason"),
        F.coalesce("won_id.value", F.lit("NO_READ")).alias("identifier"), F.when(F.col("has_id"), F.coalesce("won_id.confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"), F.coalesce("won_tag.value", no_tag).alias("tag"),
    )
    if stages is not None:
        rows = rows.join(stages, "session_id", "left").withColumn("failure_stage", failure_stage())
        rows = rows.drop(*[c for c in stages.columns if c != "session_id"])
    ends = j.filter("done is not null").select("session_id", "done")
    over = judged.join(ends, "session_id", "left")
    late = (F.col("verdict").isin(ACCEPTED, "LATE")) & F.coalesce(F.col("done") < F.col("at"), F.lit(False))
    verdicts = over.withColumn("verdict", F.when(late, "FINALIZED_REJECTED").otherwise(F.col("verdict"))).drop("done", "left", "at")
    return decided, rows, verdicts


def stage_counts(events: DataFrame, sessions: DataFrame, keys: Sequence[str], counters: dict[str, Column]) -> DataFrame:
    """Counters of ``failure_stage`` per session: events(keys, at_ms, event_id, ...) belong to the session that began last."""
    owned = asof_owner(events, sessions, list(keys), "at_ms", "start_ms", ["session_id"], "event_id").filter("session_id is not null")
    return owned.groupBy("session_id").agg(*[F.count_if(e).alias(n) for n, e in counters.items()])

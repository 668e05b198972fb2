"""Session timeline: one final row per accepted trigger (H11, C21-C23, ST4, ST7) and invariants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktrace.functions.decisions import final_status
from marktrace.operators.joins import correlate_results
from marktrace.operators.windows import asof_owner, first_per_key


@dataclass(frozen=True)
class SessionParams:
    deadline_ms: int = 30_000
    grace_ms: int = 2_500
    exit_mode: bool = True
    hold_to_deadline: bool = False
    tag_required: bool = True
    tags_enabled: bool = True


def session_bounds(accepted: DataFrame, exits: DataFrame, keys: Sequence[str], p: SessionParams) -> DataFrame:
    """Deadline, first exit signal before it, and the grace limit of each session.

    accepted: keys, session_id (bigint), start_ms; exits: keys, exit_id (bigint), at_ms.
    """
    out = accepted.withColumn("deadline_ms", F.col("start_ms") + p.deadline_ms)
    if not p.exit_mode:
        none = F.lit(None).cast("long")
        return out.withColumns({"exit_ms": none, "grace_ms": none})
    owned = asof_owner(exits, accepted, list(keys), "at_ms", "start_ms", ["session_id"], "exit_id")
    inside = owned.filter((F.col("at_ms") <= F.col("start_ms") + p.deadline_ms) & (F.col("at_ms") > F.col("start_ms")))
    first = inside.groupBy("session_id").agg(F.min("at_ms").alias("exit_ms"))
    return out.join(first, "session_id", "left").withColumn("grace_ms", F.col("exit_ms") + p.grace_ms)


def session_timeline(accepted: DataFrame, id_results: DataFrame, tag_results: DataFrame, exits: DataFrame, keys: Sequence[str], p: SessionParams) -> tuple[DataFrame, DataFrame]:
    """(final session rows, verdict per result).

    Results: session_id, result_id, at_ms, value and, for identifiers, confidence. The first accepted
    result of a kind wins; results after the session closed are FINALIZED_REJECTED.
    """
    bounds = session_bounds(accepted, exits, keys, p)
    limits = bounds.select("session_id", F.lit(None).cast("long").alias("finalised_ms"), "exit_ms", "grace_ms", "deadline_ms", F.lit(False).alias("waiting"))
    both = id_results.select("session_id", "result_id", "at_ms", "value", "confidence", F.lit("id").alias("kind")).unionByName(
        tag_results.select("session_id", "result_id", "at_ms", "value", F.lit(None).cast("double").alias("confidence"), F.lit("tag").alias("kind"))
    )
    judged = correlate_results(both, limits, "session_id").select(*both.columns, "verdict")
    ok = judged.filter("verdict = 'ACCEPTED'").drop("verdict")
    first = first_per_key(ok, ["session_id", "kind"], ["at_ms", "result_id"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    won = first.groupBy("session_id").agg(
        pick("id", "value").alias("identifier"), pick("id", "confidence").alias("confidence"), pick("id", "at_ms").alias("id_ms"),
        pick("tag", "value").alias("tag"), pick("tag", "at_ms").alias("tag_ms"),
    )
    j = bounds.join(won, "session_id", "left")
    has_id, has_tag = F.col("identifier").isNotNull(), F.col("tag").isNotNull()
    done = has_id & (has_tag | F.lit(not p.tag_required))
    done_ms = F.greatest("id_ms", "tag_ms") if p.tag_required else F.col("id_ms")
    if p.exit_mode:
        closed = F.when(F.col("exit_ms").isNull(), F.col("deadline_ms")).when(done, F.greatest("exit_ms", done_ms)).otherwise(F.col("grace_ms"))
        cause = F.when(F.col("exit_ms").isNull(), "EXIT_TIMEOUT").when(done, "EXIT_COMPLETE").otherwise("GRACE_EXPIRED")
    else:
        early = done & F.lit(not p.hold_to_deadline)
        closed = F.when(early, done_ms).otherwise(F.col("deadline_ms"))
        cause = F.when(early, "EARLY_COMPLETE").otherwise("DEADLINE")
    status, reason = final_status(has_id, has_tag, p.exit_mode, p.tag_required)
    no_tag = F.lit("NO_TAG") if p.tags_enabled else F.lit(None).cast("string")
    rows = j.select(
        *keys, "session_id", "start_ms", "exit_ms", closed.alias("finalised_ms"), cause.alias("close_cause"), status.alias("status"), reason.alias("failure_reason"),
        F.coalesce("identifier", F.lit("NO_READ")).alias("identifier"), F.when(has_id, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.coalesce("tag", no_tag).alias("tag"), (F.col("id_ms") - F.col("start_ms")).cast("double").alias("id_latency_ms"),
        (F.col("tag_ms") - F.col("start_ms")).cast("double").alias("tag_latency_ms"), (closed - F.col("start_ms")).cast("double").alias("total_ms"),
    )
    ends = rows.select("session_id", F.col("finalised_ms").alias("_end"))
    late = judged.join(ends, "session_id", "left")
    verdict = F.when((F.col("verdict") == "ACCEPTED") & (F.col("at_ms") > F.col("_end")), "FINALIZED_REJECTED").otherwise(F.col("verdict"))
    return rows, late.withColumn("verdict", verdict).drop("_end")


def read_windows(sessions: DataFrame, start: str, deadline: str, first_ms: int = 6000, pause_ms: int = 2000, again_ms: int = 4000, lead_ms: int = 250) -> DataFrame:
    """ST4: tag read windows of a session: one long window, then pause and short windows until the deadline."""
    step = pause_ms + again_ms
    opens = F.col(start) + first_ms + pause_ms
    more = F.when(opens < F.col(deadline), F.sequence(opens, F.col(deadline) - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    begins = F.concat(F.array(F.col(start)), more)
    out = sessions.select("*", F.posexplode(begins).alias("attempt", "_from"))
    length = F.when(F.col("attempt") == 0, F.lit(first_ms)).otherwise(F.lit(again_ms))
    return out.withColumns({"window_start": F.col("_from") - lead_ms, "window_end": F.least(F.col(deadline), F.col("_from") + length)}).drop("_from")


def recover_pending(sessions: DataFrame, cutoff_ms: Column, now_ms: Column) -> DataFrame:
    """ST7: rows still open from before the restart become FAILED / RESTART_RECOVERY."""
    stuck = (F.col("status") == "PENDING") & (F.col("start_ms") < cutoff_ms)
    return sessions.withColumns(
        {
            "status": F.when(stuck, "FAILED").otherwise(F.col("status")),
            "failure_reason": F.when(stuck, "RESTART_RECOVERY").otherwise(F.col("failure_reason")),
            "finalised_ms": F.when(stuck, now_ms).otherwise(F.col("finalised_ms")),
        }
    )


def invariant_checks(decisions: DataFrame, sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(check, expected, actual, ok) rows. Each side is one aggregated row."""
    d = decisions.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("decision") == "ACCEPTED").alias("accepted"), F.count_if(F.col("decision") != "ACCEPTED").alias("dropped"))
    s = sessions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("ids"), F.count_if(F.coalesce(F.col("session_id").cast("string"), F.lit("")) == "").alias("empty_ids"),
    )
    v = verdicts.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("verdict") == "ACCEPTED").alias("taken"), F.count_if(F.col("verdict") != "ACCEPTED").alias("rejected"), F.count_if(F.col("verdict") == "SESSION_MISMATCH").alias("mismatch"))
    one = d.join(F.broadcast(s)).join(F.broadcast(v))  # three single rows
    check = lambda name, e, a: F.struct(F.lit(name).alias("check"), e.cast("long").alias("expected"), a.cast("long").alias("actual"))
    rows = F.array(
        check("accepted_triggers_are_rows", F.col("accepted"), F.col("rows")),
        check("distinct_ids_are_rows", F.col("rows"), F.col("ids")),
        check("no_empty_ids", F.lit(0), F.col("empty_ids")),
        check("no_mismatch", F.lit(0), F.col("mismatch")),
        check("accepted_plus_dropped_is_seen", F.col("seen"), F.col("accepted") + F.col("dropped")),
        check("taken_plus_rejected_is_received", F.col("received"), F.col("taken") + F.col("rejected")),
    )
    return one.select(F.explode(rows).alias("c")).select("c.*").withColumn("ok", F.col("expected") == F.col("actual"))

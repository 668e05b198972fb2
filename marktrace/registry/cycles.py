"""Capture cycles on ``events``: signups are triggers, errors exit signals, some views hand-overs, purchases identifiers,
clicks tags. A result names the newest, second or third newest signup before it, taken as a session or not."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions.times import epoch_ms
from marktrace.operators.ordered import order_rows, ranked, running
from marktrace.plans.cycles import CycleParams, session_cycles, stage_counts
from marktrace.registry.base import query, table
from marktrace.session import settle
from marktrace.streaming.ownership import map_state, stream_cycles
from marktrace.streaming.run import drain_slices

c, lit = F.col, F.lit
HOUR = 3_600_000
CYCLES = CycleParams(deadline_ms=120 * HOUR, grace_ms=48 * HOUR, min_interval_ms=12 * HOUR, max_wait_ms=4_000)
FREE = CycleParams(deadline_ms=120 * HOUR, grace_ms=48 * HOUR, min_interval_ms=12 * HOUR, max_wait_ms=4_000, cycle_guard=False)


def cycle_events(spark, sf):
    """``events`` with kind, time in ms and, for results, the signup they name."""
    kind = F.when(c("event_type") == "signup", "trigger").when(c("event_type") == "purchase", "id").when(c("event_type") == "click", "tag").when(c("event_type") == "error", "exit").when(c("value") > 20, "handover").otherwise("clock")
    ev = table(spark, sf, "events").select("user_id", epoch_ms("ts").alias("at_ms"), "event_id", kind.alias("kind"), "props", "value")
    ev = running(order_rows(ev, ["user_id"], ["at_ms", "event_id"]), sums={"n": (c("kind") == "trigger").cast("long")}).plain()
    named = ranked(order_rows(ev.filter("kind = 'trigger'").select("user_id", "at_ms", "event_id"), ["user_id"], ["at_ms", "event_id"]), "n").plain()
    named = named.select("user_id", "n", c("event_id").alias("session_id"))
    wanted = ev.withColumn("n", F.when(c("kind").isin("id", "tag"), c("n") - c("event_id") % 3))
    return wanted.join(named, ["user_id", "n"], "left").drop("n")


def cycles(spark, sf, p):
    ev = cycle_events(spark, sf)
    of = lambda kind: ev.filter(c("kind") == kind).select("user_id", "at_ms", "event_id")
    triggers = ev.filter("kind = 'trigger'").select("user_id", c("at_ms").alias("start_ms"), c("event_id").alias("session_id"), F.floor(c("value") * 20).alias("waited_ms"))
    results = ev.filter("kind IN ('id', 'tag')").select("session_id", "kind", c("event_id").alias("result_id"), "at_ms", c("props").alias("value"), (c("value") / 500).alias("confidence"))
    seen = table(spark, sf, "events").filter("event_type = 'view'").select("user_id", epoch_ms("ts").alias("at_ms"), "event_id", "value")
    steps = {"payloads": 0, "decoded": 5, "detections": 10, "crops": 20, "rejected": 60, "submitted": 30, "completed": 40, "timeouts": 100, "ambiguous": 80}
    counts = stage_counts(seen, triggers, ["user_id"], {n: c("value") > v for n, v in steps.items()})
    return session_cycles(triggers, of("exit"), of("handover"), results, ["user_id"], p, counts)


def cycle_sql(guard: bool) -> str:
    busy = "AND o > w.free" if guard else ""
    return f"""WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id AS id, event_type AS k, props, value, (epoch_us(ts) // 1000)::HUGEINT * 1000000000 + event_id AS o FROM events),
    t AS (SELECT user_id, ms, id, o, floor(value * 20)::BIGINT AS waited FROM ev WHERE k = 'signup'),
    f AS (SELECT *, CASE WHEN waited > 4000 THEN o ELSE least(endo, coalesce(xo, endo), coalesce(ho, endo)) END AS free FROM (
      SELECT t.*, (ms + 432000000)::HUGEINT * 1000000000 + 999999999 AS endo,
        (SELECT min(x.o) FROM ev x WHERE x.k = 'error' AND x.user_id = t.user_id AND x.o > t.o AND x.ms <= t.ms + 432000000) AS xo,
        (SELECT min(x.o) FROM ev x WHERE x.k = 'view' AND x.value > 20 AND x.user_id = t.user_id AND x.o > t.o AND x.ms <= t.ms + 432000000) AS ho FROM t)),
    walk AS (
      SELECT * FROM f WHERE o = (SELECT min(o) FROM f g WHERE g.user_id = f.user_id)
      UNION ALL SELECT n.* FROM walk w JOIN f n ON n.user_id = w.user_id AND n.o = (SELECT min(o) FROM f g WHERE g.user_id = w.user_id AND g.ms >= w.ms + 43200000 AND g.o > w.o {busy})),
    s AS (SELECT *, waited > 4000 AS missed, CASE WHEN waited <= 4000 AND (nxt IS NULL OR xo < nxt) THEN xo END AS lefto FROM (SELECT *, lead(o) OVER (PARTITION BY user_id ORDER BY o) AS nxt FROM walk)),
    s2 AS (SELECT *, CASE WHEN NOT missed AND (lefto IS NULL OR ho < lefto) AND (nxt IS NULL OR ho < nxt) THEN ho END AS hando,
      CASE WHEN missed THEN ms WHEN lefto IS NOT NULL THEN (lefto // 1000000000)::BIGINT + 172800000 ELSE ms + 432000000 END AS lim FROM s),
    names AS (SELECT user_id, id, k, ms, o, props, value, (list(CASE WHEN k = 'signup' THEN id END) FILTER (k = 'signup') OVER (PARTITION BY user_id ORDER BY o ROWS UNBOUNDED PRECEDING)) AS l FROM ev),
    res AS (SELECT id AS result_id, CASE k WHEN 'purchase' THEN 'id' ELSE 'tag' END AS kind, ms AS at_ms, o, props, value / 500 AS confidence, l[-1 - (id % 3)] AS session_id FROM names WHERE k IN ('purchase', 'click')),
    jud AS (SELECT r.*, s2.lefto, CASE WHEN s2.id IS NULL OR r.o < s2.o THEN 'UNKNOWN_SESSION' WHEN missed OR at_ms > lim THEN 'FINALIZED_REJECTED' WHEN lefto < r.o THEN 'ACCEPTED' WHEN hando < r.o THEN 'ACCEPTED' WHEN nxt < r.o THEN 'SESSION_MISMATCH' ELSE 'ACCEPTED' END AS v
      FROM res r LEFT JOIN s2 ON s2.id = r.session_id),
    won AS (SELECT session_id, min(o) FILTER (kind = 'id') AS io, arg_min(props, o) FILTER (kind = 'id') AS ident, arg_min(confidence, o) FILTER (kind = 'id') AS conf, min(o) FILTER (kind = 'tag') AS tago, arg_min(props, o) FILTER (kind = 'tag') AS tag FROM jud WHERE v = 'ACCEPTED' GROUP BY 1),
    fin AS (SELECT s2.*, io, ident, conf, tago, tag, CASE WHEN lefto IS NOT NULL AND ident IS NOT NULL AND tag IS NOT NULL THEN greatest(lefto, io, tago) END AS done FROM s2 LEFT JOIN won ON won.session_id = s2.id),
    views AS (SELECT v.value, a.id AS session_id FROM (SELECT * FROM ev WHERE k = 'view') v ASOF JOIN t a ON v.user_id = a.user_id AND v.ms >= a.ms),
    n AS (SELECT session_id, count(*) FILTER (value > 0) AS payloads, count(*) FILTER (value > 5) AS decoded, count(*) FILTER (value > 10) AS detections, count(*) FILTER (value > 20) AS crops, count(*) FILTER (value > 60) AS rejected,
      count(*) FILTER (value > 30) AS submitted, count(*) FILTER (value > 40) AS completed, count(*) FILTER (value > 100) AS timeouts, count(*) FILTER (value > 80) AS ambiguous FROM views GROUP BY 1),
    sessions AS (SELECT user_id, fin.id AS session_id, ms AS start_ms, waited::DOUBLE AS queue_wait_ms, (lefto // 1000000000)::BIGINT AS exit_ms, coalesce((done // 1000000000)::BIGINT, lim) AS finalised_ms,
      CASE WHEN missed THEN 'MISSED_CAPTURE_WINDOW' WHEN done IS NOT NULL THEN 'EXIT_COMPLETE' WHEN lefto IS NOT NULL THEN 'GRACE_EXPIRED' ELSE 'EXIT_TIMEOUT' END AS close_cause,
      CASE WHEN missed THEN 'MISSED_CAPTURE_WINDOW' WHEN ident IS NOT NULL AND tag IS NOT NULL THEN 'SUCCESS' WHEN ident IS NOT NULL OR tag IS NOT NULL THEN 'PARTIAL_SUCCESS' ELSE 'TIMEOUT' END AS status,
      CASE WHEN missed THEN 'MISSED_CAPTURE_WINDOW' WHEN ident IS NOT NULL AND tag IS NOT NULL THEN NULL WHEN ident IS NOT NULL THEN 'VIN_OK_RFID_TIMEOUT' WHEN tag IS NOT NULL THEN 'RFID_OK_VIN_TIMEOUT' ELSE 'BOTH_TIMEOUT' END AS failure_reason,
      coalesce(ident, 'NO_READ') AS identifier, coalesce(conf, 0.0) AS confidence, coalesce(tag, 'NO_TAG') AS tag,
      CASE WHEN missed THEN 'MISSED_CAPTURE_WINDOW' WHEN ident IS NOT NULL THEN NULL WHEN coalesce(payloads, 0) = 0 THEN 'NO_PAYLOAD' WHEN decoded = 0 THEN 'DECODE_FAILED' WHEN detections = 0 THEN 'NO_DETECTION' WHEN crops = 0 THEN 'NO_CROP' WHEN crops = rejected THEN 'CROP_REJECTED'
        WHEN submitted = 0 THEN 'OCR_NOT_SUBMITTED' WHEN completed = 0 THEN 'OCR_NOT_STARTED' WHEN timeouts > 0 THEN 'OCR_TIMEOUT' WHEN ambiguous > 0 THEN 'OCR_AMBIGUOUS' ELSE 'OCR_NO_READ' END AS failure_stage FROM fin LEFT JOIN n ON n.session_id = fin.id),
    verdicts AS (SELECT result_id, jud.session_id, kind, CASE WHEN v = 'ACCEPTED' AND done < jud.o THEN 'FINALIZED_REJECTED' ELSE v END AS verdict FROM jud LEFT JOIN fin ON fin.id = jud.session_id),
    decisions AS (SELECT f.user_id, f.id AS session_id, CASE WHEN w.id = f.id THEN 'ACCEPTED' WHEN {'f.o <= w.free' if guard else 'false'} THEN 'DUPLICATE_TRIGGER_IGNORED' ELSE 'SUSPICIOUS_EARLY_TRIGGER' END AS decision FROM f ASOF JOIN walk w ON f.user_id = w.user_id AND f.o >= w.o)
    """


SESSION_COLUMNS = ["user_id", "session_id", "start_ms", "queue_wait_ms", "exit_ms", "finalised_ms", "close_cause", "status", "failure_reason", "identifier", "confidence", "tag", "failure_stage"]


@query("h11_cycle_sessions", cycle_sql(True) + "SELECT * FROM sessions")
def h11_sessions(spark, sf):
    return cycles(spark, sf, CYCLES)[1].select(*SESSION_COLUMNS)


@query("h11_cycle_verdicts", cycle_sql(True) + "SELECT * FROM verdicts")
def h11_verdicts(spark, sf):
    return cycles(spark, sf, CYCLES)[2].select("result_id", "session_id", "kind", "verdict")


@query("h11_cycle_triggers", cycle_sql(True) + "SELECT * FROM decisions")
def h11_triggers(spark, sf):
    return cycles(spark, sf, CYCLES)[0].select("user_id", "session_id", "decision")


@query("h11_unguarded_verdicts", cycle_sql(False) + "SELECT * FROM verdicts")
def h11_unguarded(spark, sf):
    """Only the interval keeps triggers apart: a session that is no longer the newest gets SESSION_MISMATCH."""
    return cycles(spark, sf, FREE)[2].select("result_id", "session_id", "kind", "verdict")


def cycle_stream(spark, sf, p, label):
    """The same events in three slices of time, then one row per user that only moves the clock."""
    ev = cycle_events(spark, sf).withColumns({"confidence": c("value") / 500, "waited_ms": F.floor(c("value") * 20), "value": c("props")}).drop("props")
    ev = settle(ev.withColumn("ts", F.timestamp_millis("at_ms")))
    lo, hi = ev.agg(F.min("at_ms"), F.max("at_ms")).first()
    piece = F.floor((c("at_ms") - lo) * 3 / (hi - lo + 1))
    later = ev.select("user_id").distinct().withColumns({"at_ms": lit(hi + 1000 * HOUR), "event_id": lit(-1).cast("long"), "kind": lit("clock"), "session_id": lit(None).cast("long"), "value": lit(None).cast("string"), "confidence": lit(None).cast("double"), "waited_ms": lit(None).cast("long")})
    slices = [*(ev.filter(piece == i) for i in range(3)), later.withColumn("ts", F.timestamp_millis("at_ms")).select(*ev.columns)]
    with map_state(spark):
        return drain_slices(slices, lambda s: stream_cycles(s.withWatermark("ts", "1 hour"), ["user_id"], p), label)


@query("st2_cycle_stream", cycle_sql(True) + "SELECT * EXCLUDE (queue_wait_ms, failure_stage) FROM sessions")
def st2_cycles(spark, sf):
    columns = [x for x in SESSION_COLUMNS if x not in ("queue_wait_ms", "failure_stage")]
    return cycle_stream(spark, sf, CYCLES, "st2-cycles").filter("record = 'session'").select(*columns)


@query("st3_cycle_verdicts", cycle_sql(True) + "SELECT user_id, result_id, session_id, verdict FROM verdicts JOIN events ON event_id = result_id")
def st3_cycles(spark, sf):
    return cycle_stream(spark, sf, CYCLES, "st3-cycles").filter("record = 'result'").select("user_id", c("event_id").alias("result_id"), "session_id", "verdict")


@query("st3_unguarded_verdicts", cycle_sql(False) + "SELECT user_id, result_id, session_id, verdict FROM verdicts JOIN events ON event_id = result_id")
def st3_unguarded(spark, sf):
    return cycle_stream(spark, sf, FREE, "st3-unguarded").filter("record = 'result'").select("user_id", c("event_id").alias("result_id"), "session_id", "verdict")

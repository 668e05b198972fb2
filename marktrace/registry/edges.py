"""Edge, fold and window queries over ``events`` (key user_id, signal value > 20, thresholds in hours)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions.times import epoch_ms
from marktrace.operators import edges as E
from marktrace.operators import windows as W
from marktrace.operators.ordered import order_rows, previous
from marktrace.registry.base import query, table

HOUR = 3_600_000
DEBOUNCE = E.DebounceParams(on_ms=HOUR, off_ms=HOUR, pulse_min_ms=12 * HOUR, pulse_max_ms=96 * HOUR)
TRIGGER = E.TriggerParams(min_interval_ms=6 * HOUR, cycle_ms=HOUR)


def samples(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("user_id", epoch_ms("ts").alias("ts_ms"), "event_id", (F.col("value") > 20).cast("int").alias("raw"))


def timed(spark, sf, *extra):
    return table(spark, sf, "events").select("user_id", epoch_ms("ts").alias("ts_ms"), "event_id", *extra)


SAMPLES_SQL = """
samples AS (
  SELECT user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS raw FROM events
)"""

# islands by difference of row numbers, first sample old enough inside each island
EDGES_SQL = SAMPLES_SQL + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, event_id)
          - row_number() OVER (PARTITION BY user_id, raw ORDER BY ts_ms, event_id) AS grp FROM samples
),
started AS (SELECT *, min(ts_ms) OVER (PARTITION BY user_id, raw, grp) AS t0 FROM numbered),
confirmed AS (
  SELECT user_id, raw AS value, arg_min(event_id, (ts_ms, event_id)) AS event_id, min(ts_ms) AS ts_ms
  FROM started WHERE ts_ms - t0 >= 3600000 GROUP BY user_id, raw, grp
),
edges AS (
  SELECT user_id, ts_ms, event_id, value, CASE value WHEN 1 THEN 'RISING' ELSE 'FALLING' END AS edge_type FROM (
    SELECT *, lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS v0 FROM confirmed
  ) WHERE v0 <> value
)"""

WIDTHS_SQL = EDGES_SQL + """,
widths AS (
  SELECT *, lag(ts_ms) OVER w AS edge0, max(CASE WHEN value = 1 THEN ts_ms END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rise0
  FROM edges WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)
)"""

RISES_SQL = """
rises AS (
  SELECT user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id, event_type = 'signup' AS startup,
         row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn
  FROM events WHERE value > 20
),
walk AS (
  SELECT user_id, ts_ms, event_id, rn, CASE WHEN startup THEN 'STARTUP_HIGH' ELSE 'ACCEPTED' END AS decision,
         CASE WHEN startup THEN NULL ELSE ts_ms END AS last FROM rises WHERE rn = 1
  UNION ALL
  SELECT user_id, ts_ms, event_id, rn, decision, CASE WHEN decision = 'ACCEPTED' THEN ts_ms ELSE last END FROM (
    SELECT r.user_id, r.ts_ms, r.event_id, r.rn, w.last,
           CASE WHEN r.startup THEN 'STARTUP_HIGH'
                WHEN r.ts_ms < w.last + 3600000 THEN 'DUPLICATE_TRIGGER_IGNORED'
                WHEN r.ts_ms < w.last + 21600000 THEN 'SUSPICIOUS_EARLY_TRIGGER' ELSE 'ACCEPTED' END AS decision
    FROM walk w JOIN rises r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
)"""


@query("w1_debounce_edges", f"WITH {EDGES_SQL} SELECT user_id, ts_ms, event_id, value, edge_type FROM edges")
def w1(spark, sf):
    return E.debounce_edges(samples(spark, sf), ["user_id"], DEBOUNCE, tie="event_id").plain()


@query(
    "w2_pulse_widths",
    f"""WITH {WIDTHS_SQL} SELECT user_id, ts_ms, event_id, value, edge_type,
    CASE WHEN value = 1 THEN (ts_ms - edge0)::DOUBLE END AS stable_low_ms,
    CASE WHEN value = 0 THEN (ts_ms - edge0)::DOUBLE END AS stable_high_ms,
    CASE WHEN value = 0 THEN (ts_ms - rise0)::DOUBLE END AS pulse_width_ms,
    CASE WHEN value = 0 THEN CASE WHEN rise0 IS NULL OR ts_ms - rise0 BETWEEN 43200000 AND 345600000 THEN 'FALLING' ELSE 'INVALID_PLC_PULSE' END END AS pulse_decision
    FROM widths""",
)
def w2(spark, sf):
    edges = E.debounce_edges(samples(spark, sf), ["user_id"], DEBOUNCE, tie="event_id")
    return E.pulse_widths(edges, DEBOUNCE).plain().drop("since_rising_ms")


@query(
    "w3_rising_intervals",
    f"WITH {WIDTHS_SQL} SELECT user_id, ts_ms, (ts_ms - rise0)::DOUBLE AS since_rising_ms FROM widths WHERE value = 1",
)
def w3(spark, sf):
    edges = E.debounce_edges(samples(spark, sf), ["user_id"], DEBOUNCE, tie="event_id")
    return E.pulse_widths(edges, DEBOUNCE).plain().filter("value = 1").select("user_id", "ts_ms", "since_rising_ms")


def decisions(spark, sf):
    rises = timed(spark, sf, (F.col("event_type") == "signup").alias("startup"), "value").filter("value > 20").drop("value")
    return E.trigger_acceptance(order_rows(rises, ["user_id"], ["ts_ms", "event_id"]), TRIGGER, startup="startup").drop("startup")


@query("w4_trigger_acceptance", f"WITH RECURSIVE {RISES_SQL} SELECT user_id, ts_ms, event_id, decision FROM walk")
def w4(spark, sf):
    return decisions(spark, sf)


@query(
    "w5_ring_context",
    f"""WITH {EDGES_SQL} SELECT e.user_id, e.ts_ms, count(*) AS ring_n, sum(s.raw)::BIGINT AS ring_high,
    string_agg(s.ts_ms || ':' || s.raw, ',' ORDER BY s.ts_ms, s.raw) AS ring
    FROM edges e JOIN samples s ON s.user_id = e.user_id AND s.ts_ms BETWEEN e.ts_ms - 43200000 AND e.ts_ms GROUP BY 1, 2""",
)
def w5(spark, sf):
    s = samples(spark, sf)
    edges = E.debounce_edges(s, ["user_id"], DEBOUNCE, tie="event_id").plain()
    ring = E.ring_context(s, edges, ["user_id"], span_ms=12 * HOUR)
    return ring.select(
        "user_id",
        "ts_ms",
        F.size("ring").cast("long").alias("ring_n"),
        F.aggregate("ring", F.lit(0).cast("long"), lambda a, x: a + x.raw).alias("ring_high"),
        F.array_join(F.transform("ring", lambda x: F.concat_ws(":", x.ts.cast("string"), x.raw.cast("string"))), ",").alias("ring"),
    )


@query(
    "w5_ring_counts",
    f"""WITH {SAMPLES_SQL} SELECT user_id, ts_ms, event_id, raw, count(*) OVER w AS ring_n, (sum(raw) OVER w)::BIGINT AS ring_high FROM samples
    WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 43200000 PRECEDING AND CURRENT ROW)""",
)
def w5b(spark, sf):
    return E.ring_counts(order_rows(samples(spark, sf), ["user_id"], ["ts_ms"]), 12 * HOUR)


@query(
    "w6_top_candidates",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
      count(*) OVER (PARTITION BY l_orderkey) AS confirmations, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best_quality FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, rank, confirmations, best_quality,
      (confirmations >= 2 AND best_quality >= 30 AND rank <= 3) AS submitted FROM r WHERE rank <= 10""",
)
def w6(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = li.withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return W.candidate_submission(li, ["l_orderkey"], "l_quantity", "tie", keep=10, submit=3, min_quality=30).drop("tie", "l_extendedprice")


@query(
    "w7_latest_per_key",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max((epoch_us(ts) // 1000), event_id) AS ts_ms, arg_max(value, event_id) AS value
    FROM events GROUP BY 1, 2 HAVING arg_max((epoch_us(ts) // 1000), event_id) >= (SELECT max((epoch_us(ts) // 1000)) FROM events) - 432000000""",
)
def w7(spark, sf):
    ev = timed(spark, sf, "event_type", "value")
    newest = ev.agg(F.max("ts_ms")).first()[0]
    best = W.latest_per_key(ev, ["user_id", "event_type"], ["event_id"])
    return W.expire(best, "ts_ms", F.lit(newest), 120 * HOUR)


@query(
    "w8_repeat_suppression",
    """WITH RECURSIVE s AS (SELECT user_id % 20 AS station, user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id, event_type,
        row_number() OVER (PARTITION BY user_id % 20 ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
    walk AS (
      SELECT station, user_id, ts_ms, event_id, event_type, rn, false AS is_repeat, event_type AS v, user_id AS u, ts_ms AS t FROM s WHERE rn = 1
      UNION ALL
      SELECT station, user_id, ts_ms, event_id, event_type, rn, rep, CASE WHEN rep THEN v ELSE event_type END, CASE WHEN rep THEN u ELSE user_id END, CASE WHEN rep THEN t ELSE ts_ms END
      FROM (SELECT s.*, w.v, w.u, w.t, (s.event_type = w.v AND s.user_id = w.u AND s.ts_ms - w.t < 86400000) AS rep FROM walk w JOIN s ON s.station = w.station AND s.rn = w.rn + 1)
    ) SELECT station, user_id, ts_ms, event_id, event_type, is_repeat FROM walk""",
)
def w8(spark, sf):
    ev = timed(spark, sf, "event_type").withColumn("station", F.col("user_id") % 20)
    return W.repeat_suppression(order_rows(ev, ["station"], ["ts_ms", "event_id"]), "event_type", "user_id", 24 * HOUR)


@query(
    "w9_throttle",
    """WITH RECURSIVE s AS (SELECT user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id FROM events),
    walk AS (
      SELECT user_id, min(ts_ms) AS ts_ms FROM s GROUP BY 1
      UNION ALL
      SELECT w.user_id, (SELECT min(s.ts_ms) FROM s WHERE s.user_id = w.user_id AND s.ts_ms >= w.ts_ms + 86400000) AS ts_ms FROM walk w WHERE w.ts_ms IS NOT NULL
    ) SELECT s.user_id, s.ts_ms, s.event_id FROM walk JOIN s USING (user_id, ts_ms)""",
)
def w9(spark, sf):
    return E.throttle(order_rows(timed(spark, sf), ["user_id"], ["ts_ms", "event_id"]), 24 * HOUR)


@query(
    "w10_first_accepted",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, epoch_us(min(ts)) // 1000 AS ts_ms FROM events WHERE event_type = 'purchase' GROUP BY 1""",
)
def w10(spark, sf):
    ev = timed(spark, sf, "event_type").filter("event_type = 'purchase'").drop("event_type")
    return W.first_per_key(ev, ["user_id"], ["ts_ms", "event_id"]).select("user_id", "event_id", "ts_ms")


@query(
    "w11_presence_segments",
    """WITH s AS (SELECT user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id, event_type NOT IN ('error', 'view') AS seen,
        row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
    f AS (SELECT *, lag(rn) OVER (PARTITION BY user_id ORDER BY rn) AS rn0 FROM s WHERE seen),
    g AS (SELECT *, sum(CASE WHEN rn0 IS NULL OR rn - rn0 > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS segment FROM f),
    h AS (SELECT user_id, segment, min(ts_ms) AS opened_ms, max(ts_ms) AS last_seen_ms, count(*) AS frames, max(rn) AS rn FROM g GROUP BY 1, 2)
    SELECT h.user_id, h.segment::BIGINT AS segment, opened_ms, last_seen_ms, frames, c.ts_ms AS closed_ms
    FROM h LEFT JOIN s c ON c.user_id = h.user_id AND c.rn = h.rn + 3""",
)
def w11(spark, sf):
    rows = order_rows(timed(spark, sf, "event_type"), ["user_id"], ["ts_ms", "event_id"])
    return W.presence_segments(rows, ~F.col("event_type").isin("error", "view"), 3)


@query(
    "w12_failure_streaks",
    """WITH s AS (SELECT user_id, ts, event_id, event_type IN ('error', 'view') AS bad,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'view') ORDER BY ts, event_id) AS g FROM events),
    r AS (SELECT user_id, g, count(*) AS n FROM s WHERE bad GROUP BY 1, 2)
    SELECT user_id, max(n) AS longest, count(*) FILTER (n >= 3) AS warn_streaks, count(*) FILTER (n >= 5) AS stop_streaks FROM r GROUP BY 1""",
)
def w12(spark, sf):
    rows = order_rows(timed(spark, sf, "event_type"), ["user_id"], ["ts_ms", "event_id"])
    return W.streak_summary(W.failure_streaks(rows, F.col("event_type").isin("error", "view")), ["user_id"], 3, 5)


@query(
    "w13_review_rank",
    """WITH p AS (SELECT p_partkey, p_retailprice, substr(p_name, 1, 1) AS ch FROM part),
    q AS (SELECT *, CASE ch WHEN 's' THEN 0 WHEN 'r' THEN 1 WHEN 'h' THEN 2 ELSE 99 END AS class_rank FROM p)
    SELECT p_partkey, class_rank, row_number() OVER (ORDER BY class_rank, p_retailprice / 10000 DESC, p_partkey) AS position FROM q""",
)
def w13(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 10000).alias("conf"), F.substring("p_name", 1, 1).alias("ch"))
    return W.review_rank(part, F.col("ch"), ["s", "r", "h"], "conf", "p_partkey").drop("ch", "conf")


@query(
    "w14_interleave",
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS depth FROM orders)
    SELECT * FROM r ORDER BY depth, o_custkey LIMIT 2000""",
)
def w14(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = order_rows(orders.withColumn("at", epoch_ms("o_orderdate")), ["o_custkey"], ["at", "o_orderkey"])
    return W.interleave(ranked, "o_custkey", 2000).select("o_custkey", "o_orderkey", "depth")


@query(
    "w15_retention_plan",
    """WITH m AS (SELECT max(doc_id) + 1 AS now_id, (SELECT sum(n_chars) FROM documents) // 2 AS lim FROM documents),
    f AS (SELECT doc_id, source, n_chars, (now_id - doc_id) > 600 AND NOT (now_id - doc_id) < 20 AS by_age, (now_id - doc_id) < 20 AS protected, lim FROM documents, m),
    r AS (SELECT *, sum(CASE WHEN by_age THEN 0 ELSE n_chars END) OVER (ORDER BY doc_id DESC) AS bytes_at_turn FROM f)
    SELECT doc_id, by_age, protected, bytes_at_turn::BIGINT AS bytes_at_turn, (NOT by_age AND NOT protected AND bytes_at_turn > 1000000) AS by_size FROM r""",
)
def w15(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("mtime_ms"), F.col("n_chars").alias("size"), F.col("doc_id").cast("string").alias("path"))
    now = docs.agg(F.max("doc_id") + 1).first()[0]
    return W.retention_marks(docs, [], F.lit(now), 600, 1_000_000, 20).select("doc_id", "by_age", "protected", "bytes_at_turn", "by_size")


@query(
    "w16_keep_newest",
    """SELECT source, doc_id, age_rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS age_rank FROM documents) WHERE age_rank > 10""",
)
def w16(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    rows = order_rows(docs.withColumn("neg", -F.col("doc_id")), ["source"], ["neg"])
    return W.keep_newest(rows, 10).drop("neg")


@query(
    "w18_capture_wait",
    """SELECT event_id, wait::DOUBLE AS queue_wait_ms, CASE WHEN wait > 7200000 THEN 'MISSED_CAPTURE_WINDOW' ELSE 'IN_TIME' END AS capture_class FROM (
    SELECT event_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wait FROM events) WHERE wait IS NOT NULL""",
)
def w18(spark, sf):
    rows = order_rows(timed(spark, sf), ["user_id"], ["ts_ms", "event_id"])
    pairs = previous(rows, {"before_ms": F.col("ts_ms")}).plain().filter("before_ms is not null")
    return E.capture_wait(pairs, "before_ms", "ts_ms", 2 * HOUR).select("event_id", "queue_wait_ms", "capture_class")


SPLIT_SQL = """WITH RECURSIVE g AS (SELECT {0} AS source, count(*) AS n FROM {1} GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rn, sum(n) OVER () AS total FROM g),
    walk AS (
      SELECT 0::BIGINT AS rn, NULL::{2} AS source, 0::BIGINT AS n, ''::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c
      UNION ALL
      SELECT rn, source, n, split, a + CASE split WHEN 'train' THEN n ELSE 0 END, b + CASE split WHEN 'validation' THEN n ELSE 0 END, c + CASE split WHEN 'test' THEN n ELSE 0 END FROM (
        SELECT o.rn, o.source, o.n, w.a, w.b, w.c,
          CASE WHEN 0.7::DOUBLE * total - w.a >= 0.15::DOUBLE * total - w.b AND 0.7::DOUBLE * total - w.a >= 0.15::DOUBLE * total - w.c THEN 'train'
               WHEN 0.15::DOUBLE * total - w.b >= 0.15::DOUBLE * total - w.c THEN 'validation' ELSE 'test' END AS split
        FROM walk w JOIN o ON o.rn = w.rn + 1)
    ) SELECT source AS {0}, n, split FROM walk WHERE rn > 0"""
SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


@query("w19_group_split", SPLIT_SQL.format("source", "documents", "VARCHAR"))
def w19(spark, sf):
    return W.group_split(table(spark, sf, "documents").select("source"), "source", SHARES)


@query("w19_many_groups", SPLIT_SQL.format("o_custkey", "orders", "BIGINT"))
def w19_many(spark, sf):
    """Many groups of few sizes: most are assigned inside runs."""
    return W.group_split(table(spark, sf, "orders").select("o_custkey"), "o_custkey", SHARES)


@query(
    "w20_retry_admission",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ts_ms, event_type AS sig, value / 500 AS q, (event_id % 40) / 2.0 AS rem, event_id % 97 = 0 AS out,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, false AS allowed, NULL::VARCHAR AS reason, NULL::VARCHAR AS sig, NULL::DOUBLE AS q, NULL::VARCHAR AS ended FROM (SELECT DISTINCT user_id FROM s)
      UNION ALL
      SELECT user_id, rn, event_id, reason IN ('RETRY_ALLOWED', 'NEW_EVIDENCE', 'IMPROVED_QUALITY'), reason,
        CASE WHEN reason IN ('RETRY_ALLOWED', 'NEW_EVIDENCE') THEN nsig ELSE sig END,
        CASE WHEN reason IN ('RETRY_ALLOWED', 'NEW_EVIDENCE', 'IMPROVED_QUALITY') THEN nq ELSE q END,
        CASE WHEN out OR rem < 0.75 THEN reason ELSE ended END
      FROM (SELECT s.user_id, s.rn, s.event_id, s.sig AS nsig, s.q AS nq, s.rem, s.out, w.sig, w.q, w.ended,
        CASE WHEN s.out THEN 'EXITED' WHEN s.rem < 0.75 THEN 'INSUFFICIENT_DEADLINE' WHEN w.sig IS NULL AND w.ended IS NULL THEN 'RETRY_ALLOWED'
             WHEN w.ended IS NOT NULL THEN w.ended WHEN s.sig <> w.sig THEN 'NEW_EVIDENCE' WHEN s.q >= w.q + 0.05 THEN 'IMPROVED_QUALITY' ELSE 'STABLE_AMBIGUITY' END AS reason
        FROM walk w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
    ) SELECT user_id, event_id, allowed, reason FROM walk WHERE rn > 0""",
)
def w20(spark, sf):
    ev = timed(
        spark,
        sf,
        F.col("event_type").alias("signature"),
        (F.col("value") / 500).alias("quality"),
        ((F.col("event_id") % 40) / 2.0).alias("remaining_sec"),
        (F.col("event_id") % 97 == 0).alias("exited"),
    )
    return W.retry_admission(order_rows(ev, ["user_id"], ["ts_ms", "event_id"])).select("user_id", "event_id", "allowed", "reason")


@query("w21_trigger_numbers", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trigger_sequence FROM events")
def w21(spark, sf):
    return E.trigger_numbers(order_rows(timed(spark, sf), ["user_id"], ["ts_ms", "event_id"])).drop("ts_ms")


@query(
    "a5_decision_counts",
    f"""WITH RECURSIVE {RISES_SQL} SELECT user_id, count(*) AS rising_total, count(*) FILTER (decision = 'ACCEPTED') AS accepted,
    count(*) FILTER (decision = 'SUSPICIOUS_EARLY_TRIGGER') AS early, count(*) FILTER (decision = 'DUPLICATE_TRIGGER_IGNORED') AS duplicates,
    count(*) FILTER (decision = 'STARTUP_HIGH') AS startup_high, 0::BIGINT AS invalid_pulse FROM walk GROUP BY 1""",
)
def a5(spark, sf):
    return E.edge_counts(decisions(spark, sf).withColumn("edge_type", F.lit("RISING")), ["user_id"])


@query(
    "a31_rolling_mean",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events""",
)
def a31(spark, sf):
    rows = order_rows(timed(spark, sf, "value"), ["user_id"], ["ts_ms", "event_id"])
    return W.rolling_mean(rows, "value", 10).select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query(
    "j13_open_session_owner",
    """WITH o AS (SELECT user_id, (epoch_us(ts) // 1000) AS start_ms, event_id AS session_id FROM events WHERE event_type = 'signup'),
    p AS (SELECT user_id, (epoch_us(ts) // 1000) AS ts_ms, event_id FROM events WHERE event_type <> 'signup')
    SELECT p.event_id, p.user_id, o.session_id, CASE WHEN o.session_id IS NULL THEN 'NEW' WHEN p.ts_ms < o.start_ms + 43200000 THEN 'DUPLICATE' ELSE 'NEW' END AS trigger_class
    FROM p ASOF LEFT JOIN o ON p.user_id = o.user_id AND p.ts_ms >= o.start_ms""",
)
def j13(spark, sf):
    ev = timed(spark, sf, "event_type")
    opened = ev.filter("event_type = 'signup'").select("user_id", F.col("ts_ms").alias("start_ms"), F.col("event_id").alias("session_id"))
    points = ev.filter("event_type <> 'signup'").drop("event_type")
    own = W.asof_owner(points, opened, ["user_id"], "ts_ms", "start_ms", ["session_id"], "event_id")
    dup = F.col("ts_ms") < F.col("start_ms") + 12 * HOUR
    return own.select("event_id", "user_id", "session_id", F.when(dup, "DUPLICATE").otherwise("NEW").alias("trigger_class"))

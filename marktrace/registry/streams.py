"""Streaming queries: the driver's rows arrive in slices of time, as many files each as their rows need and one slice per micro-batch;
last slices of clock rows per key (derived from the table) let watermarks pass so that open windows close."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions.times import epoch_ms
from marktrace.operators import windows as W
from marktrace.operators.ordered import order_rows
from marktrace.registry.base import SQL, query, table
from marktrace.registry.edges import DEBOUNCE, TRIGGER, EDGES_SQL
from marktrace.registry.jobs import HOUR, SESSION, TIMELINE_SQL
from marktrace.operators.edges import TriggerParams
from marktrace.session import scratch_path
from marktrace.sources.buckets import BucketTable
from marktrace.sources.readers import stream_files
from marktrace.sources.sinks import last_per_key
from marktrace.sources.tail import tail_lines
from marktrace.streaming import edges as SE
from marktrace.streaming import sessions as SS
from marktrace.streaming.ownership import map_state
from marktrace.streaming.run import drain, drain_batches
from marktrace.streaming.silence import drain_silence, stream_silence

c, lit = F.col, F.lit


#: files, and so writing and reading tasks, of one slice at least, and rows that one of them has at most on average
FILES, FILE_ROWS = 4, 250_000


def arriving(spark, sf, clock=False, parts=3):
    """``events`` as a file stream in time order, optionally followed by clock rows.

    Rows are dealt out evenly, so every slice has as many files and a micro-batch takes exactly one.
    """
    ev = table(spark, sf, "events").withColumn("ts_ms", epoch_ms("ts"))
    ev = ev.withColumn("ts", c("ts").cast("timestamp"))
    lo, hi, n = ev.agg(F.min("ts_ms"), F.max("ts_ms"), F.count("*")).first()
    files = max(FILES, -(-n // (parts * FILE_ROWS)))
    path = scratch_path(spark, "arriving")
    piece = F.least(F.floor((c("ts_ms") - lo) * parts / (hi - lo + 1)), lit(parts - 1))
    for i in range(parts):
        ev.filter(piece == i).repartition(files).write.mode("append").parquet(path)
    if clock:
        for n in (1, 2):
            tick = ev.select("user_id", "event_type").distinct().withColumns({"ts_ms": lit(hi + n * 400 * HOUR), "event_id": lit(-n).cast("long"), "value": lit(0.0), "props": lit(None).cast("string"), "kind": lit("clock")})
            tick = tick.withColumn("ts", F.timestamp_millis("ts_ms")).withColumn("event_type", lit("clock")).select(*ev.columns).dropDuplicates(["user_id"])
            tick.repartition(files).write.mode("append").parquet(path)
    return stream_files(spark, path, ev.schema, per_trigger=files)


@query("st1_stream_edges", f"WITH {EDGES_SQL} SELECT user_id, ts_ms, event_id, value, edge_type FROM edges")
def st1(spark, sf):
    s = arriving(spark, sf).select("user_id", "ts_ms", "event_id", (c("value") > 20).cast("int").alias("raw"))
    return drain(SE.stream_edges(s, ["user_id"], DEBOUNCE, TRIGGER), "st1").select("user_id", "ts_ms", "event_id", "value", "edge_type")


@query("st2_stream_sessions", f"{TIMELINE_SQL} SELECT user_id, session_id, start_ms, exit_ms, finalised_ms, status, identifier, confidence, tag FROM fin")
def st2(spark, sf):
    kind = F.when(c("event_type") == "signup", "trigger").when(c("event_type") == "purchase", "id").when(c("event_type") == "click", "tag").when(c("event_type") == "error", "exit").otherwise("clock")
    s = arriving(spark, sf, clock=True).withWatermark("ts", "1 hour").select("user_id", "ts", "ts_ms", "event_id", kind.alias("kind"), c("props").alias("value"), (c("value") / 500).alias("confidence"))
    out = drain(SS.stream_sessions(s, ["user_id"], SESSION, TriggerParams(24 * HOUR)), "st2")
    return out.filter("record = 'session'").select("user_id", "session_id", "start_ms", "exit_ms", "finalised_ms", "status", "identifier", "confidence", "tag")


@query(
    "st4_stream_tag_join",
    """SELECT w.event_id AS session_id, h.event_id AS tag, w.user_id FROM events w JOIN events h ON h.user_id = w.user_id AND h.ts BETWEEN w.ts AND w.ts + INTERVAL 20 HOUR
    WHERE w.event_type = 'signup' AND h.event_type = 'click'""",
)
def st4(spark, sf):
    hits = arriving(spark, sf).filter("event_type = 'click'").select("user_id", c("event_id").alias("tag"), c("ts").alias("hit_ts"))
    opened = arriving(spark, sf).filter("event_type = 'signup'")
    windows = opened.select("user_id", c("event_id").alias("session_id"), c("ts").alias("window_start"), (c("ts") + F.expr("INTERVAL 20 HOURS")).alias("window_end"))
    return drain(SE.stream_tag_join(hits, windows, "user_id", "20 HOURS"), "st4").select("session_id", "tag", "user_id")


@query(
    "st5_stream_latest",
    """WITH h AS (SELECT event_id, user_id, epoch_us(ts) AS t, sum(CASE WHEN before IS NULL OR epoch_us(ts) - before >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS entry
      FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS before FROM events))
    SELECT user_id, arg_max(event_id, (t, event_id)) AS event_id FROM h GROUP BY user_id, entry""",
)
def st5(spark, sf):
    hits = arriving(spark, sf, clock=True).select("user_id", "ts", "event_id")
    return drain(SE.stream_latest(hits, ["user_id"], "ts", "24 hours"), "st5").filter("event_id >= 0").select("user_id", "event_id")


@query("st6_stream_repeats", SQL["w8_repeat_suppression"])
def st6(spark, sf):
    s = arriving(spark, sf).select((c("user_id") % 20).alias("station"), "user_id", "ts_ms", "event_id", "event_type")
    return drain(SE.stream_repeats(s, ["station"], "event_type", "user_id", 24 * HOUR, "ts_ms", "event_id"), "st6").select("station", "user_id", "ts_ms", "event_id", "event_type", "is_repeat")


@query("st8_open_then_final", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS event_id FROM events GROUP BY 1")
def st8(spark, sf):
    root = scratch_path(spark, "st8")
    s = arriving(spark, sf).select("user_id", c("event_type").alias("status"), "event_id")
    drain_batches(s, "st8", SS.snapshot_writer(spark, root, "user_id", ["event_id"]))
    return SS.latest_snapshot(spark, root).select("user_id", "status", "event_id")


@query("st8_existing_table", "SELECT user_id, arg_max(status, (event_id, late)) AS status, max(event_id) AS event_id FROM (SELECT user_id, event_type AS status, event_id, 1 AS late FROM events UNION ALL SELECT c_custkey, 'KNOWN', c_custkey, 0 FROM customer) GROUP BY 1")
def st8_existing(spark, sf):
    """The stream joins a table that is there already; some of its rows are newer than the stream's."""
    root = scratch_path(spark, "st8")
    known = table(spark, sf, "customer").select(c("c_custkey").alias("user_id"), lit("KNOWN").alias("status"), c("c_custkey").alias("event_id"))
    s = arriving(spark, sf).select("user_id", c("event_type").alias("status"), "event_id")
    drain_batches(s, "st8", SS.snapshot_writer(spark, root, "user_id", ["event_id"], known))
    return SS.latest_snapshot(spark, root).select("user_id", "status", "event_id")


@query(
    "st9_queue_admission",
    """WITH RECURSIVE s AS (SELECT user_id % 20 AS station, event_id, event_type IN ('signup', 'click', 'view') AS inn, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
    walk AS (SELECT station, 0::BIGINT AS rn, NULL::BIGINT AS event_id, ''::VARCHAR AS outcome, 0 AS len FROM (SELECT DISTINCT station FROM s) UNION ALL
    SELECT s.station, s.rn, s.event_id, CASE WHEN inn AND len < 10 THEN 'ADMITTED' WHEN inn THEN 'DROPPED' WHEN len > 0 THEN 'SERVED' ELSE 'IDLE' END, CASE WHEN inn AND len < 10 THEN len + 1 WHEN NOT inn AND len > 0 THEN len - 1 ELSE len END FROM walk w JOIN s ON s.station = w.station AND s.rn = w.rn + 1)
    SELECT station, event_id, outcome, len AS queue_length FROM walk WHERE rn > 0""",
)
def st9(spark, sf):
    ev = table(spark, sf, "events").select((c("user_id") % 20).alias("station"), epoch_ms("ts").alias("ts_ms"), "event_id", c("event_type").isin("signup", "click", "view").alias("arrives"))
    return W.queue_admission(order_rows(ev, ["station"], ["ts_ms", "event_id"]), "arrives", 10).select("station", "event_id", "outcome", "queue_length")


@query("st10_stream_log_counts", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) // 1000 AS window_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st10(spark, sf):
    n = SE.stream_log_counts(arriving(spark, sf, clock=True), "ts", ["event_type"], "6 hours", "1 hour")
    return drain(n, "st10").filter("event_type <> 'clock'").select(epoch_ms("window_start").alias("window_ms"), "event_type", "n")


@query(
    "st11_stream_health",
    """WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS last_ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    SELECT user_id, last_ms, last_ms + 43200000 AS stale_ms FROM g WHERE coalesce(nxt - last_ms > 43200000, true)""",
)
def st11(spark, sf):
    s = arriving(spark, sf, clock=True).withWatermark("ts", "1 hour").select("user_id", "ts", "ts_ms", "event_id")
    out = drain(SE.stream_health(s, ["user_id"], "ts_ms", "event_id", 12 * HOUR), "st11")
    edge = table(spark, sf, "events").agg(F.max(epoch_ms("ts"))).first()[0]
    return out.filter(c("last_ms") <= edge)


@query(
    "st12_stream_presence",
    """WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
    SELECT user_id, min(t) AS opened_ms, max(t) AS last_seen_ms, count(*) AS frames FROM n GROUP BY user_id, k""",
)
def st12(spark, sf):
    p = drain(SE.stream_presence(arriving(spark, sf, clock=True), "ts", ["user_id", ], "12 hours", "1 hour"), "st12")
    edge = table(spark, sf, "events").agg(F.max(epoch_ms("ts"))).first()[0]
    return p.select("user_id", epoch_ms("opened").alias("opened_ms"), epoch_ms("last_seen").alias("last_seen_ms"), "frames").filter(c("opened_ms") <= edge)


@query("s14_log_tail", "SELECT event_id, event_type FROM events")
def s14(spark, sf):
    return drain(arriving(spark, sf).select("event_id", "event_type"), "s14")


@query("s15_watched_scores", "SELECT event_id, length(props)::BIGINT AS score, NULL::VARCHAR AS error FROM events")
def s15(spark, sf):
    from marktrace.plans.images import score_batch

    def model(batch):
        import pandas as pd

        return pd.DataFrame({"score": batch["props"].str.len().astype("int64")})

    return drain(score_batch(arriving(spark, sf).select("event_id", "props"), ["props"], model, "score bigint").drop("props"), "s15")


@query("w7_batch_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def w7b(spark, sf):
    return last_per_key(table(spark, sf, "events").select("user_id", "event_id"), "user_id", ["event_id"])


@query("st8_bucket_table", "SELECT user_id, arg_max(status, (event_id, late)) AS status, max(event_id) AS event_id FROM (SELECT user_id, event_type AS status, event_id, 1 AS late FROM events UNION ALL SELECT c_custkey, 'KNOWN', c_custkey, 0 FROM customer) GROUP BY 1")
def st8_buckets(spark, sf):
    """The stream joins a table in buckets that is there already."""
    held = BucketTable(spark, scratch_path(spark, "st8-buckets"), "user_id", ["event_id"], 16)
    held.apply(table(spark, sf, "customer").select(c("c_custkey").alias("user_id"), lit("KNOWN").alias("status"), c("c_custkey").alias("event_id")))
    s = arriving(spark, sf).select("user_id", c("event_type").alias("status"), "event_id")
    drain_batches(s, "st8", held.writer("st8"))
    return held.read().select("user_id", "status", "event_id")


@query(
    "k5_bucket_upserts",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def k5_buckets(spark, sf):
    """Orders arrive as two batches, the newer half first and one of them twice; each customer's newest stays."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    held = BucketTable(spark, scratch_path(spark, "k5-buckets"), "o_custkey", ["o_orderdate", "o_orderkey"], 16)
    newer = c("o_orderdate") >= "1995-06-01"
    for epoch, part in enumerate([orders.filter(newer), orders.filter(~newer), orders.filter(~newer)]):
        held.apply(part, "orders", min(epoch, 1))
    return held.read().select("o_custkey", "o_orderkey", "o_orderstatus")


@query("st11_silent_feeds", "SELECT user_id, arg_max(epoch_us(ts) // 1000, (epoch_us(ts) // 1000, event_id)) AS last_ms, arg_max(event_id, (epoch_us(ts) // 1000, event_id)) AS last_event, count(*) AS events FROM events GROUP BY 1")
def st11_silent(spark, sf):
    """All events have come and none follows: every feed is reported by its own processing-time timer."""
    root = scratch_path(spark, "st11-silent")
    ev = table(spark, sf, "events").select("user_id", epoch_ms("ts").alias("at_ms"), "event_id")
    ev.write.parquet(f"{root}/in")
    feeds = ev.select("user_id").distinct().count()
    with map_state(spark):
        return drain_silence(stream_silence(stream_files(spark, f"{root}/in", ev.schema), ["user_id"], 1_000), root, feeds)


@query("s14_tail_lines", "SELECT event_id, event_type, user_id FROM events")
def s14_tail(spark, sf):
    """Events as JSON lines that arrive in two steps; every line comes once, in stretches of at most 100 kB."""
    root = scratch_path(spark, "s14-tail")
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    out = None
    for i in range(2):
        ev.filter(c("event_id") % 2 == i).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{root}/in")
        s = tail_lines(spark, f"{root}/in", "*.txt", 0.0, 100_000).select(F.from_json("line", "event_id bigint, event_type string, user_id bigint").alias("r")).select("r.*")
        s.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        out = s.schema
    return spark.read.schema(out).parquet(f"{root}/out")

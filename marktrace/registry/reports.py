"""Aggregate and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions.times import epoch_ms
from marktrace.operators import aggregates as A
from marktrace.operators import predicates as P
from marktrace.operators import windows as W
from marktrace.registry.base import query, table
from marktrace.registry.edges import DEBOUNCE, EDGES_SQL, samples
from marktrace.registry.scalars import LOGS_SQL, log_rows

c, lit = F.col, F.lit


@query("a1_row_count", "SELECT count(*) AS n FROM orders")
def a1(spark, sf):
    return table(spark, sf, "orders").agg(F.count(lit(1)).alias("n"))


@query("a2_status_counts", "SELECT CASE WHEN o_orderstatus = 'P' THEN '?' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def a2(spark, sf):
    return A.status_counts(table(spark, sf, "orders").select(F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("status")))


@query("a3_duplicate_excess", "SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents WHERE trim(text) <> ''")
def a3(spark, sf):
    return A.duplicate_excess(table(spark, sf, "documents"), "text")


@query("a4_missing_evidence", "SELECT count(*) AS missing FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0")
def a4(spark, sf):
    k = c("o_orderkey")
    s = table(spark, sf, "orders").withColumns({"status": F.when(c("o_orderstatus") == "F", "TIMEOUT").otherwise("SUCCESS"), "image_path": F.when(k % 3 == 0, "x.jpg")})
    return P.missing_evidence(s).agg(F.count(lit(1)).alias("missing"))


@query(
    "a6_interval_summary",
    """WITH g AS (SELECT event_type, CASE WHEN event_id % 9 > 0 THEN (epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1000.0 END AS s FROM events)
    SELECT event_type, round(min(s), 2)::DOUBLE AS min_s, round(median(s::DOUBLE), 2)::DOUBLE AS median_s, round(max(s), 2)::DOUBLE AS max_s FROM g WHERE s IS NOT NULL GROUP BY 1""",
)
def a6(spark, sf):
    from marktrace.operators.ordered import order_rows, previous

    ev = table(spark, sf, "events").select("event_type", "event_id", epoch_ms("ts").alias("ts_ms"))
    gaps = previous(order_rows(ev, ["event_type"], ["ts_ms", "event_id"]), {"before": c("ts_ms")}).plain()
    text = F.when(c("event_id") % 9 > 0, (c("ts_ms") - c("before")).cast("string")).otherwise("")
    return A.interval_summary(gaps.withColumn("gap", text), ["event_type"], "gap")


P95_SQL = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(avg(value), 1)::DOUBLE AS mean, round(median(value), 1)::DOUBLE AS p50, round(max(CASE WHEN rn = {rank} THEN value END), 1)::DOUBLE AS p95 FROM r GROUP BY 1, 2"""


@query("a7_latency_p95", P95_SQL.format(rank="floor(0.95::DOUBLE * (n - 1)) + 1"))
def a7(spark, sf):
    return A.latency_summary(table(spark, sf, "events"), ["event_type"], "value")


@query("a8_engine_benchmark", "SELECT r.*, a.accuracy_percent FROM (" + P95_SQL.format(rank="floor(0.95::DOUBLE * n)") + ") r JOIN (SELECT event_type, round(100.0 * avg((value > 20)::INT), 2)::DOUBLE AS accuracy_percent FROM events GROUP BY 1) a USING (event_type)")
def a8(spark, sf):
    ev = table(spark, sf, "events")
    acc = ev.groupBy("event_type").agg(F.round(100.0 * F.avg((c("value") > 20).cast("int")), 2).alias("accuracy_percent"))
    return A.latency_summary(ev, ["event_type"], "value", rule="int_n_minus_1").join(acc, "event_type")


@query("a9_dataset_counts", "SELECT count(*) AS total, count(*) FILTER (n_chars >= 500) AS eligible, count(*) FILTER (starts_with(source, 'src1')) AS group_split FROM documents")
def a9(spark, sf):
    return table(spark, sf, "documents").agg(F.count(lit(1)).alias("total"), F.count_if(c("n_chars") >= 500).alias("eligible"), F.count_if(F.startswith("source", lit("src1"))).alias("group_split"))


@query(
    "a11_log_counters",
    f"""SELECT source, count(*) AS total, count(*) FILTER (level = 'DEBUG') AS n_debug, count(*) FILTER (level = 'INFO') AS n_info, count(*) FILTER (level = 'WARNING') AS n_warning, count(*) FILTER (level = 'ERROR') AS n_error,
    count(*) FILTER (level = 'CRITICAL') AS n_critical, count(*) FILTER (regexp_matches(msg, ': 1\\d')) AS teens FROM {LOGS_SQL} GROUP BY 1""",
)
def a11(spark, sf):
    return A.log_counters(log_rows(spark, sf), {"teens": r": 1\d"}, ["source"])


PRED_SQL = """(SELECT doc_id, quality::VARCHAR AS truth, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS predicted, CASE WHEN n_chars < 200 THEN 'NO_READ' WHEN doc_id % 7 = 0 THEN 'OCR_AMBIGUOUS' ELSE 'ACCEPT' END AS status, lang FROM labels JOIN documents USING (doc_id))"""


def predictions(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf, "labels"), "doc_id")
    status = F.when(c("n_chars") < 200, "NO_READ").when(c("doc_id") % 7 == 0, "OCR_AMBIGUOUS").otherwise("ACCEPT")
    return j.select("doc_id", c("quality").cast("string").alias("truth"), F.when(c("n_chars") > 1500, "1").otherwise("0").alias("predicted"), status.alias("status"), "lang")


@query(
    "a12_acceptance_report",
    f"""WITH x AS (SELECT lang, count(*) AS n, count(*) FILTER (status = 'ACCEPT' AND truth = predicted) AS exact, count(*) FILTER (status = 'ACCEPT') AS accepted, count(*) FILTER (status = 'ACCEPT' AND truth <> predicted) AS false_accept,
    count(*) FILTER (status = 'OCR_AMBIGUOUS') AS ambiguous, count(*) FILTER (status = 'NO_READ') AS no_read FROM {PRED_SQL} GROUP BY 1)
    SELECT *, round(exact / n, 4)::DOUBLE AS exact_rate, round(accepted / n, 4)::DOUBLE AS accepted_rate, round(false_accept / n, 4)::DOUBLE AS false_accept_rate, round(ambiguous / n, 4)::DOUBLE AS ambiguous_rate, round(no_read / n, 4)::DOUBLE AS no_read_rate FROM x""",
)
def a12(spark, sf):
    return A.acceptance_report(predictions(spark, sf), ["lang"])


@query(
    "a13_character_confusions",
    """WITH z AS (SELECT i - 1 AS pos, substr(p_name, i, 1) AS t, substr(p_type || p_brand, i, 1) AS p FROM part, (SELECT unnest(range(1, 30)) AS i) WHERE length(p_name) = length(p_type || p_brand) AND i <= length(p_name))
    SELECT pos::INTEGER AS pos, t, p, count(*) AS n FROM z WHERE t <> p GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 15""",
)
def a13(spark, sf):
    part = table(spark, sf, "part").select("p_name", F.concat("p_type", "p_brand").alias("guess"))
    return A.character_confusions(part, "p_name", "guess").orderBy(F.col("n").desc(), "pos", "t", "p").limit(15)


CLASS_SQL = """WITH d AS (SELECT o_orderpriority AS t, CASE WHEN o_totalprice > 300000 THEN '9-NEVER' WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '1-URGENT' ELSE '5-LOW' END AS p FROM orders),
k AS (SELECT t AS cls FROM d UNION SELECT p FROM d),
m AS (SELECT cls, (SELECT count(*) FROM d WHERE t = cls AND p = cls) AS tp, (SELECT count(*) FROM d WHERE p = cls) AS as_pred, (SELECT count(*) FROM d WHERE t = cls) AS support FROM k),
pr AS (SELECT *, coalesce(tp / nullif(as_pred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM m),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


def classes(spark, sf):
    k = c("o_orderkey")
    p = F.when(c("o_totalprice") > 300000, "9-NEVER").when(k % 3 == 0, c("o_orderpriority")).when(k % 3 == 1, "1-URGENT").otherwise("5-LOW")
    return table(spark, sf, "orders").select(c("o_orderpriority").alias("t"), p.alias("p"), (c("o_totalprice") / 500000).alias("prob"))


@query("a14_class_metrics", f"{CLASS_SQL} SELECT cls, tp, as_pred, support, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM f")
def a14(spark, sf):
    m = A.class_metrics(classes(spark, sf), "t", "p")
    return m.select("cls", "tp", "as_pred", "support", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


MACRO_SQL = "SELECT round(avg(precision), 6)::DOUBLE AS macro_precision, round(avg(recall), 6)::DOUBLE AS balanced_accuracy, round(avg(f1), 6)::DOUBLE AS macro_f1, round(sum(tp) / sum(support), 6)::DOUBLE AS accuracy FROM f"


@query("a14_macro_metrics", f"{CLASS_SQL} {MACRO_SQL} WHERE support > 0")
def a14b(spark, sf):
    return A.macro_metrics(A.class_metrics(classes(spark, sf), "t", "p"))


@query("a15_macro_seen", f"{CLASS_SQL} {MACRO_SQL}")
def a15(spark, sf):
    return A.macro_metrics(A.class_metrics(classes(spark, sf), "t", "p"), "seen")


@query("a14_top_two", f"{CLASS_SQL.split('k AS')[0].rstrip().rstrip(',').replace('FROM orders', ', o_totalprice / 500000 AS prob FROM orders')} SELECT count(*) AS n, round(avg((t = p)::INT), 6)::DOUBLE AS top1, round(avg((t = p OR t = '2-HIGH')::INT), 6)::DOUBLE AS top2, round(avg(prob), 6)::DOUBLE AS mean_confidence FROM d")
def a14c(spark, sf):
    return A.top_two(classes(spark, sf).withColumn("second", lit("2-HIGH")), "t", "p", "second", "prob")


@query("a16_confusion_matrix", "SELECT l_returnflag AS truth, count(*) FILTER (l_linestatus = 'O') AS \"O\", count(*) FILTER (l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def a16(spark, sf):
    return A.confusion_matrix(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query(
    "a17_sequence_metrics",
    """WITH z AS (SELECT p_partkey, upper(p_name) AS t, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE upper(p_type || p_name) END AS p FROM part),
    s AS (SELECT sum(CASE WHEN substr(t, i, 1) = substr(p, i, 1) AND substr(t, i, 1) <> '' THEN 1 ELSE 0 END) AS same FROM z, (SELECT unnest(range(1, 18)) AS i))
    SELECT count(*) AS n, round(avg((t = p)::INT), 6)::DOUBLE AS exact_rate, round(avg(regexp_matches(p, '^[A-Z]+$')::INT), 6)::DOUBLE AS valid_rate, round(avg(1 - levenshtein(t, p) / greatest(length(t), length(p), 1)), 6)::DOUBLE AS char_accuracy,
    round((SELECT same FROM s) / (17 * count(*)), 6)::DOUBLE AS position_accuracy FROM z""",
)
def a17(spark, sf):
    part = table(spark, sf, "part")
    p = F.when(c("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.upper(F.concat("p_type", "p_name")))
    return A.sequence_metrics(part.select(F.upper("p_name").alias("t"), p.alias("p")), "t", "p", "^[A-Z]+$", 17)


@query("a20_plurality", "WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders WHERE length(o_orderpriority) >= 6 GROUP BY 1, 2) SELECT o_custkey, arg_max(o_orderpriority, (n, -f)) AS plurality, max(n) AS votes FROM g GROUP BY 1")
def a20(spark, sf):
    return A.plurality(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", 6)


@query("a22_independent_frames", "SELECT lang, count(DISTINCT CASE WHEN doc_id % 5 > 0 THEN md5(text) END) AS frames FROM documents GROUP BY 1")
def a22(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.when(c("doc_id") % 5 > 0, F.md5("text")).otherwise("").alias("h"))
    return A.independent_frames(d, ["lang"], "h")


KINDS = {"payloads": "view", "decoded": "click", "detections": "purchase", "timeouts": "error"}


@query(
    "a23_stage_counters",
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{v}') AS {n}, min(epoch_us(ts) // 1000) FILTER (event_type = '{v}') AS first_{n}" for n, v in KINDS.items()) + " FROM events GROUP BY 1",
)
def a23(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", epoch_ms("ts").alias("ts_ms"))
    return A.stage_counters(ev, ["user_id"], "event_type", "ts_ms", KINDS)


@query(
    "a24_dataset_summary",
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, count(*) AS n, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY {d}" for d in ("p_brand", "p_type", "p_size")),
)
def a24(spark, sf):
    return A.dataset_summary(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], {"large": c("p_size") > 25})


@query(
    "a25_stream_health",
    """SELECT event_type, count(*) AS frames, count(*) FILTER (value <= 20) AS failures, round(s, 3)::DOUBLE AS elapsed_s, round(count(*) / s, 6)::DOUBLE AS read_rate, round(count(*) FILTER (value > 20) / s, 6)::DOUBLE AS decode_rate, round(avg(value), 4)::DOUBLE AS mean_ms
    FROM (SELECT *, (max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type) - min(epoch_us(ts) // 1000) OVER (PARTITION BY event_type))::DOUBLE / 1000 AS s FROM events) GROUP BY event_type, s""",
)
def a25(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "value", epoch_ms("ts").alias("ts_ms"))
    return A.stream_health(ev, ["event_type"], "ts_ms", c("value") > 20, "value")


@query(
    "a26_task_telemetry",
    "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{v}') AS {n}" for n, v in [("ok", "click"), ("empty", "view"), ("timeouts", "error"), ("crashes", "signup"), ("errors", "purchase")]) + ", bool_or(value > 400) AS deadline_hit FROM events GROUP BY 1",
)
def a26(spark, sf):
    names = {"click": "OK", "view": "EMPTY", "error": "TIMEOUT", "signup": "CRASH", "purchase": "ERROR"}
    from marktrace.functions.text import lookup

    return A.task_telemetry(table(spark, sf, "events").withColumn("status", lookup(c("event_type"), names)), ["user_id"], "status", c("value") > 400)


@query("a27_class_weights", "WITH g AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_type, n, round((SELECT count(*) / sum(1.0::DOUBLE / n) FROM g) / n, 6)::DOUBLE AS weight FROM g")
def a27(spark, sf):
    return A.class_weights(table(spark, sf, "part"), "p_type")


@query("a28_evidence_items", """WITH e AS (SELECT o_custkey, count(DISTINCT (o_orderpriority, o_orderstatus)) AS items, list_sort(list(DISTINCT o_orderpriority || '|' || o_orderstatus)) AS held FROM orders GROUP BY 1)
    SELECT o_custkey, items, min(o_custkey) OVER (PARTITION BY held) AS same_as FROM e""")
def a28(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    one = A.evidence_signature(o, ["o_custkey"], ["o_orderpriority", "o_orderstatus"])
    # the same evidence in other order and partly twice: signatures meet exactly where the evidence is equal
    two = A.evidence_signature(o.union(o.filter("o_orderstatus = 'F'")).repartition(F.xxhash64(*o.columns)), ["o_custkey"], ["o_orderpriority", "o_orderstatus"])
    first = two.groupBy("signature").agg(F.min("o_custkey").alias("same_as"))
    return one.join(first, "signature", "left").select("o_custkey", "items", "same_as")


@query(
    "a29_dashboard_stats",
    "SELECT count(*) AS total, count(*) FILTER (o_orderdate = '1998-01-01') AS today, count(*) FILTER (o_orderkey % 4 > 0) AS with_tag, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*))::DOUBLE AS success_percent FROM orders",
)
def a29(spark, sf):
    o = table(spark, sf, "orders").withColumns({"tag": F.when(c("o_orderkey") % 4 > 0, c("o_orderpriority")).otherwise("NO_TAG"), "status": F.when(c("o_orderstatus") == "F", "SUCCESS").otherwise("TIMEOUT")})
    return A.dashboard_stats(o, F.to_date("o_orderdate"), F.to_date(lit("1998-01-01")), "tag", "status")


@query(
    "a32_latency_percentiles",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(value, 0.95), 6)::DOUBLE AS p95, round(quantile_cont(value, 0.99), 6)::DOUBLE AS p99 FROM events GROUP BY 1",
)
def a32(spark, sf):
    p = A.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", *[F.round(x, 6).alias(x) for x in ("p50", "p95", "p99")])


@query(
    "a33_retention_totals",
    """WITH m AS (SELECT max(doc_id) + 1 AS now_id FROM documents), f AS (SELECT doc_id, n_chars, (now_id - doc_id) > 600 AS by_age, (now_id - doc_id) < 20 AS protected FROM documents, m),
    r AS (SELECT *, sum(CASE WHEN by_age THEN 0 ELSE n_chars END) OVER (ORDER BY doc_id DESC) AS left_over FROM f), g AS (SELECT *, by_age OR (NOT protected AND left_over > 1000000) AS gone FROM r)
    SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (gone) AS candidates, sum(CASE WHEN gone THEN 0 ELSE n_chars END)::BIGINT AS kept_bytes FROM g""",
)
def a33(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", c("doc_id").alias("mtime_ms"), c("n_chars").alias("size"), c("doc_id").cast("string").alias("path"))
    now = docs.agg(F.max("doc_id") + 1).first()[0]
    return A.retention_totals(W.retention_marks(docs, [], lit(now), 600, 1_000_000, 20))


@query("a34_acceptance_rate", "SELECT p_type, count(*) AS processed, count(*) FILTER (p_size > 30) AS accepted, round(100.0 * count(*) FILTER (p_size > 30) / count(*))::DOUBLE AS accept_percent FROM part GROUP BY 1")
def a34(spark, sf):
    return A.acceptance_rate(table(spark, sf, "part"), ["p_type"], c("p_size") > 30)


@query(
    "a35_operational_snapshot",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS open_sessions, count(*) FILTER (o_orderstatus = 'P') AS finalising,
    arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS last_session, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS last_failure_stage FROM orders GROUP BY 1""",
)
def a35(spark, sf):
    state = F.when(c("o_orderstatus") == "F", "DONE").when(c("o_orderstatus") == "P", "FINALIZING").otherwise("ACTIVE")
    s = table(spark, sf, "orders").select("o_custkey", state.alias("state"), c("o_orderkey").alias("session_id"), c("o_orderpriority").alias("failure_stage"), epoch_ms("o_orderdate").alias("finalised_ms"))
    return A.operational_snapshot(s, ["o_custkey"], ["DONE"])


@query("a36_observation_status", "SELECT round((max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 3600000.0, 4)::DOUBLE AS elapsed_hours, 'COMPLETED' AS status, 'b1' AS build FROM events")
def a36(spark, sf):
    return A.observation_status(table(spark, sf, "events").select(epoch_ms("ts").alias("t")), "t", 600, "b1")


@query(
    "h5_edge_report",
    f"""WITH {EDGES_SQL}, w AS (SELECT *, lag(ts_ms) OVER (PARTITION BY user_id, value ORDER BY ts_ms) AS same0 FROM edges)
    SELECT user_id, count(*) FILTER (value = 1) AS rising, count(*) FILTER (value = 0) AS falling, min(CASE WHEN value = 1 THEN ts_ms END) AS first_rise_ms, max(CASE WHEN value = 1 THEN (ts_ms - same0)::DOUBLE END) AS longest_interval_ms FROM w GROUP BY 1""",
)
def h5_edges(spark, sf):
    from marktrace.operators import edges as E

    e = E.pulse_widths(E.debounce_edges(samples(spark, sf), ["user_id"], DEBOUNCE, tie="event_id"), DEBOUNCE).plain()
    rising = c("value") == 1
    return e.groupBy("user_id").agg(
        F.count_if(rising).alias("rising"), F.count_if(~rising).alias("falling"), F.min(F.when(rising, c("ts_ms"))).alias("first_rise_ms"), F.max("since_rising_ms").alias("longest_interval_ms")
    )


# ---- set operations ---------------------------------------------------------------------------


@query("u3_evidence_union", "SELECT k, count(*) AS n, round(sum(w), 4)::DOUBLE AS w FROM (SELECT l_orderkey AS k, l_quantity AS w FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice FROM orders) GROUP BY 1")
def u3(spark, sf):
    a = table(spark, sf, "lineitem").select(c("l_orderkey").alias("k"), c("l_quantity").alias("w"))
    b = table(spark, sf, "orders").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("w"))
    return a.unionByName(b).groupBy("k").agg(F.count(lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("w"))


@query("u4_set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("u5_set_intersection", "SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type || p_brand, ''))))::INTEGER AS shared FROM part")
def u5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(F.split("p_name", ""), F.split(F.concat("p_type", "p_brand"), ""))).alias("shared"))


@query("u6_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def u6(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("u7_column_union", "SELECT r_regionkey AS id, r_name AS name, NULL::INTEGER AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def u7(spark, sf):
    a = table(spark, sf, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("name"))
    b = table(spark, sf, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name"), c("n_regionkey").alias("parent"))
    return a.unionByName(b, allowMissingColumns=True)

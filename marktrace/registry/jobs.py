"""Composite jobs on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions.decisions import CollectionPolicy, failure_stage, final_status
from marktrace.functions.times import epoch_ms
from marktrace.operators import aggregates as A
from marktrace.operators import edges as E
from marktrace.operators.ordered import order_rows
from marktrace.operators.windows import asof_owner
from marktrace.plans import curation as C
from marktrace.plans import images as I
from marktrace.plans import logs as L
from marktrace.plans import timeline as T
from marktrace.plans import variants as IV
from marktrace.plans.observation import observation_report
from marktrace.plans.retention import retention_plan
from marktrace.registry.base import query, table
from marktrace.registry.edges import DEBOUNCE, EDGES_SQL, samples
from marktrace.session import settle

c, lit = F.col, F.lit
HOUR = 3_600_000

# ---- session timeline: signups are triggers, purchases and clicks results, errors exit signals --------

SESSION = T.SessionParams(deadline_ms=30 * HOUR, grace_ms=6 * HOUR)


def triggers(spark, sf):
    ev = table(spark, sf, "events").filter("event_type = 'signup'").select("user_id", epoch_ms("ts").alias("start_ms"), c("event_id").alias("session_id"))
    return E.trigger_acceptance(order_rows(ev, ["user_id"], ["start_ms", "session_id"]), E.TriggerParams(24 * HOUR))


def owned(spark, sf, accepted, kind):
    ev = table(spark, sf, "events").filter(c("event_type") == kind).select("user_id", epoch_ms("ts").alias("at_ms"), c("event_id").alias("result_id"), c("props").alias("value"), (c("value") / 500).alias("confidence"))
    return asof_owner(ev, accepted, ["user_id"], "at_ms", "start_ms", ["session_id"], "result_id").filter("session_id is not null").drop("start_ms")


def timeline(spark, sf, params=SESSION):
    # the accepted triggers feed four branches: write them once instead of folding again in each
    acc = settle(triggers(spark, sf).filter("decision = 'ACCEPTED'").drop("decision"))
    exits = table(spark, sf, "events").filter("event_type = 'error'").select("user_id", epoch_ms("ts").alias("at_ms"), c("event_id").alias("exit_id"))
    return T.session_timeline(acc, owned(spark, sf, acc, "purchase"), owned(spark, sf, acc, "click"), exits, ["user_id"], params)


TIMELINE_SQL = """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) // 1000 AS start_ms, event_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE event_type = 'signup'),
walk AS (SELECT user_id, start_ms, session_id, rn, true AS ok, start_ms AS last FROM s WHERE rn = 1 UNION ALL
 SELECT s.user_id, s.start_ms, s.session_id, s.rn, s.start_ms >= w.last + 86400000, CASE WHEN s.start_ms >= w.last + 86400000 THEN s.start_ms ELSE w.last END FROM walk w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1),
acc AS (SELECT user_id, start_ms, session_id FROM walk WHERE ok),
ev AS (SELECT e.user_id, e.event_id, e.event_type, e.props, e.value, epoch_us(e.ts) // 1000 AS at_ms, a.session_id, a.start_ms FROM events e ASOF JOIN acc a ON e.user_id = a.user_id AND epoch_us(e.ts) // 1000 >= a.start_ms),
ex AS (SELECT session_id, min(at_ms) AS exit_ms FROM ev WHERE event_type = 'error' AND at_ms > start_ms AND at_ms <= start_ms + 108000000 GROUP BY 1),
res AS (SELECT ev.*, exit_ms, CASE WHEN at_ms >= exit_ms THEN CASE WHEN at_ms > exit_ms + 21600000 THEN 'LATE' ELSE 'ACCEPTED' END WHEN at_ms > start_ms + 108000000 THEN 'LATE' ELSE 'ACCEPTED' END AS v FROM ev LEFT JOIN ex USING (session_id) WHERE event_type IN ('purchase', 'click')),
won AS (SELECT session_id, arg_min(props, at_ms) FILTER (event_type = 'purchase') AS ident, arg_min(value, at_ms) FILTER (event_type = 'purchase') AS conf, min(at_ms) FILTER (event_type = 'purchase') AS id_ms,
 arg_min(props, at_ms) FILTER (event_type = 'click') AS tag, min(at_ms) FILTER (event_type = 'click') AS tag_ms FROM res WHERE v = 'ACCEPTED' GROUP BY 1),
fin AS (SELECT a.user_id, a.session_id, a.start_ms, ex.exit_ms, CASE WHEN exit_ms IS NULL THEN a.start_ms + 108000000 WHEN ident IS NOT NULL AND tag IS NOT NULL THEN greatest(exit_ms, id_ms, tag_ms) ELSE exit_ms + 21600000 END AS finalised_ms,
 CASE WHEN ident IS NOT NULL AND tag IS NOT NULL THEN 'SUCCESS' WHEN ident IS NOT NULL OR tag IS NOT NULL THEN 'PARTIAL_SUCCESS' ELSE 'TIMEOUT' END AS status, coalesce(ident, 'NO_READ') AS identifier,
 CASE WHEN ident IS NULL THEN 0.0::DOUBLE ELSE conf / 500 END AS confidence, coalesce(tag, 'NO_TAG') AS tag, (id_ms - a.start_ms)::DOUBLE AS id_latency_ms FROM acc a LEFT JOIN ex USING (session_id) LEFT JOIN won USING (session_id))"""


@query("h11_session_timeline", f"{TIMELINE_SQL} SELECT * FROM fin")
def h11(spark, sf):
    return timeline(spark, sf)[0].select("user_id", "session_id", "start_ms", "exit_ms", "finalised_ms", "status", "identifier", "confidence", "tag", "id_latency_ms")


@query(
    "h11_result_verdicts",
    f"{TIMELINE_SQL} SELECT r.event_id AS result_id, r.session_id, CASE WHEN v = 'ACCEPTED' AND at_ms > finalised_ms THEN 'FINALIZED_REJECTED' ELSE v END AS verdict FROM res r JOIN fin USING (session_id)",
)
def h11b(spark, sf):
    return timeline(spark, sf)[1].select("result_id", "session_id", "verdict")


INVARIANTS_SQL = f"""{TIMELINE_SQL},
    told AS (SELECT CASE WHEN v = 'ACCEPTED' AND at_ms > finalised_ms THEN 'FINALIZED_REJECTED' ELSE v END AS verdict FROM res JOIN fin USING (session_id)),
    sides AS (
      SELECT 'accepted_triggers_are_rows' AS "check", (SELECT count(*) FROM walk WHERE ok) AS expected, (SELECT count(*) FROM fin) AS actual
      UNION ALL SELECT 'distinct_ids_are_rows', (SELECT count(*) FROM fin), (SELECT count(DISTINCT session_id) FROM fin)
      UNION ALL SELECT 'no_empty_ids', 0, (SELECT count(*) FROM fin WHERE coalesce(session_id::VARCHAR, '') = '')
      UNION ALL SELECT 'no_mismatch', 0, (SELECT count(*) FROM told WHERE verdict = 'SESSION_MISMATCH')
      UNION ALL SELECT 'accepted_plus_dropped_is_seen', (SELECT count(*) FROM events WHERE event_type = 'signup'), (SELECT count(*) FILTER (ok) + count(*) FILTER (NOT ok) FROM walk)
      UNION ALL SELECT 'taken_plus_rejected_is_received', (SELECT count(*) FROM res), (SELECT count(*) FILTER (verdict = 'ACCEPTED') + count(*) FILTER (verdict IN ('LATE', 'FINALIZED_REJECTED', 'UNKNOWN_SESSION', 'SESSION_MISMATCH')) FROM told))
    SELECT "check", expected::BIGINT AS expected, actual::BIGINT AS actual, expected = actual AS ok FROM sides"""


@query("h14_invariants", INVARIANTS_SQL)
def h14(spark, sf):
    rows, verdicts = timeline(spark, sf)
    return T.invariant_checks(triggers(spark, sf), rows, verdicts)


@query("a30_invariants", f"SELECT count(*) AS checks, count(*) FILTER (NOT ok) AS broken FROM ({INVARIANTS_SQL})")
def a30(spark, sf):
    return h14(spark, sf).agg(F.count(lit(1)).alias("checks"), F.count_if(~c("ok")).alias("broken"))


@query(
    "st4_read_windows",
    """WITH s AS (SELECT event_id AS session_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + 20000 + floor(value)::BIGINT * 100 AS d FROM events WHERE event_type = 'signup')
    SELECT session_id, 0 AS attempt, a - 250 AS window_start, least(d, a + 6000) AS window_end FROM s
    UNION ALL SELECT session_id, (1 + (f - a - 8000) // 6000)::INTEGER, f - 250, least(d, f + 4000) FROM (SELECT session_id, a, d, unnest(range(a + 8000, d, 6000)) AS f FROM s)""",
)
def st4(spark, sf):
    s = table(spark, sf, "events").filter("event_type = 'signup'").select(c("event_id").alias("session_id"), epoch_ms("ts").alias("a"), (epoch_ms("ts") + 20000 + F.floor("value") * 100).alias("d"))
    return T.read_windows(s, "a", "d").select("session_id", "attempt", "window_start", "window_end")


@query(
    "st7_restart_recovery",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < '1998-01-01' THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'SUCCESS' END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderdate < '1998-01-01' THEN 'RESTART_RECOVERY' END AS failure_reason, CASE WHEN o_orderstatus = 'P' AND o_orderdate < '1998-01-01' THEN 99::BIGINT END AS finalised_ms FROM orders",
)
def st7(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "P", "PENDING").otherwise("SUCCESS").alias("status"), lit(None).cast("string").alias("failure_reason"), lit(None).cast("long").alias("finalised_ms"), epoch_ms("o_orderdate").alias("start_ms"))
    return T.recover_pending(o, lit(883612800000), lit(99).cast("long")).drop("start_ms")


STAGES = ["payloads", "decoded", "detections", "crops", "rejected", "submitted", "completed", "timeouts", "ambiguous"]


@query(
    "c21_failure_stage",
    """WITH z AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) FILTER (event_id % 9 < 8) AS payloads, count(*) FILTER (event_id % 9 < 7) AS decoded, count(*) FILTER (event_id % 7 < 5) AS detections, count(*) FILTER (event_type = 'view') AS crops,
    count(*) FILTER (event_type = 'view' AND value < 10) AS rejected, count(*) FILTER (event_type IN ('click', 'view')) AS submitted, count(*) FILTER (event_type = 'click') AS completed, count(*) FILTER (event_type = 'error') AS timeouts, count(*) FILTER (event_type = 'signup') AS ambiguous, bool_or(value > 300) AS read FROM events GROUP BY 1, 2)
    SELECT user_id, day, CASE WHEN user_id % 20 = 0 THEN 'MISSED_CAPTURE_WINDOW' WHEN user_id % 20 = 1 THEN 'DATABASE_FAILURE' WHEN read THEN NULL WHEN payloads = 0 THEN 'NO_PAYLOAD' WHEN decoded = 0 THEN 'DECODE_FAILED' WHEN detections = 0 THEN 'NO_DETECTION' WHEN crops = 0 THEN 'NO_CROP'
    WHEN crops = rejected THEN 'CROP_REJECTED' WHEN submitted = 0 THEN 'OCR_NOT_SUBMITTED' WHEN completed = 0 THEN 'OCR_NOT_STARTED' WHEN timeouts > 0 THEN 'OCR_TIMEOUT' WHEN ambiguous > 0 THEN 'OCR_AMBIGUOUS' ELSE 'OCR_NO_READ' END AS stage FROM z""",
)
def c21(spark, sf):
    k, t = c("event_id"), c("event_type")
    flags = [k % 9 < 8, k % 9 < 7, k % 7 < 5, t == "view", (t == "view") & (c("value") < 10), t.isin("click", "view"), t == "click", t == "error", t == "signup"]
    day = F.floor(epoch_ms("ts") / 86_400_000).alias("day")
    z = table(spark, sf, "events").groupBy("user_id", day).agg(*[F.count_if(f).alias(n) for n, f in zip(STAGES, flags)], F.bool_or(c("value") > 300).alias("read"))
    u = c("user_id") % 20
    z = z.withColumns({"failure_reason": F.when(u == 0, "MISSED_CAPTURE_WINDOW").when(u == 1, "DATABASE_FAILED"), "identifier": F.when(c("read"), "X1").otherwise("NO_READ")})
    return z.select("user_id", "day", failure_stage().alias("stage"))


@query(
    "c22_final_status",
    """SELECT o_orderkey, CASE WHEN i AND t THEN 'SUCCESS' WHEN i OR t THEN 'PARTIAL_SUCCESS' ELSE 'TIMEOUT' END AS exit_status, CASE WHEN i AND t THEN NULL WHEN i THEN 'VIN_OK_RFID_TIMEOUT' WHEN t THEN 'RFID_OK_VIN_TIMEOUT' ELSE 'BOTH_TIMEOUT' END AS exit_reason,
    CASE WHEN i AND t THEN 'SUCCESS' ELSE 'TIMEOUT' END AS single_status, CASE WHEN i THEN 'SUCCESS' ELSE 'TIMEOUT' END AS no_tag_status FROM (SELECT o_orderkey, o_orderstatus = 'F' AS i, o_totalprice > 200000 AS t FROM orders)""",
)
def c22(spark, sf):
    i, t = c("o_orderstatus") == "F", c("o_totalprice") > 200000
    s, r = final_status(i, t, True)
    return table(spark, sf, "orders").select("o_orderkey", s.alias("exit_status"), r.alias("exit_reason"), final_status(i, t, False)[0].alias("single_status"), final_status(i, t, False, False)[0].alias("no_tag_status"))


# ---- reports ----------------------------------------------------------------------------------


@query(
    "h5_observation_report",
    f"""WITH {EDGES_SQL}, w AS (SELECT *, CASE WHEN value = 1 THEN ts_ms - lag(ts_ms) OVER (PARTITION BY user_id, value ORDER BY ts_ms) END AS gap, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS e0 FROM edges),
    l AS (SELECT value, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events)
    SELECT (SELECT count(*) FROM edges WHERE value = 1) AS rising_total, (SELECT count(*) FROM edges WHERE value = 1 AND event_id % 5 > 0) AS accepted, (SELECT count(*) FROM edges WHERE value = 1 AND event_id % 5 = 0) AS early,
    (SELECT count(*) FROM w WHERE value = 0 AND NOT (ts_ms - e0 BETWEEN 43200000 AND 345600000)) AS invalid_pulse,
    (SELECT round(min(gap) / 1000.0, 2)::DOUBLE FROM w) AS min_interval_s, (SELECT round(median((gap / 1000.0)::DOUBLE), 2) FROM w WHERE gap IS NOT NULL) AS median_interval_s, (SELECT round(max(gap) / 1000.0, 2)::DOUBLE FROM w) AS max_interval_s,
    (SELECT count(*) FROM events WHERE event_type = 'error') AS suppressed, (SELECT count(*) FROM orders) AS records, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0) AS missing_evidence,
    (SELECT (count(*) - count(DISTINCT o_custkey))::BIGINT FROM orders) AS duplicates, (SELECT round(avg(value), 1) FROM events) AS mean_latency_ms, (SELECT round(value, 1) FROM l WHERE rn = floor(0.95::DOUBLE * (n - 1)) + 1) AS p95_latency_ms,
    (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'error') AND bool_or(event_type = 'click'))) AS conflicts,
    (SELECT round((max(ts_ms) - min(ts_ms)) / 3600000.0, 4)::DOUBLE FROM edges) AS elapsed_hours, 'NOT COMPLETED' AS status, 'b7' AS build""",
)
def h5(spark, sf):
    e = E.pulse_widths(E.debounce_edges(samples(spark, sf), ["user_id"], DEBOUNCE, tie="event_id"), DEBOUNCE).plain()
    e = e.withColumn("decision", F.when((c("value") == 1) & (c("event_id") % 5 == 0), "SUSPICIOUS_EARLY_TRIGGER").when(c("value") == 1, "ACCEPTED").otherwise(c("pulse_decision")))
    ev = table(spark, sf, "events")
    k = c("o_orderkey")
    s = table(spark, sf, "orders").select(
        k.alias("session_id"), c("o_custkey").cast("string").alias("identifier"), F.when(c("o_orderstatus") == "F", "TIMEOUT").otherwise("SUCCESS").alias("status"), F.when(k % 3 == 0, "x.jpg").otherwise("").alias("image_path")
    )
    eng = ev.select(c("user_id").alias("session_id"), F.upper(F.substring("event_type", 1, 1)).alias("text"), c("value").alias("latency_ms"))
    pairs = spark.createDataFrame([("C", "E")], "a string, b string")
    return observation_report(e, ev.filter("event_type = 'error'").select(c("event_type").alias("decision")), s, eng, pairs, 10_000, "b7")


@query("h6_evaluation", "WITH x AS (SELECT quality::VARCHAR AS t, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS p FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, round(avg((t = p)::INT), 6)::DOUBLE AS exact_rate, 1.0::DOUBLE AS valid_rate, round(avg((t = p)::INT), 6)::DOUBLE AS char_accuracy, round(avg((t = p)::INT), 6)::DOUBLE AS position_accuracy FROM x")
def h6(spark, sf):
    from marktrace.registry.reports import predictions

    return A.sequence_metrics(predictions(spark, sf), "truth", "predicted", "^[01]$", 1)


def pixels(spark, sf):
    """Whole document texts as gray images, 64 bytes per row, the last row filled up with zeros."""
    raw = F.encode("text", "UTF-8")
    rows = F.ceil(F.octet_length(raw) / 64).cast("int")
    return table(spark, sf, "documents").select("doc_id", rows.alias("height"), lit(64).alias("width"), lit(1).alias("channels"), F.rpad(raw, rows * 64, F.unhex(lit("00"))).alias("data"))


@query("g1_image_features")
def g1(spark, sf):
    return I.image_features(pixels(spark, sf), ["doc_id"])


@query("g2_image_hashes")
def g2(spark, sf):
    return I.image_hashes(pixels(spark, sf), ["doc_id"])


@query("g1_brightness", "WITH b AS (SELECT doc_id, encode(text) AS d, (octet_length(encode(text)) + 63) // 64 AS h FROM documents) SELECT doc_id, CASE WHEN h > 0 THEN 64 END::INTEGER AS width, CASE WHEN h > 0 THEN h END::INTEGER AS height FROM b")
def g1b(spark, sf):
    return g1(spark, sf).select("doc_id", "width", "height")


@query("h7_review_dataset")
def h7(spark, sf):
    from marktrace.registry.scalars import paths, suggestions

    img = g1(spark, sf).join(paths(spark, sf), "doc_id")
    s = suggestions(spark, sf).join(paths(spark, sf), "doc_id").select("path", c("engine").alias("ocr_suggested"), F.when(c("doc_id") % 5 == 0, "NO_READ").otherwise("ACCEPT").alias("ocr_status"), c("plural").alias("ocr_raw_best"))
    out = C.prepare_review_dataset(img, s)
    return out.select("doc_id", "session_id", "filename_guess", "best_suggestion", "agreement", "lighting", "quality", "split", "review_priority")


@query("h7_review_summary", "SELECT 'split' AS dimension, CASE WHEN s < 70 THEN 'train' WHEN s < 85 THEN 'validation' ELSE 'test' END AS value, count(*) AS n FROM (SELECT ('0x' || substr(sha1('S' || doc_id), 1, 8))::BIGINT % 100 AS s FROM documents) GROUP BY 2")
def h7b(spark, sf):
    return A.dataset_summary(h7(spark, sf), ["split"])


@query("h8_final_labels", "SELECT CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents WHERE doc_id % 4 < 2 AND doc_id % 6 > 0 GROUP BY 1")
def h8(spark, sf):
    from marktrace.operators.predicates import finalised_reviews
    from marktrace.registry.scalars import reviews

    done = finalised_reviews(reviews(spark, sf)).withColumn("split", F.when(c("split") == "odd", "train").otherwise(c("split")))
    return done.groupBy("split").agg(F.count(lit(1)).alias("n"))


def items(spark, sf):
    from marktrace.registry.scalars import curation

    cur = curation(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return cur.select(
        c("p_partkey").alias("collection_id"), (c("p_retailprice") / 3000).alias("model_confidence"), "review_status", "label_status", "expected_character",
        F.upper(F.substring("p_name", 1, 1)).alias("model_character"), c("p_size").alias("character_position"), F.concat_ws("-", "p_name", "p_size").alias("item_key"),
    )


@query(
    "h9_curation_queue",
    """WITH i AS (SELECT p_partkey AS collection_id, p_retailprice / 3000 AS cf, CASE WHEN p_size % 5 = 0 THEN NULL ELSE upper(substr(p_name, 1, 1)) END AS ex, upper(substr(p_name, 1, 1)) AS mc, p_size FROM part WHERE p_size % 3 = 0)
    SELECT collection_id, row_number() OVER (ORDER BY CASE ex WHEN 'S' THEN 0 WHEN 'B' THEN 1 ELSE 99 END, cf DESC, collection_id) AS position, mc IN ('S', 'R') AS confusion_risk, p_size + 1 AS display_position FROM i""",
)
def h9(spark, sf):
    return C.curation_queue(items(spark, sf), ["S", "B"], "SR").select("collection_id", "position", "confusion_risk", "display_position")


@query(
    "h9_import_reviewed",
    """WITH r AS (SELECT p_partkey AS collection_id, p_name || '-' || p_size AS item_key FROM part WHERE p_size % 3 = 1 AND p_size % 2 = 0 AND p_size % 5 <> 0 AND contains('SBR', upper(substr(p_name, 1, 1))))
    SELECT item_key, min(collection_id) AS collection_id, (SELECT count(*) FROM r) AS marked FROM r WHERE item_key NOT IN (SELECT item_key FROM r WHERE collection_id % 50 = 0) GROUP BY 1""",
)
def h9b(spark, sf):
    it = items(spark, sf)
    known = it.filter("collection_id % 50 = 0 and review_status = 'ACCEPTED'").select("item_key")
    fresh, marked = C.import_reviewed(it, known, "SBR")
    n = marked.filter("review_status = 'IMPORTED'").agg(F.count(lit(1)).alias("marked"))
    return fresh.select("item_key", "collection_id").join(F.broadcast(n))  # ``n`` is one count


@query(
    "h10_active_learning",
    """SELECT p_partkey AS session_id, count(*) AS n, count(*) FILTER (cf < 0.85) AS low FROM (SELECT p_partkey, i, ((p_partkey * i) % 100) / 100.0 AS cf, ((p_partkey * i) % 7) / 10.0 AS sc FROM (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i FROM part)) WHERE cf < 0.85 OR cf - sc < 0.10 GROUP BY 1""",
)
def h10(spark, sf):
    k = c("p_partkey")
    p = table(spark, sf, "part").select(k.alias("session_id"), "p_name", "p_size", F.explode(F.sequence(lit(1), F.length("p_name"))).alias("i"))
    ch = F.upper(F.substr("p_name", c("i"), lit(1)))
    pos = p.select(
        "session_id", (c("i") - 1).alias("position"), F.when(ch == "", "X").otherwise(ch).alias("char"), lit("A").alias("gated"),
        ((c("session_id") * c("i")) % 100 / 100.0).alias("confidence"), ((c("session_id") * c("i")) % 7 / 10.0).alias("second"), lit(False).alias("disagree"),
        lit("ENGRAVED_BOXES").alias("alignment"), F.md5(c("session_id").cast("string")).alias("source_hash"), F.sha1(F.concat_ws("-", "session_id", "i")).alias("crop_hash"),
    )
    s = table(spark, sf, "part").filter(k % 2 == 0).select(k.alias("session_id"), F.upper("p_name").alias("trusted_id"))
    out = C.collect_active_learning(pos, s, CollectionPolicy(supported="ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"))
    return out.groupBy("session_id").agg(F.count(lit(1)).alias("n"), F.count_if(F.contains("collection_reason", lit("LOW_CONFIDENCE"))).alias("low"))


@query(
    "h12_log_analytics",
    "SELECT CASE event_type WHEN 'click' THEN 'OPERATOR' WHEN 'view' THEN 'CAMERA' ELSE 'SYSTEM' END AS source, count(*) AS total, count(*) FILTER (event_id % 2 = 0) AS masked FROM events GROUP BY 1",
)
def h12(spark, sf):
    body = F.when(c("event_id") % 2 == 0, F.concat(lit("password="), c("event_id").cast("string"))).otherwise(c("props"))
    tag = F.when(c("event_type") == "click", lit("[UI] ")).otherwise("")
    line = F.concat(lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), lit("] [INFO] ["), F.when(c("event_type") == "view", "grabber").otherwise("main"), lit("] "), tag, body)
    logs = L.log_analytics(table(spark, sf, "events").select(line.alias("value")), {"UI": "OPERATOR"}, {"grabber": "CAMERA"})
    return L.log_report(logs, {"masked": r"password=\*\*\*$"}).select("source", "total", "masked")


@query(
    "h13_retention_plan",
    """WITH m AS (SELECT max(doc_id) + 1 AS now_id FROM documents), f AS (SELECT doc_id, source, n_chars, (now_id - doc_id) > 600 AS by_age, (now_id - doc_id) < 20 AS protected FROM documents, m),
    r AS (SELECT *, sum(CASE WHEN by_age THEN 0 ELSE n_chars END) OVER (PARTITION BY source ORDER BY doc_id DESC) AS t FROM f), g AS (SELECT *, by_age OR (NOT protected AND t > 20000) AS gone FROM r)
    SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (gone) AS candidates, sum(CASE WHEN gone THEN 0 ELSE n_chars END)::BIGINT AS kept_bytes FROM g GROUP BY 1""",
)
def h13(spark, sf):
    docs = table(spark, sf, "documents").select("source", c("doc_id").alias("mtime_ms"), c("n_chars").alias("size"), c("doc_id").cast("string").alias("path"))
    now = docs.agg(F.max("mtime_ms") + 1).first()[0]
    return retention_plan(docs, ["source"], lit(now), 600, 20_000, 20)[1]


def _length_model(batch):
    import pandas as pd

    return pd.DataFrame({"words": batch["text"].str.count(r"[^ \n\t]+").astype("int64")})


@query("h15_score_batch", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\n\\t]+'))::BIGINT AS words, NULL::VARCHAR AS error FROM documents")
def h15(spark, sf):
    return I.score_batch(table(spark, sf, "documents").select("doc_id", "text"), ["text"], _length_model, "words bigint").drop("text")


@query("x5_positions", "SELECT p_partkey, (i - 1)::INTEGER AS position, substr(p_name, i, 1) AS char FROM part, (SELECT unnest(range(1, 60)) AS i) WHERE i <= length(p_name)")
def x5(spark, sf):
    return I.explode_positions(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name").drop("p_name")


VARIANTS_SQL = """WITH d AS (SELECT doc_id, (octet_length(encode(text)) + 63) // 64 AS h FROM documents),
    v AS (SELECT * FROM (VALUES (1, 'raw', 1.0, 0.0), (2, 'stretched', 0.9, 0.0), (3, 'inverted', 0.7, 0.0), (4, 'raw@-3', 0.9, -3.0), (5, 'stretched@-3', 0.81, -3.0), (6, 'raw@+3', 0.9, 3.0), (7, 'stretched@+3', 0.81, 3.0),
      (8, 'raw@-6', 0.8, -6.0), (9, 'stretched@-6', 0.72, -6.0), (10, 'raw@+6', 0.8, 6.0), (11, 'stretched@+6', 0.72, 6.0)) x(turn, variant_name, weight, rotation)),
    one AS (SELECT doc_id, doc_id % 50 AS session_id, turn, variant_name, weight::DOUBLE AS weight, rotation::DOUBLE AS rotation, h FROM d, v WHERE h > 0)"""


def crop_variants(spark, sf):
    return IV.image_variants(pixels(spark, sf).withColumn("session_id", c("doc_id") % 50), ["session_id", "doc_id"])


@query("x5_image_variants", f"{VARIANTS_SQL} SELECT doc_id, variant_name, round(weight, 9) AS weight, rotation, h::INTEGER AS height, 64::INTEGER AS width, h * 64 AS n_bytes FROM one")
def x5_variants(spark, sf):
    return crop_variants(spark, sf).select("doc_id", "variant_name", F.round("weight", 9).alias("weight"), "rotation", "height", "width", F.octet_length("data").cast("long").alias("n_bytes"))


@query("x5_capped_variants", f"{VARIANTS_SQL} SELECT session_id, doc_id, variant_name FROM one QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn, doc_id) <= 48")
def x5_capped(spark, sf):
    return IV.capped_variants(crop_variants(spark, sf).drop("data"), "session_id", "doc_id", 48).select("session_id", "doc_id", "variant_name")

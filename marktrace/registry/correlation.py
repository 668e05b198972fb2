"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions.times import epoch_ms
from marktrace.operators import joins as J
from marktrace.registry.base import query, table
from marktrace.registry.scalars import curation

c, lit = F.col, F.lit
HOUR = 3_600_000

SESSIONS_SQL = """sess AS (SELECT event_id AS session_id, user_id, epoch_us(ts) // 1000 AS open_ms, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000 + 20 * 3600000 END AS exit_ms FROM events WHERE event_type = 'signup'),
res AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type IN ('click', 'purchase')),
linked AS (SELECT r.*, CASE WHEN r.event_id % 10 = 0 THEN -1 ELSE s.session_id END AS session_id FROM res r ASOF JOIN sess s ON r.user_id = s.user_id AND r.at_ms >= s.open_ms)"""


def sessions(spark, sf):
    ev = table(spark, sf, "events").filter("event_type = 'signup'")
    s = ev.select(c("event_id").alias("session_id"), "user_id", epoch_ms("ts").alias("open_ms"))
    return s.withColumn("exit_ms", F.when(c("session_id") % 4 == 0, c("open_ms") + 20 * HOUR))


def linked(spark, sf):
    from marktrace.operators.windows import asof_owner

    r = table(spark, sf, "events").filter(c("event_type").isin("click", "purchase")).select("event_id", "user_id", epoch_ms("ts").alias("at_ms"))
    own = asof_owner(r, sessions(spark, sf).select("user_id", "open_ms", "session_id"), ["user_id"], "at_ms", "open_ms", ["session_id"], "event_id")
    own = own.filter("session_id is not null").drop("open_ms")
    return own.withColumn("session_id", F.when(c("event_id") % 10 == 0, lit(-1)).otherwise(c("session_id")))


def session_limits(s):
    k = c("session_id")
    return s.select(
        "session_id",
        F.when(k % 5 == 0, c("open_ms") + 10 * HOUR).alias("finalised_ms"),
        "exit_ms",
        (c("exit_ms") + 8 * HOUR).alias("grace_ms"),
        (c("open_ms") + 48 * HOUR).alias("deadline_ms"),
        (k % 7 == 0).alias("waiting"),
        c("open_ms").alias("active_from_ms"),
        (c("open_ms") + 72 * HOUR).alias("active_to_ms"),
    )


VERDICT_SQL = f"""WITH {SESSIONS_SQL}, v AS (SELECT l.event_id, l.session_id, CASE WHEN s.session_id IS NULL THEN 'UNKNOWN_SESSION' WHEN s.session_id % 5 = 0 AND at_ms > open_ms + 36000000 THEN 'FINALIZED_REJECTED'
 WHEN at_ms >= exit_ms THEN CASE WHEN at_ms > exit_ms + 28800000 THEN 'LATE' ELSE 'ACCEPTED' END WHEN s.session_id % 7 = 0 THEN 'ACCEPTED' WHEN at_ms > open_ms + 259200000 THEN 'SESSION_MISMATCH' WHEN at_ms > open_ms + 172800000 THEN 'LATE' ELSE 'ACCEPTED' END AS verdict
 FROM linked l LEFT JOIN sess s ON s.session_id = l.session_id)"""


def verdicts(spark, sf):
    return J.correlate_results(linked(spark, sf), session_limits(sessions(spark, sf)), "session_id")


@query("j1_result_verdicts", f"{VERDICT_SQL} SELECT event_id, session_id, verdict FROM v")
def j1(spark, sf):
    return verdicts(spark, sf).select("event_id", "session_id", "verdict")


@query(
    "st3_late_policy_counts",
    f"{VERDICT_SQL} SELECT session_id % 10 AS station, count(*) AS received, count(*) FILTER (verdict = 'ACCEPTED') AS accepted, count(*) FILTER (verdict IN ('UNKNOWN_SESSION','FINALIZED_REJECTED','LATE')) AS late, count(*) FILTER (verdict = 'SESSION_MISMATCH') AS mismatch FROM v GROUP BY 1",
)
def st3(spark, sf):
    return J.verdict_counts(verdicts(spark, sf).withColumn("station", c("session_id") % 10), ["station"])


TAGS_SQL = """w AS (SELECT user_id, event_id AS session_id, epoch_us(ts) // 1000 - 250 AS s, epoch_us(ts) // 1000 + 86400000 AS e FROM events WHERE event_type = 'signup'),
h AS (SELECT user_id, 'T' || (event_id % 5) AS epc, (event_id % 4)::INTEGER AS antenna, CASE WHEN event_id % 9 = 0 THEN NULL ELSE -value END AS rssi, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type = 'view'),
l AS (SELECT w.user_id, session_id, epc, max(ts_ms) AS ts_ms, arg_max(antenna, (ts_ms, rssi, antenna)) AS antenna, arg_max(struct_pack(r := rssi), ts_ms).r AS rssi FROM w JOIN h ON w.user_id = h.user_id AND h.ts_ms BETWEEN s AND e GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(rssi, '-inf'::DOUBLE) DESC, ts_ms, epc DESC) AS rn FROM l)"""


def tag_hits(spark, sf):
    k = c("event_id")
    return table(spark, sf, "events").filter("event_type = 'view'").select(
        "user_id", F.concat(lit("T"), (k % 5).cast("string")).alias("epc"), (k % 4).cast("int").alias("antenna"), F.when(k % 9 != 0, -c("value")).alias("rssi"), epoch_ms("ts").alias("ts_ms")
    )


def tag_windows(spark, sf):
    return sessions(spark, sf).select("user_id", "session_id", c("open_ms").alias("start_ms"), (c("open_ms") + 24 * HOUR).alias("end_ms"))


@query("j2_strongest_tag", f"WITH {TAGS_SQL} SELECT user_id, session_id, epc, antenna, rssi, ts_ms FROM best WHERE rn = 1")
def j2(spark, sf):
    return J.strongest_tag(tag_hits(spark, sf), tag_windows(spark, sf), ["user_id"], "session_id", 24 * HOUR)


@query("x6_tag_predicate", "WITH " + TAGS_SQL.replace("WHERE event_type = 'view')", "WHERE event_type = 'view' AND event_id % 5 <> 3 AND (event_id % 9 = 0 OR -value > -60))") + " SELECT user_id, session_id, epc, antenna, rssi, ts_ms FROM best WHERE rn = 1")
def x6(spark, sf):
    """Only tags that the user's predicate accepts are looked at."""
    fine = (c("epc") != "T3") & (F.coalesce(c("rssi"), lit(-1.0)) > -60)
    return J.strongest_tag(tag_hits(spark, sf), tag_windows(spark, sf), ["user_id"], "session_id", 24 * HOUR, accept=fine)


@query("j3_stale_tags", f"WITH {TAGS_SQL} SELECT session_id, epc, CASE WHEN s + 250 + 43200000 - ts_ms > 21600000 THEN 'STALE_RFID_EVENT' END AS stale FROM best JOIN w USING (session_id) WHERE rn = 1")
def j3(spark, sf):
    best = J.strongest_tag(tag_hits(spark, sf), tag_windows(spark, sf), ["user_id"], "session_id", 24 * HOUR)
    start = tag_windows(spark, sf).select("session_id", (c("start_ms") + 12 * HOUR).alias("read_ms"))
    return best.join(start, "session_id").select("session_id", "epc", J.stale_reason(c("read_ms"), c("ts_ms"), 6 * HOUR).alias("stale"))


@query("j4_new_items", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1")
def j4(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return J.new_items(d, d.filter("doc_id % 10 = 0"), "digest", ["doc_id"])


@query("j5_accepted_lines", "SELECT o_orderkey, o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25 AND length(o_orderpriority) = 6 GROUP BY 1, 2")
def j5(spark, sf):
    li = table(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey"), (c("l_quantity") > 25).alias("accepted"))
    man = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return J.accepted_lines(man, li, "o_orderkey", "o_orderpriority", 6).groupBy("o_orderkey", "o_orderpriority").agg(F.count(lit(1)).alias("n"))


@query(
    "j6_align_engines",
    """SELECT user_id, """ + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{e}') AS {e}_value, arg_max(props, event_id) FILTER (event_type = '{e}') AS {e}_props" for e in ("click", "view", "error")) + " FROM events GROUP BY 1",
)
def j6(spark, sf):
    return J.align_engines(table(spark, sf, "events"), "user_id", "event_type", ["click", "view", "error"], ["value", "props"], "event_id")


@query("j7_truth_join", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::VARCHAR WHEN d.doc_id % 3 = 0 THEN d.lang END AS truth FROM documents d LEFT JOIN labels l USING (doc_id)")
def j7(spark, sf):
    pred = table(spark, sf, "documents").select("doc_id", "lang")
    truth = table(spark, sf, "labels").select("doc_id", c("quality").cast("string").alias("vin"))
    return J.truth_join(pred, truth, F.when(c("doc_id") % 3 == 0, c("lang")).otherwise(""), "doc_id").select("doc_id", "truth")


CHARS_SQL = "ch AS (SELECT p_partkey, p_type AS model, i AS pos, substr(upper(p_name), i, 1) AS ch FROM part, (SELECT unnest(range(1, 30)) AS i) WHERE i <= length(p_name))"
RULES_SQL = "rules AS (SELECT DISTINCT p_type AS model, i AS pos, substr(upper(p_name), i, 1) AS ch FROM part, (SELECT unnest(range(1, 30)) AS i) WHERE i <= length(p_name) AND p_size < 4)"


def chars(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", c("p_type").alias("model"), F.posexplode(F.split(F.upper("p_name"), "")).alias("pos", "char")).withColumn("pos", c("pos") + 1)


@query("j8_rule_flags", f"WITH {CHARS_SQL}, {RULES_SQL} SELECT p_partkey, ch.pos::INTEGER AS pos, ch.ch AS char, rules.ch IS NOT NULL AS allowed FROM ch LEFT JOIN rules ON ch.model = rules.model AND ch.pos = rules.pos AND ch.ch = rules.ch")
def j8(spark, sf):
    ch = chars(spark, sf)
    rules = ch.filter("p_size < 4").select("model", "pos", c("char").alias("allowed_char"))
    return J.rule_flags(ch.drop("p_size"), rules).select("p_partkey", "pos", "char", "allowed")


CONF = [("B", "E", 1), ("L", "I", 1), ("O", "D", 1), ("R", "B", 1), ("S", "E", 2)]
CONF_SQL = "cf AS (SELECT * FROM (VALUES ('B','E'),('L','I'),('O','D'),('R','B'),('S','E')) t(a, b)), sym AS (SELECT a, b FROM cf UNION SELECT b, a FROM cf)"


def confusions(spark):
    return spark.createDataFrame(CONF, "char string, alt string, rank int")


@query("j9_confusion_expansion", f"WITH {CHARS_SQL}, {CONF_SQL} SELECT p_partkey, pos::INTEGER AS pos, ch AS char, b AS alt FROM ch JOIN sym ON ch = a")
def j9(spark, sf):
    return J.expand_confusions(chars(spark, sf).select("p_partkey", "pos", "char"), confusions(spark))


@query(
    "j10_confusable_conflicts",
    f"""WITH t AS (SELECT p_brand, p_partkey, i AS pos, substr(upper(p_name), i, 1) AS ch FROM part, (SELECT unnest(range(1, 30)) AS i) WHERE i <= length(p_name)), {CONF_SQL}
    SELECT x.p_brand, (x.pos - 1)::INTEGER AS pos, x.ch AS a, y.ch AS b, count(*) AS clashes FROM t x JOIN t y ON x.p_brand = y.p_brand AND x.pos = y.pos JOIN sym ON sym.a = x.ch AND sym.b = y.ch WHERE x.ch < y.ch GROUP BY 1, 2, 3, 4""",
)
def j10(spark, sf):
    texts = table(spark, sf, "part").select("p_brand", F.upper("p_name").alias("text"))
    return J.confusable_conflicts(texts, ["p_brand"], "text", confusions(spark).select(c("char").alias("a"), c("alt").alias("b")))


@query(
    "a10_conflict_kinds",
    f"""WITH t AS (SELECT p_brand, p_partkey, i AS pos, substr(upper(p_name), i, 1) AS ch FROM part, (SELECT unnest(range(1, 30)) AS i) WHERE i <= length(p_name)), {CONF_SQL}
    SELECT x.ch || '/' || y.ch AS pair, count(*) AS n FROM t x JOIN t y ON x.p_brand = y.p_brand AND x.pos = y.pos JOIN sym ON sym.a = x.ch AND sym.b = y.ch WHERE x.ch < y.ch GROUP BY 1""",
)
def a10(spark, sf):
    return j10(spark, sf).groupBy(F.concat_ws("/", "a", "b").alias("pair")).agg(F.sum("clashes").alias("n"))


@query(
    "j12_primary_or_fallback",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN o_orderpriority ELSE o_orderstatus END AS text, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'TIMEOUT' ELSE 'OK' END AS status, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS used_fallback, false AS agree FROM orders""",
)
def j12(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    p = o.select("o_orderkey", F.when(k % 3 == 0, "TIMEOUT").otherwise("OK").alias("status"), c("o_orderstatus").alias("text"))
    f = o.filter(k % 4 != 0).select("o_orderkey", lit("OK").alias("status"), c("o_orderpriority").alias("text"))
    return J.primary_or_fallback(p, f, "o_orderkey")


@query(
    "j14_second_reader",
    """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1), x AS (SELECT o.*, coalesce(n, 0) AS n, o_orderkey % 2 = 0 AS ok, o_orderkey % 3 = 0 AS usable, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'Z' END AS st FROM orders o LEFT JOIN s ON l_orderkey = o_orderkey)
    SELECT o_orderkey, CASE WHEN ok AND st = o_orderstatus THEN 'AGREE' WHEN ok THEN 'KEEP' WHEN usable AND n >= 1 THEN 'SECOND_ACCEPT' ELSE 'NONE' END AS action, CASE WHEN NOT ok AND usable AND n >= 1 THEN st ELSE o_orderstatus END AS final_text,
    (CASE WHEN ok AND st = o_orderstatus THEN least(1.0::DOUBLE, o_totalprice / 500000 + 0.03::DOUBLE) WHEN NOT ok AND usable AND n >= 1 THEN least(0.99::DOUBLE, greatest(0.55::DOUBLE, 1 - o_totalprice / 500000)) ELSE o_totalprice / 500000 END)::DOUBLE AS final_score FROM x""",
)
def j14(spark, sf):
    return J.second_reader_assist(*second_reader_tables(spark, sf), "o_orderkey")


def second_reader_tables(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    acc = o.select("o_orderkey", F.when(k % 2 == 0, "ACCEPT").otherwise("NO_READ").alias("status"), c("o_orderstatus").alias("text"), (c("o_totalprice") / 500000).alias("score"))
    sec = o.select("o_orderkey", F.when(k % 5 == 0, c("o_orderstatus")).otherwise("Z").alias("second_text"), (1 - c("o_totalprice") / 500000).alias("second_avg"), (k % 3 == 0).alias("usable"))
    sup = table(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count(lit(1)).alias("exact_reads"))
    return acc, sec, sup


J14_SQL = """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1), x AS (SELECT o.*, o_totalprice / 500000 AS sc, coalesce(n, 0) AS n, o_orderkey % 2 = 0 AS ok, o_orderkey % 3 = 0 AS usable, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'Z' END AS st FROM orders o LEFT JOIN s ON l_orderkey = o_orderkey),
    d AS (SELECT *, CASE WHEN ok AND st = o_orderstatus THEN 'AGREE' WHEN ok AND usable AND {enforce} THEN 'REJECT' WHEN ok THEN 'KEEP' WHEN usable AND {fallback} AND (n >= 1 OR {free}) THEN 'SECOND_ACCEPT' ELSE 'NONE' END AS action FROM x)
    SELECT o_orderkey, action, CASE WHEN action = 'SECOND_ACCEPT' AND NOT {shadow} THEN st ELSE o_orderstatus END AS final_text,
    (CASE WHEN {shadow} THEN sc WHEN action = 'AGREE' THEN least(1.0::DOUBLE, sc + 0.03::DOUBLE) WHEN action = 'SECOND_ACCEPT' THEN least(0.99::DOUBLE, greatest(0.55::DOUBLE, 1 - sc)) ELSE sc END)::DOUBLE AS final_score FROM d"""
J14_MODES = {
    "shadow": {"shadow": True},
    "enforce": {"enforce": True},
    "no_fallback": {"fallback": False},
    "support_free": {"support_required": False},
}


def _j14_mode(name: str, given: dict) -> None:
    told = {"enforce": given.get("enforce", False), "fallback": given.get("fallback", True), "free": given.get("enforce", False) or not given.get("support_required", True), "shadow": given.get("shadow", False)}

    @query(f"j14_{name}", J14_SQL.format(**{k: str(v).lower() for k, v in told.items()}))
    def run(spark, sf):
        return J.second_reader_assist(*second_reader_tables(spark, sf), "o_orderkey", **given)


for _name, _given in J14_MODES.items():
    _j14_mode(_name, _given)


@query(
    "j15_completeness",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS has_tag,
    c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS complete FROM customer""",
)
def j15(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.completeness(table(spark, sf, "customer").select("c_custkey"), o.filter("o_orderstatus = 'F'").select("c_custkey"), o.filter("o_totalprice > 400000").select("c_custkey"), "c_custkey")


@query("u4_engine_difference", "SELECT p_partkey FROM part WHERE p_size % 3 = 1 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)")
def u4b(spark, sf):
    items = curation(spark, sf)
    left = items.filter("review_status = 'ACCEPTED'").select("p_partkey")
    return left.exceptAll(items.filter("label_status = 'TRUSTED_LABEL'").select("p_partkey"))

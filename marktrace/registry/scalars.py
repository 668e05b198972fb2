"""Scalar functions and row predicates on driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marktrace.functions import decisions as D
from marktrace.functions import tags as G
from marktrace.functions import text as X
from marktrace.functions import times as M
from marktrace.operators import predicates as P
from marktrace.registry.base import query, table

c, lit = F.col, F.lit


@query(
    "c1_normalize",
    "SELECT doc_id, length(n)::INTEGER AS n_kept, md5(n) AS digest FROM (SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS n FROM documents)",
)
def c1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.normalize(c("text")).alias("n"))
    return d.select("doc_id", F.length("n").alias("n_kept"), F.md5("n").alias("digest"))


@query(
    "c2_model_from_prefix",
    "SELECT p_partkey, CASE substr(upper(p_name), 1, 4) WHEN 'SMAL' THEN 'ALPHA' WHEN 'BLUE' THEN 'BETA' WHEN 'RED ' THEN NULL WHEN 'REDW' THEN 'GAMMA' END AS model FROM (SELECT p_partkey, replace(p_name, ' ', '') AS p_name FROM part)",
)
def c2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.model_of(c("p_name"), {"SMAL": "ALPHA", "BLUE": "BETA", "REDW": "GAMMA"}).alias("model"))


@query(
    "c3_year_from_code",
    "SELECT c_custkey, CASE substr(upper(c_mktsegment), 4, 1) WHEN 'S' THEN 2024 WHEN 'H' THEN 2025 WHEN 'L' THEN 2026 END::INTEGER AS model_year FROM customer",
)
def c3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.year_of(c("c_mktsegment"), {"S": 2024, "H": 2025, "L": 2026}, 4).alias("model_year"))


ALLOWED = ["SBRHC", "MLEAO", "ADULT", "LEGWB", "AEIOURB"]


@query(
    "c4_compliance",
    """WITH t AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS s, p_size % 2 = 1 AS fits FROM part),
    f AS (SELECT p_partkey, s, fits, contains(['SBRHC','MLEAO','ADULT','LEGWB','AEIOURB'][(i - 1) % 5 + 1], substr(s, i, 1)) AS ok FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t))
    SELECT p_partkey, CASE WHEN fits THEN round(count(*) FILTER (ok) / length(s)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS compliance, (fits AND bool_and(ok)) AS all_valid FROM f GROUP BY p_partkey, s, fits""",
)
def c4(spark, sf):
    """Whole names, under rules as long as the name, or one position longer."""
    t = table(spark, sf, "part").select("p_partkey", X.normalize(c("p_name")).alias("s"), (c("p_size") % 2 == 0).cast("int").alias("more"))
    rules = F.array(*[lit(a) for a in ALLOWED])
    allowed = F.transform(F.sequence(lit(1), F.length("s") + c("more")), lambda i: F.element_at(rules, ((i - 1) % 5 + 1).cast("int")))
    return t.select("p_partkey", F.round(X.compliance(c("s"), allowed), 6).alias("compliance"), X.all_valid(c("s"), allowed).alias("all_valid"))


@query("c6_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_brand)::INTEGER AS distance, round(1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand), 1), 6)::DOUBLE AS similarity FROM part")
def c6(spark, sf):
    a, b = c("p_name"), c("p_brand")
    return table(spark, sf, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"), F.round(X.edit_similarity(a, b), 6).alias("similarity"))


EPC_SQL = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 9, '0') WHEN 1 THEN md5(o_orderkey::VARCHAR) WHEN 2 THEN ' TAG-' || o_orderkey || ' ' WHEN 3 THEN '00X' || (o_orderkey % 7) ELSE '' END AS epc FROM orders"""


def epcs(spark, sf):
    k = c("o_orderkey")
    epc = (
        F.when(k % 5 == 0, F.lpad(k.cast("string"), 9, "0"))
        .when(k % 5 == 1, F.md5(k.cast("string")))
        .when(k % 5 == 2, F.concat(lit(" TAG-"), k.cast("string"), lit(" ")))
        .when(k % 5 == 3, F.concat(lit("00X"), (k % 7).cast("string")))
        .otherwise("")
    )
    return table(spark, sf, "orders").select("o_orderkey", epc.alias("epc"))


@query(
    "c7_tag_number",
    f"""SELECT o_orderkey, CASE WHEN t = '' THEN '' WHEN regexp_full_match(s, '[0-9]+') THEN s WHEN length(d) >= 4 THEN right(d, 4) WHEN d <> '' THEN d ELSE s END AS number FROM (
    SELECT o_orderkey, trim(epc) AS t, CASE WHEN ltrim(trim(epc), '0') = '' THEN '0' ELSE ltrim(trim(epc), '0') END AS s, regexp_replace(epc, '[^0-9]', '', 'g') AS d FROM ({EPC_SQL}))""",
)
def c7(spark, sf):
    return epcs(spark, sf).select("o_orderkey", G.tag_number(c("epc")).alias("number"))


@query(
    "c8_decode_epc",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN md5(p_name) WHEN p_partkey % 4 = 2 THEN p_partkey::VARCHAR ELSE '<no-epc>' END AS epc FROM part""",
)
def c8(spark, sf):
    k = c("p_partkey")
    url = lambda b: F.regexp_replace(F.translate(F.base64(b), "+/", "-_"), "=+$", "")
    epc = (
        F.when(k % 4 == 0, url(F.encode("p_name", "UTF-8")))
        .when(k % 4 == 1, F.when(k % 8 == 1, url(F.unhex(F.md5("p_name")))).otherwise(F.md5("p_name")))
        .when(k % 4 == 2, k.cast("string"))
        .otherwise(F.when(k % 8 == 3, lit("  ")).otherwise("!not*base64"))
    )
    return table(spark, sf, "part").select("p_partkey", G.decode_epc(epc).alias("epc"))


@query("c9_rssi_dbm", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (json_extract(props, '$.k')::BIGINT / 100.0)::DOUBLE ELSE value END AS rssi FROM events")
def c9(spark, sf):
    centi = F.when(c("event_id") % 3 == 0, F.get_json_object("props", "$.k").cast("long"))
    return table(spark, sf, "events").select("event_id", G.rssi_dbm(centi, c("value")).alias("rssi"))


@query(
    "c10_trigger_state",
    "SELECT o_orderkey, (o_orderkey = 1)::INTEGER AS by_value, ((o_orderkey >> 3) & 1)::INTEGER AS by_bit, ((o_orderkey & 12) = (5 & 12))::INTEGER AS by_mask, ((o_orderkey & 6) = (1 & 6))::INTEGER AS by_auto FROM orders",
)
def c10(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        G.trigger_state(k, "value").alias("by_value"),
        G.trigger_state(k, "bit", bit=3).alias("by_bit"),
        G.trigger_state(k, "mask", on_value=5, mask=12).alias("by_mask"),
        G.trigger_state(k, "auto", bit=3, mask=6).alias("by_auto"),
    )


PATH_SQL = """SELECT doc_id, '/img/' || source || '/S' || doc_id || '_' || CASE doc_id % 3 WHEN 0 THEN substr(lower(md5(doc_id::VARCHAR)), 1, 17) WHEN 1 THEN 'OQ' || substr(md5(doc_id::VARCHAR), 1, 15) ELSE 'short' END || '_20240' || (1 + doc_id % 9) || '01-1200.frame.jpg' AS path FROM documents"""


def paths(spark, sf):
    h = F.md5(c("doc_id").cast("string"))
    middle = F.when(c("doc_id") % 3 == 0, F.substring(h, 1, 17)).when(c("doc_id") % 3 == 1, F.concat(lit("OQ"), F.substring(h, 1, 15))).otherwise("short")
    path = F.concat(lit("/img/"), "source", lit("/S"), "doc_id", lit("_"), middle, lit("_20240"), (1 + c("doc_id") % 9).cast("string"), lit("01-1200.frame.jpg"))
    return table(spark, sf, "documents").select("doc_id", path.alias("path"))


@query(
    "c11_name_guess",
    f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(substr(md5(doc_id::VARCHAR), 1, 17)) WHEN 1 THEN 'OQ' || upper(substr(md5(doc_id::VARCHAR), 1, 15)) ELSE '' END AS guess FROM ({PATH_SQL})",
)
def c11(spark, sf):
    return paths(spark, sf).select("doc_id", X.name_guess(c("path")).alias("guess"))


@query("c12_name_parts", f"SELECT doc_id, 'S' || doc_id AS session_id, '20240' || (1 + doc_id % 9) || '01-1200' AS captured_at FROM ({PATH_SQL})")
def c12(spark, sf):
    return paths(spark, sf).select("doc_id", X.name_part(c("path"), r"^(S\d+)_").alias("session_id"), X.name_part(c("path"), r"_(\d{8}-\d{4})").alias("captured_at"))


@query(
    "c13_hash_split",
    "SELECT doc_id, CASE WHEN s < 70 THEN 'train' WHEN s < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha1(source || doc_id), 1, 8))::BIGINT % 100 AS s FROM documents)",
)
def c13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.hash_split(F.concat("source", "doc_id")).alias("split"))


@query("c14_group_key", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE doc_id::VARCHAR END AS group_key FROM documents")
def c14(spark, sf):
    a = F.when(c("doc_id") % 3 == 0, c("source")).otherwise("")
    b = F.when(c("doc_id") % 3 == 1, c("lang"))
    return table(spark, sf, "documents").select("doc_id", X.group_key(a, b, c("doc_id").cast("string")).alias("group_key"))


@query("c15_digests", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def c15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.digest(c("text"), "sha1").alias("sha1"), X.digest(c("text")).alias("sha256"))


IMAGE_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 5 AS mean, l_quantity * 1.2 AS std, l_discount * 2 AS bright, l_tax / 2 AS saturated, l_quantity AS h, (l_partkey % 300)::DOUBLE AS w, (l_suppkey % 130)::DOUBLE AS blur, l_discount * 7 AS dark FROM lineitem"""


def image_features(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (c("l_quantity") * 5).alias("mean"), (c("l_quantity") * lit(1.2)).alias("std"), (c("l_discount") * 2).alias("bright"), (c("l_tax") / 2).alias("saturated"),
        c("l_quantity").alias("h"), (c("l_partkey") % 300).cast("double").alias("w"), (c("l_suppkey") % 130).cast("double").alias("blur"), (c("l_discount") * 7).alias("dark"),
    )


LIGHT_SQL = "CASE WHEN saturated > 0.025 AND bright > 0.12 THEN 'glare' WHEN mean < 65 THEN 'dark' WHEN mean > 190 THEN 'bright' WHEN std < 22 THEN 'low_contrast' ELSE 'normal' END"


@query(
    "c16_image_classes",
    f"""SELECT lighting, quality, count(*) AS n FROM (SELECT *, CASE WHEN h < 18 OR w < 80 OR blur < 12 OR std < 8 THEN 'reject' WHEN blur < 35 OR std < 16 OR dark > 0.55 OR saturated > 0.08 THEN 'poor'
    WHEN blur < 80 OR std < 25 OR lighting <> 'normal' THEN 'medium' ELSE 'good' END AS quality FROM (SELECT *, {LIGHT_SQL} AS lighting FROM ({IMAGE_SQL}))) GROUP BY 1, 2""",
)
def c16(spark, sf):
    f = image_features(spark, sf).withColumn("lighting", D.lighting_class(c("mean"), c("std"), c("bright"), c("saturated")))
    f = f.withColumn("quality", D.quality_class(c("h"), c("w"), c("blur"), c("std"), c("dark"), c("saturated"), c("lighting")))
    return f.groupBy("lighting", "quality").agg(F.count(lit(1)).alias("n"))


SUGGEST_SQL = """SELECT doc_id, h, CASE doc_id % 4 WHEN 0 THEN substr(h, 1, 17) WHEN 1 THEN substr(h, 1, 20) WHEN 2 THEN 'SHORT' ELSE '' END AS engine,
  CASE doc_id % 3 WHEN 0 THEN substr(h, 3, 17) ELSE 'X' END AS plural, CASE doc_id % 2 WHEN 0 THEN substr(h, 5, 17) ELSE lower(substr(h, 5, 19)) END AS guess FROM (SELECT doc_id, upper(md5(doc_id::VARCHAR)) AS h FROM documents)"""


def suggestions(spark, sf):
    k, h = c("doc_id"), F.upper(F.md5(c("doc_id").cast("string")))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(k % 4 == 0, F.substring(h, 1, 17)).when(k % 4 == 1, F.substring(h, 1, 20)).when(k % 4 == 2, "SHORT").otherwise("").alias("engine"),
        F.when(k % 3 == 0, F.substring(h, 3, 17)).otherwise("X").alias("plural"),
        F.when(k % 2 == 0, F.substring(h, 5, 17)).otherwise(F.lower(F.substring(h, 5, 19))).alias("guess"),
    )


BEST_SQL = """CASE WHEN doc_id % 4 = 0 THEN engine WHEN doc_id % 3 = 0 THEN plural WHEN doc_id % 2 = 0 THEN guess WHEN doc_id % 4 = 1 THEN substr(engine, 1, 17) ELSE substr(upper(guess), 1, 17) END"""


@query("c17_best_suggestion", f"SELECT doc_id, {BEST_SQL} AS suggestion FROM ({SUGGEST_SQL})")
def c17(spark, sf):
    return suggestions(spark, sf).select("doc_id", X.best_suggestion(c("engine"), c("plural"), c("guess")).alias("suggestion"))


@query(
    "c18_review_priority",
    f"""SELECT doc_id, CASE WHEN length(engine) <> 17 THEN 1 WHEN doc_id % 5 = 0 THEN 2 WHEN guess <> engine AND doc_id % 7 <> 0 THEN 3 WHEN doc_id % 11 = 0 THEN 4 ELSE 5 END::INTEGER AS priority FROM ({SUGGEST_SQL})""",
)
def c18(spark, sf):
    k = c("doc_id")
    guess = F.when(k % 7 == 0, "").otherwise(c("guess"))
    status = F.when(k % 5 == 0, "NO_READ").otherwise("ACCEPT")
    quality = F.when(k % 11 == 0, "poor").otherwise("good")
    return suggestions(spark, sf).select("doc_id", X.review_priority(c("engine"), status, guess, c("engine"), quality).alias("priority"))


@query(
    "c19_log_source",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'OPERATOR' WHEN 'assistant' THEN 'ENGINE' ELSE CASE turn % 2 WHEN 0 THEN 'CAMERA' ELSE 'SYSTEM' END END AS source FROM conversations""",
)
def c19(spark, sf):
    t = table(spark, sf, "conversations")
    msg = F.concat(lit("step [ "), F.initcap("role"), lit("] "), c("text"))
    src = X.log_source(msg, F.when(c("turn") % 2 == 0, "grabber").otherwise("main"), {"USER": "OPERATOR", "ASSISTANT": "ENGINE"}, {"grabber": "CAMERA"})
    return t.select("conv_id", "turn", src.alias("source"))


# written for the shapes that occur in these tables: name = "value" and name=value
MASKED_SQL = """regexp_replace(regexp_replace(text, '(?i)\\b(password|token)( ?= ?)("[^"]*"|[^ ,;"\n]+)', '\\1\\2***', 'g'), '\\b24be64\\b', '***', 'g')"""


@query("c20_redact", f"SELECT 'c' || conv_id || '.' || turn AS id, md5({MASKED_SQL}) AS digest FROM conversations UNION ALL SELECT 'd' || doc_id, md5({MASKED_SQL}) FROM documents")
def c20(spark, sf):
    conv = table(spark, sf, "conversations").select(F.concat(lit("c"), "conv_id", lit("."), "turn").alias("id"), "text")
    docs = table(spark, sf, "documents").select(F.concat(lit("d"), "doc_id").alias("id"), "text")
    return conv.unionByName(docs).select("id", F.md5(X.redact(c("text"), known=["24be64"])).alias("digest"))


@query(
    "c24_feed_health",
    """SELECT event_id, CASE WHEN event_type <> 'error' AND value * 20 > 3000 AND event_type <> 'signup' THEN 'STALE' ELSE CASE event_type WHEN 'signup' THEN 'RECONNECTING' ELSE 'STREAMING' END END AS health FROM events""",
)
def c24(spark, sf):
    state = F.when(c("event_type") == "signup", "RECONNECTING").otherwise("STREAMING")
    return table(spark, sf, "events").select("event_id", D.feed_health(state, c("event_type") != "error", c("value") * 20).alias("health"))


@query("c25_threshold_status", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'critical' WHEN c_acctbal <= 1000 THEN 'warning' ELSE 'ok' END AS status FROM customer")
def c25(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", D.threshold_status(c("c_acctbal"), 1000.0, 0.0).alias("status"))


def _chars(k):
    name = F.upper("p_name")
    one = lambda i: F.struct(F.substr(name, i, lit(1)).alias("char"), ((k * i) % 100 / 100.0).alias("confidence"), ((k * i) % 7 / 10.0).alias("second"))
    return F.transform(F.sequence(lit(1), F.length(name)), one)


@query(
    "c26_gate_characters",
    """WITH p AS (SELECT p_partkey, i, substr(upper(p_name), i, 1) AS ch, ((p_partkey * i) % 100 / 100.0)::DOUBLE AS cf, ((p_partkey * i) % 7 / 10.0)::DOUBLE AS sc FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
    g AS (SELECT p_partkey, string_agg(CASE WHEN ch = '' OR cf < CASE ch WHEN 'S' THEN 0.9 WHEN 'L' THEN 0.3 ELSE 0.6 END OR cf - sc < 0.10 THEN '?' ELSE ch END, '' ORDER BY i) AS gated FROM p GROUP BY 1)
    SELECT p_partkey, gated, NOT contains(gated, '?') AS ok FROM g""",
)
def c26(spark, sf):
    g = table(spark, sf, "part").select("p_partkey", D.gate_characters(_chars(c("p_partkey")), {"S": 0.9, "L": 0.3}, 0.6).alias("gated"))
    return g.withColumn("ok", D.sequence_ok(c("gated")))


ENGINES_SQL = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN NULL ELSE 'OK' END AS st, CASE o_orderkey % 5 WHEN 0 THEN 'AB?D' ELSE 'ABCD' END AS raw,
 CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'AB?D' WHEN 2 THEN 'UBCD' ELSE 'ABCD' END AS p, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ABCD' ELSE 'VBCD' END AS b, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ABCD' ELSE 'VBCD' END AS s FROM orders"""


def engines(spark, sf):
    k = c("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 7 == 0, "TIMEOUT").when(k % 7 == 1, lit(None).cast("string")).otherwise("OK").alias("st"),
        F.when(k % 5 == 0, "AB?D").otherwise("ABCD").alias("raw"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "AB?D").when(k % 5 == 2, "UBCD").otherwise("ABCD").alias("p"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "ABCD").otherwise("VBCD").alias("b"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "ABCD").otherwise("VBCD").alias("s"),
    )


@query(
    "c27_release_decision",
    f"""WITH e AS (SELECT *, CASE WHEN st IS NULL OR st = 'TIMEOUT' THEN 'ENGINE_TIMEOUT' WHEN raw LIKE '%?%' AND p = '' THEN 'ENGRAVED_UNKNOWN_CHAR' WHEN p = '' OR p LIKE '%?%' THEN 'ENGRAVED_LOW_CONFIDENCE' WHEN p LIKE '%U%' THEN 'ENGRAVED_WEAK_CLASS_BLOCKED' END AS cause FROM ({ENGINES_SQL}))
    SELECT o_orderkey, CASE WHEN cause IS NULL THEN p WHEN b <> '' THEN b ELSE s END AS final_text,
    CASE WHEN cause IS NULL THEN 'primary' WHEN b <> '' AND b = s THEN 'consensus' WHEN b <> '' THEN 'baseline' WHEN s <> '' THEN 'second' END AS final_source,
    CASE WHEN cause IS NULL THEN 'PRIMARY_ACCEPTED' ELSE cause || '->' || CASE WHEN b <> '' AND s <> '' AND b = s THEN 'CONSENSUS' WHEN b <> '' AND s <> '' THEN 'ENGINES_DISAGREE' WHEN b <> '' THEN 'BASELINE_ONLY' WHEN s <> '' THEN 'SECOND_ONLY' ELSE 'NO_SAFE_RESULT' END END AS final_reason,
    len(list_distinct(list_filter([p, b, s], lambda x: x <> ''))) > 1 AS engines_disagree FROM e""",
)
def c27(spark, sf):
    d = D.release_decision(c("st"), c("raw"), c("p"), c("b"), c("s"), D.ReleasePolicy(weak_classes="UF", allow_weak=False))
    return engines(spark, sf).select("o_orderkey", *[v.alias(n) for n, v in d.items()])


@query(
    "c28_second_reader_check",
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'no_prediction' WHEN p_size % 9 = 0 OR p_size = 26 THEN 'invalid_vin' WHEN p_size = 31 OR (p_retailprice / 2000 < 0.80 AND p_size % 2 = 0) THEN 'avg_conf<0.80' WHEN p_size < 18 OR p_size = 37 THEN 'min_char_conf<0.35'
    WHEN p_size % 5 = 0 THEN 'unknown_model' WHEN p_size % 7 = 0 THEN 'structure_mismatch' ELSE 'ok' END AS verdict FROM part""",
)
def c28(spark, sf):
    s = c("p_size")
    avg = F.when(s % 2 == 0, c("p_retailprice") / 2000).when(s != 31, 0.9)
    v = D.second_reader_check(F.when(s != 1, c("p_name")), F.when(s != 26, s % 9 != 0), avg, F.when(s != 37, s / 50.0 - 0.005), F.when(s % 5 != 0, c("p_type")), s % 7 != 0)
    return table(spark, sf, "part").select("p_partkey", v.alias("verdict"))


@query(
    "c29_weak_position",
    """SELECT p_partkey, (NOT contains('SB', upper(substr(p_name, 1, 1))) OR p_size % 3 >= 2 OR (CASE WHEN upper(substr(p_name, 1, 1)) = 'S' THEN 2 ELSE CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END END) >= 2 OR p_size >= 43) AS ok FROM part""",
)
def c29(spark, sf):
    ch = F.upper(F.substring("p_name", 1, 1))
    votes = F.array(ch, lit("S"), F.when(c("p_size") % 2 == 0, ch))
    return table(spark, sf, "part").select("p_partkey", D.weak_position_ok(ch, votes, c("p_size") % 3, c("p_size") / 50.0, "SB").alias("ok"))


@query(
    "c30_uncertain_positions",
    """SELECT p_partkey, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (contains('ea ', substr(p_name, (i + 1)::BIGINT, 1)) AND i < length(p_name)), '') AS positions FROM part, (SELECT unnest(range(0, 40)) AS i) GROUP BY 1""",
)
def c30(spark, sf):
    at = X.uncertain_positions(c("p_name"), "ea ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("positions"))


@query(
    "c31_variant_weight",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'clear' ELSE 'other' END AS base, round(CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.7 END * CASE WHEN p_size % 10 < 1 THEN 1.0 WHEN p_size % 10 <= 3 THEN 0.9 WHEN p_size % 10 <= 6 THEN 0.8 ELSE 0.7 END, 6)::DOUBLE AS weight FROM part""",
)
def c31(spark, sf):
    s = c("p_size")
    name = F.concat(F.when(s % 4 == 0, "base").when(s % 4 == 1, "clear").otherwise("other"), F.when(s % 10 == 0, "").otherwise(F.concat(lit("@-"), (s % 10).cast("string"))))
    return table(spark, sf, "part").select("p_partkey", X.base_variant(name).alias("base"), F.round(X.variant_weight(name, {"base": 1.0, "clear": 0.9}), 6).alias("weight"))


@query(
    "c32_quality_score",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (0.40 * dark + 0.30 * least(blur * 3 / 300.0, 1) + 0.15 * greatest(0, 1 - abs(mean - 125) / 125) + 0.15 * least(h * w / 4800, 1) - 0.25 * least(abs(std) / 45, 1))::DOUBLE AS score FROM ({IMAGE_SQL})""",
)
def c32(spark, sf):
    f = image_features(spark, sf)
    s = D.quality_score(c("dark"), c("blur") * 3, c("mean"), c("h"), c("w"), c("std"))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", s.alias("score"))


@query(
    "c33_queue_fields",
    """SELECT event_id, user_id + 1 AS position, contains('clickview', event_type) AS confusion_risk, json_extract(props, '$.k')::INTEGER AS box_x FROM events""",
)
def c33(spark, sf):
    box = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", (c("user_id") + 1).alias("position"), F.contains(lit("clickview"), c("event_type")).alias("confusion_risk"), box.getField("k").alias("box_x"))


@query(
    "c34_collection_reasons",
    """SELECT p_partkey, coalesce(array_to_string(list_sort(list_filter([CASE WHEN p_size % 13 = 0 THEN 'UNKNOWN' END, CASE WHEN p_size / 50 < 0.85 THEN 'LOW_CONFIDENCE' END, CASE WHEN p_size / 50 - 0.8 < 0.10 THEN 'LOW_MARGIN' END,
     CASE WHEN p_size % 13 <> 0 AND contains('UVS', ch) THEN 'WEAK_CLASS' END, CASE WHEN p_size % 2 = 0 THEN 'ENGINE_DISAGREEMENT' END, CASE WHEN p_size % 3 = 0 AND NOT contains('SBRHC', ch) THEN 'UNSUPPORTED_EXPECTED_CLASS' END,
     CASE WHEN p_size % 3 = 0 AND contains('RB', ch) THEN 'TARGET_CHAR' END], lambda x: x IS NOT NULL)), ';'), '') AS reasons FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, upper(substr(p_name, 1, 1)) AS ch FROM part)""",
)
def c34(spark, sf):
    ch, s = F.upper(F.substring("p_name", 1, 1)), c("p_size")
    policy = D.CollectionPolicy(weak="UVS", targets="RB", supported="SBRHC")
    r = D.collection_reasons(F.when(s % 13 != 0, ch), ch, s / 50.0, lit(0.8), s % 2 == 0, F.when(s % 3 == 0, ch), policy)
    return table(spark, sf, "part").select("p_partkey", r.alias("reasons"))


@query(
    "c35_boxes",
    """SELECT *, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 || ',' || y1 || ',' || x2 || ',' || y2 END AS box FROM (
    SELECT p_partkey, greatest(0, p_size - 10) AS x1, greatest(0, p_partkey % 40 - 10) AS y1, least(60, p_size + 30) AS x2, least(45, p_partkey % 60 + 10) AS y2 FROM part)""",
)
def c35(spark, sf):
    s, k = c("p_size"), c("p_partkey")
    b = D.clamp_box(s, k % 40, s + 20, k % 60, lit(60), lit(45), 10)
    text = F.concat_ws(",", *[b.getField(n).cast("string") for n in ("x1", "y1", "x2", "y2")])
    parts = dict(x1=F.greatest(lit(0), s - 10), y1=F.greatest(lit(0), k % 40 - 10), x2=F.least(lit(60), s + 30), y2=F.least(lit(45), k % 60 + 10))
    return table(spark, sf, "part").select("p_partkey", *[v.alias(n) for n, v in parts.items()], F.when(b.isNotNull(), text).alias("box"))


@query(
    "c35_margin_boxes",
    """SELECT p_partkey, greatest(0, p_size - trunc(20 * 0.15)::INT) || ',' || least(60, p_size + 20 + trunc(20 * 0.15)::INT) AS span FROM part WHERE least(60, p_size + 23) > greatest(0, p_size - 3)""",
)
def c35b(spark, sf):
    s = c("p_size")
    b = D.margin_box(s, lit(0), s + 20, lit(20), lit(60), lit(45), 0.15)
    t = table(spark, sf, "part").select("p_partkey", b.alias("b")).filter("b is not null")
    return t.select("p_partkey", F.concat_ws(",", c("b.x1").cast("string"), c("b.x2").cast("string")).alias("span"))


@query(
    "c36_iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS iso, strftime(ts, '%Y%m%d') AS day, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS parsed_ms FROM events""",
)
def c36(spark, sf):
    t = table(spark, sf, "events")
    blank = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(c("event_id") % 3 == 0, blank).when(c("event_id") % 3 == 1, F.regexp_replace(blank, " ", "T")).otherwise("not a time")
    return t.select("event_id", M.iso_ms(c("ts")).alias("iso"), M.day_key(c("ts")).alias("day"), M.epoch_ms(M.parse_iso(text)).alias("parsed_ms"))


@query("c23_latencies", "SELECT event_id, (epoch_us(ts) // 1000 - 1704067200000)::DOUBLE AS latency_ms, CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE (epoch_us(ts) // 1000 - 1704067200000)::DOUBLE END AS trigger_to_capture_ms FROM events")
def c23(spark, sf):
    at = M.epoch_ms("ts")
    zero = lit(1704067200000).cast("long")
    return table(spark, sf, "events").select("event_id", M.ms_between(zero, at).alias("latency_ms"), M.trigger_to_capture_ms(zero, F.when(c("event_type") != "error", at)).alias("trigger_to_capture_ms"))


@query("c37_counters", "SELECT event_id, coalesce(CASE event_id % 3 WHEN 0 THEN json_extract(props, '$.k')::BIGINT WHEN 1 THEN 0 ELSE floor(value)::BIGINT END, 0)::BIGINT AS n FROM events")
def c37(spark, sf):
    k = c("event_id")
    first = F.when(k % 3 == 0, F.get_json_object("props", "$.k")).when(k % 3 == 1, c("event_type"))
    return table(spark, sf, "events").select("event_id", D.counter(first, c("value").cast("string")).alias("n"))


# ---- predicates -------------------------------------------------------------------------------

ORDER_COLUMNS = P.HistoryColumns("o_orderpriority", "o_orderstatus", "o_orderstatus", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(
    "f1_history_search",
    """SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE (contains(upper(o_orderpriority), 'HIGH') OR contains(upper(o_orderstatus), 'HIGH')) AND (contains(o_orderstatus, 'O') OR contains(o_orderpriority, 'O')) AND o_orderstatus = 'O' AND o_totalprice >= 100000
    AND o_orderdate >= '1996-01-01' AND o_orderdate < '1998-07-02'""",
)
def f1(spark, sf):
    f = P.HistoryFilter(identifier="high", tag="o", model="o", min_confidence=100000, start="1996-01-01", end="1998-07-01")
    return P.history(table(spark, sf, "orders"), f, ORDER_COLUMNS).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("f2_export_projection", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def f2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def log_rows(spark, sf):
    ts = M.epoch_ms("ts")
    k = c("event_id")
    level = F.element_at(F.array(*[lit(x) for x in P.LEVELS]), (k % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", ts.alias("ts"), level.alias("level"), F.upper("event_type").alias("source"), c("props").alias("msg"))


LOGS_SQL = "(SELECT event_id, epoch_us(ts) // 1000 AS ts, ['DEBUG','INFO','WARNING','ERROR','CRITICAL'][event_id % 5 + 1] AS level, upper(event_type) AS source, props AS msg FROM events)"


@query("f3_log_query", f"SELECT event_id, level, source FROM {LOGS_SQL} WHERE level IN ('ERROR','CRITICAL') AND (contains(msg, '7') OR contains(lower(source), '7')) UNION ALL SELECT event_id, level, source FROM {LOGS_SQL} WHERE source = 'CLICK' AND level = 'INFO' AND ts BETWEEN 1704500000000 AND 1705500000000")
def f3(spark, sf):
    logs = log_rows(spark, sf)
    a = P.log_query(logs, source="ERROR", text="7")
    b = P.log_query(logs, source="CLICK", level="INFO", start=lit(1704500000000), end=lit(1705500000000))
    return a.unionByName(b).select("event_id", "level", "source")


@query("f4_strict_identifier", f"SELECT doc_id, regexp_full_match(upper(t), '[A-HJ-NPR-Z0-9]{{17}}') AS strict FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(md5(doc_id::VARCHAR), 1, 17) WHEN 1 THEN 'O' || substr(md5(doc_id::VARCHAR), 1, 16) ELSE substr(md5(doc_id::VARCHAR), 1, 16) END AS t FROM documents)")
def f4(spark, sf):
    h, k = F.md5(c("doc_id").cast("string")), c("doc_id")
    text = F.when(k % 3 == 0, F.substring(h, 1, 17)).when(k % 3 == 1, F.concat(lit("O"), F.substring(h, 1, 16))).otherwise(F.substring(h, 1, 16))
    return table(spark, sf, "documents").select("doc_id", X.is_strict(text).alias("strict"))


@query(
    "f5_identifier_policy",
    """SELECT p_partkey, coalesce(array_to_string(list_filter([CASE WHEN length(s) <> 10 THEN 'length=' || length(s) || '!=10' END, CASE WHEN bad <> '' THEN 'charset_violation=' || bad END,
     CASE WHEN p_size / 50 < 0.5 THEN 'confidence=' || printf('%.3f', p_size / 50) || '<0.500' END, CASE WHEN p_partkey % 4 < 2 THEN 'crops=' || (p_partkey % 4) || '<2' END], lambda x: x IS NOT NULL), ';'), '') AS reasons
    FROM (SELECT *, upper(p_name) AS s, array_to_string(list_sort(list_distinct(list_filter(string_split(upper(p_name), ''), lambda x: NOT contains('ABCDEFGHIJKLMN', x)))), '') AS bad FROM (SELECT p_partkey, p_name, p_size::DOUBLE AS p_size FROM part))""",
)
def f5(spark, sf):
    r = P.identifier_reasons(c("p_name"), c("p_size") / 50.0, c("p_partkey") % 4, P.IdentifierPolicy(10, "ABCDEFGHIJKLMN", 0.5, 2))
    return table(spark, sf, "part").select("p_partkey", F.array_join(r, ";").alias("reasons"))


@query(
    "x2_charset",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(upper(p_name), ''), lambda x: NOT contains('ABCDEFGHIJKLMN ', x)))), '') AS wide,
    array_to_string(list_sort(list_distinct(list_filter(string_split(upper(p_name), ''), lambda x: NOT contains('OPQRSTUVWXYZ', x)))), '') AS narrow FROM part""",
)
def x2(spark, sf):
    """Character sets of the user's own beside the built-in one."""
    bad = lambda chars: F.regexp_extract(F.array_join(P.identifier_reasons(c("p_name"), lit(1.0), lit(1), P.IdentifierPolicy(0, chars)), ";"), "^charset_violation=(.*)$", 1)
    return table(spark, sf, "part").select("p_partkey", bad("ABCDEFGHIJKLMN ").alias("wide"), bad("OPQRSTUVWXYZ").alias("narrow"))


@query(
    "f6_plant_tag",
    f"""SELECT o_orderkey, coalesce(CASE WHEN regexp_full_match(t, '[0-9]+') THEN t::BIGINT BETWEEN 1000 AND 9999 END, false) OR coalesce(CASE WHEN regexp_full_match(n, '[0-9]+') THEN n::BIGINT BETWEEN 1000 AND 9999 END, false) AS ok FROM (
    SELECT *, CASE WHEN t = '' THEN '' WHEN regexp_full_match(s, '[0-9]+') THEN s WHEN length(d) >= 4 THEN right(d, 4) WHEN d <> '' THEN d ELSE s END AS n FROM (
    SELECT o_orderkey, trim(epc) AS t, CASE WHEN ltrim(trim(epc), '0') = '' THEN '0' ELSE ltrim(trim(epc), '0') END AS s, regexp_replace(epc, '[^0-9]', '', 'g') AS d FROM ({EPC_SQL})))""",
)
def f6(spark, sf):
    return epcs(spark, sf).select("o_orderkey", G.is_plant_tag(c("epc"), 1000, 9999).alias("ok"))


@query(
    "f7_detector_gate",
    """WITH b AS (SELECT o_custkey, o_orderkey, max(l_quantity) AS best_conf, count(*) AS n_kept FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 5 GROUP BY 1, 2)
    SELECT *, max(best_conf) OVER (PARTITION BY o_custkey) AS peak_conf, best_conf >= 40 AS triggers, max(best_conf) OVER (PARTITION BY o_custkey) >= 48 AS submits FROM b""",
)
def f7(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    return P.detector_gate(li, ["o_custkey"], ["o_orderkey"], "l_quantity", 5, 40, 48)


CURATION = {
    "review_status": "CASE WHEN p_size % 3 = 0 THEN 'PENDING' WHEN p_size % 3 = 1 THEN 'ACCEPTED' ELSE 'PENDING_REVIEW' END",
    "label_status": "CASE WHEN p_size % 2 = 0 THEN 'TRUSTED_LABEL' ELSE 'UNLABELED' END",
    "expected_character": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE upper(substr(p_name, 1, 1)) END",
}


def curation(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice", *[F.expr(e).alias(n) for n, e in CURATION.items()])


@query("f8_pending_review", "SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def f8(spark, sf):
    return P.pending_review(curation(spark, sf)).select("p_partkey")


@query("f9_importable", "SELECT p_partkey FROM part WHERE p_size % 3 = 1 AND p_size % 2 = 0 AND p_size % 5 <> 0 AND contains('SBR', upper(substr(p_name, 1, 1)))")
def f9(spark, sf):
    return P.importable(curation(spark, sf), "SBR").select("p_partkey")


REVIEW_SQL = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN ' OK ' ELSE '' END AS verification_status, CASE doc_id % 6 WHEN 0 THEN 'BAD' ELSE upper(substr(md5(doc_id::VARCHAR), 1, 17)) END AS verified_vin,
 CASE WHEN doc_id % 5 = 0 THEN 'NO_READ' ELSE 'ACCEPT' END AS ocr_status, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS agreement, upper(substr(md5(doc_id::VARCHAR), 2, 17)) AS ocr_suggested_vin, CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'odd' END AS split FROM documents)"""


def reviews(spark, sf):
    k, h = c("doc_id"), F.upper(F.md5(c("doc_id").cast("string")))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(k % 4 == 0, "verified").when(k % 4 == 1, " OK ").otherwise("").alias("verification_status"),
        F.when(k % 6 == 0, "BAD").otherwise(F.substring(h, 1, 17)).alias("verified_vin"),
        F.when(k % 5 == 0, "NO_READ").otherwise("ACCEPT").alias("ocr_status"),
        F.when(k % 2 == 0, "yes").otherwise("no").alias("agreement"),
        F.substring(h, 2, 17).alias("ocr_suggested_vin"),
        F.when(k % 3 == 0, "test").when(k % 3 == 1, "validation").otherwise("odd").alias("split"),
    )


@query(
    "f10_label_tiers",
    f"""SELECT doc_id, CASE split WHEN 'odd' THEN 'train' ELSE split END AS split, CASE WHEN gold THEN verified_vin ELSE ocr_suggested_vin END AS label, CASE WHEN gold THEN 'gold' ELSE 'silver' END AS tier
    FROM (SELECT *, verification_status = 'verified' AND length(verified_vin) = 17 AS gold FROM {REVIEW_SQL}) WHERE gold OR (ocr_status = 'ACCEPT' AND agreement = 'yes')""",
)
def f10(spark, sf):
    return P.label_tiers(reviews(spark, sf)).select("doc_id", "split", "label", "tier")


@query("f11_finalised_reviews", f"SELECT doc_id, verified_vin FROM {REVIEW_SQL} WHERE verification_status <> '' AND length(verified_vin) = 17")
def f11(spark, sf):
    return P.finalised_reviews(reviews(spark, sf)).select("doc_id", "verified_vin")


@query("f12_missing_evidence", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0")
def f12(spark, sf):
    k = c("o_orderkey")
    s = table(spark, sf, "orders").withColumns({"status": F.when(c("o_orderstatus") == "F", "TIMEOUT").otherwise("SUCCESS"), "image_path": F.when(k % 3 == 0, "x.jpg").when(k % 3 == 1, " ")})
    return P.missing_evidence(s).select("o_orderkey")


@query("f13_real_values", "SELECT o_orderkey, o_orderkey % 5 NOT IN (0, 1, 2, 3) AS real FROM orders")
def f13(spark, sf):
    k = c("o_orderkey")
    v = F.when(k % 5 == 0, "NO_TAG").when(k % 5 == 1, " ").when(k % 5 == 2, lit(None)).when(k % 5 == 3, "NO_READ").otherwise(c("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", G.is_real(v).alias("real"))


@query(
    "f16_job_outcome",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'ENGINE_UNAVAILABLE' WHEN event_id % 4 = 0 AND event_id % 5 = 0 THEN 'TIMEOUT' WHEN event_id % 4 = 0 AND event_id % 7 = 0 THEN 'CRASH' WHEN event_id % 4 = 0 OR event_type = 'error' THEN 'NO_READ' WHEN event_type <> 'click' THEN 'AMBIGUOUS' ELSE 'ACCEPT' END AS outcome FROM events""",
)
def f16(spark, sf):
    k = c("event_id")
    flag = lambda n: F.when(k % n == 0, 1).otherwise(0)
    fusion = F.when(c("event_type") == "error", "NO_READ").when(c("event_type") == "click", "ACCEPT").otherwise("OCR_AMBIGUOUS")
    return table(spark, sf, "events").select("event_id", D.job_outcome(k % 4, lit(0), flag(3), flag(5), flag(7), fusion).alias("outcome"))


# ---- sorts and pages --------------------------------------------------------------------------


@query("l1_sorted_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def l1(spark, sf):
    return P.sorted_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", False, "o_orderkey", 500, allowed=["o_totalprice"])


@query("l2_offset_page", f"SELECT event_id, level, (SELECT count(*) FROM {LOGS_SQL} WHERE source = 'CLICK') AS total FROM {LOGS_SQL} WHERE source = 'CLICK' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 200")
def l2(spark, sf):
    hits = P.log_query(log_rows(spark, sf), source="CLICK")
    return P.sorted_page(hits, "ts", False, "event_id", 100, 200).select("event_id", "level", lit(hits.count()).cast("long").alias("total"))


@query("l3_ui_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def l3(spark, sf):
    return P.sorted_page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", False, "o_orderkey", 25, 50).select("o_orderkey")


@query("l4_top_counts", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15")
def l4(spark, sf):
    return P.top_counts(table(spark, sf, "part"), ["p_brand", "p_type"], 15)


@query("l5_newest_matches", f"SELECT event_id FROM {LOGS_SQL} WHERE contains(msg, '3') OR contains(lower(source), '3') ORDER BY ts DESC, event_id LIMIT 50")
def l5(spark, sf):
    return P.sorted_page(P.log_query(log_rows(spark, sf), text="3"), "ts", False, "event_id", 50).select("event_id")


@query("l6_review_order", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey")
def l6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").orderBy("p_size", "p_partkey")

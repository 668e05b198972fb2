"""Fusion, re-ranking, disagreement and near-duplicate queries: reads derived from ``lineitem``, one session
per order, seven-character identifiers from the order key with misreads per item."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marktrace.functions.times import epoch_ms
from marktrace.operators import disagreement as G
from marktrace.operators import fusion as U
from marktrace.operators.fusion_twin import RESULT, fuse_groups
from marktrace.operators.joins import dealt
from marktrace.registry.base import query, table

c, lit = F.col, F.lit

# an invented grammar: hexadecimal digits, position 5 a letter, the last three free
PARAMS = U.FusionParams(
    length=7, models=("ALPHA", "BETA"), constants={2: "A"}, prefixes={"1A": "ALPHA", "2A": "BETA", "3A": "ALPHA"}, prefix_width=2,
    trusted_variants=("base", "clear"), risky=(3, 4), serial=(6, 7), key=5, suspects="08", rescue_raw="6", final_score=0.7,
)
CONFUSIONS = [("8", "B", 1), ("0", "D", 1), ("6", "B", 2), ("5", "E", 1), ("1", "7", 1)]


# the same with 17 positions, position 9 a digit
LONG = replace(PARAMS, length=17, risky=(3, 4, 10), serial=(14, 15, 16, 17), final_score=0.6, rescue_b_score=0.6, rescue_b_support=0.6, rescue_conf=0.5)


def rule_table(spark, length=7):
    digits, letters = "0123456789", "ABCDEF"
    allowed = {i: digits + letters for i in range(1, length + 1)} | {1: digits, 2: "A", 5: letters} | ({9: digits} if length > 9 else {})
    rows = [(m, p, ch) for m in ("ALPHA", "BETA") for p, cs in allowed.items() for ch in cs if not (m == "BETA" and p == 3 and ch in "AB")]
    return spark.createDataFrame(rows, "model string, pos int, allowed_char string")


def confusion_table(spark):
    return spark.createDataFrame(CONFUSIONS, "char string, alt string, rank int")


def reads(spark, sf, length=7):
    h = F.upper(F.md5(c("l_orderkey").cast("string")))
    base = F.concat((c("l_orderkey") % 4).cast("string"), lit("A"), F.substring(h, 3, length - 2))
    k = c("l_partkey")
    text = F.when(k % 9 == 0, F.substring(base, 1, length - 1)).when(k % 4 == 0, F.translate(base, "B", "8")).when(k % 4 == 1, F.translate(base, "D", "0")).otherwise(F.lower(base))
    variant = F.element_at(F.array(lit("base"), lit("clear@2"), lit("relief"), lit("other")), (k % 4 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("session_id"),
        (k * 1000 + c("l_suppkey")).alias("read_seq"),
        c("l_linenumber").alias("crop_index"),
        (c("l_suppkey") % 3).cast("int").alias("evidence_group"),
        variant.alias("variant_name"),
        (1 - c("l_discount") * 2).alias("ocr_conf"),
        text.alias("raw_text"),
        (c("l_quantity") / 50).alias("crop_quality"),
        F.when(k % 4 < 2, 1.0).otherwise(0.9).alias("variant_weight"),
    )


READS_SQL = """reads AS (SELECT l_orderkey AS session_id, l_suppkey % 3 AS evidence_group, ['base','clear@2','relief','other'][l_partkey % 4 + 1] AS variant_name, 1 - l_discount * 2 AS ocr_conf,
 upper(CASE WHEN l_partkey % 9 = 0 THEN substr(b, 1, 6) WHEN l_partkey % 4 = 0 THEN replace(b, 'B', '8') WHEN l_partkey % 4 = 1 THEN replace(b, 'D', '0') ELSE b END) AS t,
 l_quantity / 50 AS q, CASE WHEN l_partkey % 4 < 2 THEN 1.0 ELSE 0.9 END::DOUBLE AS vw FROM (SELECT *, (l_orderkey % 4) || 'A' || substr(upper(md5(l_orderkey::VARCHAR)), 3, 5) AS b FROM lineitem))"""


@query(
    "a18_position_votes",
    f"""WITH {READS_SQL} SELECT session_id, i::INTEGER AS pos, substr(t, i, 1) AS char, round(sum(greatest(greatest(0, ocr_conf) * vw * greatest(0.05, q), 1e-6)), 9)::DOUBLE AS weight, count(*) AS reads, count(DISTINCT variant_name) AS variants, count(DISTINCT evidence_group) AS groups
    FROM reads, (SELECT unnest(range(1, 8)) AS i) WHERE length(t) = 7 GROUP BY 1, 2, 3""",
)
def a18(spark, sf):
    v = U.session_votes(reads(spark, sf), ["session_id"], 7)
    return v.select("session_id", "pos", "char", F.round("weight", 9).alias("weight"), "reads", "variants", "groups")


@query(
    "a19_weighted_confidence",
    f"""WITH {READS_SQL} SELECT session_id, round(sum(greatest(0, ocr_conf) * vw * greatest(0.05, q)) / sum(vw * greatest(0.05, q)), 9)::DOUBLE AS avg_conf, count(*) AS n_reads, count(DISTINCT evidence_group) AS n_groups FROM reads WHERE length(t) = 7 GROUP BY 1""",
)
def a19(spark, sf):
    w = U.weighted_confidence(U.merge_reads(reads(spark, sf), ["session_id"], 7), ["session_id"])
    return w.select("session_id", F.round("avg_conf", 9).alias("avg_conf"), "n_reads", "n_groups")


def fused(spark, sf):
    return U.fuse_reads(reads(spark, sf), rule_table(spark), confusion_table(spark), PARAMS)


@query("h3_fuse_reads")
def h3(spark, sf):
    f = fused(spark, sf)
    return f.select("session_id", "status", "fused", "model", F.round("score", 4).alias("score"), "n_reads", "n_groups", "rescue", F.array_join("reasons", ",").alias("reasons"))


@query("a21_exact_evidence")
def a21(spark, sf):
    return fused(spark, sf).filter("status <> 'NO_READ'").select("session_id", "exact_reads", "exact_groups", "trusted_bases", "exact_mean_conf", "conflict")


def _allowed(m, pos, ch):
    return f"(CASE {pos} WHEN 1 THEN contains('0123456789', {ch}) WHEN 2 THEN {ch} = 'A' WHEN 5 THEN contains('ABCDEF', {ch}) ELSE contains('0123456789ABCDEF', {ch}) END AND NOT ({m} = 'BETA' AND {pos} = 3 AND {ch} IN ('A', 'B')))"


CHOICE_SQL = READS_SQL.replace("SELECT l_orderkey AS session_id,", "SELECT l_orderkey AS session_id, l_partkey * 1000 + l_suppkey AS seq,") + f""",
votes AS MATERIALIZED (SELECT session_id, i AS pos, substr(t, i, 1) AS ch, sum(greatest(greatest(0, ocr_conf) * vw * greatest(0.05, q), 1e-6)) AS w, count(*) AS n, min(seq) AS seq FROM reads, (SELECT unnest(range(1, 8)) AS i) WHERE length(t) = 7 GROUP BY 1, 2, 3),
conf AS (SELECT session_id, sum(greatest(0, ocr_conf) * vw * greatest(0.05, q)) / sum(vw * greatest(0.05, q)) AS avg_conf FROM reads WHERE length(t) = 7 GROUP BY 1),
near AS (SELECT * FROM (VALUES ('8','B'),('B','8'),('0','D'),('D','0'),('6','B'),('B','6'),('5','E'),('E','5'),('1','7'),('7','1')) x(a, b)),
mv AS (SELECT v.*, m FROM votes v, (VALUES ('ALPHA'), ('BETA')) x(m)),
tgt AS MATERIALIZED (SELECT session_id, m, pos, ch, b, count(*) OVER (PARTITION BY session_id, m, pos, ch) AS k, w, seq FROM mv JOIN near ON a = ch WHERE NOT {_allowed('m', 'pos', 'ch')} AND {_allowed('m', 'pos', 'b')}),
flow AS (SELECT session_id, m, pos, ch AS c, w AS ev, seq FROM mv WHERE {_allowed('m', 'pos', 'ch')} UNION ALL SELECT session_id, m, pos, b, w * 0.6 / k, seq FROM tgt
  UNION ALL SELECT session_id, m, pos, ch, w * 0.5, seq FROM mv WHERE NOT {_allowed('m', 'pos', 'ch')} AND (session_id, m, pos, ch) NOT IN (SELECT session_id, m, pos, ch FROM tgt)),
ev AS MATERIALIZED (SELECT session_id, m, pos, c, sum(ev) AS ev, min(seq) AS seq, {_allowed('m', 'pos', 'c')} AS ok FROM flow GROUP BY 1, 2, 3, 4),
top AS MATERIALIZED (SELECT session_id, m, pos, sum(ev) AS tot, CASE WHEN pos = 2 THEN 'A' ELSE arg_max(c, (round(ev, 9), -seq)) END AS best FROM ev GROUP BY 1, 2, 3),
raw AS (SELECT session_id, pos, arg_max(ch, (round(w, 9), -seq)) AS raw_char FROM votes GROUP BY 1, 2),
sec AS MATERIALIZED (SELECT t.session_id, t.m, t.pos, max(r.ev) AS ev FROM top t JOIN ev r ON r.session_id = t.session_id AND r.m = t.m AND r.pos = t.pos AND r.c <> t.best AND (r.ok OR NOT {_allowed('t.m', 't.pos', 't.best')}) GROUP BY 1, 2, 3),
dec AS MATERIALIZED (SELECT t.session_id, t.m, t.pos, t.best, raw_char, {_allowed('t.m', 't.pos', 't.best')} AS allowed, coalesce(e.ev, 0) / tot AS prob,
  coalesce(sec.ev, 0) / tot AS second, coalesce(v.n, 0) AS support, v.ch IS NOT NULL AS seen
  FROM top t JOIN raw USING (session_id, pos) LEFT JOIN sec ON sec.session_id = t.session_id AND sec.m = t.m AND sec.pos = t.pos LEFT JOIN ev e ON e.session_id = t.session_id AND e.m = t.m AND e.pos = t.pos AND e.c = t.best LEFT JOIN votes v ON v.session_id = t.session_id AND v.pos = t.pos AND v.ch = t.best),
model AS (SELECT session_id, m, string_agg(best, '' ORDER BY pos) AS fused, count(*) FILTER (allowed) / 7.0::DOUBLE AS comp, 0.5 * (count(*) FILTER (allowed) / 7.0::DOUBLE) + 0.25 * avg(prob) + 0.25 * any_value(avg_conf) AS score FROM dec JOIN conf USING (session_id) GROUP BY 1, 2),
won AS (SELECT * FROM model QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY comp = 1.0 DESC, round(score, 9) DESC, m) = 1)"""


@query(
    "h3_fused_text",
    f"WITH {CHOICE_SQL} SELECT session_id, fused, CASE substr(fused, 1, 2) WHEN '1A' THEN 'ALPHA' WHEN '2A' THEN 'BETA' WHEN '3A' THEN 'ALPHA' ELSE m END AS model, round(score + 1e-10, 8)::DOUBLE AS score FROM won",
)
def h3_text(spark, sf):
    return fused(spark, sf).filter("status <> 'NO_READ'").select("session_id", "fused", "model", F.round(c("score") + 1e-10, 8).alias("score"))


@query(
    "w17_position_choice",
    f"""WITH {CHOICE_SQL} SELECT session_id, pos::INTEGER AS pos, raw_char, best AS chosen, allowed, round(greatest(0, prob - second), 6)::DOUBLE AS margin, support,
    (best <> raw_char AND (NOT seen OR pos = 2)) AS structure_corrected FROM dec JOIN won USING (session_id, m)""",
)
def w17(spark, sf):
    f = fused(spark, sf).filter("status <> 'NO_READ'").select("session_id", F.explode("decisions").alias("d"))
    return f.select("session_id", "d.pos", "d.raw_char", "d.chosen", "d.allowed", F.round("d.margin", 6).alias("margin"), "d.support", "d.structure_corrected")


@query("x4_fusion_twin", "SELECT DISTINCT l_orderkey AS session_id, true AS agrees FROM lineitem")
def x4(spark, sf):
    """Expressions and grouped function on whole identifiers of 17 positions: every field of every session."""
    args = (reads(spark, sf, 17), rule_table(spark, 17), confusion_table(spark), LONG)
    kinds = [f.split() for f in RESULT.split(", ")]
    mine = U.fuse_reads(*args).select("session_id", F.struct(*[n for n, _ in kinds]).alias("a"))
    both = mine.join(fuse_groups(*args).select("session_id", F.struct(*[n for n, _ in kinds]).alias("b")), "session_id", "full")
    near = {"exact_mean_conf": 1.01e-3}
    same = lambda n, t: F.abs(c(f"a.{n}") - c(f"b.{n}")) <= near.get(n, 1e-9) if t == "double" else c(f"a.{n}") == c(f"b.{n}")
    agrees = F.lit(True)
    for n, t in kinds:
        agrees = agrees & ((c(f"a.{n}").isNull() & c(f"b.{n}").isNull()) | F.coalesce(same(n, t), lit(False)))
    return both.select("session_id", agrees.alias("agrees"))


@query(
    "x3_rule_edits",
    f"""WITH {CHOICE_SQL.replace("WHEN 5 THEN contains('ABCDEF', ", "WHEN 5 THEN contains('ABCDEF8', ")} SELECT session_id, fused, round(score + 1e-10, 8)::DOUBLE AS score FROM won""",
)
def x3(spark, sf):
    """A rule added by the user: position 5 also takes an 8, so misread letters there are no longer moved."""
    more = rule_table(spark).unionByName(spark.createDataFrame([(m, 5, "8") for m in ("ALPHA", "BETA")], "model string, pos int, allowed_char string"))
    f = U.fuse_reads(reads(spark, sf), more, confusion_table(spark), PARAMS)
    return f.filter("status <> 'NO_READ'").select("session_id", "fused", F.round(c("score") + 1e-10, 8).alias("score"))


@query("f15_second_pass")
def f15(spark, sf):
    return U.unresolved(fused(spark, sf)).select("session_id", "status")


RERANK_SQL_ALLOWED = """CASE WHEN i = 1 THEN contains('0123456789', X) WHEN i = 2 THEN X = 'A' WHEN i = 5 THEN contains('ABCDEF', X) ELSE contains('0123456789ABCDEF', X) END"""


@query(
    "h2_rerank_reads",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i, substr(b, i, 1) AS ch, ((l_partkey * i) % 100) / 100.0 AS v FROM (SELECT *, (l_orderkey % 4) || 'A' || substr(upper(md5(l_orderkey::VARCHAR)), 3, 5) AS b FROM lineitem), (SELECT unnest(range(1, 8)) AS i)),
    cand AS (SELECT *, ch AS x, v AS vis, 0 AS ord FROM r UNION ALL SELECT r.*, alt, v * 0.6, rk FROM r JOIN (VALUES ('8','B',1),('0','D',1),('6','B',1),('5','E',1),('1','7',1)) t(a, alt, rk) ON ch = a),
    s AS (SELECT *, vis::DOUBLE + CASE WHEN {RERANK_SQL_ALLOWED.replace('X', 'x')} THEN 0.5 ELSE -0.5 END AS sc FROM cand),
    best AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i, arg_max(x, (sc, -ord)) AS x, arg_max(vis, (sc, -ord)) AS vis FROM s GROUP BY ALL),
    f AS (SELECT *, CASE WHEN i = 2 THEN 'A' ELSE x END AS y FROM best)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, string_agg(y, '' ORDER BY i) AS final_text, round(count(*) FILTER ({RERANK_SQL_ALLOWED.replace('X', 'y')}) / 7.0, 6)::DOUBLE AS compliance FROM f GROUP BY 1, 2, 3, 4""",
)
def h2(spark, sf):
    h = F.upper(F.md5(c("l_orderkey").cast("string")))
    base = F.concat((c("l_orderkey") % 4).cast("string"), lit("A"), F.substring(h, 3, 5))
    confs = F.transform(F.sequence(lit(1), lit(7)), lambda i: (c("l_partkey") * i) % 100 / 100.0)
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    # text and confidences follow from the ids, so only these are shuffled
    one = dealt(table(spark, sf, "lineitem").select(*ids), ids).distinct().select(*ids, base.alias("text"), lit("ALPHA").alias("model"), confs.alias("confs"))
    out = U.rerank_reads(one, rule_table(spark), confusion_table(spark), PARAMS, ids)
    return out.select(*ids, "final_text", F.round("compliance", 6).alias("compliance"))


@query(
    "h4_disagreement_audit",
    """WITH e AS (SELECT p_partkey, upper(p_name) AS a, upper(p_type) AS b, upper(p_brand) AS raw, CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE upper(p_brand) END AS fin FROM part),
    z AS (SELECT p_partkey, i - 1 AS position, nullif(substr(a, i, 1), '') AS a, nullif(substr(b, i, 1), '') AS b, nullif(substr(raw, i, 1), '') AS r, nullif(substr(fin, i, 1), '') AS f FROM e, (SELECT unnest(range(1, 40)) AS i)),
    q AS (SELECT p_partkey, position, list_sort(list_filter([CASE WHEN r <> f THEN 'RAW_FINAL_DISAGREEMENT' END, CASE WHEN r <> f AND (r || f) IN ('BE', 'EB', 'LI', 'IL') THEN 'CONFUSABLE_' || r || '_' || f END, CASE WHEN a <> b THEN 'ENGINE_DISAGREEMENT' END,
      CASE WHEN a <> b AND (a || b) IN ('BE', 'EB', 'LI', 'IL') AND NOT coalesce(r <> f AND 'CONFUSABLE_' || r || '_' || f = 'CONFUSABLE_' || least(a, b) || '_' || greatest(a, b), false) THEN 'CONFUSABLE_' || least(a, b) || '_' || greatest(a, b) END,
      CASE WHEN f IS NOT NULL AND coalesce(a, b) IS NOT NULL AND f IS DISTINCT FROM a AND f IS DISTINCT FROM b THEN 'VALIDATOR_CHANGED_CHARACTER' END], lambda x: x IS NOT NULL)) AS reasons, coalesce(f IN ('S', 'E') OR r IN ('S', 'E'), f IN ('S', 'E'), r IN ('S', 'E'), false) AS weak FROM z)
    SELECT p_partkey, position::INTEGER AS position, array_to_string(reasons, ';') AS reasons, weak FROM q WHERE len(reasons) > 0""",
)
def h4(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("a"), F.upper("p_type").alias("b"), F.upper("p_brand").alias("raw"), F.when(c("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.upper("p_brand")).alias("fin")
    )
    audit = G.disagreement_audit(part, ["p_partkey"], ["a", "b"], "raw", "fin", [("B", "E"), ("I", "L")], weak="SE")
    return audit.select("p_partkey", "position", F.array_join("reasons", ";").alias("reasons"), "weak")


_HALF = "list_sum(list_transform(range({0}, {0} + 32), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - {0}) ELSE 0 END))::BIGINT"
GREEDY_SQL = f"""WITH RECURSIVE h AS (SELECT label, vec_id, {_HALF.format(1)} AS lo, {_HALF.format(33)} AS hi, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
walk AS (
  SELECT label, 0::BIGINT AS rn, NULL::BIGINT AS vec_id, NULL::BIGINT AS rep, []::STRUCT(lo BIGINT, hi BIGINT, i BIGINT)[] AS reps FROM (SELECT DISTINCT label FROM h)
  UNION ALL
  SELECT label, rn, vec_id, coalesce(hit, vec_id), CASE WHEN hit IS NULL THEN list_append(reps, struct_pack(lo := lo, hi := hi, i := vec_id)) ELSE reps END FROM (
    SELECT h.label, h.rn, h.vec_id, h.lo, h.hi, w.reps, list_filter(w.reps, lambda r: bit_count(xor(r.lo, h.lo)) + bit_count(xor(r.hi, h.hi)) <= 5)[1].i AS hit FROM walk w JOIN h ON h.label = w.label AND h.rn = w.rn + 1)
) SELECT label, vec_id, rep AS representative FROM walk WHERE rn > 0"""


@query("h1_near_duplicate_groups", GREEDY_SQL)
def h1(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", G.sign_hash(c("embedding")).alias("h"))
    return G.near_duplicate_groups(e, ["label"], "h", "vec_id").drop("h")


@query(
    "j11_group_sizes",
    f"SELECT label, representative, count(*) AS members FROM ({GREEDY_SQL}) GROUP BY 1, 2",
)
def j11(spark, sf):
    return h1(spark, sf).groupBy("label", "representative").agg(F.count(lit(1)).alias("members"))


@query("u5_trusted_bases", "SELECT event_type, count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM events WHERE value > 450)) AS trusted FROM events GROUP BY 1")
def u5b(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "user_id", "value", epoch_ms("ts").alias("t"))
    pairs = ev.select("event_type", "user_id").distinct()
    good = ev.filter("value > 450").select("user_id").distinct().withColumn("_g", lit(True))
    return pairs.join(good, "user_id", "left").groupBy("event_type").agg(F.count("_g").alias("trusted"))


_VALID = " AND ".join(_allowed("fmod", str(i), f"substr(t, {i}, 1)") for i in range(1, 8))


@query(
    "a21_exact_counts",
    f"""WITH {CHOICE_SQL}, fm AS (SELECT session_id, fused, CASE substr(fused, 1, 2) WHEN '1A' THEN 'ALPHA' WHEN '2A' THEN 'BETA' WHEN '3A' THEN 'ALPHA' ELSE m END AS fmod FROM won),
    tx AS (SELECT session_id, t, fused, fmod, sum(greatest(0, ocr_conf) * vw * greatest(0.05, q)) AS wt, count(*) AS n, count(DISTINCT evidence_group) AS g, count(DISTINCT split_part(variant_name, '@', 1)) FILTER (split_part(variant_name, '@', 1) IN ('base', 'clear')) AS tb
      FROM reads JOIN fm USING (session_id) WHERE length(t) = 7 GROUP BY 1, 2, 3, 4),
    vx AS (SELECT *, {_VALID} AND CASE substr(t, 1, 2) WHEN '1A' THEN 'ALPHA' WHEN '2A' THEN 'BETA' WHEN '3A' THEN 'ALPHA' END IS NOT DISTINCT FROM fmod AS valid FROM tx)
    SELECT session_id, coalesce(max(n) FILTER (t = fused), 0)::BIGINT AS exact_reads, coalesce(max(g) FILTER (t = fused), 0)::BIGINT AS exact_groups, coalesce(max(tb) FILTER (t = fused), 0)::BIGINT AS trusted_bases,
    coalesce(max(wt) FILTER (t <> fused AND valid AND tb > 0) / greatest(coalesce(sum(wt) FILTER (t = fused), 0), 1e-9) >= 0.55, false) AS conflict FROM vx GROUP BY 1""",
)
def a21_counts(spark, sf):
    return fused(spark, sf).filter("status <> 'NO_READ'").select("session_id", "exact_reads", "exact_groups", "trusted_bases", "conflict")

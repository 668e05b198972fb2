"""Source, sink and schema queries: driver rows are written to the shared scratch folder and read back."""

from __future__ import annotations

import os
import struct
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.functions.times import epoch_ms
from marktrace.registry.base import query, table
from marktrace.session import scratch_path
from marktrace.sources import readers as R
from marktrace.sources import schema_ops as M
from marktrace.sources import sinks as K

c, lit = F.col, F.lit


@query("s1_session_scan", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"))
    o.write.parquet(path)
    there = R.read_sessions(spark, path, o.schema)
    return there.unionByName(R.read_sessions(spark, path + "-absent", o.schema))


@query("s2_day_csv", "SELECT event_id, value, strftime(ts, '%Y%m%d') AS file_day FROM events")
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    ev = table(spark, sf, "events").select("event_id", "value", F.concat(F.date_format("ts", "yyyyMMdd"), lit(".csv")).alias("events_day"))
    ev.repartition("events_day").write.partitionBy("events_day").option("header", True).csv(path)
    return R.read_day_csv(spark, path, "events", ev.drop("events_day").schema)


@query("s3_tolerant_jsonl", "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_id % 10 = 0) AS malformed FROM events WHERE event_id % 10 > 0")
def s3(spark, sf):
    path = scratch_path(spark, "s3")
    ev = table(spark, sf, "events").select("event_id", "event_type")
    good = F.to_json(F.struct("event_id", "event_type"))
    ev.select(F.when(c("event_id") % 10 == 0, F.concat(lit("{broken "), c("event_id").cast("string"))).otherwise(F.concat(good, F.when(c("event_id") % 10 == 1, "\n").otherwise(""))).alias("value")).write.text(path)
    rows, bad = R.split_corrupt(R.read_jsonl(spark, path, ev.schema))
    return rows.crossJoin(F.broadcast(bad))  # ``bad`` is one count


#: small files written by one task
TASK_FILES = 500


@query("s4_sidecars", "SELECT s_suppkey AS item, s_name AS name FROM supplier WHERE s_suppkey % 10 > 0")
def s4(spark, sf):
    """One JSON document per folder, over several lines; some cannot be read."""
    path, k = scratch_path(spark, "s4"), c("s_suppkey")
    broken = F.when(k % 10 == 0, lit("{ \"item\": ")).otherwise(F.to_json(F.struct(k.alias("item"), c("s_name").alias("name")), {"pretty": "true"}))
    rows = table(spark, sf, "supplier")
    # files cost more than their few bytes: a bounded number for each task, which also puts them in their place
    placed = rows.select(k.alias("folder"), broken.alias("value")).repartition(1 + rows.count() // TASK_FILES, "folder")
    placed.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder").text(path)
    return R.read_sidecars(spark, path, T.StructType.fromDDL("item bigint, name string"), "*.txt").select("item", "name")


def png(height: int, width: int, value: int) -> bytes:
    """A grey picture of one value as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + bytes([value]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pictures(spark, sf):
    """One picture per supplier, below folders; every tenth file is no picture, every seventh none by name."""
    path = scratch_path(spark, "pictures")
    folder = path.removeprefix("file://").removeprefix("file:")

    def write(rows):
        for r in rows:
            os.makedirs(f"{folder}/{r.k % 3}", exist_ok=True)
            with open(f"{folder}/{r.k % 3}/{r.k}.{'txt' if r.k % 7 == 0 else 'png'}", "wb") as f:
                f.write(b"no picture" if r.k % 10 == 0 else png(2 + r.k % 5, 3 + r.k % 4, r.k % 256))

    table(spark, sf, "supplier").select(c("s_suppkey").alias("k")).foreachPartition(write)
    return path


@query("s8_image_inventory", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 > 0")
def s8(spark, sf):
    files = R.file_inventory(spark, pictures(spark, sf), R.IMAGE_GLOB).filter("size > 0 AND mtime_ms > 0")
    return files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("s_suppkey"))


@query("s9_read_images", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 > 0 THEN (2 + s_suppkey % 5)::INTEGER END AS height, CASE WHEN s_suppkey % 10 > 0 THEN (3 + s_suppkey % 4)::INTEGER END AS width, s_suppkey % 10 > 0 AS readable FROM supplier WHERE s_suppkey % 7 > 0")
def s9(spark, sf):
    got = R.read_images(spark, pictures(spark, sf))
    size = lambda n: F.when(c("readable"), c(n))
    return got.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("s_suppkey"), size("height").alias("height"), size("width").alias("width"), "readable")


@query("s15_settled_files", "SELECT DISTINCT p_partkey % 7 AS g FROM part WHERE p_partkey % 7 >= 2")
def s15_settled(spark, sf):
    """Files by age: the clock stands g seconds behind each folder's last change, and two seconds must have passed."""
    path = scratch_path(spark, "s15")
    table(spark, sf, "part").withColumn("g", c("p_partkey") % 7).write.partitionBy("g").parquet(path)
    files = R.file_inventory(spark, path, "*.parquet").withColumn("g", F.regexp_extract("path", r"g=(\d)", 1).cast("long"))
    return R.settled_only(files, "mtime_ms", c("mtime_ms") + c("g") * 1000).select("g").distinct()


@query("s5_log_lines", "SELECT event_id::VARCHAR || ' ' || props AS msg, event_type AS source, epoch_us(date_trunc('second', ts)) // 1000 AS ts_ms FROM events WHERE event_id % 5 > 0")
def s5(spark, sf):
    line = F.concat(lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), lit("] [INFO] ["), c("event_type"), lit("] "), c("event_id").cast("string"), lit(" "), c("props"))
    text = table(spark, sf, "events").select(F.when(c("event_id") % 5 == 0, F.concat(lit("  at "), c("props"))).otherwise(line).alias("value"))
    return R.parse_log_lines(text).select("msg", "source", epoch_ms("ts").alias("ts_ms"))


@query("s6_tag_feed", "SELECT event_id, CASE WHEN event_id = 0 THEN '0' ELSE event_id::VARCHAR END AS epc, CASE WHEN event_id % 2 = 0 THEN value / 100 ELSE -value END AS rssi, (event_id % 3)::INTEGER AS antenna FROM events WHERE event_type = 'view'")
def s6(spark, sf):
    ev = table(spark, sf, "events")
    k = c("event_id")
    tag = F.to_json(F.struct(F.lpad(k.cast("string"), 8, "0").alias("epc"), F.when(k % 2 == 0, c("value")).alias("peakRssiCdbm"), (-c("value")).alias("rssi"), F.when(k % 3 > 0, (k % 3).cast("int")).alias("antenna")))
    kind = F.when(c("event_type") == "view", "tagInventory").otherwise("status")
    line = F.concat(lit('data: {"eventType": "'), kind, lit('", "tagInventoryEvent": '), tag, lit("} "))
    return R.parse_tag_feed(ev.select("event_id", line.alias("value"))).select("event_id", "epc", "rssi", "antenna")


@query("s7_ground_truth", "SELECT 'd' || doc_id || '.jpg' AS filename, upper(substr(md5(doc_id::VARCHAR), 1, 17)) AS vin, CASE WHEN doc_id % 3 = 0 THEN 'NO_READ' ELSE 'ACCEPT' END AS expected_status FROM documents")
def s7(spark, sf):
    path = scratch_path(spark, "s7")
    d = table(spark, sf, "documents").select(
        F.concat(lit("a/b/d"), "doc_id", lit(".jpg")).alias("image"), F.concat(lit(" "), F.substring(F.md5(c("doc_id").cast("string")), 1, 17)).alias("ground_truth"), F.when(c("doc_id") % 3 == 0, "NO_READ").alias("expected_status")
    )
    d.write.option("header", True).csv(path)
    return R.read_truth(spark, path)


@query("s10_manifest_splits", "SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM part")
def s10(spark, sf):
    path = scratch_path(spark, "s10")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    for i, s in enumerate(("train", "validation", "test")):
        p.filter(c("p_size") % 3 == i).drop("p_size").write.option("header", True).csv(f"{path}/{s}.csv")
    return R.read_manifests(spark, path, ["train", "validation", "test", "known"], p.drop("p_size").schema)


@query("s12_file_inventory", "SELECT 7::BIGINT AS folders, true AS sized, count(*) AS rows FROM part WHERE p_size >= 0")
def s12(spark, sf):
    path = scratch_path(spark, "s12")
    table(spark, sf, "part").withColumn("g", c("p_partkey") % 7).write.partitionBy("g").parquet(path)
    files = R.file_inventory(spark, path, "*.parquet")
    rows = spark.read.parquet(path).count()
    return files.agg(F.count_distinct(F.regexp_extract("path", r"g=(\d)", 1)).alias("folders"), F.bool_and((c("size") > 0) & (c("mtime_ms") > 0)).alias("sized"), lit(rows).cast("long").alias("rows"))


@query("s13_session_evidence", "SELECT l_linenumber AS id, l_quantity FROM lineitem WHERE l_orderkey = 42")
def s13(spark, sf):
    li = table(spark, sf, "lineitem").select(c("l_orderkey").cast("string").alias("session_id"), c("l_linenumber").alias("id"), "l_quantity")
    return R.session_evidence(li, "42").drop("session_id")


@query("k1_csv_export", "SELECT doc_id, text, source FROM documents")
def k1(spark, sf):
    path = scratch_path(spark, "k1")
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    K.write_csv(d, path)
    return spark.read.schema(d.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("k2_day_json", "SELECT event_id, event_type, strftime(ts, '%Y%m%d') AS day FROM events")
def k2(spark, sf):
    path = scratch_path(spark, "k2")
    ev = table(spark, sf, "events").select("event_id", "event_type", "ts")
    K.append_day_json(ev.filter("event_id % 2 = 0"), path, F.date_format("ts", "yyyyMMdd"))
    K.append_day_json(ev.filter("event_id % 2 = 1"), path, F.date_format("ts", "yyyyMMdd"))
    return spark.read.schema("event_id long, event_type string, day string").json(path)


@query("k3_log_export", "SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [INFO] [' || event_type || '] ' || props AS value FROM events")
def k3(spark, sf):
    ev = table(spark, sf, "events").select("ts", c("event_id").alias("id"), lit("INFO").alias("level"), c("event_type").alias("source"), c("props").alias("msg"))
    return K.log_lines(ev)


@query("k4_metrics_json", "SELECT '{\"rows\":' || count(*) || ',\"customers\":' || count(DISTINCT o_custkey) || '}' AS json FROM orders")
def k4(spark, sf):
    return K.metrics_json(table(spark, sf, "orders").agg(F.count(lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers")))


@query("k4_metrics_markdown", "SELECT '# Orders' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|---|---|' || chr(10) || '| rows | ' || count(*) || ' |' || chr(10) || '| customers | ' || count(DISTINCT o_custkey) || ' |' || chr(10) AS markdown FROM orders")
def k4_markdown(spark, sf):
    text = K.metrics_markdown(table(spark, sf, "orders").agg(F.count(lit(1)).alias("rows"), F.count_distinct("o_custkey").alias("customers")), "Orders")
    return spark.createDataFrame([(text,)], "markdown string")


@query("k5_upsert", "SELECT c.c_custkey, CASE WHEN o.o_custkey IS NULL THEN 'PENDING' ELSE o.s END AS status FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey")
def k5(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", lit("PENDING").alias("status"), lit(None).cast("timestamp_ntz").alias("at"), lit(-1).cast("long").alias("seq"))
    batch = table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("at"), c("o_orderkey").alias("seq"))
    once = K.upsert(target, batch, "c_custkey", ["at", "seq"])
    return K.upsert(once, batch, "c_custkey", ["at", "seq"]).select("c_custkey", "status")


@query("k6_insert_new", "SELECT o_custkey AS session_key, min(o_orderkey) AS id, 'inserted' AS outcome FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, o_custkey, 'existing' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 2 = 0")
def k6(spark, sf):
    target = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").alias("session_key"), c("c_custkey").alias("id"))
    batch = table(spark, sf, "orders").select(c("o_custkey").alias("session_key"), c("o_orderkey").alias("id"))
    new, old = K.insert_new(target, batch, "session_key", ["id"])
    return new.withColumn("outcome", lit("inserted")).unionByName(old.withColumn("outcome", lit("existing")))


@query("k7_insert_distinct", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type, p_size, p_name ORDER BY p_partkey) = 1 AND p_brand <> 'Brand#2' AS inserted FROM part")
def k7(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_name", "p_partkey")
    return K.insert_distinct(p.filter("p_brand = 'Brand#2'"), p, ["p_brand", "p_type", "p_size", "p_name"], "p_partkey").select("p_partkey", "inserted")


@query("k8_evidence_export", "SELECT p_partkey, '{\"x\":' || p_size || ',\"y\":' || p_partkey || '}' AS box FROM part")
def k8(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.struct(c("p_size").alias("x"), c("p_partkey").alias("y")).alias("box"))
    return K.evidence_export(p, ["box"])


@query("k9_update_columns", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'NEW' ELSE p_brand END AS p_brand, p_type FROM part")
def k9(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return K.update_columns(p.drop("p_size"), p.filter("p_size > 25").select("p_partkey", lit("NEW").alias("p_brand")), "p_partkey", ["p_brand"])


@query("k10_split_manifests", "SELECT doc_id::VARCHAR || '.png' AS image, upper(substr(md5(doc_id::VARCHAR), 1, 17)) AS label, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 4 > 0")
def k10(spark, sf):
    path = scratch_path(spark, "k10")
    h = F.upper(F.substring(F.md5(c("doc_id").cast("string")), 1, 17))
    d = table(spark, sf, "documents").select(F.concat(c("doc_id").cast("string"), lit(".png")).alias("image"), F.when(c("doc_id") % 4 > 0, h).otherwise("BAD").alias("label"), F.when(c("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    K.write_manifest(d, path, "image", "label")
    return spark.read.schema("image string, label string, split string").option("sep", "\t").csv(path)


@query(
    "k11_detector_labels",
    "SELECT l_orderkey, string_agg(line, chr(10) ORDER BY line) AS label_text FROM (SELECT l_orderkey, l_linenumber || ' ' || printf('%.6f', least(1, (l_quantity + 10) / 100)) || ' ' || printf('%.6f', 0.5::DOUBLE) || ' ' || printf('%.6f', 0.2::DOUBLE) || ' ' || printf('%.6f', 1.0::DOUBLE) AS line FROM lineitem) GROUP BY 1",
)
def k11(spark, sf):
    q = c("l_quantity")
    b = table(spark, sf, "lineitem").select("l_orderkey", c("l_linenumber").alias("cls"), q.alias("x1"), lit(-10.0).alias("y1"), (q + 20).alias("x2"), lit(60.0).alias("y2"), lit(100.0).alias("img_w"), lit(50.0).alias("img_h"))
    return K.detector_labels(b, "l_orderkey")


@query("k12_confusion_csv", "SELECT l_returnflag AS truth, count(*) FILTER (l_linestatus = 'O') AS \"O\", count(*) FILTER (l_linestatus = 'F') AS \"F\" FROM lineitem GROUP BY 1")
def k12(spark, sf):
    from marktrace.operators.aggregates import confusion_matrix

    path = scratch_path(spark, "k12")
    m = confusion_matrix(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])
    K.write_csv(m, path)
    return spark.read.schema(m.schema).option("header", True).csv(path)


@query("k13_restore_report", "SELECT count(*) AS source_rows, count(*) AS copy_rows, 0::BIGINT AS differing_keys, true AS intact FROM orders")
def k13(spark, sf):
    path = scratch_path(spark, "k13")
    o = table(spark, sf, "orders")
    return K.copy_checked(spark, M.backfill_session_keys(o, "o_orderkey"), path, "o_orderkey")


@query(
    "k13_damaged_copy",
    """SELECT count(*) AS source_rows, count(*) FILTER (o_orderkey % 7 > 0) + count(*) FILTER (o_orderkey % 11 = 0) AS copy_rows,
    count(*) FILTER ((o_orderkey % 7 = 0) <> (o_orderkey % 11 = 0) OR o_orderkey % 13 = 0) AS differing_keys, false AS intact FROM orders""",
)
def k13_damaged(spark, sf):
    """A copy with rows lost, rows twice and rows whose contents changed is told from its source."""
    k = c("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changed = o.withColumn("o_totalprice", c("o_totalprice") + F.when(k % 13 == 0, 1.0).otherwise(0.0))
    return K.restore_report(o, changed.filter(k % 7 > 0).union(changed.filter(k % 11 == 0)), "o_orderkey")


@query("m1_ensure_columns", "SELECT r_regionkey, r_name, NULL::DOUBLE AS confidence, NULL::VARCHAR AS reason, 'confidence,reason' AS added FROM region")
def m1(spark, sf):
    from pyspark.sql.types import StructType

    df, added = M.ensure_columns(table(spark, sf, "region"), StructType.fromDDL("r_name string, confidence double, reason string"))
    again, more = M.ensure_columns(df, StructType.fromDDL("r_name string, confidence double, reason string"))
    return again.withColumn("added", lit(",".join(added + more)))


@query("m2_require_columns", "SELECT o_orderkey FROM orders")
def m2(spark, sf):
    return M.require_columns(table(spark, sf, "orders"), ["o_orderkey", "o_custkey"]).select("o_orderkey")


@query("m3_backfill_keys", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'legacy-' || o_orderkey END AS session_id FROM orders")
def m3(spark, sf):
    k = c("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, c("o_orderpriority")).when(k % 3 == 1, " ").alias("session_id"))
    return M.backfill_session_keys(M.backfill_session_keys(o, "o_orderkey"), "o_orderkey")


@query(
    "k5_older_batch",
    """WITH b AS (SELECT o_custkey, o_orderkey AS seq, o_orderstatus AS s, o_orderstatus = 'F' AS terminal FROM orders)
    SELECT o_custkey, arg_max(s, (terminal, seq)) AS status, arg_max(seq, (terminal, seq)) AS seq FROM b GROUP BY 1""",
)
def k5_older(spark, sf):
    """A newer batch, then an older one, then the newer one again."""
    o = table(spark, sf, "orders").select("o_custkey", c("o_orderkey").alias("seq"), c("o_orderstatus").alias("status"), (c("o_orderstatus") == "F").alias("terminal"))
    newer, older = o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1")
    order = ["terminal", "seq"]
    target = K.upsert(K.upsert(newer.limit(0), newer, "o_custkey", order), older, "o_custkey", order)
    return K.upsert(target, newer, "o_custkey", order).select("o_custkey", "status", "seq")


@query("m3_backfill_report", "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 3 > 0) AS to_fill FROM orders")
def m3b(spark, sf):
    return M.backfill_report(table(spark, sf, "orders").select(F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")).alias("session_id")))


@query("u1_day_union", "SELECT strftime(ts, '%Y%m%d') AS file_day, count(*) AS n FROM events GROUP BY 1")
def u1(spark, sf):
    return s2(spark, sf).groupBy("file_day").agg(F.count(lit(1)).alias("n"))


@query("u2_label_union", "SELECT split, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM part) GROUP BY 1")
def u2(spark, sf):
    return s10(spark, sf).groupBy("split").agg(F.count(lit(1)).alias("n"))


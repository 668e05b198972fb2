"""Scans (S1-S15). Schemas are given, never inferred; missing paths give an empty table of that schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.functions.tags import NO_EPC, decode_epc, rssi_dbm, strip_zeros
from marktrace.functions.text import file_name

IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _or_empty(spark: SparkSession, schema: T.StructType | None, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as err:
        if schema is not None and "PATH_NOT_FOUND" in str(err):
            return empty(spark, schema)
        raise


def read_sessions(spark: SparkSession, path: str, schema: T.StructType, order: str = "id") -> DataFrame:
    """S1."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path)).orderBy(order)


def read_day_csv(spark: SparkSession, folder: str, stem: str, schema: T.StructType) -> DataFrame:
    """All ``<stem>_<day>.csv`` files, or folders named so or ``<stem>_<name>=<day>.csv``, with the day taken from the name."""
    full = T.StructType([*schema.fields, T.StructField("file_day", T.StringType())])

    def read():
        df = spark.read.schema(schema).option("header", True).csv(f"{folder}/{stem}_*.csv")
        return df.withColumn("file_day", F.regexp_extract(F.col("_metadata.file_path"), rf"/{stem}_(?:\w+=)?([^/]+)\.csv(?:/|$)", 1))

    return _or_empty(spark, full, read)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: tolerant JSON lines; bad lines stay visible in ``_corrupt_record`` (see ``split_corrupt``)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return _or_empty(spark, full, lambda: spark.read.text(path).filter(F.trim("value") != "").select(
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*"))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, count of malformed lines)."""
    good = df.filter("_corrupt_record is null").drop("_corrupt_record")
    return good, df.agg(F.count("_corrupt_record").alias("malformed"))


def read_sidecars(spark: SparkSession, root: str, schema: T.StructType, name: str = "metadata.json") -> DataFrame:
    """Every sidecar below ``root``, unreadable ones skipped."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])

    def read():
        df = spark.read.schema(full).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
        return df.withColumn("sidecar_path", F.col("_metadata.file_path")).filter("_corrupt_record is null").drop("_corrupt_record")

    return _or_empty(spark, T.StructType([*schema.fields, T.StructField("sidecar_path", T.StringType())]), read)


# Fixed value: layout of a log line, [time] [level] [source] message.
LOG_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[(\w+)\s*\] \[([^\]]*)\] (.*)$"


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Four fields per line; lines of another shape are dropped."""
    g = lambda i: F.regexp_extract(column, LOG_LINE, i)
    hit = lines.filter(F.col(column).rlike(LOG_LINE))
    return hit.select(F.try_to_timestamp(g(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), g(2).alias("level"), F.trim(g(3)).alias("source"), g(4).alias("msg"))


TAG_EVENT = "eventType string, tagInventoryEvent struct<epc: string, tag: struct<epc: string>, peakRssiCdbm: double, rssi: double, antennaPort: int, antenna: int>"


def parse_tag_feed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Event-stream lines to tag hits; other events and unreadable tags are dropped."""
    body = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    e = lines.withColumn("_e", F.from_json(body, TAG_EVENT)).filter(F.lower(F.trim("_e.eventType")) == "taginventory")
    t = F.col("_e.tagInventoryEvent")
    epc = decode_epc(F.coalesce(t.epc, t.tag.epc))
    out = e.filter(t.isNotNull()).withColumns(
        {
            "epc": F.when(epc != NO_EPC, strip_zeros(epc)),
            "rssi": rssi_dbm(t.peakRssiCdbm, t.rssi),
            "antenna": F.coalesce(F.nullif(t.antennaPort, F.lit(0)), t.antenna, F.lit(0)),
        }
    )
    return out.filter("epc is not null").drop("_e")


def aliased(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Header aliases: each target takes the first source column present, case-insensitive, BOM-safe."""
    have = {c.replace("﻿", "").strip().lower(): c for c in df.columns}
    cols = []
    for target, names in aliases.items():
        found = next((have[n] for n in names if n in have), None)
        cols.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(target))
    return df.select(*cols)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth with header aliases, or a headerless two-column file."""
    first = spark.read.text(path).limit(1).first()
    names = {n.strip().lower() for n in (first[0] if first else "").replace("﻿", "").split(",")}
    if names & {"filename", "file", "image"}:
        raw = spark.read.option("header", True).csv(path)
        df = aliased(raw, {"filename": ("filename", "file", "image"), "vin": ("vin", "ground_truth"), "expected_status": ("expected_status",)})
    else:
        df = spark.read.schema("filename string, vin string").csv(path).withColumn("expected_status", F.lit(None).cast("string"))
    name = F.regexp_replace("filename", "﻿", "")
    return df.select(file_name(name).alias("filename"), F.upper(F.trim("vin")).alias("vin"), F.coalesce("expected_status", F.lit("ACCEPT")).alias("expected_status"))


def file_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Path, modification time and size; file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Images decoded in the JVM; undecodable files keep a row with no pixels."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    pixels = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    img = pixels.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    paths = raw.select("path")
    out = paths.join(img, F.regexp_replace(paths["path"], "^file:/+", "/") == F.regexp_replace(img["path"], "^file:/+", "/"), "left").drop(img["path"])
    return out.withColumn("readable", F.coalesce(F.col("channels") > 0, F.lit(False)))


def read_manifests(spark: SparkSession, folder: str, splits: Sequence[str], schema: T.StructType) -> DataFrame:
    """One CSV per split, missing files give no rows."""
    out = None
    for split in splits:
        part = _or_empty(spark, schema, lambda s=split: spark.read.schema(schema).option("header", True).csv(f"{folder}/{s}.csv"))
        part = part.withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def session_evidence(engine_results: DataFrame, session_id: str) -> DataFrame:
    """S13."""
    return engine_results.filter(F.col("session_id") == session_id).orderBy("id")


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files only; what was seen is kept in the query's checkpoint."""
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def settled_only(files: DataFrame, modified: str, now: Column, min_age_ms: int = 2000) -> DataFrame:
    """Skip files that may still be written to."""
    return files.filter(now - F.col(modified) >= min_age_ms)


__all__ = [n for n in dir() if not n.startswith("_")]

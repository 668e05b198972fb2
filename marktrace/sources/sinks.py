"""Writers and keyed updates (K1-K13). Updates return a new snapshot; publishing is an atomic directory write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marktrace.session import scratch_path, settle
from marktrace.functions.decisions import unit
from marktrace.functions.text import is_strict


def write_csv(df: DataFrame, path: str) -> None:
    """K1: quoted CSV with a header."""
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def append_day_json(df: DataFrame, path: str, day: Column) -> None:
    """K2: JSON lines below one folder per day."""
    df.withColumn("day", day).write.partitionBy("day").mode("append").json(path)


def log_lines(logs: DataFrame) -> DataFrame:
    """K3: chronological text lines."""
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.col("level"), F.lit("] ["), F.col("source"), F.lit("] "), F.col("msg"))
    return logs.orderBy("ts", "id").select(line.alias("value"))


def metrics_json(row: DataFrame) -> DataFrame:
    """K4: one aggregated row as JSON."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))


def metrics_markdown(row: DataFrame, title: str) -> str:
    """K4: summary text of one aggregated row."""
    values = row.first().asDict()
    lines = [f"# {title}", "", "| metric | value |", "|---|---|"]
    return "\n".join([*lines, *[f"| {k} | {v} |" for k, v in values.items()]]) + "\n"


def last_per_key(batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in batch.columns if c != key]
    one = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return one.select(key, "_r.*").select(*batch.columns)


def upsert(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """K5: the newest row per key of target and batch together, by ``order`` (e.g. terminal flag, then time).

    A replayed or older batch changes nothing; of rows with equal order the batch's one stays. Where the target
    lacks an order column its rows count as oldest.
    """
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_per_key(both, key, [*order, "_new"]).drop("_new")


def insert_new(target: DataFrame, batch: DataFrame, key: str, order: Sequence[str], ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """K6: (rows to add, existing ids for duplicates). An empty key is an error."""
    bad = batch.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "").limit(1).count()
    if bad:
        raise ValueError(f"{key} must not be empty")
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    existing = batch.select(key).distinct().join(target.select(key, ident), key)
    return first.join(target.select(key), key, "left_anti").select(*batch.columns), existing


def insert_distinct(target: DataFrame, batch: DataFrame, natural: Sequence[str], ident: str) -> DataFrame:
    """K7: every batch row with an ``inserted`` flag: the first of its natural key that the target lacks."""
    rest = [c for c in batch.columns if c not in natural]
    first = batch.groupBy(*natural).agg(F.min(ident).alias("_first"))
    fresh = first.join(target.select(*natural).distinct(), list(natural), "left_anti")
    flagged = batch.join(fresh, list(natural), "left")
    return flagged.select(*natural, *rest, F.coalesce(F.col(ident) == F.col("_first"), F.lit(False)).alias("inserted"))


def evidence_export(rows: DataFrame, nested: Sequence[str]) -> DataFrame:
    """K8: nested columns as JSON text, only for export."""
    return rows.withColumns({c: F.to_json(c) for c in nested})


def update_columns(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """K9: new values where given, old ones elsewhere."""
    new = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return target.join(new, key, "left").select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def write_manifest(rows: DataFrame, path: str, image: str, label: str) -> None:
    """image<TAB>label files per split, valid labels only."""
    ok = rows.filter(is_strict(F.col(label)))
    ok.select("split", image, label).write.partitionBy("split").option("sep", "\t").csv(path)


def detector_labels(boxes: DataFrame, image: str) -> DataFrame:
    """Label text per image: class and normalised centre and size, six decimals."""
    w, h = F.col("img_w"), F.col("img_h")
    num = lambda v: F.format_string("%.6f", unit(v))
    line = F.concat_ws(
        " ", F.col("cls").cast("string"),
        num((F.col("x1") + F.col("x2")) / 2.0 / w), num((F.col("y1") + F.col("y2")) / 2.0 / h), num((F.col("x2") - F.col("x1")) / w), num((F.col("y2") - F.col("y1")) / h),
    )
    # one list per image: as long as one frame has detections
    return boxes.withColumn("_line", line).groupBy(image).agg(F.array_join(F.array_sort(F.collect_list("_line")), "\n").alias("label_text"))


def restore_report(source: DataFrame, copy: DataFrame, key: str) -> DataFrame:
    """Row counts, keys and contents of a copy against its source, before anything is published.

    Contents are compared as the sum of row hashes per key, so rows may come in any order.
    """
    rows = F.xxhash64(*source.columns).cast("decimal(38,0)")
    a = source.select(F.col(key).alias("k"), F.lit(1).alias("s"), F.lit(0).alias("c"), rows.alias("h"))
    b = copy.select(F.col(key).alias("k"), F.lit(0).alias("s"), F.lit(1).alias("c"), (-rows).alias("h"))
    per = a.unionByName(b).groupBy("k").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("h").alias("h"))
    same = (F.col("s") == F.col("c")) & (F.col("h") == 0)
    return per.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("copy_rows"),
        F.count_if(~same).alias("differing_keys"), F.coalesce(F.bool_and(same), F.lit(True)).alias("intact"),
    )


def copy_checked(spark: SparkSession, source: DataFrame, path: str, key: str, dry_run: bool = False) -> DataFrame:
    """Stage a copy, compare it with its source, and publish it only if both hold the same rows per key.

    Returns the comparison; with ``dry_run``, or where it finds a difference, nothing appears at ``path``.
    """
    staged = scratch_path(spark, "staged")
    source.write.parquet(staged)
    copy = spark.read.schema(source.schema).parquet(staged)
    report = settle(restore_report(source, copy, key))
    if report.first()["intact"] and not dry_run:
        publish(spark, copy, path)
    return report


def publish(spark: SparkSession, df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a snapshot; an existing one is kept unless told otherwise."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


__all__ = [n for n in dir() if not n.startswith("_")]

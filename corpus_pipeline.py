"""Training-corpus pipeline over ``documents``: each stage works on all rows its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet below the shared folder and reads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktrace.llm.common import stored, whole_text
from marktrace.llm.decontaminate import contamination
from marktrace.llm.lines import dedup_lines
from marktrace.llm.minhash import near_duplicates
from marktrace.llm.packing import pack_documents
from marktrace.llm.quality import quality_scores
from marktrace.registry.base import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``rejected(doc_id, text_key)`` names; ids may be null or repeated."""
    keyed = docs.select(*COLUMNS, F.xxhash64(whole_text()).alias("text_key"))
    gone = rejected.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["text_key"] == gone["_key"]), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters found in 5 or more documents stay in one; ``n_chars`` follows the text."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    marked = stored(near_duplicates(docs), "near-duplicates")
    met = marked.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left, again = _without(docs, met.where("NOT kept")), met.where("kept AND n > 1")
    # of rows that repeat both id and text one stays
    return left if again.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 2048."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]
#: token ids cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""What the corpus operators share: stored intermediate tables, keys and connected components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marktrace.session import scratch_path

#: edges that one task may hold while components are found
TASK_EDGES = 200_000
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table below the shared folder and read again.

    Cuts the lineage: whatever an executor loses later is read from the table, not recomputed. While it is
    written, Arrow batches hold at most ``BATCH_ROWS`` rows, which bounds what Python workers get at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    rows = spark.conf.get(BATCH_CONF)
    if not 0 < int(rows) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, rows)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing reads any more."""
    spark: SparkSession = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: bytes of text decoded and worked on at once
PORTION_BYTES = 500_000


def portions(texts: pa.Array, limit: int = PORTION_BYTES, most: int = 1_000) -> Iterator[tuple[slice, list[str]]]:
    """Consecutive texts of about ``limit`` bytes and at most ``most`` texts, decoded one portion after the other.

    Null texts are empty. Memory follows the longest text, not the Arrow batch.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate([*sizes, limit + 1]):
        if i > first and (held + size > limit or i - first == most):
            yield slice(first, i), [t or "" for t in texts.slice(first, i - first).to_pylist()]
            first, held = i, 0
        held += size


def frugal(work: Callable) -> Callable:
    """``work``, a function over Arrow batches, that gives freed memory back to the system when a partition ends.

    Python workers live as long as their executor; without this each keeps the most it ever held.
    """

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run


def key128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the same values."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(0x5BD1E995), *columns)]


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each of ``n`` nodes' components under the links ``a, b``."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars: each node but the smallest of a component with that one."""
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        a, b = (table.column(c).to_numpy() for c in "ab")
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = labels(len(nodes), at[: len(a)], at[len(a) :])
        child = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])


def connected(edges: DataFrame, label: str = "components", task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root being the smallest node.

    Each task first contracts its own edges, ``task_edges`` at most on average. Then alternating large-star and
    small-star rounds, of map-side-combined minima and equi-joins, are stored until nothing changes; as soon as
    no more than ``task_edges`` are left, one task finishes them. A node that is its own root has no row; nulls
    and self-links are ignored. The number of rounds is logarithmic in the longest chain; only counts and a
    checksum come to the driver.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now, seen = stored(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), label), None
    while True:
        n = now.count()
        if n <= task_edges:
            return now.coalesce(1).mapInArrow(_contract, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
        if seen is None:
            after, mark = stored(now.repartition(-(-n // task_edges)).mapInArrow(_contract, "a long, b long"), label), (0, 0)
        else:
            mark = (n, now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
            if mark == seen:
                return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            after = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), label)
        discard(now)
        now, seen = after, mark

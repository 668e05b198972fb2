"""K5/ST8: a keyed table in buckets, so that a batch rewrites the buckets it touches and no others."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marktrace.sources.sinks import upsert

MANIFEST = "bucket int, version bigint, stream string, epoch bigint"


class BucketTable:
    """Rows by ``key`` below ``root``: ``data/v=<version>/bucket=<n>`` and one manifest per version.

    A manifest names the version of every bucket and the last batch of every stream; a version counts once its
    manifest is complete, so readers never see half a batch and a failed one leaves only files nobody reads.
    It has ``buckets`` rows and one per stream, which is all that reaches the driver. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, order: Sequence[str], buckets: int = 256):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, list(order), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """Newest complete version, 0 for a table without any."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.root}/manifest")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return 0
        found = [f.getPath() for f in fs.listStatus(top)]
        return max((int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS"))), default=0)

    def _manifest(self) -> tuple[int, dict[int, int], dict[str, int]]:
        now = self.version()
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/v={now}").collect() if now else []
        return now, {r.bucket: r.version for r in rows if r.bucket is not None}, {r.stream: r.epoch for r in rows if r.stream is not None}

    def _read(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        """The whole table as of the newest version."""
        rows = self._read(self._manifest()[1])
        if rows is None:
            raise ValueError(f"no version at {self.root}")
        return rows

    def apply(self, batch: DataFrame, stream: str = "batch", epoch: int | None = None) -> int:
        """Upsert ``batch`` and return how many buckets were rewritten.

        A batch of ``stream`` up to the last ``epoch`` applied is a replay and changes nothing. Of rows with one
        key the newest by ``order`` stays, as in ``upsert``.
        """
        now, versions, epochs = self._manifest()
        if epoch is not None and epoch <= epochs.get(stream, -1):
            return 0
        placed = batch.withColumn("bucket", self._bucket())
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
        before = self._read({b: versions[b] for b in touched if b in versions})
        merged = upsert(batch.limit(0) if before is None else before, batch, self.key, self.order)
        new = now + 1
        if touched:
            laid = merged.withColumn("bucket", self._bucket()).repartition("bucket")
            # a version that failed before its manifest is written over
            laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={new}")
        if epoch is not None:
            epochs[stream] = epoch
        rows = [(b, v, None, None) for b, v in sorted((versions | dict.fromkeys(touched, new)).items())] + [(None, None, s, e) for s, e in sorted(epochs.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={new}")
        return len(touched)

    def writer(self, stream: str) -> Callable[[DataFrame, int], None]:
        """foreachBatch function; ``stream`` names the checkpoint, so one that starts again needs another name."""

        def write(batch: DataFrame, epoch: int) -> None:
            self.apply(batch, stream, epoch)

        return write


__all__ = ["BucketTable"]

"""Running a streaming query over what is there now."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from marktrace.session import scratch_path


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all available input into a file sink with its own checkpoint and return the result."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def drain_batches(stream: DataFrame, label: str, write: Callable[[DataFrame, int], None]) -> None:
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{scratch_path(spark, label)}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def drain_slices(slices: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], label: str, mode: str = "append") -> DataFrame:
    """The result of ``build`` over a file stream that each of ``slices`` reaches as one micro-batch, one after the other.

    A slice is written with all its partitions and taken in whole by its own run of the same query and checkpoint.
    """
    root, out, schema = None, None, None
    for rows in slices:
        spark = rows.sparkSession
        root = root or scratch_path(spark, label)
        schema = schema or rows.schema
        rows.write.mode("append").parquet(f"{root}/in")
        out = build(spark.readStream.schema(schema).parquet(f"{root}/in"))
        q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    if out is None:
        raise ValueError("no slices")
    return spark.read.schema(out.schema).parquet(f"{root}/out")

"""Image feature and hash jobs (G1, G2) and model scoring (H15, X1). numpy runs inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marktrace.operators.ordered import step_frame

FEATURES = "width int, height int, mean double, std double, blur double, dark_ratio double, bright_ratio double, saturated_ratio double"


def _gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    px = np.frombuffer(data, dtype=np.uint8, count=height * width * channels).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0].astype(float)
    b, g, r = (px[:, :, i].astype(float) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r)


def features_of(gray: np.ndarray) -> tuple:
    h, w = gray.shape
    p = np.pad(gray, 1, mode="reflect") if min(h, w) > 1 else np.pad(gray, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
    share = lambda m: float(m.mean())
    return w, h, float(gray.mean()), float(gray.std()), float(lap.var()), share(gray < 40), share(gray > 215), share(gray > 248)


def image_features(images: DataFrame, ids: Sequence[str]) -> DataFrame:
    """G1: size, brightness, contrast, Laplacian variance and pixel ratios; unreadable images keep NULLs.

    images: ids, height, width, channels, data.
    """
    names = [f.name for f in T.StructType.fromDDL(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features_of(g) if g is not None else (None,) * len(names) for g in _readable(b)]
            made = [pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in ids), *made], names=[*ids, *names])

    schema = T.StructType([*[images.schema[i] for i in ids], *T.StructType.fromDDL(FEATURES).fields])
    types = [f.type for f in to_arrow_schema(T.StructType.fromDDL(FEATURES))]
    return images.select(*ids, "height", "width", "channels", "data").mapInArrow(run, schema)


def _readable(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """Gray images of a batch, None where one cannot be read."""
    for h, w, c, d in zip(*(batch.column(n).to_pylist() for n in ("height", "width", "channels", "data"))):
        fine = d is not None and all(v is not None and v > 0 for v in (h, w, c))
        yield _gray(h, w, c, d) if fine else None


def _area(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over the source area of every target cell, partial pixels weighted."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(at + 1, edges[1:, None]) - np.maximum(at, edges[:-1, None]), 0, None) * m / n

    return weights(gray.shape[0], rows) @ gray @ weights(gray.shape[1], cols).T


def difference_hash(gray: np.ndarray) -> int:
    small = _area(gray, 8, 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    value = sum(1 << i for i, b in enumerate(bits) if b)
    return value - (1 << 64) if value >> 63 else value


def image_hashes(images: DataFrame, ids: Sequence[str]) -> DataFrame:
    """64-bit row-gradient hash; NULL for unreadable images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([difference_hash(g) if g is not None else None for g in _readable(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in ids), made], names=[*ids, "hash"])

    schema = T.StructType([*[images.schema[i] for i in ids], T.StructField("hash", T.LongType())])
    return images.select(*ids, "height", "width", "channels", "data").mapInArrow(run, schema)


#: bytes of input a model gets at once, by the average row of its Arrow batch
PIECE_BYTES = 4_000_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, b.num_rows * PIECE_BYTES // max(b.nbytes, 1))
        yield from (b.slice(at, step) for at in range(0, b.num_rows, step))


def score_batch(df: DataFrame, inputs: Sequence[str], predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user model over Arrow batches, large ones in pieces. Every input row comes back, id columns
    untouched; a piece the model fails on gives rows with ``error`` set instead of a failed job."""
    out = T.StructType([*df.schema.fields, *T.StructType.fromDDL(schema).fields, T.StructField("error", T.StringType())])
    names = [f.name for f in T.StructType.fromDDL(schema)]
    cols = list(inputs)

    types = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            try:
                got = predict(step_frame(b.select(cols), zone)).reset_index(drop=True)[names]
                made, error = [pa.array(got[n], t, from_pandas=True) for n, t in zip(names, types)], None
                if len(got) != b.num_rows:
                    raise ValueError(f"{len(got)} predictions for {b.num_rows} rows")
            except Exception as err:  # noqa: BLE001
                made, error = [pa.nulls(b.num_rows, t) for t in types], f"{type(err).__name__}: {err}"
            yield pa.RecordBatch.from_arrays([*b.columns, *made, pa.array([error] * b.num_rows, pa.string())], names=out.names)

    return df.mapInArrow(run, out)


def explode_positions(df: DataFrame, text: str) -> DataFrame:
    """One row per character."""
    return df.select("*", F.posexplode(F.filter(F.split(text, ""), lambda ch: ch != "")).alias("position", "char"))

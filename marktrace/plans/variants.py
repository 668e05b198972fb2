"""One crop becomes many variants by an Arrow table function; sessions are capped round-robin by its partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marktrace.plans.images import _readable

VARIANT = "variant_name string, weight double, rotation double, height int, width int, data binary"


@dataclass(frozen=True)
class VariantPlan:
    """Filters with their weights in order of trust, and the further rotations of the first ``rotated`` of them."""

    filters: tuple[tuple[str, float], ...] = (("raw", 1.0), ("stretched", 0.9), ("inverted", 0.7))
    rotations: tuple[float, ...] = (-3.0, 3.0, -6.0, 6.0)
    rotated: int = 2
    #: weight of a rotation up to so many degrees, and of larger ones, as ``rotation_weight`` has them
    turns: tuple[tuple[float, float], ...] = ((0.5, 1.0), (3.5, 0.9), (6.5, 0.8))
    beyond: float = 0.7

    def rows(self) -> list[tuple[str, str, float, float]]:
        """(name, filter, weight, rotation): every filter as it is first, then turn by turn."""
        out = [(name, name, weight, 0.0) for name, weight in self.filters]
        for turn in self.rotations:
            share = next((share for upto, share in self.turns if abs(turn) <= upto), self.beyond)
            out += [(f"{name}@{turn:+g}", name, weight * share, turn) for name, weight in self.filters[: self.rotated]]
        return out


def stretched(gray: np.ndarray) -> np.ndarray:
    low, high = gray.min(), gray.max()
    return gray if high == low else (gray - low) * 255.0 / (high - low)


FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"raw": lambda g: g, "stretched": stretched, "inverted": lambda g: 255.0 - g}


def turned(gray: np.ndarray, degrees: float) -> np.ndarray:
    """The picture turned about its middle, nearest pixel, edges repeated."""
    if not degrees:
        return gray
    h, w = gray.shape
    y, x = np.mgrid[0:h, 0:w]
    a = np.deg2rad(degrees)
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    from_y, from_x = np.cos(a) * dy - np.sin(a) * dx + (h - 1) / 2, np.sin(a) * dy + np.cos(a) * dx + (w - 1) / 2
    return gray[np.clip(np.rint(from_y), 0, h - 1).astype(int), np.clip(np.rint(from_x), 0, w - 1).astype(int)]


def variants_of(gray: np.ndarray, plan: VariantPlan) -> Iterator[tuple]:
    for name, kind, weight, turn in plan.rows():
        made = np.rint(FILTERS[kind](turned(gray, turn))).astype(np.uint8)
        yield name, weight, turn, made.shape[0], made.shape[1], made.tobytes()


def image_variants(images: DataFrame, ids: Sequence[str], plan: VariantPlan = VariantPlan()) -> DataFrame:
    """Ids and ``VARIANT``: every variant of every readable crop. images: ids, height, width, channels, data."""
    schema = T.StructType([*[images.schema[i] for i in ids], *T.StructType.fromDDL(VARIANT).fields])
    arrow, n = to_arrow_schema(schema), len(ids)

    @F.arrow_udtf(returnType=schema)
    class Variants:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            # a crop at a time: a batch of large pictures is not multiplied at once
            for at, gray in enumerate(_readable(batch)):
                if gray is not None:
                    rows = list(variants_of(gray, plan))
                    own = [batch.column(i).slice(at, 1).take(pa.array([0] * len(rows))) for i in ids]
                    yield pa.table([*own, *(pa.array(c, t.type) for c, t in zip(zip(*rows), list(arrow)[n:]))], schema=arrow)

    return Variants(images.select(*ids, "height", "width", "channels", "data").asTable())


def capped_variants(variants: DataFrame, session: str, crop: str, total: int, plan: VariantPlan = VariantPlan()) -> DataFrame:
    """At most ``total`` variants per session, dealt out round-robin over its crops: every crop's first, then every second.

    Partitioned by session and ordered by round and crop; a session's rows stream past a counter.
    """
    turn = F.array_position(F.array(*[F.lit(name) for name, *_ in plan.rows()]), F.col("variant_name")).cast("int")
    numbered = variants.withColumn("turn", turn)
    schema = numbered.schema

    @F.arrow_udtf(returnType=schema)
    class Capped:
        def __init__(self):
            self.left = total

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            part = batch.slice(0, self.left)
            self.left -= part.num_rows
            yield pa.Table.from_batches([part])

    return Capped(numbered.asTable().partitionBy(session).orderBy("turn", crop)).drop("turn")


__all__ = ["VariantPlan", "capped_variants", "image_variants", "variants_of"]

"""Ordered per-key computation that survives hot keys.

``Window.partitionBy(key)`` sends all rows of a key to one task. That is the right plan while each
key is small, and fatal when one key holds a third of the table. The helpers here count rows per key
first (a column-pruned, map-side-combined aggregate) and

* if no key exceeds the slice size, build the ordinary window plan;
* otherwise cut only the oversized keys into consecutive slices of their order column, compute inside
  each slice, and combine the per-slice totals: one row per slice, so the carry table is small.

The number of hot keys and of slice bounds is limited by construction: a slice holds at least
``max(slice_rows, total / MAX_SLICES)`` rows, so there are at most ``2 * MAX_SLICES`` bounds in all.
That bound is what makes broadcasting them safe at any input size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marktrace.session import settle, slice_rows

MAX_SLICES = 20_000
SLICE = "_slice"


@dataclass(frozen=True)
class Ordered:
    """Rows plus the partitioning (keys, slices) and the total order to compute along."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: bool = False

    @property
    def partition(self) -> list[str]:
        return [*self.keys, SLICE] if self.hot else list(self.keys)

    def window(self):
        base = Window.partitionBy(*self.partition) if self.partition else Window.partitionBy()
        return base.orderBy(*sort_columns(self.order))

    def with_df(self, df: DataFrame) -> "Ordered":
        return replace(self, df=df)

    def settle(self) -> "Ordered":
        """Cut the lineage, but only when slices make later branches read the rows again."""
        return self.with_df(settle(self.df)) if self.hot else self

    def plain(self) -> DataFrame:
        return self.df.drop(SLICE) if self.hot else self.df


def sort_columns(order: Sequence[str]) -> list[Column]:
    """Order tokens to sort columns; a leading minus sorts descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match each other; keeps one copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    joined = left.join(renamed, _same(left, keys), how)
    return joined.drop(*[f"_hot_{k}" for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> tuple[int, list]:
    """(slice size, rows ``(*keys, n)`` of groups larger than it); at most MAX_SLICES rows."""
    limit = rows or slice_rows(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or top <= limit:
        return limit, []
    limit = max(limit, math.ceil(total / MAX_SLICES))
    return limit, counts.filter(F.col("_n") > limit).collect()


def order_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_on: str | None = None, rows: int | None = None) -> Ordered:
    """Prepare ``df`` for ordered computation along ``order`` (ascending column names, unique per key).

    ``slice_on`` is a numeric or timestamp column that never decreases along the order; the first
    order column by default. ``rows`` is the slice size, that of the session by default.
    """
    on = slice_on or order[0]
    limit, hot = hot_groups(df, keys, rows)
    plan = Ordered(df, tuple(keys), tuple(order))
    if not hot:
        return plan
    n_max = max(r["_n"] for r in hot)
    pieces = math.ceil(n_max / limit)
    fractions = [i / pieces for i in range(1, pieces)]
    accuracy = max(10_000, 20 * pieces)
    spark = df.sparkSession
    if keys:
        schema = T.StructType([df.schema[k] for k in keys])
        hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], schema)
        source = df.join(F.broadcast(_aliased(hot_keys, keys)), _same(df, keys), "left_semi")
    else:
        source = df
    found = source.groupBy(*keys).agg(F.percentile_approx(on, fractions, accuracy).alias("_cuts")).collect()
    size = {tuple(r[k] for k in keys): r["_n"] for r in hot}
    bounds = []
    for r in found:
        key = tuple(r[k] for k in keys)
        step = max(1, round(pieces * limit / size[key]))
        bounds.append((*key, sorted(set(r["_cuts"][step - 1 :: step]))))
    width = max(len(b[-1]) for b in bounds)
    cut_type = T.ArrayType(df.schema[on].dataType)
    if keys:
        table_schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_cuts", cut_type)])
        table = _aliased(spark.createDataFrame(bounds, table_schema), keys, extra=["_cuts"])
        tagged = df.join(F.broadcast(table), _same(df, keys), "left").select(*[df[c] for c in df.columns], "_cuts")
    else:
        tagged = df.crossJoin(F.broadcast(spark.createDataFrame([(bounds[0][-1],)], T.StructType([T.StructField("_cuts", cut_type)]))))
    cut = tagged.withColumn(SLICE, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_bisect(F.col("_cuts"), F.col(on), width)))
    return replace(plan, df=cut.drop("_cuts"), hot=True)


def _aliased(df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *extra)


def _same(df: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"_hot_{k}"))
    return cond


def _bisect(cuts: Column, value: Column, width: int) -> Column:
    """Number of cuts <= value, by halving steps: log2(width) probes per row."""
    steps = [2**p for p in range(width.bit_length(), -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= value), at + step
        ).otherwise(at),
    )


def running(
    rows: Ordered,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    exclusive: bool = False,
) -> Ordered:
    """Prefix sum / last non-null / maximum per key along the order, up to (or before) each row."""
    sums, lasts, maxes = sums or {}, lasts or {}, maxes or {}
    w = rows.window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = {
        **{n: F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in sums.items()},
        **{n: F.last(e, ignorenulls=True).over(w) for n, e in lasts.items()},
        **{n: F.max(e).over(w) for n, e in maxes.items()},
    }
    if lasts and any(o.startswith("-") for o in rows.order):
        raise ValueError("last-value carries need an ascending order")
    if not rows.hot:
        return rows.with_df(rows.df.withColumns(local))
    position = F.struct(*[o.lstrip("-") for o in rows.order])
    totals = rows.df.groupBy(*rows.partition).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(n) for n, e in lasts.items()],
        *[F.max(e).alias(n) for n, e in maxes.items()],
    )
    before = (Window.partitionBy(*rows.keys) if rows.keys else Window.partitionBy()).orderBy(SLICE)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_hot_{k}") for k in rows.keys],
        F.col(SLICE).alias("_hot_slice"),
        *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[F.max(n).over(before).alias(f"_c_{n}") for n in maxes],
    ).filter(F.col("_hot_slice") > 0)
    # one row per non-first slice of a hot key: at most 2 * MAX_SLICES rows, see module docstring
    cond = _same(rows.df, rows.keys) & (rows.df[SLICE] == F.col("_hot_slice"))
    joined = rows.df.withColumns({f"_l_{n}": c for n, c in local.items()}).join(F.broadcast(carry), cond, "left")
    merged = {
        **{n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums},
        **{n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in lasts},
        **{n: F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in maxes},
    }
    kept = [rows.df[c] for c in rows.df.columns if c not in merged]
    return rows.with_df(joined.select(*kept, *[c.alias(n) for n, c in merged.items()]))


def previous(rows: Ordered, columns: dict[str, Column]) -> Ordered:
    """Values of the directly preceding row of the key (NULL on the first row)."""
    box = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = running(rows, lasts={"_prev": box}, exclusive=True)
    return out.with_df(out.df.withColumns({n: F.col("_prev").getField(n) for n in columns}).drop("_prev"))


def ranked(rows: Ordered, name: str = "rn") -> Ordered:
    """1-based position of each row inside its key."""
    return running(rows, sums={name: F.lit(1).cast("long")})


def trailing(rows: Ordered, before: int, exprs: dict[str, Callable]) -> DataFrame:
    """Aggregates over the current row and the ``before`` rows ahead of it.

    ``exprs`` maps names to functions window -> Column. On hot keys the rows are numbered and cut into
    blocks, and the last ``before`` rows of a block are repeated in front of the next block.
    """
    if not rows.hot:
        w = rows.window().rowsBetween(-before, 0)
        return rows.df.withColumns({n: f(w) for n, f in exprs.items()})
    size = max(before, slice_rows(rows.df.sparkSession))
    pos = ranked(rows, "_rn").df.withColumn("_rn", F.col("_rn") - 1)
    block = F.floor(F.col("_rn") / size)
    in_tail = F.col("_rn") % size >= size - before
    spread = pos.withColumn("_copies", F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block)))
    spread = spread.select("*", F.posexplode("_copies").alias("_halo", "_block"))
    w = Window.partitionBy(*rows.keys, "_block").orderBy("_rn").rowsBetween(-before, 0)
    out = spread.withColumns({n: f(w) for n, f in exprs.items()}).filter("_halo = 0")
    return out.drop(SLICE, "_rn", "_copies", "_halo", "_block")


Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, dict]]


def ordered_fold(rows: Ordered, step: Step, out: str) -> DataFrame:
    """Sequential fold per key whose result depends on earlier decisions.

    ``step(state, run)`` gets the state so far (``None`` at the start) and consecutive rows of one key
    and returns the new state (JSON-able tuple) and the new columns declared in the DDL ``out``.
    Rows stream through in Arrow batches, so a task holds one batch and one state, never a whole key.

    Hot keys are folded slice by slice in parallel from guessed entry states; the exit states give
    better guesses and only slices whose entry changed are folded again, until nothing changes. The
    first slice starts right, so every round fixes at least one more slice, and the fixed point is
    exactly the sequential result. Only one small state per slice reaches the driver.
    """
    source = rows.df
    keys = list(rows.keys)
    extra = T.StructType.fromDDL(out)
    if not rows.hot:
        return _fold_pass(source, keys, list(rows.order), step, extra, None)
    entry: dict[tuple, str | None] = {}
    source = settle(source)
    multi = source.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    slices: dict[tuple, list[int]] = {}
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    for r in multi.withColumn("_top", F.max(SLICE).over(per_key)).filter("_top > 0").collect():
        slices.setdefault(tuple(r[k] for k in keys), []).append(r[SLICE])
    todo = [(k, s) for k, ss in slices.items() for s in ss]
    exits: dict[tuple, str | None] = {}
    while todo:
        table = [(*k, s, entry.get((k, s))) for k, s in todo]
        part = _attach_entry(source, keys, table, "inner")
        for r in _fold_pass(part, keys, list(rows.order), step, extra, "states").collect():
            exits[(tuple(r[k] for k in keys), r[SLICE])] = r["_exit"]
        todo = []
        for k, ss in slices.items():
            ss = sorted(ss)
            for before, after in zip(ss, ss[1:]):
                if entry.get((k, after)) != exits.get((k, before)):
                    entry[(k, after)] = exits[(k, before)]
                    todo.append((k, after))
    table = [(*k, s, entry.get((k, s))) for k, ss in slices.items() for s in ss]
    final = _attach_entry(source, keys, table, "left")
    return _fold_pass(final, keys, list(rows.order), step, extra, "rows")


def _attach_entry(source: DataFrame, keys: list[str], table: list[tuple], how: str) -> DataFrame:
    schema = T.StructType(
        [
            *[source.schema[k] for k in keys],
            T.StructField("_hot_slice", T.IntegerType()),
            T.StructField("_entry", T.StringType()),
        ]
    )
    # one row per slice of a hot key: bounded by 2 * MAX_SLICES
    small = source.sparkSession.createDataFrame(table, schema)
    small = _aliased(small, keys, extra=["_hot_slice", "_entry"])
    cond = _same(source, keys) & (source[SLICE] == F.col("_hot_slice"))
    return source.join(F.broadcast(small), cond, how).select(*[source[c] for c in source.columns], "_entry")


def _fold_pass(df: DataFrame, keys: list[str], order: list[str], step: Step, extra: T.StructType, mode: str | None) -> DataFrame:
    part = [*keys, SLICE] if mode else keys
    if part:
        placed = df.repartition(*part).sortWithinPartitions(*part, *sort_columns(order))
    else:
        placed = df.coalesce(1).sortWithinPartitions(*sort_columns(order))
    keep = [f for f in df.schema.fields if f.name not in (SLICE, "_entry")]
    names = [f.name for f in extra.fields]
    if mode == "states":
        schema = T.StructType([*[df.schema[p] for p in part], T.StructField("_exit", T.StringType())])
    else:
        schema = T.StructType([*keep, *extra.fields])

    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    added = to_arrow_schema(extra)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: tuple | None = None
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = step_frame(batch, zone)
            keyed = frame[part].astype(object)
            if part:
                earlier = keyed.shift()
                changed = (keyed != earlier) & ~(keyed.isna() & earlier.isna())
                starts = [0, *[i for i in changed.any(axis=1).to_numpy().nonzero()[0] if i > 0]]
            else:
                starts = [0]
            pieces: dict[str, list] = {n: [] for n in names}
            finished = []
            for a, b in zip(starts, [*starts[1:], len(frame)]):
                run = frame.iloc[a:b]
                key = tuple(None if pd.isna(v) else v for v in keyed.iloc[a]) if part else ()
                if not seen or key != current:
                    if seen and mode == "states":
                        finished.append((*current, _dump(state)))
                    current, seen = key, True
                    given = run["_entry"].iloc[0] if mode else None
                    state = tuple(json.loads(given)) if isinstance(given, str) else None
                state, cols = step(state, run)
                for n in names:
                    pieces[n].extend(cols[n])
            if mode == "states":
                if finished:
                    yield _exits(finished, batch.schema)
                last = batch.schema
            else:
                # rows pass through as Arrow; only what the step made is new
                new = [pa.array(pieces[f.name], f.type, from_pandas=True) for f in added]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *new], names=[*(f.name for f in keep), *names])
        if mode == "states" and seen:
            yield _exits([(*current, _dump(state))], last)

    def _exits(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        types = [*(like.field(p).type for p in part), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*part, "_exit"])

    return placed.mapInArrow(fold, schema)


def step_frame(batch: pa.RecordBatch, zone: str) -> pd.DataFrame:
    """Rows as a step sees them: integers stay exact where some are NULL (objects with None, not floats)."""
    frame = batch.to_pandas(integer_object_nulls=True, date_as_object=True)
    for name, kind in frame.dtypes.items():
        if isinstance(kind, pd.DatetimeTZDtype):
            frame[name] = frame[name].dt.tz_convert(zone).dt.tz_localize(None)
    return frame


def _dump(state: tuple | None) -> str | None:
    return None if state is None else json.dumps([v.item() if hasattr(v, "item") else v for v in state])

"""Ranking, suppression, segmentation and retention windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.operators.ordered import Ordered, null_safe_join, order_rows, ordered_fold, ranked, running, trailing
from marktrace.session import settle


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. The rank filter is pushed below the shuffle, so each task sends
    at most ``k`` rows per key however large the key is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def candidate_submission(df: DataFrame, keys: Sequence[str], quality: str, tie: str, keep: int = 10, submit: int = 3, min_hits: int = 2, min_quality: float = 0.45) -> DataFrame:
    """W6 with gates: keep the best ``keep`` candidates of an event; submit the best ``submit`` of them
    when the event has enough confirmations and its best candidate is good enough."""
    best = top_k(df, keys, [F.col(quality).desc(), F.col(tie)], keep)
    gate = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("confirmations"), F.max(quality).alias("best_quality"))
    passed = (F.col("confirmations") >= min_hits) & (F.col("best_quality") >= min_quality)
    return best.join(gate, list(keys)).withColumn("submitted", passed & (F.col("rank") <= submit))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as a partial aggregate, one row per key and task leaves the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key wins and locks the key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def expire(df: DataFrame, ts: str, now: Column, ttl_ms: int) -> DataFrame:
    """Drop rows older than the time to live."""
    return df.filter(F.col(ts) >= now - ttl_ms)


def repeat_step(value: str, session: str, ts: str, window_ms: int):
    """Fold step of W8, shared by the batch and the streaming form."""

    def step(state, run):
        flags = np.zeros(len(run), bool)
        for i, (v, s, t) in enumerate(zip(run[value], run[session], run[ts])):
            if state is not None and state[0] == v and state[1] == s and t - state[2] < window_ms:
                flags[i] = True
            else:
                state = (v, s, t)
        return state, {"is_repeat": flags}

    return step


def queue_admission(rows: Ordered, arrival: str, capacity: int) -> DataFrame:
    """ST9: bounded queue. Arrivals beyond the capacity are dropped and marked; other rows are departures."""

    def step(state, run):
        length = state[0] if state else 0
        out, sizes = [], []
        for is_in in run[arrival]:
            if is_in:
                out.append("ADMITTED" if length < capacity else "DROPPED")
                length += out[-1] == "ADMITTED"
            else:
                out.append("SERVED" if length else "IDLE")
                length -= out[-1] == "SERVED"
            sizes.append(int(length))
        return (int(length),), {"outcome": out, "queue_length": sizes}

    return ordered_fold(rows, step, "outcome string, queue_length int").drop("_slice")


def repeat_suppression(rows: Ordered, value: str, session: str, window_ms: int = 90_000) -> DataFrame:
    """A row repeats when value and session equal the remembered ones and it is less than the window
    after the last kept row. A repeat does not refresh the memory; any other row replaces it."""
    step = repeat_step(value, session, rows.order[0], window_ms)
    return ordered_fold(rows, step, "is_repeat boolean").drop("_slice")


def presence_segments(rows: Ordered, present: Column, empties: int = 3) -> DataFrame:
    """Presence events; an event ends when ``empties`` empty frames follow each other."""
    ts = rows.order[0]
    rows = rows.with_df(rows.df.withColumn("_on", present.cast("int")))
    on = F.col("_on") == 1
    rows = running(rows, sums={"_gone": (1 - F.col("_on")).cast("long")}).settle()
    rows = running(rows, maxes={"_gone0": F.when(on, F.col("_gone"))}, exclusive=True)
    gap = F.col("_gone") - F.col("_gone0")
    rows = rows.with_df(
        rows.df.withColumns(
            {
                "_opens": (on & (F.col("_gone0").isNull() | (gap >= empties))).cast("long"),
                "_closes": ~on & (gap == empties),
            }
        )
    ).settle()
    rows = running(rows, sums={"segment": F.col("_opens")})
    inside = rows.df.filter((F.col("segment") > 0) & (on | F.col("_closes")))
    return inside.groupBy(*rows.keys, "segment").agg(
        F.min(F.when(on, F.col(ts))).alias("opened_ms"),
        F.max(F.when(on, F.col(ts))).alias("last_seen_ms"),
        F.count_if(on).alias("frames"),
        F.min(F.when(F.col("_closes"), F.col(ts))).alias("closed_ms"),
    )


def failure_streaks(rows: Ordered, failed: Column) -> DataFrame:
    """Maximal runs of consecutive failures per key."""
    ts = rows.order[0]
    rows = rows.with_df(rows.df.withColumn("_bad", failed))
    rows = running(rows, sums={"_good": (~F.col("_bad")).cast("long")})
    return (
        rows.df.filter("_bad")
        .groupBy(*rows.keys, "_good")
        .agg(F.count(F.lit(1)).alias("streak"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))
        .drop("_good")
    )


def streak_summary(streaks: DataFrame, keys: Sequence[str], warn: int, stop: int) -> DataFrame:
    return streaks.groupBy(*keys).agg(
        F.max("streak").alias("longest"),
        F.count_if(F.col("streak") >= warn).alias("warn_streaks"),
        F.count_if(F.col("streak") >= stop).alias("stop_streaks"),
    )


def review_rank(df: DataFrame, character: Column, priority: Sequence[str], confidence: str, tie: str, unknown: int = 99) -> DataFrame:
    """Global review position by class priority, then confidence descending. Unknown class last."""
    place = F.array_position(F.array(*[F.lit(c) for c in priority]), F.coalesce(character, F.lit("")))
    rated = df.withColumns(
        {
            "class_rank": F.when(place == 0, F.lit(unknown)).otherwise(place.cast("int") - 1),
            "_slot": F.lit(0.0),
        }
    )
    # a number that never decreases along (class_rank, -confidence) lets one class span many slices: confidences
    # of any size are drawn into (-1, 1) without changing their order; NaN sorts above, NULL below all others
    value = F.col(confidence).cast("double")
    drawn = F.when(F.isnan(value), 1.5).when(F.abs(value) == float("inf"), F.signum(value)).otherwise(value / (1 + F.abs(value)))
    rated = rated.withColumn("_slot", F.col("class_rank") * 4.0 - F.coalesce(drawn, F.lit(-1.5)))
    rows = order_rows(rated, [], ["class_rank", f"-{confidence}", tie], slice_on="_slot")
    return ranked(rows, "position").plain().drop("_slot")


def interleave(rows: Ordered, group: str, total: int) -> DataFrame:
    """Round-robin over the groups, first ``total`` items of the interleaved order."""
    return ranked(rows, "depth").plain().orderBy("depth", group).limit(total)


def retention_marks(files: DataFrame, keys: Sequence[str], now_ms: Column, max_age_ms: int, max_bytes: int, grace_ms: int) -> DataFrame:
    """What to delete. Old files go unless they are inside the grace window; then the oldest
    unprotected files go until the rest fits. A limit of 0 switches that rule off.

    Protected files are the newest ones, so one newest-first running size gives the bytes left when a
    file's turn comes, without a global total.
    """
    age = now_ms - F.col("mtime_ms")
    marked = files.withColumns({"protected": age < grace_ms, "_neg": -F.col("mtime_ms")})
    too_old = (age > max_age_ms) & ~F.col("protected") if max_age_ms > 0 else F.lit(False)
    marked = marked.withColumn("by_age", too_old)
    rows = order_rows(marked, keys, ["_neg", "-path"])
    rows = running(rows, sums={"bytes_at_turn": F.when(~F.col("by_age"), F.col("size")).otherwise(0).cast("long")})
    over = F.col("bytes_at_turn") > max_bytes if max_bytes > 0 else F.lit(False)
    out = rows.plain().drop("_neg")
    return out.withColumn("by_size", ~F.col("by_age") & ~F.col("protected") & over)


def keep_newest(rows: Ordered, keep: int) -> DataFrame:
    """Rows beyond the newest ``keep`` of each key (order given newest first)."""
    return ranked(rows, "age_rank").plain().filter(F.col("age_rank") > keep)


class Shares:
    """Split sizes wanted, and which split each of many groups of one size goes to, without taking them one by one.

    A group goes to the split furthest below its share (of equals the first). With equal sizes that takes the
    numbers ``want - (filled + k * n)`` of all splits in descending order, so the place of any of them in
    that order is a count, and what the r-th group gets is found by bisection.
    """

    def __init__(self, want: np.ndarray):
        self.want = want

    def _below(self, i: int, filled: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.want[i] - (filled[i] + k * n)

    def _place(self, j: int, filled: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many picks come before the ``k``-th of split ``j``."""
        value, place = self._below(j, filled, n, k), k.copy()
        for i in range(len(self.want)):
            if i != j:
                # one below the quotient to be safe against rounding, then counted up exactly
                c = np.maximum(np.floor((self.want[i] - filled[i] - value) / n).astype(np.int64) - 1, 0)
                for _ in range(3):
                    own = self._below(i, filled, n, c)
                    c += (own > value) | ((own == value) & (i < j))
                place += c
        return place

    def first(self, j: int, filled: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Smallest k whose place is ``rank`` or later: how many of the first ``rank`` groups split ``j`` gets."""
        low, high = np.zeros_like(rank), rank.copy()
        while (low < high).any():
            middle = (low + high) // 2
            enough = self._place(j, filled, n, middle) >= rank
            low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
        return low

    def picked(self, filled: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Split of the ``rank``-th group (from 0) of its run; ``filled`` has one row per split."""
        out = np.zeros(len(rank), dtype=np.int64)
        for j in range(len(self.want)):
            k = self.first(j, filled, n, rank)
            out[self._place(j, filled, n, k) == rank] = j
        return out


def range_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row in its key, along columns of any type.

    Rows are range-partitioned by key and order, so a hot key lies in many partitions; each numbers its own rows
    and is moved up by the counts of the key's earlier partitions.
    """
    laid = settle(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    numbered = null_safe_join(laid.withColumn("_own", own), before, [*keys, "_part"])
    return numbered.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).select(*df.columns, name)


def group_split(df: DataFrame, group: str, fractions: dict[str, float]) -> DataFrame:
    """Whole groups go to splits, largest group first, each to the split furthest below its share.

    Groups of one size form a run. Only runs are folded, one small row each and never more than the square
    root of twice the items; inside a run every group's split follows from its rank, in parallel.
    """
    sizes = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    names = list(fractions)
    shares = Shares(np.array([fractions[n] for n in names]) * total)

    def step(state, run):
        filled = np.array(state if state else [0] * len(names), dtype="int64")
        starts = []
        for n, groups in zip(run["n"], run["groups"]):
            starts.append(filled.tolist())
            column, size, m = filled[:, None], np.array([n]), np.array([groups])
            filled = filled + n * np.array([shares.first(j, column, size, m)[0] for j in range(len(names))])
        return tuple(int(v) for v in filled), {"filled": starts}

    runs = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).withColumn("_neg", -F.col("n"))
    opened = ordered_fold(order_rows(runs, [], ["_neg"]), step, "filled array<bigint>").select("n", "filled")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                filled = batch.column("filled").flatten().to_numpy().reshape(-1, len(names)).T
                split = shares.picked(filled, batch.column("n").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("n"), pa.array([names[i] for i in split])], names=[group, "n", "split"])

    placed = range_ranked(sizes, ["n"], [group]).join(opened, "n").select(group, "n", "rank", "filled")
    return placed.mapInArrow(assign, T.StructType([sizes.schema[group], sizes.schema["n"], T.StructField("split", T.StringType())]))


def _absent(value) -> bool:
    return value is None or value != value


def retry_admission(rows: Ordered, min_remaining: float = 0.75, gain: float = 0.05) -> DataFrame:
    """Admit an attempt that is the first, brings new evidence or clearly better quality.

    Columns: signature, quality, remaining_sec (nullable), exited. State: signature, quality, terminal reason, whether an attempt was admitted.
    A NULL signature is a signature like any other; a NULL quality never counts as better.
    """

    def step(state, run):
        sig, best, ended, begun = state if state else (None, None, None, False)
        started = state is not None
        allowed, reasons = [], []
        for s, q, rem, out in zip(run["signature"], run["quality"], run["remaining_sec"], run["exited"]):
            ok = False
            if out:
                ended = reason = "EXITED"
            elif rem is not None and rem == rem and rem < min_remaining:
                ended = reason = "INSUFFICIENT_DEADLINE"
            elif not begun and ended is None:
                ok, reason, sig, best, begun = True, "RETRY_ALLOWED", s, q, True
            elif ended is not None:
                reason = ended
            elif not (_absent(s) and _absent(sig)) and s != sig:
                ok, reason, sig, best = True, "NEW_EVIDENCE", s, q
            elif not _absent(q) and (_absent(best) or q >= best + gain):
                ok, reason, best = True, "IMPROVED_QUALITY", q
            else:
                reason = "STABLE_AMBIGUITY"
            started = True
            allowed.append(ok)
            reasons.append(reason)
        return ((sig, best, ended, begun) if started else None), {"allowed": allowed, "reason": reasons}

    return ordered_fold(rows, step, "allowed boolean, reason string").drop("_slice")


def rolling_mean(rows: Ordered, value: str, last_n: int, name: str = "rolling_mean") -> DataFrame:
    """Mean of the current and the previous ``last_n - 1`` values."""
    return trailing(rows, last_n - 1, {name: lambda w: F.avg(value).over(w)})


def asof_owner(points: DataFrame, starts: DataFrame, keys: Sequence[str], ts: str, start: str, owner: Sequence[str], tie: str) -> DataFrame:
    """For each point, the latest interval start at or before it (columns ``owner`` of ``starts``).

    Union of both sides on one time line plus a running last value: linear, no pairs, no range join.
    """
    left = points.withColumns({"_t": F.col(ts), "_side": F.lit(1), "_tie": F.col(tie).cast("long"), "_own": F.lit(None)})
    box = F.struct(F.col(start).alias(start), *owner)
    right = starts.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"), box.alias("_own"))
    line = left.drop("_own").unionByName(right, allowMissingColumns=True)
    rows = order_rows(line, keys, ["_t", "_side", "_tie"])
    rows = running(rows, lasts={"_found": F.col("_own")})
    out = rows.plain().filter("_side = 1")
    names = [start, *owner]
    return out.select(*points.columns, *[F.col("_found").getField(n).alias(n) for n in names])


__all__ = [n for n in dir() if not n.startswith("_")]

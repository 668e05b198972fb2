"""Mixing sources to target weights: nested hash thresholds found from histograms, expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marktrace.llm.common import discard, stored, whole_text

WEIGHTS, SHARE, MOST, TOLERANCE = (3, 1, 2), 1.5, 2, 0.001
#: runs of characters other than blank and tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"
NO_CAP = 2**63 - 1
#: the place of a row is its 60-bit key and then its row number; each digit is one histogram of at most 4,096 buckets a source
DIGITS = [("k", s) for s in (48, 36, 24, 12, 0)] + [("row", s) for s in (51, 39, 27, 15, 3, 0)]
RESULT = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def place_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of a row's id and text, so a rerun draws the same rows."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 15), 16, 10).cast("long")


def source_sizes(rows: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``source, source_size, weight`` with weights dealt in turn along the sources by code point, null last.

    Sources are range-partitioned, numbered inside their partition and moved up by the partitions before.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    laid = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = laid.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    numbered = laid.withColumn("turn", turn).join(before, F.col("part") == F.col("_part"))
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("turn") + F.col("before") - 1) % len(weights) + 1).cast("int"))
    return numbered.select("source", "source_size", dealt.alias("weight"))


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` with ``target``: shares by weight of ``share`` times all sizes, none above ``most`` times its source.

    What is above is shared again by weight among the others until none is above; each step is one aggregate.
    """
    whole, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, seen = share * (whole or 0), 0.0, None
    if weight:
        level = total / weight
    while seen is None or weight:
        full = most * F.col("source_size") < F.lit(level) * F.col("weight")
        stopped, weight = sources.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if (stopped, weight) == seen or not weight:
            break
        seen, level = (stopped, weight), (total - most * stopped) / weight
    bound = (F.lit(most) * F.col("source_size")).cast("double")
    return sources.withColumn("target", F.least(bound, F.lit(level) * F.col("weight")) if weight else bound)


def _edges(rows: DataFrame, bucket: Column) -> DataFrame:
    """Per source the first bucket whose mass no longer fits the residual, and the residual in front of it."""
    state = ("residual", "cap", "tol", "from_k", "from_row")
    mass = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("mass"), F.count("*").alias("n"), F.min(F.struct("k", "row")).alias("first"), *[F.first(c).alias(c) for c in state])
    upto = F.sum("mass").over(Window.partitionBy("source").orderBy("bucket"))
    over = mass.withColumn("upto", upto).where("upto > residual")
    one = over.groupBy("source").agg(F.min(F.struct("bucket", "n", (F.col("residual") - F.col("upto") + F.col("mass")).alias("left"), "first", *[s for s in state if s != "residual"])).alias("e"))
    return one.select("source", "e.*")


def _segments(slim: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: every live source takes rows in place order up to the first that does not fit.

    Returns the segments ``source, cap, from_k, from_row, to_k, to_row`` (no end: all rest is taken) and the
    state of the sources that met such a row.
    """
    state = live.withColumnRenamed("source", "_source")
    after = (F.col("k") > F.col("from_k")) | ((F.col("k") == F.col("from_k")) & (F.col("row") > F.col("from_row")))
    joined = slim.join(state, slim["source"].eqNullSafe(state["_source"])).where((F.col("size") > 0) & (F.col("size") <= F.col("cap")) & after)
    rows = joined.select("source", "size", "k", "row", "residual", "cap", "tol", "from_k", "from_row")
    met: DataFrame | None = None
    held: list[DataFrame] = []
    for column, shift in DIGITS:
        edge = stored(_edges(rows, F.shiftright(column, shift)), "mix-edges")
        alone = edge.where("n = 1")
        met = alone if met is None else met.unionByName(alone)
        deep = edge.where("n > 1")
        if deep.isEmpty():
            break
        # only the boundary bucket is read on
        inside = deep.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.col("left").alias("_left"))
        next_rows = rows.join(inside, rows["source"].eqNullSafe(inside["_source"]) & (F.shiftright(column, shift) == inside["_bucket"]))
        rows = stored(next_rows.select("source", "size", "k", "row", F.col("_left").alias("residual"), "cap", "tol", "from_k", "from_row"), "mix-boundary")
        held.append(rows)
    ends = met.select(F.col("source").alias("_source"), F.col("left"), F.col("first.k").alias("to_k"), F.col("first.row").alias("to_row"))
    round_ = stored(live.join(ends, live["source"].eqNullSafe(ends["_source"]), "left").drop("_source"), "mix-round")
    for table in held:
        discard(table)
    after_row = round_.where("to_k IS NOT NULL AND left > tol").select("source", F.col("left").alias("residual"), F.col("left").alias("cap"), "tol", F.col("to_k").alias("from_k"), F.col("to_row").alias("from_row"))
    return round_.select("source", "cap", "from_k", "from_row", "to_k", "to_row"), after_row


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, tolerance: float = TOLERANCE, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the columns ``carry``, one row per row of ``docs``.

    ``size`` counts the runs of non-blanks of the whole text (null: 0). Sources by code point, null last, get
    ``weights`` in turn and share ``share`` times all sizes; none gets more than ``most`` times its own size.
    Each row is taken a whole number of times, ``copies``, at most ``most``; ``taken`` is that times its size.
    A source's rows are all taken as often as its target holds all of them. For one more copy rows are taken
    by hash up to a threshold: sizes are summed by source and hash bucket, the bucket that the budget ends in
    is refined alone until it holds one row, and that row is left out. While more than ``tolerance`` of the
    target is missing, a further threshold is found behind that row for rows that still fit, so a source ends
    within the tolerance or where no more row fits. Rows are filtered by these thresholds, never sorted.

    The hash is of id and text: reruns agree, whatever the partitions. Rows equal in both are told apart by
    their number in the stored table, so any number of copies is split exactly (which of them is taken may
    change, not how many). An empty table gives an empty result; sources without words have target 0. Very
    long texts are one row each and taken whole. Other columns, of whatever names, are not read; those
    in ``carry`` must not be named like a result column.
    """
    if clash := set(carry) & set(RESULT):
        raise ValueError(f"carried columns named like results: {sorted(clash)}")
    text = whole_text()
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        place_key(F.col("doc_id"), text).alias("k"), F.monotonically_increasing_id().alias("row"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    slim = stored(slim, "mix-rows")
    whole = F.floor(F.col("target") / F.col("source_size"))
    planned = targets(source_sizes(slim, weights), share, most).withColumn("base", F.when(F.col("source_size") > 0, whole).otherwise(0))
    planned = stored(planned, "mix-targets")
    rest = F.floor(F.col("target") - F.col("base") * F.col("source_size"))
    live = planned.select("source", rest.alias("residual"), F.lit(NO_CAP).alias("cap"), F.floor(F.col("target") * tolerance).alias("tol"), F.lit(-1).cast("long").alias("from_k"), F.lit(-1).cast("long").alias("from_row")).where("residual > tol")
    found: DataFrame | None = None
    while not live.isEmpty():
        segments, live = _segments(slim, live)
        found = segments if found is None else found.unionByName(segments)
    if found is None:
        found = live.select("source", "cap", "from_k", "from_row", F.lit(0).cast("long").alias("to_k"), F.lit(0).cast("long").alias("to_row"))
    nested = found.groupBy("source").agg(F.collect_list(F.struct("cap", "from_k", "from_row", "to_k", "to_row")).alias("segments")).withColumnRenamed("source", "_segmented")
    plan = planned.join(nested, planned["source"].eqNullSafe(nested["_segmented"]), "left").select(F.col("source").alias("_source"), "source_size", "target", "base", "segments")
    plan = stored(plan, "mix-plan")

    def chosen(s: Column) -> Column:
        after = (F.col("k") > s["from_k"]) | ((F.col("k") == s["from_k"]) & (F.col("row") > s["from_row"]))
        before = s["to_k"].isNull() | (F.col("k") < s["to_k"]) | ((F.col("k") == s["to_k"]) & (F.col("row") < s["to_row"]))
        return (F.col("size") <= s["cap"]) & after & before

    extra = F.when(F.col("segments").isNotNull() & F.exists("segments", chosen), 1).otherwise(0)
    mixed = slim.join(plan, slim["source"].eqNullSafe(plan["_source"])).withColumn("copies", (F.col("base") + extra).cast("int"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *[F.col("carried")[c].alias(c) for c in carry])

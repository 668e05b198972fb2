"""Engine disagreement audit and near-duplicate grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marktrace.operators.fusion import once
from marktrace.operators.joins import TASK_ROWS, skew_join
from marktrace.session import settle


def disagreement_audit(rows: DataFrame, keys: Sequence[str], engines: Sequence[str], raw: str, final: str, pairs: Sequence[tuple[str, str]], weak: str = "") -> DataFrame:
    """H4: rows (position, reasons, weak) where engines, raw and final text differ. Positions are 0-based.

    One row per session in, so every list here is as long as an identifier.
    """
    texts = [*engines, raw, final]
    longest = F.greatest(*[F.length(F.coalesce(F.col(t), F.lit(""))) for t in texts])
    sized = rows.select(*keys, *texts, longest.alias("_n"))
    # a small file becomes many positions: its rows are dealt out by the number of these
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    sized = sized.repartition(max(least, math.ceil(total / TASK_ROWS)), *keys)
    at = sized.filter("_n > 0").select(*keys, *texts, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("position"))
    ch = lambda t: F.nullif(F.substr(F.coalesce(F.col(t), F.lit("")), F.col("position") + 1, F.lit(1)), F.lit(""))
    some = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    read = F.struct(ch(raw).alias("r"), ch(final).alias("f"), F.array_distinct(some([ch(e) for e in engines])).alias("seen"))
    at = once(at, read, "_c").select(*keys, "position", "_c.*")
    r, f, seen = F.col("r"), F.col("f"), F.col("seen")
    pair_list = F.array(*[F.lit("".join(sorted(p))) for p in pairs])
    raw_final = r.isNotNull() & f.isNotNull() & (r != f)
    corrected = f.isNotNull() & (F.size(seen) > 0) & ~F.array_contains(seen, f)
    both = lambda a, b: F.array_contains(seen, a) & F.array_contains(seen, b)
    tags = [
        F.when(raw_final, "RAW_FINAL_DISAGREEMENT"),
        F.when(raw_final & F.array_contains(pair_list, F.concat(F.least(r, f), F.greatest(r, f))), F.concat(F.lit("CONFUSABLE_"), r, F.lit("_"), f)),
        F.when(F.size(seen) > 1, "ENGINE_DISAGREEMENT"),
        F.when(corrected, "VALIDATOR_CHANGED_CHARACTER"),
        *[F.when(both(a, b), f"CONFUSABLE_{a}_{b}") for a, b in map(sorted, pairs) if a != b],
    ]
    is_weak = F.contains(F.lit(weak), f) | F.contains(F.lit(weak), r) if weak else F.lit(False)
    # the other reasons come with one of these three, so no list is made only to be found empty
    found = at.filter(raw_final | (F.size(seen) > 1) | corrected)
    return found.select(*keys, "position", F.sort_array(F.array_distinct(some(tags))).alias("reasons"), F.coalesce(is_weak, F.lit(False)).alias("weak"))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """G2-like key: sign bits of the first ``bits`` components as one long."""
    head = F.slice(vector, 1, bits)
    return F.aggregate(
        F.transform(head, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )


#: edges that one task may finish in order once so few are left
TASK_EDGES = 200_000


def hamming_pairs(nodes: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """``keys, a, b``: nodes(keys, id, h) of a key whose 64-bit hashes differ in at most ``distance`` bits, a before b.

    Pigeonhole: of ``distance + 1`` bands of the bits at least one is equal, so bands are an equi-join index;
    a pair is taken in the first band it shares. Hot bands are salted, and every candidate is counted in place.
    """
    bands, width = distance + 1, -(-64 // (distance + 1))
    part = lambda h, i: F.shiftrightunsigned(F.shiftleft(h, max(0, 64 - width * (i + 1))), 64 - width if width * (i + 1) <= 64 else width * i)
    values = lambda h: F.array(*[part(h, i) for i in range(bands)])
    placed = nodes.select(*keys, "id", "h", F.posexplode(values(F.col("h"))).alias("_band", "_value"))
    other = placed.select(*keys, "_band", "_value", F.col("id").alias("b"), F.col("h").alias("_h"))
    met = skew_join(placed, other, [*keys, "_band", "_value"], "inner").filter(F.col("id") < F.col("b"))
    differ = F.col("h").bitwiseXOR(F.col("_h"))
    near = met.filter(F.bit_count(differ) <= distance)
    first = F.array_position(F.zip_with(values(F.col("h")), values(F.col("_h")), lambda x, y: x == y), F.lit(True)) - 1
    return near.filter(first == F.col("_band")).select(*keys, F.col("id").alias("a"), "b")


def greedy_members(pairs: DataFrame, keys: Sequence[str], task_edges: int = TASK_EDGES) -> DataFrame:
    """``keys, b``: the nodes that an earlier representative takes, of ``pairs(keys, a, b)`` with a before b.

    A node is a representative if none of its earlier neighbours is one. Rounds decide all nodes in parallel
    whose earlier neighbours are decided: those without any are representatives, their later neighbours are
    taken, and both leave. What is left is finished in order by one task once it is ``task_edges`` or fewer.
    """
    spark, schema = pairs.sparkSession, T.StructType([pairs.schema[k] for k in keys] + [pairs.schema["b"]])
    left, taken = settle(pairs), []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("b", "a", *keys)), strict=True)), key=lambda r: r[:2])
        lost: dict = {}
        for b, a, *key in held:
            if (*key, a) not in lost:
                lost[(*key, b)] = None
        columns = zip(*lost, strict=True) if lost else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, to_arrow_schema(schema), strict=True)], names=schema.names)

    while (n := left.count()) > task_edges:
        later = left.select(*keys, F.col("b").alias("a")).distinct()
        heads = left.select(*keys, "a").distinct().join(later, [*keys, "a"], "left_anti")
        knocked = settle(left.join(heads, [*keys, "a"]).select(*keys, "b").distinct())
        taken.append(knocked)
        gone = knocked.withColumnRenamed("b", "a").unionByName(heads)
        left = settle(left.join(knocked, [*keys, "b"], "left_anti").join(gone, [*keys, "a"], "left_anti").select(*pairs.columns))
    if n:
        taken.append(left.coalesce(1).mapInArrow(finish, schema))
    out = spark.createDataFrame([], schema)
    for more in taken:
        out = out.unionByName(more)
    return out


def near_duplicate_groups(rows: DataFrame, keys: Sequence[str], digest: str, ident: str, distance: int = 5, task_edges: int = TASK_EDGES) -> DataFrame:
    """``rows`` with ``representative``: by ``ident`` in order, the first representative within the Hamming
    distance of the 64-bit ``digest``, else the row itself. A row without a hash is its own group.

    Equal hashes share their fate, so each is one node first. No list of representatives is kept anywhere.
    """
    hashed = rows.filter(F.col(digest).isNotNull())
    nodes = settle(hashed.groupBy(*keys, F.col(digest).alias("h")).agg(F.min(ident).alias("id")))
    pairs = settle(hamming_pairs(nodes, keys, distance))
    taken = settle(greedy_members(pairs, keys, task_edges))
    owners = pairs.join(taken, [*keys, "b"]).join(taken.withColumnRenamed("b", "a"), [*keys, "a"], "left_anti")
    owner = owners.groupBy(*keys, "b").agg(F.min("a").alias("_owner")).withColumnRenamed("b", "id")
    placed = nodes.join(owner, [*keys, "id"], "left").select(*keys, F.col("h").alias(digest), F.coalesce("_owner", "id").alias("_owner"))
    found = skew_join(rows, placed, [*keys, digest], "left")
    return found.withColumn("representative", F.coalesce("_owner", ident)).select(*rows.columns, "representative")


__all__ = [n for n in dir() if not n.startswith("_")]

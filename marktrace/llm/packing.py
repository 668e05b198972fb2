"""Best-fit packing of token pieces by hierarchical residual packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.llm.common import frugal, portions, stored, whole_text
from marktrace.llm.tokens import TokenIds, loaded

#: items packed together by one task
TASK_ITEMS = 100_000
#: bytes of text cut at once: the more, the fewer distinct pieces are looked up for each byte
CUT_BYTES = 2_000_000


def token_pieces(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32``.

    A document is its token ids followed by ``end_id``; only longer ones are cut. A null text is empty and
    gives one piece holding the end id. Every input row gives its own pieces, repeated ids included.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(TokenIds, name)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            owner: list[int] = []
            rows: list[tuple[int, int, int, int]] = []
            for part, texts in portions(batch.column("text"), CUT_BYTES):
                for at, ids in enumerate(tokens.ids(texts), part.start):
                    ids = np.concatenate([ids.astype("<u4", copy=False), end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((k, start, len(piece), zlib.crc32(piece)))
                        owner.append(at)
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return slim.mapInArrow(frugal(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest items first, each into the open bin it fills best."""
    bins = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r: some bin has room r
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
        bins[i] = b
    return bins


def pack_table(table: pa.Table, capacity: int, slack: int) -> pa.RecordBatch:
    """Pack the bins of ``table`` (fill, members) into fewer, with members laid end to end."""
    fill = table.column("fill").to_numpy()
    bins = best_fit(fill, capacity)
    order = np.argsort(bins, kind="stable")
    lists = table.column("members").combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values
    sizes = np.diff(offsets)[order]
    ends = np.cumsum(sizes)
    taken = np.repeat(offsets[:-1][order] - ends + sizes, sizes) + np.arange(ends[-1])
    count = bins.max() + 1
    total = np.bincount(bins, weights=fill, minlength=count).astype(np.int64)
    members = np.bincount(bins[order], weights=sizes, minlength=count).astype(np.int32)
    bounds = np.append(0, np.cumsum(members))
    values = values.take(pa.array(taken))
    size = values.field("size").to_numpy()
    before = np.cumsum(size) - size
    places = before - np.repeat(before[bounds[:-1]], members)
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (values, pa.array(places))]
    return pa.RecordBatch.from_arrays([pa.array(total), pa.array(total >= capacity - slack), *lists], names=["fill", "closed", "members", "places"])


def pack_best_fit(items: DataFrame, capacity: int = 2048, slack: int = 2, task_items: int = TASK_ITEMS) -> DataFrame:
    """``items`` with a column ``length`` (1 to ``capacity``), plus ``sequence_id`` and ``offset``.

    Round 0 packs within each partition. Bins with at most ``slack`` free places are final; the others are
    items of the next round, which has as many tasks as ``task_items`` asks for, down to one. Where several
    tasks remain and a round joins nothing, the bins are final. No task holds more than ``task_items`` items
    at once. Item columns are carried as they are; an item column called sequence_id or offset is replaced.
    """
    payload = T.StructType([f for f in items.schema.fields if f.name not in ("sequence_id", "offset")])
    member = T.StructType([T.StructField("item", payload), T.StructField("size", T.LongType())])
    schema = T.StructType([T.StructField("fill", T.LongType()), T.StructField("closed", T.BooleanType()), T.StructField("members", T.ArrayType(member)), T.StructField("places", T.ArrayType(T.LongType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, task_items - rows), batch.slice(min(task_items - rows, batch.num_rows))
                held.append(part)
                rows += part.num_rows
                if rows == task_items:
                    yield pack_table(pa.Table.from_batches(held), capacity, slack)
                    held, rows = [], 0
        if rows:
            yield pack_table(pa.Table.from_batches(held), capacity, slack)

    single = F.struct(F.struct(*payload.names).alias("item"), F.col("length").cast("long").alias("size"))
    now = items.select(F.col("length").cast("long").alias("fill"), F.array(single).alias("members"))
    final: list[DataFrame] = []
    left, tasks, turn = None, None, 0
    while True:
        packed = stored(now.mapInArrow(pack, schema), f"packing-{turn}")
        final.append(packed.where("closed"))
        under = packed.where("NOT closed").select("fill", "members")
        n = under.count()
        # a round of one task has compared all; without progress further rounds would not join anything either
        if n == 0 or tasks == 1 and n <= task_items or tasks is not None and n == left:
            final.append(packed.where("NOT closed"))
            break
        left, tasks, turn = n, -(-n // task_items), turn + 1
        now = under.repartition(tasks) if tasks > 1 else under.coalesce(1)
    bins = final[0]
    for more in final[1:]:
        bins = bins.union(more)
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), F.arrays_zip("members", "places").alias("m"))
    one = numbered.select("sequence_id", F.explode("m").alias("m"))
    return one.select(*(F.col(f"m.members.item.`{c}`").alias(c) for c in payload.names), "sequence_id", F.col("m.places").alias("offset"))


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """Pieces of every whole text packed into sequences of at most ``capacity`` tokens."""
    pieces = stored(token_pieces(docs, name, capacity), "pieces")
    packed = pack_best_fit(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

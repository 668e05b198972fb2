"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import stored, whole_text
from marktrace.llm.words import BASE, BYTE_VALUE, mix, powers

#: bytes of a gram that windows are dealt by
GRAM = 20
#: bytes of text sorted together, and different stretches of one anchor beyond which windows are dealt singly
SORT_BYTES, ANCHOR_STRETCHES = 1_000_000, 2_000
#: window starts worked on at once within a long text
STARTS = 1 << 20


def difference_cover_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (symbols from 1 on).

    Difference cover of 3: triples at positions 1 and 2 modulo 3 are sorted and named; while names are not
    unique, their string is sorted by recursion; the remaining suffixes are sorted by their first symbol and
    the rank behind it, and merged. Symbols and positions must stay below 2**21, so that three fit into one
    integer.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, dtype=np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = (t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2]
    names, inverse = np.unique(triple, return_inverse=True)
    inverse = inverse + 1
    if len(names) == len(sample):
        by_rank = np.argsort(inverse)
    else:
        by_rank = difference_cover_order(inverse)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[by_rank]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    sa12 = sample[by_rank]
    sa12 = sa12[sa12 < n]
    zero = np.arange(0, n, 3)
    pair0 = (t[zero] << 21) | rank[zero + 1]
    order0 = np.argsort(pair0, kind="stable")
    sa0 = zero[order0]
    kind1, kind2 = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    less1 = np.searchsorted((t[kind1] << 21) | rank[kind1 + 1], pair0[order0])
    less2 = np.searchsorted((t[kind2] << 42) | (t[kind2 + 1] << 21) | rank[kind2 + 2], (t[sa0] << 42) | (t[sa0 + 1] << 21) | rank[sa0 + 2])
    place = np.arange(len(sa0)) + less1 + less2
    out = np.empty(n, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    taken[place] = True
    out[place], out[~taken] = sa0, sa12
    return out


def repeated_starts(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch, which of its ``length``-byte windows also start in another place of the stretches."""
    data = np.frombuffer(b"\0".join([*stretches, b""]), dtype=np.uint8)
    size = np.array([len(x) for x in stretches], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    valid = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + np.maximum(size - length + 1, 0), -1)
    valid = np.cumsum(valid)[:-1] > 0
    symbols = data.astype(np.int64) + 2
    symbols[begin + size] = 1  # ends of stretches
    order = difference_cover_order(symbols)
    word = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    eight = sum(word[k : k + len(data)] << np.uint64(8 * k) for k in range(8))
    near = np.flatnonzero(valid[order[:-1]] & valid[order[1:]])
    for k in [*range(0, length - 7, 8), length - 8]:
        near = near[eight[order[near] + k] == eight[order[near + 1] + k]]
    found = np.zeros(len(data), dtype=bool)
    found[order[near]] = found[order[near + 1]] = True
    return [found[b : b + n - length + 1] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    total = np.append(np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), dtype=np.uint64))
    m = len(data) - size + 1
    return mix((total[size:] - total[:-size]) * powers(pow(BASE, -1, 2**64), len(data))[:m])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with the same anchor: anchor hash, first start, number of starts.

    A window's anchor is the leftmost of its grams with the smallest hash. It depends on the window's bytes
    only, so equal windows have equal anchor hashes wherever they are.
    """
    span, n = length - gram + 1, len(data) - length + 1
    value = _grams(data, gram)
    packed = (value & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(value), dtype=np.uint64)
    blocks = -(-len(packed) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(blocks, span)
    upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(onward[:n], upto[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return value[at[first]], first, np.diff(np.append(first, n))


def stretches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, text_key, at, n, key, print``: every window of every text, in stretches with one anchor.

    ``key`` is the anchor's hash and ``print`` a hash of all bytes from the first window to the last.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            owner, parts = [], []
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                for base in range(0, max(len(data) - length + 1, 0), STARTS):
                    piece = data[base : base + STARTS + length - 1]
                    key, at, n = anchors(piece, length, gram)
                    total = np.append(np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[piece] * powers(BASE, len(piece)), dtype=np.uint64))
                    mark = mix((total[at + n + length - 1] - total[at]) * powers(pow(BASE, -1, 2**64), len(piece))[at] + n.astype(np.uint64))
                    parts.append((at + base, n, key.view(np.int64), mark.view(np.int64)))
                    owner.append(np.full(len(at), i))
            if owner:
                take = pa.array(np.concatenate(owner))
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), *columns], names=["doc_id", "text_key", "at", "n", "key", "print"])

    return _texts(docs).mapInArrow(cut, "doc_id long, text_key long, at long, n long, key long, print long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), F.encode(whole_text(), "utf-8").alias("text"))


def _by_row(texts: DataFrame, grouped: DataFrame, how: str) -> DataFrame:
    other = grouped.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    return texts.join(other, texts["doc_id"].eqNullSafe(other["_id"]) & (texts["text_key"] == other["_key"]), how).drop("_id", "_key")


def repeated_stretches(seen: DataFrame, docs: DataFrame, length: int, anchor_stretches: int) -> DataFrame:
    """``key, print, a, b``: windows ``a`` to ``b`` (exclusive) of such a stretch occur more than once."""
    every = stored(seen.groupBy("key", "print").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "at", "n")).alias("one")), "distinct-stretches")
    whole = every.where("times > 1").select("key", "print", F.lit(0).cast("long").alias("a"), F.col("one.n").alias("b"))
    kinds = stored(every.groupBy("key").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 AND least = 1").select("key", "kinds"), "mixed-anchors")
    # of anchors with different stretches around them one of each kind is looked at
    wanted = every.join(kinds, "key").select("key", "print", "times", (F.col("kinds") > anchor_stretches).alias("single"), "one.*")
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("key", "print", "times", "single", "at", "n")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data, rows = text.as_buffer(), wanted.values
                get = {f: rows.field(f).to_numpy(zero_copy_only=False) for f in ("key", "print", "times", "single", "at", "n")}
                bytes_of = [data[a : a + n + length - 1].to_pybytes() for a, n in zip(get["at"].tolist(), get["n"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.field("key"), rows.field("print"), rows.field("times"), rows.field("single"), pa.array(bytes_of, pa.binary())], names=["key", "print", "times", "single", "bytes"])

    texts = _by_row(_texts(docs).dropDuplicates(["doc_id", "text_key"]) if _has_repeats(docs) else _texts(docs), lists, "inner").select("text", "wanted")
    fetched = stored(texts.mapInArrow(fetch, "key long, print long, times long, single boolean, bytes binary"), "stretch-bytes")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def flush():
            rows = [(k, p, a, b) for (k, p, _), flags in zip(held, repeated_starts([x for _, _, x in held], length), strict=True) for a, b in intervals(flags)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "print", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "print", "bytes")), strict=True):
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + 1
        if held:
            yield flush()

    few = fetched.where("NOT single").select("key", "print", "bytes").repartition("key").sortWithinPartitions("key")
    sorted_out = few.mapInArrow(sort, "key long, print long, a long, b long")
    out = whole.unionByName(stored(sorted_out, "sorted-stretches"))
    many = fetched.where("single")
    if not many.isEmpty():
        each = many.select("key", "print", F.posexplode(F.expr(f"transform(sequence(1, octet_length(bytes) - {length - 1}), i -> md5(substring(bytes, i, {length})))")).alias("a", "window"))
        each = stored(each, "single-windows")
        again = stored(each.groupBy("window").agg(F.count("*").alias("m")).where("m > 1").select("window"), "repeated-windows")
        out = out.unionByName(each.join(again, "window").select("key", "print", F.col("a").cast("long").alias("a"), (F.col("a") + 1).cast("long").alias("b")))
    return out


def _has_repeats(docs: DataFrame) -> bool:
    """Whether some id and text occur in several rows."""
    keys = docs.select(F.col("doc_id"), F.xxhash64(whole_text()).alias("k"))
    return not keys.groupBy("doc_id", "k").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, anchor_stretches: int = ANCHOR_STRETCHES) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, spans, kept``: the text's bytes outside repeated strings.

    A byte goes when a string of ``length`` bytes that covers it starts in at least one more place of any
    row's text, the same one included; all are judged on the input. ``spans`` are the maximal removed runs
    (``start``, ``end``) and ``kept`` the other bytes, which need not be valid UTF-8. Null texts are empty;
    rows that repeat an id or a text are texts of their own, so equal rows of ``length`` bytes lose them all.

    Windows are dealt by their anchor, a gram chosen by content, because equal windows have equal anchors.
    Stretches of windows around anchors that occur once are never read again; equal stretches are counted, not
    moved; of anchors with different stretches one copy of each is sorted with others by the difference-cover
    algorithm, about a million bytes at a time, and adjacent prefixes are compared. An anchor with more than
    ``anchor_stretches`` different stretches has its windows dealt and counted singly.
    """
    if not gram + 8 <= length <= 50_000:
        raise ValueError("a window must be at least 8 bytes longer than a gram, and at most 50,000")
    # what is sorted together stays below 2**21 bytes; a stretch has fewer than two windows' bytes
    anchor_stretches = min(anchor_stretches, (2**21 - SORT_BYTES) // (2 * length) - 1)
    seen = stored(stretches(docs, length, gram), "stretches")
    marks = stored(repeated_stretches(seen, docs, length, anchor_stretches), "repeated-stretches")
    hit = seen.join(marks, ["key", "print"]).select("doc_id", "text_key", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + (length - 1)).alias("b"))
    spans = hit.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("hits"))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, found, kept = [], [], [], []
            for text, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                cover = np.zeros(len(data) + 1, dtype=np.int64)
                if hits.is_valid:
                    np.add.at(cover, hits.values.field("a").to_numpy(), 1)
                    np.add.at(cover, hits.values.field("b").to_numpy(), -1)
                gone = np.cumsum(cover)[:-1] > 0
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                found.append([{"start": a, "end": b} for a, b in intervals(gone)])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    rows = _by_row(_texts(docs), spans, "left").select("doc_id", "text", "hits")
    return rows.mapInArrow(take_out, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")

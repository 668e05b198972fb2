"""Benchmark decontamination: prefix-filtered set join with exact containment of item windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import frugal, portions, stored, whole_text
from marktrace.llm.words import Words

#: shingle tokens held by every task at most (8 bytes each); beyond it tokens are joined instead of looked up
LOOKUP_TOKENS = 2_000_000
TOKEN_WORDS = 3


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Windows of each item: ``item_id, body, size, step, tokens``.

    ``body`` is the window's words joined by spaces; ``tokens`` are its shingles of ``step`` words in order.
    An item of fewer words than a window, but not none, is one window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch.column("text")):
                w = Words(texts)
                hashes = {k: w.shingles(k)[0] for k in range(1, TOKEN_WORDS + 1)}
                ids = batch.column("item_id").slice(part.start, part.stop - part.start)
                owner, rows = [], []
                for at, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
                    size = min(window, b - a)
                    step = min(TOKEN_WORDS, size)
                    for i in range(a, b - size + 1) if size else ():
                        owner.append(at)
                        rows.append((w.text(i, i + size), size, step, hashes[step][i : i + size - step + 1].view(np.int64)))
                body, size, step, tokens = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), pa.array(body, pa.string()), pa.array(size, pa.int32()), pa.array(step, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["item_id", "body", "size", "step", "tokens"])

    slim = items.select(F.col("item_id").cast("string").alias("item_id"), whole_text().alias("text"))
    return slim.mapInArrow(frugal(cut), "item_id string, body string, size int, step int, tokens array<long>")


def lookup(tokens: DataFrame, limit: int) -> np.ndarray | None:
    """The distinct ``token`` values sorted, or None where there are more than ``limit``."""
    rows = tokens.select("token").distinct().limit(limit + 1).toArrow()
    return None if rows.num_rows > limit else np.sort(rows.column("token").to_numpy())


def _found(values: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    if known is None:
        return np.ones(len(values), dtype=bool)
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def token_rarity(docs: DataFrame, steps: list[int], known: np.ndarray | None) -> DataFrame:
    """``token, n``: occurrences in all whole texts, of the tokens in ``known`` or of all; summed in the task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch.column("text")):
                w = Words(texts)
                got = []
                for step in steps:
                    value, whole = w.shingles(step)
                    value = value[whole].view(np.int64)
                    got.append(value[_found(value, known)])
                token, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

    return docs.select(whole_text().alias("text")).mapInArrow(frugal(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


#: candidate places that leave the scan in one batch
BATCH_PLACES = 5_000


def candidates(docs: DataFrame, steps: list[int], known: np.ndarray | None, window: int) -> DataFrame:
    """One row per input row: ``row, doc_id, text_key, n_words``; and one per place where a known token starts:
    ``row, n_words, token, at, first, around``, the words around it that a window with this token can hold.

    Tokens of fewer than ``TOKEN_WORDS`` words stand for windows of just these words. Places leave the scan in
    batches, so a word that a text repeats very often fills no cell and no worker.
    """
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    names = ["row", "doc_id", "text_key", "n_words", "token", "at", "first", "around"]

    def out(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch.column("text")):
                w = Words(texts)
                n, sizes = len(texts), np.diff(w.bounds)
                rows = batch.column("row").slice(part.start, n).to_numpy()
                own = [batch.column(c).slice(part.start, n) for c in ("row", "doc_id", "text_key")]
                nothing = [pa.nulls(n, t) for t in types[4:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), *nothing], names=names)
                for step in steps:
                    value, whole = w.shingles(step)
                    value = value.view(np.int64)
                    places = np.flatnonzero(whole & _found(value, known))
                    widest = window if step == TOKEN_WORDS else step
                    for k in range(0, len(places), BATCH_PLACES):
                        here = places[k : k + BATCH_PLACES]
                        at = np.searchsorted(w.bounds, here, "right") - 1
                        begin, end = w.bounds[at], w.bounds[at + 1]
                        first, last = np.maximum(begin, here - widest + step), np.minimum(end, here + widest)
                        around = [w.text(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                        yield out([rows[at], [None] * len(here), [None] * len(here), sizes[at], value[here], here - begin, first - begin, around])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    return slim.mapInArrow(frugal(scan), "row long, doc_id long, text_key long, n_words long, token long, at int, first int, around string")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, lookup_tokens: int = LOOKUP_TOKENS) -> DataFrame:
    """Which words of each document lie inside a window of a benchmark item.

    Returns per input row ``doc_id, text_key`` (xxhash64 of the text)``, n_words, hits`` (distinct ``start, size`` of occurring windows), ``n_hit``,
    ``items`` (ids as strings, sorted), ``n_items`` and ``contaminated`` (some word hit, and at least one in
    ``share``). Null texts have no words; an item without id marks words but is not listed; an item that occurs
    twice counts once. Rows that repeat an id are judged one by one. Columns beyond id and text are not read.

    Windows keep their order of shingles by rarity: a window whose rarest shingle never occurs cannot occur,
    any other occurs only where that shingle does, so it is the one token joined (the necessary prefix for
    whole containment). Position bounds leave windows that fit into the text at that place, and the words
    themselves are compared. Tokens that fit into ``lookup_tokens`` are looked up in the scan, so only places
    with a prefix token leave it; more are joined without that filter, with the same result.
    """
    raw = stored(item_windows(items, window), "windows")
    steps = sorted(r.step for r in raw.select("step").distinct().collect())
    tokens = raw.select(F.explode("tokens").alias("token"))
    every = lookup(tokens, lookup_tokens)
    counted = token_rarity(docs, steps, every)
    rarity = stored(counted if every is not None else counted.join(tokens.distinct(), "token", "left_semi"), "rarity")
    bodies = raw.select("body", "size", "step", "tokens").dropDuplicates(["body"])
    placed = bodies.select("body", "size", "step", F.posexplode("tokens").alias("place", "token"))
    ranked = placed.join(rarity, "token", "left").groupBy("body").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place", "size", "step")).alias("r"))
    prefix = stored(ranked.where("r.n > 0").select("body", "r.token", "r.place", "r.size", "r.step"), "prefix")
    used = sorted(r.step for r in prefix.select("step").distinct().collect())
    scanned = stored(candidates(docs, used, lookup(prefix, lookup_tokens), window).withColumnRenamed("row", "_row"), "candidates")
    rows, cand = scanned.where("token IS NULL"), scanned.where("token IS NOT NULL").select("_row", "n_words", "token", "at", "first", F.split("around", " ").alias("around"))
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice("around", start - F.col("first") + 1, F.col("size")), " ") == F.col("body")
    placed_hits = cand.join(prefix, "token").where(fits).where(same).select("_row", start.alias("start"), "size", "body").distinct()
    hits = stored(placed_hits, "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))).cast("long")
    spans = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "size")).alias("hits")).withColumn("n_hit", covered)
    named = hits.select("_row", "body").join(raw.select("item_id", "body").distinct(), "body").groupBy("_row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    marked = spans.join(named, "_row", "left")
    all_rows = rows.select("_row", "doc_id", "text_key", "n_words").join(marked, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return all_rows.select("doc_id", "text_key", "n_words", F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>")).alias("hits"), n_hit.alias("n_hit"), listed.alias("items"), F.size(listed).cast("long").alias("n_items"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))

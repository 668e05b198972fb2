"""MinHash near-dedup with DartMinHash signatures, a banded join and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import connected, discard, frugal, portions, stored, whole_text
from marktrace.llm.words import Words, mix, powers

BANDS, BAND_ROWS, SHINGLE_WORDS, SIMILARITY = 24, 5, 5, 0.8
#: rounds in which each bucket is compared with one member, before what is left is joined
STAR_ROUNDS = 2
_A, _B, _C, _D = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def weighted_shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes with their counts, grouped by text, and the bounds of each text's group.

    A text of fewer words than a shingle, but not none, has its word sequence as its one shingle.
    """
    w = Words(texts)
    value, whole = w.shingles(words)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    value, owner = value[whole], owner[whole]
    for i in np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < words)).tolist():
        sequence = 0
        for h in w.hash[w.bounds[i] : w.bounds[i + 1]].tolist():
            sequence = (sequence * int(_A) + h + 1) % 2**64
        value, owner = np.append(value, mix(np.array([sequence], dtype=np.uint64))), np.append(owner, i)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(value)))
    return value[first], counts, np.searchsorted(owner[first], np.arange(len(texts) + 1))


def dart_signatures(element: np.ndarray, weight: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """DartMinHash signatures of several weighted sets, one row of ``k`` each (zeros for an empty set).

    Every element has a region [0, weight) in each of the rank levels below a bound. Regions are cut at
    weights 1, 2, 4, ...; a cut's darts arrive along the rank at a rate equal to its width, and each dart has
    a hashed place in the cut and a hashed coordinate. A dart inside the region is kept; the earliest one per
    coordinate is the signature, so two sets agree in a coordinate with a probability equal to their weighted
    Jaccard similarity. The rank bound follows from the total weight: about ln k + 2 darts per coordinate are
    thrown, whatever the set's size, and sets with an empty coordinate are thrown again to twice the rank.
    """
    n_sets = len(bounds) - 1
    signature = np.zeros((n_sets, k), dtype=np.uint64)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n_sets), size)
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    bound = k * (np.log(k) + 2) / np.maximum(total, 1e-12)
    missing = size > 0
    while missing.any():
        chosen = missing[owner]
        best = np.full(n_sets * k, np.inf)
        thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, width, cut = 0.0, 1.0, 0
        alive = np.flatnonzero(chosen)
        while len(alive):
            at, rank, turn = alive, np.zeros(len(alive)), 0
            while len(at):
                h = mix(element[at] * _A + np.uint64(((cut << 32) + turn + 1) * int(_C) % 2**64))
                rank = rank - np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
                inside = rank <= bound[owner[at]]
                at, rank, h = at[inside], rank[inside], h[inside]
                dart = mix(h ^ _B)
                place = low + width * ((mix(dart ^ _D) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
                hit = place < weight[at]
                slot = owner[at][hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, slot, rank[hit])
                thrown.append((slot, rank[hit], dart[hit]))
                turn += 1
            low, width, cut = (1.0, 1.0, 1) if cut == 0 else (low * 2, width * 2, cut + 1)
            alive = alive[weight[alive] > low]
        flat = signature.reshape(-1)
        for slot, rank, dart in thrown:
            won = rank == best[slot]
            flat[slot[won]] = dart[won]
        missing = missing & np.isinf(best.reshape(n_sets, k)).any(axis=1)
        bound = bound * 2
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    parts = signature.reshape(len(signature), bands, rows)
    return mix((parts * powers(int(_C), rows)).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _D)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row ``doc_id, text_key``, a 128-bit hash ``x, y`` of its weighted shingles, their ``total`` and band keys.

    Texts without words have no bands, and only equal ones of them share ``x, y``.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch.column("text")):
                element, count, bounds = weighted_shingles(texts, words)
                keys = band_keys(dart_signatures(element, count.astype(np.float64), bounds, bands * rows), bands, rows)
                run = np.append(np.zeros(1, np.uint64), np.cumsum(mix(element * _A + count.astype(np.uint64) * _B), dtype=np.uint64))
                run2 = np.append(np.zeros(1, np.uint64), np.cumsum(mix(element * _C + count.astype(np.uint64) * _D), dtype=np.uint64))
                total = np.append(0, np.cumsum(count))[bounds]
                total = np.diff(total)
                some = total > 0
                text_key = batch.column("text_key").slice(part.start, part.stop - part.start)
                other = mix(text_key.to_numpy().view(np.uint64) + _A)
                x, y = (np.where(some, r[bounds[1:]] - r[bounds[:-1]], alt).view(np.int64) for r, alt in ((run, text_key.to_numpy().view(np.uint64)), (run2, other)))
                offsets = np.append(0, np.cumsum(np.where(some, bands, 0)))
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, text_key, pa.array(x), pa.array(y), pa.array(total), listed], names=["doc_id", "text_key", "x", "y", "total", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    return slim.mapInArrow(frugal(sketch), "doc_id long, text_key long, x long, y long, total long, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """``a, b, linked`` for ``pairs(a, b)``: whether the weighted Jaccard similarity of the texts reaches the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked: list[bool] = []
            for part, left in portions(batch.column("ta")):
                right = batch.column("tb").slice(part.start, part.stop - part.start).to_pylist()
                distinct = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
                value, count, bounds = weighted_shingles(list(distinct), words)
                for x, y in zip(left, right, strict=True):
                    (p, q), (r, s) = (bounds[distinct[t] : distinct[t] + 2] for t in (x, y))
                    _, i, j = np.intersect1d(value[p:q], value[r:s], assume_unique=True, return_indices=True)
                    both = np.minimum(count[p:q][i], count[r:s][j]).sum()
                    either = count[p:q].sum() + count[r:s].sum() - both
                    linked.append(bool(either and both >= threshold * either))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one = texts.select(F.col("row").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    # the smaller number has the centre of a bucket more often: the other side's text is fetched first, so a centre's text moves once
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(frugal(compare), "a long, b long, linked boolean")


def apart_pairs(named: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of different components in ``named(row, root)`` that may reach the threshold; none is missed.

    Prefix-filtered join: each text's shingles, one element per occurrence, are ordered by how few texts have
    them. Two similar texts share an element among the first of both (fewer in the smaller one), at positions
    that leave enough elements behind. What members of a family have in common is frequent and thus not among
    the first, so even large families give few pairs.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch.column("text")):
                value, count, bounds = weighted_shingles(texts, words)
                ends = np.append(0, np.cumsum(count))
                turn = np.arange(ends[-1]) - np.repeat(ends[:-1], count)
                each = mix(np.repeat(value, count) + turn.astype(np.uint64) * _D)
                listed = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(each.view(np.int64)))
                rows, roots = (batch.column(c).slice(part.start, part.stop - part.start) for c in ("row", "root"))
                yield pa.RecordBatch.from_arrays([rows, roots, listed], names=["row", "root", "elements"])

    chosen = texts.join(named.select("row", "root").distinct(), "row").select("row", "root", "text")
    sets = stored(chosen.mapInArrow(frugal(elements), "row long, root long, elements array<long>"), "apart-elements")
    one = sets.select("row", "root", F.size("elements").alias("total"), F.explode("elements").alias("element"))
    common = stored(one.groupBy("element").agg(F.count("*").alias("texts")), "apart-frequencies")
    ordered = one.join(common, "element").groupBy("row", "root", "total").agg(F.sort_array(F.collect_list(F.struct("texts", "element"))).alias("order"))
    ordered = stored(ordered.select("row", "root", "total", F.slice("order", 1, F.col("total") - F.ceil(F.col("total") * threshold - 1e-9).cast("int") + 1).alias("first")), "apart-prefixes")
    places = ordered.select("row", "root", "total", F.posexplode("first").alias("at", "e")).select("row", "root", "total", "at", F.col("e.element").alias("element"))
    small = places.where(F.col("at") <= F.col("total") - F.ceil(F.col("total") * (2 * threshold / (1 + threshold)) - 1e-9)).select("element", *(F.col(c).alias(f"{c}2") for c in ("row", "root", "total", "at")))
    smaller = (F.col("total2") < F.col("total")) | ((F.col("total2") == F.col("total")) & (F.col("row2") < F.col("row")))
    enough = 1e-9 + F.least(F.col("total") - F.col("at"), F.col("total2") - F.col("at2")) >= (F.col("total") + F.col("total2")) * (threshold / (1 + threshold))
    met = places.join(small, "element").where(smaller & (F.col("root") != F.col("root2")) & (F.col("total2") >= threshold * F.col("total")) & enough)
    return met.select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b")).distinct()


def candidate_links(members: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links ``a, b`` that connect all similar members of each bucket in ``members(key, row, total, met)``.

    Round by round each bucket compares one of its members with those not yet connected to it: the one that
    ``met`` most others in its buckets, which is the text most copies were made from. That turns a large group
    of copies into one component in a few rounds of as many pairs as members. Members of
    buckets that are then still apart go through an exact similarity join, so no two similar members of a
    bucket stay unlinked, whatever its size.
    """
    spark = members.sparkSession
    done = spark.createDataFrame([], "a long, b long, linked boolean")
    for turn in range(STAR_ROUNDS + 1):
        roots = connected(done.where("linked").select("a", "b"), f"near-{turn}") if turn else None
        named = members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")) if turn else members.withColumn("root", F.col("row"))
        apart = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.max(F.struct("met", (-F.col("row")).alias("first"), F.col("row").alias("centre"), F.col("root").alias("centre_root"), F.col("total").alias("centre_total"))).alias("c")).where("lo < hi").select("key", "n", "c.centre", "c.centre_root", "c.centre_total")
        apart = stored(apart, "buckets-apart")
        if apart.isEmpty():
            break
        if turn:
            named = stored(named.join(apart.select("key"), "key"), "apart-members")
        if turn == STAR_ROUNDS:
            fresh = similar(apart_pairs(named, texts, words, threshold).join(done, ["a", "b"], "left_anti"), texts, words, threshold)
            done = done.union(stored(fresh, "compared"))
            break
        met = named.join(apart, "key").where("root <> centre_root").select("row", "total", F.col("centre").alias("other"), F.col("centre_total").alias("other_total"))
        near = met.where((F.col("total") >= threshold * F.col("other_total")) & (F.col("other_total") >= threshold * F.col("total")))
        pairs = near.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
        pairs = pairs.join(done, ["a", "b"], "left_anti") if turn else pairs
        fresh = stored(similar(pairs, texts, words, threshold), "compared")
        done = fresh if not turn else done.union(fresh)
        # a centre has been compared with its whole bucket or is connected to it, and with it a bucket of two is done
        rest = members.join(apart.select("key", F.col("centre").alias("row")), ["key", "row"], "left_anti")
        members = stored(rest.join(apart.where("n > 2").select("key"), "key"), "buckets")
    return done.where("linked").select("a", "b")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, text_key, class_id, class_size, kept`` for every row of ``docs``.

    Rows are linked when the weighted Jaccard similarity of their word shingles, each counted as often as it
    occurs, is at least ``threshold``; ``class_id`` is the smallest doc_id that links lead to. ``kept`` marks
    one row of each class: the one with that id. Words are runs of ASCII letters, digits and non-ASCII
    characters, with A-Z in lower case. Texts without words (null counts as empty) are linked with equal texts
    only. Rows may repeat an id; a row without id is linked by its text and kept where no row with id is.

    Rows with the same weighted shingles become one node first. Nodes that agree in all coordinates of a band
    meet; at the default 24 bands of 5 two texts of similarity 0.8 miss each other once in 10,000 times.
    """
    seen = stored(sketches(docs, words, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = seen.groupBy("x", "y").agg(F.min(F.struct("row", "doc_id", "text_key", "total", "bands")).alias("m"), F.count("*").alias("n")).select("x", "y", "m.*", "n")
    nodes = stored(nodes, "sketch-nodes")
    meetings = nodes.select("row", "total", F.explode("bands").alias("key"))
    shared = meetings.groupBy("key").agg((F.count("*") - 1).alias("others")).where("others > 0")
    joined = stored(meetings.join(shared, "key"), "bucket-members")
    members = stored(joined.join(joined.groupBy("row").agg(F.sum("others").alias("met")), "row").drop("others"), "buckets")
    wanted = nodes.join(members.select("row").distinct(), "row").select("row", "doc_id", "text_key")
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("text"))
    texts = source.join(wanted, source["_id"].eqNullSafe(wanted["doc_id"]) & (F.xxhash64(source["text"]) == wanted["text_key"])).select("row", "text")
    texts = stored(texts, "bucket-texts")
    links = candidate_links(members, texts, words, threshold)
    roots = connected(links, "near")
    placed = nodes.select("x", "y", F.col("row").alias("node"), "n").join(roots, "node", "left").select("x", "y", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "node-roots")
    rooted = seen.select("row", "doc_id", "text_key", "x", "y").join(placed, ["x", "y"])
    first = stored(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"), F.count("*").alias("class_size")).select("root", F.col("m.doc_id").alias("class_id"), F.col("m.row").alias("first"), "class_size"), "classes")
    discard(texts)
    return rooted.join(first, "root").select("doc_id", "text_key", "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"))

"""Prefix trie of conversations as a burst trie: suffix containers under trie heads, burst while oversized, then swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marktrace.llm.common import stored
from marktrace.llm.mixing import word_count
from marktrace.operators.ordered import order_rows, ranked

#: characters of one turn id (hexadecimal md5) in a suffix
ID = 32
#: turns one cell may hold; longer conversations go on under a head of their own
SEGMENT_TURNS = 100_000
#: turns a container may hold before it bursts
CONTAINER_TURNS = 20_000
#: characters of conversation ids in one row on the way to their hash
CHUNK_CHARS = 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, head string, above array<string>, top boolean"
HEAD_STATE = ("depth", "parent_conv", "head_words", "above")


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, words``: turns in order (null first, equal ones by id), a null role or text being empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    slim = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), word_count(text).alias("words"))
    return ranked(order_rows(stored(slim, "turns"), ["conv_id"], ["turn", "key"]), "pos").plain().drop("turn")


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, key, words`` of the rebuilt conversations, and ``conv_id, total`` of each.

    Conversation c starts with the first h turns of conversation c - c % block, h being the CRC-32 of the
    decimal c modulo ``most``, and goes on with its own turns behind its first h.
    """
    sizes = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversation-sizes")
    c = F.col("conv_id")
    plan = sizes.select("conv_id", "n", (c - c % block).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = stored(plan.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "total"), "conversation-plan")
    firsts = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    lent = plan.where("taken > 0").select("conv_id", "base", "taken").join(firsts, "base").where("pos <= taken")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "key", "words"]
    return lent.select(*columns).unionByName(own.select(*columns)), plan.select("conv_id", "total")


def sequences(turns: DataFrame, sizes: DataFrame, segment: int) -> DataFrame:
    """Each conversation's turn ids as strings of at most ``segment`` ids, one row per segment.

    A segment's ``head`` names all turns before it (two 64-bit hashes per segment, combined by XOR over its place),
    ``next_head`` those up to its end if the conversation goes on there; the last segment is shorter than
    ``segment``, if need be empty.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "key", "words")))
    full = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / segment).alias("seg")).agg(ordered.alias("t"))
    full = full.select("conv_id", "seg", F.array_join("t.key", "").alias("suffix"), F.col("t.words").alias("words"))
    closing = sizes.where(F.col("total") % segment == 0).select("conv_id", F.floor(F.col("total") / segment).alias("seg"), F.lit("").alias("suffix"), F.array().cast("array<bigint>").alias("words"))
    laid = stored(full.unionByName(closing), "segments")
    going_on = F.char_length("suffix") == segment * ID
    short = laid.where((F.col("seg") == 0) & ~going_on).select("*", F.lit("").alias("head"), F.lit(None).cast("string").alias("next_head"))
    lane = Window.partitionBy("conv_id").orderBy("seg")
    seen = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(salt), "seg", "suffix")).over(lane.rowsBetween(Window.unboundedPreceding, last)), F.lit(0)) for last in (-1, 0) for salt in (1, 2)]
    name = lambda seg, a, b: F.concat_ws("-", seg.cast("string"), F.hex(a), F.hex(b))
    long = laid.where((F.col("seg") > 0) | going_on)
    long = long.select("*", F.when(F.col("seg") == 0, "").otherwise(name(F.col("seg"), *seen[:2])).alias("head"), F.when(going_on, name(F.col("seg") + 1, *seen[2:])).alias("next_head"))
    return short.unionByName(long).withColumn("ends", F.when(~going_on, F.md5(F.concat("head", F.lit(":"), "suffix"))))


def ends_hashes(ended: DataFrame) -> DataFrame:
    """``ends, ends_sha256`` of ``ended(ends, conv_id)``: SHA-256 of the decimal ids, ascending, joined by commas.

    Ids are range-partitioned by (ends, id), so those of a place where very many conversations end lie in many
    tasks; each joins its own into chunks, and only chunks of one place go through one task, one after the other.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, parts, size = None, 0, [], 0
        for batch in batches:
            out: list[tuple] = []
            for e, c in zip(batch.column("ends").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if parts and (e != place or size > CHUNK_CHARS):
                    out.append((place, first, ",".join(parts)))
                    parts, size = [], 0
                if not parts:
                    place, first = e, c
                parts.append(str(c))
                size += len(parts[-1]) + 1
            yield _batch(out, "ends first ids", (pa.string(), pa.int64(), pa.string()))
        if parts:
            yield _batch([(place, first, ",".join(parts))], "ends first ids", (pa.string(), pa.int64(), pa.string()))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, run = None, None
        for batch in batches:
            out: list[tuple] = []
            for e, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if run is None or e != place:
                    if run is not None:
                        out.append((place, run.hexdigest()))
                    place, run = e, hashlib.sha256(ids.encode())
                else:
                    run.update(b"," + ids.encode())
            yield _batch(out, "ends ends_sha256", (pa.string(), pa.string()))
        if run is not None:
            yield _batch([(place, run.hexdigest())], "ends ends_sha256", (pa.string(), pa.string()))

    laid = ended.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id")
    joined = laid.mapInArrow(chunks, "ends string, first long, ids string")
    return joined.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(digests, "ends string, ends_sha256 string")


def _batch(rows: list[tuple], names: str, types: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Containers of at most ``limit`` turns, and the heads whose containers burst.

    A container of several sequences and more turns hands each of them to the child head of its next turn;
    what ends at the head stays there. Every round stores both sides.
    """
    settled: DataFrame | None = None
    heads: DataFrame | None = None
    turns = F.char_length("suffix") / ID
    while True:
        sized = rows.groupBy("head").agg(F.sum(turns).alias("turns"), F.count("*").alias("n_rows"), F.min("conv").alias("head_conv"))
        over = stored(sized.where((F.col("turns") > limit) & (F.col("n_rows") > 1)).select("head", "head_conv"), "burst-heads")
        if over.isEmpty():
            return (rows if settled is None else settled.unionByName(rows)), heads
        rest = stored(rows.join(over, "head", "left_anti"), "containers")
        settled = rest if settled is None else settled.unionByName(rest)
        inside = rows.join(over, "head")
        following = F.substring("suffix", 1, ID)
        record = inside.groupBy("head").agg(
            F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("suffix") == "", F.col("ends"))).alias("ends"),
            F.countDistinct(F.when(F.col("suffix") != "", following)).alias("n_children"), *[F.first(c).alias(c) for c in HEAD_STATE])
        record = stored(record, "heads")
        heads = record if heads is None else heads.unionByName(record)
        moved = inside.where("suffix <> ''").select(
            F.md5(F.concat("head", following)).alias("head"), (F.col("depth") + 1).alias("depth"), F.substring("suffix", F.lit(ID + 1), F.char_length("suffix")).alias("suffix"),
            F.slice("words", F.lit(2), F.size("words")).alias("words"), "n", "conv", "ends", "low", F.col("head_conv").alias("parent_conv"),
            F.col("words")[0].alias("head_words"), F.concat("above", F.array("head")).alias("above"))
        rows = stored(moved, "containers")


def _swept(head: dict, rows: list[dict]) -> list[tuple]:
    """Nodes of one container, the head first: sorted suffixes are laid on a path that each shares with the one before."""
    depth, words, parent, n, conv, ends, low = [head["depth"]], [head["head_words"]], [-1], [0], [None], [None], [None]
    path, before = [0], ""
    for r in rows:
        suffix, common = r["suffix"], 0
        top = min(len(before), len(suffix))
        while common < top and before[common : common + ID] == suffix[common : common + ID]:
            common += ID
        before, at = suffix, common // ID
        del path[at + 1 :]
        for i in range(at, len(suffix) // ID):
            depth.append(head["depth"] + i + 1)
            words.append(r["words"][i])
            parent.append(path[-1])
            path.append(len(n))
            n.append(0)
            conv.append(None)
            ends.append(None)
            low.append(None)
        last = path[-1]
        n[last] += r["n"]
        conv[last] = r["conv"] if conv[last] is None else min(conv[last], r["conv"])
        ends[last], low[last] = r["ends"], r["low"]
    size = len(n)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for i in reversed(range(size)):
        if low[i]:
            children[i], leaves[i], ends[i] = low[i]["n_children"], low[i]["n_leaves"], low[i]["ends"]
            saved[i] += low[i]["saved_tokens"]
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * words[i]
        if (p := parent[i]) >= 0:
            n[p] += n[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    up = [head["parent_conv"], *(conv[p] for p in parent[1:])]
    return [(conv[i], depth[i], up[i], n[i], children[i], leaves[i], saved[i], ends[i], *((head["head"], head["above"], True) if i == 0 else (None, None, False))) for i in range(size)]


NODE_TYPES = (*[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
NODE_NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends head above top"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers that come one after the other, sorted by suffix; one container is held at a time."""
    held: list[dict] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if held and row["head"] != held[0]["head"]:
                out += _swept(held[0], held)
                held = []
            held.append(row)
        yield _batch(out, NODE_NAMES, NODE_TYPES)
    if held:
        yield _batch(_swept(held[0], held), NODE_NAMES, NODE_TYPES)


def _level(rows: DataFrame, limit: int) -> DataFrame:
    """All nodes of one segment level in the form ``NODE``."""
    containers, heads = burst(rows, limit)
    nodes = stored(containers.repartition("head").sortWithinPartitions("head", "suffix").mapInArrow(_sweep, NODE), "trie-nodes")
    if heads is None:
        return nodes
    own = heads.select("*", ((F.col("n_convs") - 1) * F.col("head_words")).alias("own"))
    shares = nodes.where("top").select("above", "n_leaves", "saved_tokens").unionByName(own.select("above", F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens")))
    below = shares.select(F.explode("above").alias("head"), "n_leaves", "saved_tokens").groupBy("head").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    done = own.join(below, "head").select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("own") + F.col("below")).alias("saved_tokens"),
        "ends", "head", "above", F.lit(True).alias("top"))
    return nodes.unionByName(done)


def conversation_trie(conversations: DataFrame, block: int = 20, most: int = 4, segment: int = SEGMENT_TURNS, limit: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see ``rebuilt``).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns are known by the md5 of role and text. Equal sequences are one row with a count before any shuffle by
    head, so a conversation that a third of all repeat is one row per task. Conversations longer than
    ``segment`` turns go on under heads of their own, so no cell or task holds a whole one; their levels are
    swept from the deepest up. Containers of more than ``limit`` turns burst by next turn; the rest is sorted
    by suffix inside the shards and swept, one container in memory at a time.

    Rows without conv_id belong to no conversation. Turns come by number, null first; rows of the same number
    by the md5 of role and text, and repeated rows are turns of their own. A null role or text is empty. An
    empty table has no conversation and thus no node, not even the root. Texts are only hashed and counted, so
    their length does not matter. Other columns, of whatever names, are not read.
    """
    turns, sizes = rebuilt(turn_ids(conversations), block, most)
    laid = stored(sequences(turns, sizes, segment), "sequences")
    same = laid.groupBy("seg", "head", "suffix").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("words").alias("words"), F.first("ends").alias("ends"), F.first("next_head").alias("next_head"))
    same = stored(same, "distinct-sequences")
    deepest = same.agg(F.max("seg")).first()[0]
    low = "struct<n_children: bigint, n_leaves: bigint, saved_tokens: bigint, ends: string>"
    below, nodes = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = same.where(F.col("seg") == level)
        if below is None:
            rows = rows.withColumn("low", F.lit(None).cast(low))
        else:
            tops = below.select(F.col("head").alias("next_head"), F.struct("n_children", "n_leaves", "saved_tokens", "ends").alias("low"))
            rows = rows.join(tops, "next_head", "left")
        rows = rows.select(
            "head", F.lit(level * segment).cast("long").alias("depth"), "suffix", "words", "n", "conv", "ends", "low", F.lit(None).cast("long").alias("parent_conv"),
            F.lit(0).cast("long").alias("head_words"), F.array().cast("array<string>").alias("above"))
        found = _level(stored(rows, "containers"), limit)
        # a deeper level's own head is a node of the level above and only hands its sums to it
        handed = F.col("top") & (F.size("above") == 0)
        below = found.where(handed)
        kept = found.where(~handed) if level else found
        nodes = kept if nodes is None else nodes.unionByName(kept)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if nodes is None:
        spark = conversations.sparkSession
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in columns) + ", ends_sha256 string")
    hashes = ends_hashes(laid.where("ends IS NOT NULL").select("ends", "conv_id"))
    ended = nodes.where("ends IS NOT NULL").join(hashes, "ends").select(*columns, "ends_sha256")
    return ended.unionByName(nodes.where("ends IS NULL").select(*columns, F.lit(NO_ENDS).alias("ends_sha256")))

"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import bind, key128, stored, whole_text

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, ASCII letters in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def countable(lines: Column, min_chars: int) -> Column:
    """``x, y, pos, first`` of the lines whose keys are long enough: hash, place, and whether it is the key's first.

    Sorted by hash, so equal keys are neighbours and a text of many lines is not searched per line.
    """
    placed = F.transform(lines, lambda line, i: F.struct(F.when(F.char_length(line) >= min_chars, line_key(line)).alias("key"), i.alias("pos")))
    long = F.filter(placed, lambda p: F.char_length(p["key"]) >= min_chars)

    def hashed(p: Column) -> Column:
        x, y = key128(p["key"])
        return F.struct(x.alias("x"), y.alias("y"), p["pos"].alias("pos"))

    def marked(found: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.get(found, i - 1)
            same = (i > 0) & (before["x"] == p["x"]) & (before["y"] == p["y"])
            return F.struct(p["x"].alias("x"), p["y"].alias("y"), p["pos"].alias("pos"), (~F.coalesce(same, F.lit(False))).alias("first"))

        return F.transform(found, one)

    return bind(F.sort_array(F.transform(long, hashed)), marked)


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the ascending places ``gone``: the stretches between them, each copied once."""

    def between(pair: Column) -> Column:
        edge = lambda i: F.get(pair["edges"], i)
        stretches = F.transform(F.sequence(F.lit(1), F.size(pair["edges"]) - 1), lambda i: F.slice(pair["lines"], edge(i - 1) + 2, edge(i) - edge(i - 1) - 1))
        return F.flatten(stretches)

    edges = lambda held: F.concat(F.array(F.lit(-1)), gone, F.array(F.size(held)))
    return bind(lines, lambda held: bind(F.struct(held.alias("lines"), edges(held).alias("edges")), between))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` with ``text`` deduplicated, plus ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold lose their lines in every
    row but those with the largest doc_id among them. Each row is a document of its own, whatever its id; a
    row without id never is the one that keeps a line unless no holder has an id. A null text is one empty
    line and comes back empty. Input columns called n_lines or n_dropped are replaced, all others pass
    through whatever their names. Work on a text grows with its lines times their logarithm, however many go.

    Hashes are counted with map-side combining, so a line that a third of all rows share is one row per task.
    They are stored once with their places, so texts are split twice in all, and texts move once, for the join
    with the places to drop; rows are matched by id and text hash.
    """
    base = docs.drop("n_lines", "n_dropped")
    text = whole_text()
    held = base.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_key"), F.explode(countable(F.split(text, "\n", -1), min_chars)).alias("h")).select("id", "text_key", "h.*")
    held = stored(held, "lines")
    common = held.groupBy("x", "y").agg(F.count_if("first").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("x", "y", "keeper")
    # as a table of its own the common side leaves the line side of the join free to be split where a line is hot
    common = stored(common, "common-lines")
    lost = held.join(common, ["x", "y"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # equal rows name the same places; the set makes them one
    gone = lost.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    left = base.select(F.struct(*base.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_key"))
    joined = left.join(gone, left["own_id"].eqNullSafe(gone["id"]) & (left["own_key"] == gone["text_key"]), "left")
    whole = F.coalesce(F.col("row")["text"], F.lit(""))
    lines = F.split(whole, "\n", -1)
    kept = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(without(lines, F.col("gone")), "\n"))
    out = [kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in base.columns]
    return joined.select(*out, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))

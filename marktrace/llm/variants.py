"""Spelling variants: the vocabulary's minimised acceptor composed with a one-edit transducer and itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marktrace.llm.common import stored, whole_text
from marktrace.llm.lines import LOWER, UPPER

MIN_CHARS, MIN_COUNT, NOISE, RATIO = 5, 3, 97, 2
#: runs of ASCII letters and the characters U+00C0 to U+00FF, once A-Z are lowered
RUN = "[a-zÀ-ÿ]+"
#: words an initial state may have before it is divided by its next symbol
STATE_WORDS = 5_000
NEAR = "word string, n_near long, best_n long, best string"


def vocabulary_counts(docs: DataFrame, noise: int = NOISE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: runs of letters of whole texts with at least ``min_chars`` code points and ``min_count`` occurrences.

    A run whose CRC-32 with its document's id is divisible by ``noise`` loses the code point at that number
    modulo its length. Counted with map-side combining.
    """
    runs = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(RUN), F.lit(0))
    one = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).where(F.char_length("run") >= min_chars)
    hashed = one.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """Minimised acyclic acceptor of distinct words given in ascending order, read from state ``start``.

    Words are added along the path of the one before; what the next word no longer shares is frozen: states
    with the same finality and arcs are one.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[list, dict]] = [([False], {})]
        before = ""
        for word in words:
            common, top = 0, min(len(before), len(word))
            while common < top and before[common] == word[common]:
                common += 1
            self._freeze(path, before, common)
            path += [([False], {}) for _ in range(len(word) - common)]
            path[-1][0][0] = True
            before = word
        self._freeze(path, before, 0)
        self.start = self._state(*path[0])

    def _state(self, final: list, arcs: dict) -> int:
        key = (final[0], *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.final)
            self.final.append(final[0])
            self.arcs.append(arcs)
        return self._known[key]

    def _freeze(self, path: list, word: str, down_to: int) -> None:
        for i in range(len(path) - 1, down_to, -1):
            path[i - 1][1][word[i - 1]] = self._state(*path.pop())

    def common(self, p: int, q: int) -> list[str]:
        """Words that lead from both ``p`` and ``q`` to final states."""
        out, todo = [], [(p, q, "")]
        while todo:
            p, q, done = todo.pop()
            if self.final[p] and self.final[q]:
                out.append(done)
            mine, other = self.arcs[p], self.arcs[q]
            if len(mine) > len(other):
                mine, other = other, mine
            todo += [(t, other[x], done + x) for x, t in mine.items() if x in other]
        return out

    def one_edit_pairs(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted words at one edit, each once: paths of acceptor, one-edit transducer and acceptor.

        Up to the edit both acceptors are in the same state. The edit reads two different symbols, or one
        symbol more on the left; it is taken where the words first differ, so a pair has one path only. Behind
        it both must read the same, which depends on the two states alone and is looked up.
        """
        rests: dict[tuple[int, int], list[str]] = {}

        def rest(p: int, q: int) -> list[str]:
            key = (p, q) if p < q else (q, p)
            if key not in rests:
                rests[key] = self.common(*key)
            return rests[key]

        todo = [(self.start, "")]
        while todo:
            q, done = todo.pop()
            arcs = list(self.arcs[q].items())
            for i, (x, p) in enumerate(arcs):
                todo.append((p, done + x))
                for y, r in arcs[i + 1 :]:
                    for end in rest(p, r):
                        yield done + x + end, done + y + end
                if self.final[p] and self.final[q]:
                    yield done + x, done
                onward = self.arcs[p]
                for y, r in arcs:
                    if y != x and y in onward:
                        for end in rest(onward[y], r):
                            yield done + x + y + end, done + y + end


def _near_rows(near: dict[str, list]) -> list[tuple]:
    return [(w, k, n, b) for w, (k, n, b) in near.items()]


def _meet(near: dict[str, list], u: str, v: str, n_v: int) -> None:
    """``u`` has ``v`` near it: counted, and kept if it is the most frequent (of equals the first)."""
    have = near.get(u)
    if have is None:
        near[u] = [1, n_v, v]
        return
    have[0] += 1
    if n_v > have[1] or (n_v == have[1] and v < have[2]):
        have[1], have[2] = n_v, v


def _output(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def _by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], work) -> Iterator[pa.RecordBatch]:
    """``work(rows)`` of each run of rows with equal ``keys``; one run is held at a time."""
    held: list[dict] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                out += work(held)
                held = []
            held.append(row)
        yield _output(out)
    if held:
        yield _output(work(held))


def _composed(rows: list[dict]) -> list[tuple]:
    """Near words within one initial state, whose words come sorted."""
    cut = len(rows[0]["state"])
    n = {r["word"][cut:]: r["n"] for r in rows}
    near: dict[str, list] = {}
    for u, v in Acceptor(list(n)).one_edit_pairs():
        _meet(near, u, v, n[v])
        _meet(near, v, u, n[u])
    start = rows[0]["state"]
    return [(start + w, k, b_n, start + b) for w, k, b_n, b in _near_rows(near)]


def _edited(rows: list[dict]) -> list[tuple]:
    """Near words whose edit lies at a divided state: all that have the same symbols around it, one per symbol."""
    near: dict[str, list] = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            # the word that has no symbol there must not go on with the other's: they would differ further on
            if a["whole"] and b["symbol"] == a["symbol"] or b["whole"] and a["symbol"] == b["symbol"]:
                continue
            _meet(near, a["word"], b["word"], b["n"])
            _meet(near, b["word"], a["word"], a["n"])
    return _near_rows(near)


def near_words(vocabulary: DataFrame, limit: int = STATE_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of ``vocabulary(word, n)``: how many words are at one edit, and the most frequent.

    Words are dealt by the state that their first symbols lead to. A state with more than ``limit`` words is
    divided by the next symbol: pairs whose edit lies behind it share that symbol and meet in a child state;
    pairs whose edit is at that symbol are equal around it and meet by what is left without it, at most one
    word per symbol of the alphabet and one without. So no task holds more than ``limit`` words, however
    many start alike. Every other state's acceptor is composed by one task at a time.
    """
    settled, edits = None, None
    rows, level = vocabulary.select("word", "n", F.substring("word", 1, 0).alias("state")), 0
    while True:
        over = stored(rows.groupBy("state").agg(F.count("*").alias("words")).where(F.col("words") > limit).select("state"), "divided-states")
        if over.isEmpty():
            settled = rows if settled is None else settled.unionByName(rows)
            break
        kept = stored(rows.join(over, "state", "left_anti"), "states")
        settled = kept if settled is None else settled.unionByName(kept)
        inside = rows.join(over, "state")
        symbol, beyond = F.substring("word", level + 1, 1), F.col("word").substr(F.lit(level + 2), F.char_length("word"))
        without = inside.where(F.char_length("word") > level).select(F.lit(level).alias("level"), F.concat("state", beyond).alias("rest"), "word", "n", symbol.alias("symbol"), F.lit(False).alias("whole"))
        itself = inside.select(F.lit(level).alias("level"), F.col("word").alias("rest"), "word", "n", symbol.alias("symbol"), F.lit(True).alias("whole"))
        both = without.unionByName(itself)
        edits = both if edits is None else edits.unionByName(both)
        rows = stored(inside.where(F.char_length("word") > level).select("word", "n", F.substring("word", 1, level + 1).alias("state")), "states")
        level += 1
    found = settled.repartition("state").sortWithinPartitions("state", "word").mapInArrow(lambda b: _by_group(b, ("state",), _composed), NEAR)
    if edits is not None:
        found = found.unionByName(edits.repartition("level", "rest").sortWithinPartitions("level", "rest").mapInArrow(lambda b: _by_group(b, ("level", "rest"), _edited), NEAR))
    best = F.min(F.struct((-F.col("best_n")).alias("low"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.low")).alias("best_n"), "b.best")


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``links(word, form)``, forms followed to the last; each round doubles the steps taken."""
    now = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if after.where("moved").isEmpty():
            return now
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, limit: int = STATE_WORDS, **counting) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``vocabulary_counts(docs, **counting)``.

    Two words are near if they differ by one inserted, deleted or replaced code point. ``form`` is the most
    frequent near word (of equals the first by code point) if it occurs at least ``ratio`` times as often,
    else null; ``root`` is what forms lead to. A form is at least ``ratio`` (2 or more) times as frequent as its
    word, so chains are short and have no rings.

    A null text has no runs; a null id counts as an empty string in the hash; rows that repeat an id or a text
    are counted each. Empty tables give no words. A run may be as long as the text. Other columns, of
    whatever names, are not read.
    """
    vocabulary = stored(vocabulary_counts(docs, **counting), "vocabulary")
    near = stored(near_words(vocabulary, limit), "near-words")
    told = vocabulary.join(near, "word", "left").withColumn("close", F.col("best_n") >= ratio * F.col("n"))
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("close"), F.col("best")).alias("form"), F.when(F.col("close"), F.col("best_n")).alias("form_n")), "word-forms")
    last = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

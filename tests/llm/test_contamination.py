import re

from marktrace.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(rows, items, window=13):
    cut = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            cut.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(c) for c in cut}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in cut:
                    hit |= set(range(k, k + n))
                    found |= cut[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), tuple(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(docs, items, **k):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in contamination(docs, items, **k).collect()), key=str)


def case():
    text = " ".join(f"w{i % 17}x{i % 5}" for i in range(60))
    items = [(1, text), (2, "Alpha, beta GAMMA"), (3, ""), (4, None), (None, "delta epsilon zeta eta"), (10, "solo"), (10, "solo"), (11, "alpha beta gamma"), (12, "é ü naïve words")]
    parts = text.split()
    rows = ["nothing here", "", None, text, "pre " + " ".join(parts[5:18]) + " post", " ".join(parts[5:17]), "ALPHA.beta\ngamma", "alpha beta", "x " * 100 + "solo", "x " * 10 + "Solo!", "delta epsilon zeta eta", "É ü naïve words é ü naïve words", "alpha beta gamma", "alpha beta gamma", "long " * 5000 + text]
    return [*enumerate(rows), (None, "solo"), (3, "solo solo"), (3, text)], items


def test_against_brute_force(spark, frame):
    rows, items = case()
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS body", "2 AS n_words")
    assert run(frame(rows), table) == brute(rows, items)


def test_tokens_beyond_the_lookup_are_joined(spark, frame):
    rows, items = case()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert run(frame(rows), table, lookup_tokens=2) == brute(rows, items)


def test_short_windows(spark, frame):
    rows, items = case()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert run(frame(rows), table, window=4) == brute(rows, items, 4)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(frame(["a b"]), none) == [(0, 2, 0, (), False)]
    assert run(frame([]), spark.createDataFrame([(1, "a")], "item_id long, text string")) == []


def test_common_word_as_item_in_long_text(spark):
    """A one-word item that a long text repeats 200,000 times: every word is hit, places leave the scan in batches."""
    from marktrace.llm.decontaminate import contamination

    docs = spark.createDataFrame([(1, "the cat " * 200_000), (2, "a dog"), (3, "thecat the")], "doc_id long, text string")
    items = spark.createDataFrame([("w", "THE")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in contamination(docs, items).collect()}
    assert got == {1: (400_000, 200_000, ["w"]), 2: (2, 0, []), 3: (2, 1, ["w"])}

import random
import re
from collections import Counter

import numpy as np

import marktrace.llm.common as common
from marktrace.llm.common import connected
from marktrace.llm.minhash import apart_pairs, dart_signatures, near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(FOLD))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, least=0.8):
    """(id, class id) of each row, and the size of each class."""
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = sum((s[a] & s[b]).values()), sum((s[a] | s[b]).values())
            if (rows[a][1] or "") == (rows[b][1] or "") or either and both >= least * either:
                root[find(a)] = find(b)
    ids = {}
    for a in range(len(rows)):
        ids.setdefault(find(a), []).append(rows[a][0])
    name = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[a][0], name[find(a)], len(ids[find(a)])) for a in range(len(rows))), key=str)


def corpus(copies=25):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for _ in range(copies):  # one large group of near copies, not all near each other
        w = list(base[0])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0]] * 8 + [texts[1].upper() + "!", texts[2] + " " + texts[2], texts[3] + " tail", "", None, "!!!", "!!!", "...", "one two", "One, two", "one two three"]
    return [*enumerate(texts), (None, texts[4]), (None, "without id"), (None, "without id"), (5, texts[6]), (5, texts[5])]


def run(df, **k):
    got = near_duplicates(df, **k).collect()
    kept = Counter((r.class_id, r.class_size) for r in got if r.kept)
    assert sum(kept.values()) == len({(r.class_id, r.class_size) for r in got}) or any(r.class_id is None for r in got) or len(got) == 0
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str), got


def test_against_brute_force(frame):
    rows = corpus()
    got, all_rows = run(frame(rows))
    assert got == brute(rows)
    again = near_duplicates(frame(rows, extra=False, parts=7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, all_rows))


def test_empty_table(frame):
    assert near_duplicates(frame([])).collect() == []
    assert run(frame(["", None]))[0] == [(0, 0, 2), (1, 0, 2)]


def test_signatures_agree_as_often_as_weighted_sets():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**62, 300).astype(np.uint64)
    a = rng.integers(1, 9, 300).astype(float)
    b = a.copy()
    b[:90] = rng.integers(1, 30, 90) / 3
    s = dart_signatures(np.concatenate([element, element]), np.concatenate([a, b]), np.array([0, 300, 600]), 6000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    alone = dart_signatures(element, b, np.array([0, 300]), 6000)
    assert (alone[0] == s[1]).all()  # a set's signature does not depend on its neighbours


def test_components_in_star_rounds(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(400)] + [(5, None), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for bound in (common.TASK_EDGES, 20, 1):
        assert {tuple(r) for r in connected(df, task_edges=bound).collect()} == want
    assert connected(df.limit(0)).collect() == []


def test_exact_join_at_the_threshold(spark):
    common = [f"c{i}" for i in range(60)]  # 56 of 63 shingles in common: similarity 0.8
    both = [(row, row, " ".join(common + [f"{row}x{i}" for i in range(7)])) for row in (1, 2)]
    table = spark.createDataFrame(both, "row long, root long, text string")
    assert [tuple(r) for r in apart_pairs(table.select("row", "root"), table.select("row", "text"), 5, 0.8).collect()] == [(1, 2)]

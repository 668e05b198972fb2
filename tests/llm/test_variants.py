"""Spelling variants against a comparison of all words, with states small enough to be divided."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from marktrace.llm.variants import Acceptor, near_words, spelling_variants

SCHEMA = "doc_id long, text string, word string, n string, state string, best string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(parts)


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def random_rows(seed, docs, alphabet="abé", extra=("Café", "ÀÉÎõü")):
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choice(alphabet) for _ in range(min(9, 3 + int(rng.paretovariate(1)))))
    return [(d, " ".join(pick() if rng.random() < 0.9 else rng.choice(extra) for _ in range(120))) for d in range(docs)]


@pytest.mark.parametrize("limit", [5_000, 7, 1])
def test_equals_all_pairs(spark, limit):
    rows = random_rows(limit, 60)
    assert got(spelling_variants(table(spark, rows), limit=limit)) == plain(rows)


def test_other_settings_keep_every_word(spark):
    rows = random_rows(3, 5)
    found = spelling_variants(table(spark, rows), min_chars=1, min_count=1, noise=2**40).collect()
    words = Counter(re.findall("[a-zÀ-ÿ]+", "\n".join(t for _, t in rows).translate({i: i + 32 for i in range(65, 91)})))
    assert {r.word: r.n for r in found} == words


def test_acceptor_pairs_and_size():
    rng = random.Random(5)
    for _ in range(30):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(40)})
        pairs = list(Acceptor(words).one_edit_pairs())
        assert len(pairs) == len(set(map(frozenset, pairs)))
        assert {frozenset(p) for p in pairs} == {frozenset((u, v)) for u in words for v in words if one_edit(u, v)}
    # all words over two letters up to length 6 need one state per length only
    full = sorted(["".join(w) for k in range(7) for w in itertools.product("ab", repeat=k)])
    assert len(Acceptor(full).final) == 7


def test_many_words_with_one_start(spark):
    """A third of all words start alike: their state is divided again and again."""
    words = [("start" + "".join(chr(97 + i // 26**k % 26) for k in range(3)), 3 + i % 9) for i in range(0, 17_576, 3)] + [(f"other{chr(97 + i % 26)}{i % 5}x", 4) for i in range(60)]
    words = sorted(dict(words).items())
    found = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(spark.createDataFrame(words, "word string, n long").repartition(4), limit=200).collect()}
    n, masks = dict(words), {}
    for w in n:
        for i in range(len(w)):
            masks.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    near = {}
    for group in masks.values():
        for u in group:
            near.setdefault(u, set()).update(v for v in group if v != u)
    best = {u: min((-n[x], x) for x in v) for u, v in near.items() if v}
    assert found == {u: (len(near[u]), -low, v) for u, (low, v) in best.items()}


def test_odd_tables(spark):
    assert spelling_variants(table(spark, []).limit(0)).collect() == []
    rows = [(None, None), (None, ""), (1, "12 ,.;")] + [(None, "Wörter wörter WÖRTER worter worter worter")] * 3 + [(7, "x" * 120_000 + " " + "x" * 119_999)] * 3 + [(7, "×÷×÷×")] * 4
    assert got(spelling_variants(table(spark, rows))) == plain(rows)

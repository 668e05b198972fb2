import random
from collections import Counter

import numpy as np
import pytest

from marktrace.llm.suffixes import difference_cover_order, intervals, remove_repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((i, len(t), int(gone.sum()), tuple(intervals(gone)), bytes(np.frombuffer(t, dtype=np.uint8)[~gone])))
    return sorted(out, key=str)


def texts():
    rng = random.Random(2)
    base = ["".join(rng.choice("ab \n") for _ in range(400)) for _ in range(4)]
    out = []
    for i in range(50):
        t = "".join(rng.choice("abc é\0") for _ in range(rng.randrange(200)))
        if i % 3 == 0:
            b, a = rng.choice(base), rng.randrange(300)
            t += b[a : a + rng.randrange(100)] + t[:50]
        out.append(t)
    out += ["a" * 500, "", None, "ab" * 200, out[5], out[5], "日本語" * 40, "x" * 200, "x" * 199]
    return [*enumerate(out), (None, out[7]), (3, out[3]), (4, out[8])]


@pytest.mark.parametrize(("length", "gram", "stretches"), [(40, 12, 2000), (40, 12, 1), (30, 8, 2000), (200, 20, 2000)])
def test_against_brute_force(frame, length, gram, stretches):
    rows = texts()
    got = remove_repeats(frame(rows), length, gram, stretches).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in got), key=str) == brute(rows, length)


def test_empty_table(frame):
    assert remove_repeats(frame([])).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 6, 7, 50, 301, 2000):
        for letters in (1, 2, 5, 200):
            s = rng.integers(1, letters + 1, n)
            assert difference_cover_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())

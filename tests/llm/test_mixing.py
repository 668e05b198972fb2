"""Mixing against a plain walk of each source in hash order, and its promises on odd tables."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from marktrace.llm.mixing import mix_sources, source_sizes, targets

SCHEMA = "doc_id long, text string, source string, size string, k string, row string, segments string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, "a", "b", "c", "d") for i, t, s in rows], SCHEMA).repartition(parts)


def plain(rows, weights=(3, 1, 2), share=1.5, most=2, tolerance=0.001):
    """(doc_id, source) -> list of (size, target, taken), by pouring and by walking."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted([s for s in total if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if most * total[s] < level * weight[s]}
        for s in full or free:
            target[s] = most * total[s] if full else level * weight[s]
            left -= target[s] if full else 0
        free -= full or free
    out = []
    for s in order:
        base = int(target[s] // total[s]) if total[s] else 0
        rest, tol = int(target[s] - base * total[s]), int(target[s] * tolerance)
        cap = float("inf") if rest > tol else 0
        key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=key):
            n, more = size(t), 0
            if 0 < n <= cap:
                if n <= rest:
                    rest, more = rest - n, 1
                else:
                    cap = rest if rest > tol else 0
            out.append((d, s, n, total[s], round(target[s], 6), (base + more) * n))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def random_rows(seed, n, n_sources):
    rng = random.Random(seed)
    names = [None, "", *(f"é{i}" if i % 2 else f"S{i}" for i in range(n_sources))]
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(0.6)) % 3000)) or None, names[0 if rng.random() < 0.3 else rng.randrange(len(names))]) for i in range(n)]


@pytest.mark.parametrize("seed, n, n_sources", [(1, 400, 5), (2, 60, 1), (3, 300, 40)])
def test_equals_plain_walk(spark, seed, n, n_sources):
    rows = random_rows(seed, n, n_sources)
    assert got(mix_sources(table(spark, rows))) == plain(rows)


def test_near_targets_and_reruns_agree(spark):
    rows = random_rows(7, 1500, 6)
    first = mix_sources(table(spark, rows))
    assert got(first) == got(mix_sources(table(spark, rows, parts=7)))
    taken, target = defaultdict(int), {}
    for r in first.collect():
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(0.015 * target[s], 3) for s in target)


def test_repeated_rows_are_split_exactly(spark):
    rows = [(5, "a b c d", "hot")] * 700 + [(None, "x\ty\x0bz", None)] * 300 + [(9, "only one", "cold")]
    by = defaultdict(int)
    target = {}
    for r in mix_sources(table(spark, rows)).collect():
        by[r.source] += r.taken
        target[r.source] = r.target
    assert all(target[s] - by[s] < max(5, 0.001 * target[s] + 4) and by[s] <= target[s] for s in by)


def test_odd_tables(spark):
    assert mix_sources(table(spark, []).limit(0)).collect() == []
    only_empty = mix_sources(table(spark, [(1, None, "a"), (2, "", None), (3, " \t\n", "b")])).collect()
    assert [(r.size, r.target, r.taken) for r in only_empty] == [(0, 0.0, 0)] * 3
    long = [(1, "w " * 200_000, "a"), (2, "v " * 10, "a"), (3, "u", "b")]
    assert got(mix_sources(table(spark, long))) == plain(long)
    carried = mix_sources(table(spark, [(1, "a b", "s")]), carry=("text", "k"))
    assert carried.columns[-2:] == ["text", "k"] and carried.first().k == "b"
    with pytest.raises(ValueError):
        mix_sources(table(spark, long), carry=("size",))


def test_targets_stop_and_reshare(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    found = {r.source: r.target for r in targets(source_sizes(rows, (3, 1, 2)), 1.5, 2).collect()}
    # a and the source without name stop at twice their size; the rest, 3022.5 - 30, is shared 1 : 2
    assert found == {"a": 20.0, None: 10.0, "b": 997.5, "c": 1995.0}
    more = {r.source: r.target for r in targets(source_sizes(rows, (3, 1, 4)), 1.5, 2).collect()}
    # now c stops, too, and what is left goes to b
    assert more == {"a": 20.0, None: 10.0, "b": 992.5, "c": 2000.0}

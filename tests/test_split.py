"""Group split by runs of equal sizes against the sequential rule."""

import random

import numpy as np
import pytest

from marktrace.operators.windows import Shares, group_split


def one_by_one(sizes, fractions):
    want = np.array(list(fractions.values())) * sum(n for _, n in sizes)
    filled, out = np.zeros(len(want), dtype="int64"), {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        slot = int(np.argmax(want - filled))
        filled[slot] += n
        out[name] = list(fractions)[slot]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shares_pick_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        want = rng.choice([rng.random(3) * 100, np.array([0.7, 0.15, 0.15]) * rng.integers(1, 500), np.array([10.0, 10.0, 10.0])])
        filled, n, m = rng.integers(0, 40, len(want)), int(rng.integers(1, 9)), int(rng.integers(1, 60))
        now, expected = filled.copy(), []
        for _ in range(m):
            slot = int(np.argmax(want - now))
            now[slot] += n
            expected.append(slot)
        shares, column = Shares(want), filled[:, None]
        assert shares.picked(np.repeat(column, m, axis=1), np.full(m, n), np.arange(m)).tolist() == expected
        assert [int(shares.first(j, column, np.array([n]), np.array([m]))[0]) for j in range(len(want))] == [expected.count(j) for j in range(len(want))]


def test_split_equals_fold_on_random_sizes(spark):
    rng = random.Random(8)
    sizes = [(f"g{i}é" if i % 3 else f"G{i}", max(1, int(rng.paretovariate(0.9)) % 50)) for i in range(400)] + [(None, 7)]
    rows = [(g,) for g, n in sizes for _ in range(n)]
    fractions = {"train": 0.7, "validation": 0.15, "test": 0.15}
    df = spark.createDataFrame(rows, "g string").repartition(5)
    named = [("" if g is None else g, n) for g, n in sizes]
    got = {r.g or "": r.split for r in group_split(df, "g", fractions).collect()}
    assert got == one_by_one(named, fractions)
    assert group_split(df.limit(0), "g", fractions).collect() == []

"""The conversation trie against a dictionary of prefixes, with segments and containers small enough to be crossed."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from marktrace.llm.tries import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, words string, head string, depth string, ends string"
KEY = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(parts)


def plain(rows):
    turns = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            turns[c].append(((n is not None, n or 0), KEY(r or "", t or ""), r or "", t or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        new = tuple(turns.get(base, [])[:h]) + tuple(own[h:])
        for d in range(len(new) + 1):
            members[new[:d]].append((c, len(new) == d))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        own = (n - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        kids = [sums[k] for k in children[p]]
        sums[p] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
        ids = sorted(c for c, ends in members[p] if ends)
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in members[p]), len(p), up, n, len(kids), *sums[p], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def random_rows(seed, convs, longest, texts=3):
    rng = random.Random(seed)
    return [(c, i if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "hi there\tyou", None, "ok", "é ü\x0bx"][: texts + 2])) for c in range(convs) for i in range(rng.randint(0, longest))]


@pytest.mark.parametrize("segment, limit", [(100_000, 3), (2, 20_000), (1, 1), (3, 5)])
def test_equals_prefix_dictionary(spark, segment, limit):
    rows = random_rows(segment * 7 + limit, 60, 7)
    assert got(conversation_trie(table(spark, rows), segment=segment, limit=limit)) == plain(rows)


def test_hot_first_turn_and_copies(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(200) for i in range(4)] + [(c, 0, "user", "t0") for c in range(200, 300)] + [(c, i, "user", f"{c % 7}{i}") for c in range(300, 360) for i in range(3)]
    assert got(conversation_trie(table(spark, rows), limit=10)) == plain(rows)


def test_long_conversation(spark):
    """One conversation holds most turns: it is cut into segments, and its order comes from slices of the hot key."""
    rows = [(40, i, "user", f"t{i % 11}") for i in range(3000)] + [(41, i, "user", f"t{i % 11}") for i in range(40)] + [(42, None, None, None)]
    spark.conf.set("marktrace.sliceRows", "500")
    try:
        assert got(conversation_trie(table(spark, rows), segment=700, limit=50)) == plain(rows)
    finally:
        spark.conf.unset("marktrace.sliceRows")


def test_odd_tables(spark):
    assert conversation_trie(table(spark, []).limit(0)).collect() == []
    assert conversation_trie(table(spark, [(None, 1, "user", "x")])).collect() == []
    # turnless once rebuilt: 1's first turn is replaced by the turns of 0, which has none
    lone = [(c, 0, "u", "x") for c in range(1, 8)]
    assert got(conversation_trie(table(spark, lone))) == plain(lone)
    repeated = [(20, 1, "u", "same text")] * 3 + [(-21, 1, "u", "same text"), (-20, 1, "u", "b" * 300_000), (10**15, 2, None, "x y")]
    assert got(conversation_trie(table(spark, repeated))) == plain(repeated)

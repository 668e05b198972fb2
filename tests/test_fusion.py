"""Fusion fixtures with an invented grammar and a plain Python twin of the position choice."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest

from marktrace.operators import fusion as U

GOOD = "KDTA5C1230"
LETTERS, DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "0123456789"
ALLOWED = {1: "K", 2: "D", 3: "T", 4: LETTERS, 5: "CD5", 6: LETTERS, 7: DIGITS, 8: DIGITS, 9: DIGITS, 10: DIGITS}
PARAMS = U.FusionParams(length=10, models=("M1",), constants={1: "K"}, prefixes={"KD": "M1"}, prefix_width=2, trusted_variants=("raw", "sharp"), risky=(4, 5), serial=(7, 8, 9, 10), key=5, suspects="0", rescue_raw="6")
CONF = [("0", "D", 1), ("8", "B", 1), ("6", "C", 1), ("1", "T", 1)]


def fuse(spark, reads, params=PARAMS):
    rules = spark.createDataFrame([("M1", p, ch) for p, cs in ALLOWED.items() for ch in cs], "model string, pos int, allowed_char string")
    confusions = spark.createDataFrame(CONF, "char string, alt string, rank int")
    schema = "session_id string, read_seq int, crop_index int, evidence_group int, variant_name string, ocr_conf double, raw_text string, crop_quality double, variant_weight double"
    return {r.session_id: r for r in U.fuse_reads(spark.createDataFrame(reads, schema), rules, confusions, params).collect()}


def reads_of(session, texts):
    return [(session, i, g, g, v, c, t, 0.9, 1.0) for i, (g, v, c, t) in enumerate(texts)]


def test_gates(spark):
    clean = [(g, v, 0.98, GOOD) for g in (1, 2, 3) for v in ("raw", "sharp", "relief")]
    other = GOOD[:-1] + "7"
    rows = (
        reads_of("clean", clean)
        + reads_of("single", [(1, "raw", 0.98, GOOD)])
        + reads_of("badkey", [(g, "raw", 0.98, "KDTA0C1230") for g in (1, 2, 3)])
        + reads_of("conflict", [(1, "raw", 0.95, GOOD), (2, "sharp", 0.94, other)])
        + reads_of("short", [(1, "raw", 0.9, "KDTA5")])
    )
    got = fuse(spark, rows)
    assert (got["clean"].status, got["clean"].fused, got["clean"].model) == ("ACCEPT", GOOD, "M1")
    assert all(g.passed for g in got["clean"].gates.values()) and got["clean"].exact_groups == 3
    assert got["single"].status == "OCR_AMBIGUOUS" and got["single"].reasons == ["crops_or_consensus"]
    assert got["badkey"].status == "OCR_AMBIGUOUS" and "key_position" in got["badkey"].reasons
    assert got["conflict"].status == "OCR_AMBIGUOUS" and got["conflict"].conflict
    assert got["short"].status == "NO_READ" and got["short"].fused == ""


def test_single_read_opt_in(spark):
    got = fuse(spark, reads_of("s", [(1, "raw", 1.0, GOOD)]), replace(PARAMS, single_read=True, single_score=0.8))
    assert got["s"].status == "ACCEPT"


def test_direct_rescue(spark):
    """The key margin is thin, but nothing else allowed was read there and two groups read the text exactly."""
    rows = reads_of("r", [(1, "raw", 0.97, GOOD), (2, "sharp", 0.97, GOOD), (3, "relief", 0.97, "KDTAXC1230"), (4, "other", 0.97, "KDTAYC1230"), (4, "more", 0.97, "KDTAZC1230")])
    got = fuse(spark, rows, replace(PARAMS, key_margin=0.9, final_score=0.8))["r"]
    assert (got.fused, got.status, got.rescue, list(got.reasons)) == (GOOD, "ACCEPT", "DIRECT", [])
    # another allowed character at the key position forbids it
    rival = fuse(spark, rows + reads_of("r", [(5, "last", 0.3, "KDTACC1230")]), replace(PARAMS, key_margin=0.9, final_score=0.8))["r"]
    assert (rival.fused, rival.status, rival.rescue, list(rival.reasons)) == (GOOD, "OCR_AMBIGUOUS", None, ["key_position"])


def twin_choice(texts):
    """Evidence per position by the written rules."""
    near = defaultdict(set)
    for a, b, _ in CONF:
        near[a].add(b)
        near[b].add(a)
    out = ""
    for pos, allowed in ALLOWED.items():
        votes, first = defaultdict(float), {}
        for i, (_, _, conf, text) in enumerate(texts):
            votes[text[pos - 1]] += max(conf * 0.9, 1e-6)
            first.setdefault(text[pos - 1], i)
        ev, at = defaultdict(float), {}
        for ch, w in votes.items():
            targets = sorted(n for n in near[ch] if n in allowed)
            if ch in allowed:
                moves = [(ch, w)]
            elif targets:
                moves = [(t, w * 0.6 / len(targets)) for t in targets]
            else:
                moves = [(ch, w * 0.5)]
            for t, x in moves:
                ev[t] += x
                at[t] = min(at.get(t, 99), first[ch])
        best = min(ev, key=lambda ch: (-round(ev[ch], 9), at[ch], ch))
        out += "K" if pos == 1 else best
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 3])
def test_position_choice_equals_twin(spark, sliced, slice_rows):
    sliced(slice_rows)
    rng = random.Random(11)
    rows, want = [], {}
    for s in range(40):
        texts = []
        for _ in range(rng.randint(1, 8)):
            text = "".join(rng.choice("0168BDTC5") if rng.random() < 0.25 else ch for ch in GOOD)
            texts.append((rng.randint(1, 3), rng.choice(["raw", "sharp", "relief"]), rng.choice([0.31, 0.57, 0.83, 0.97]), text))
        rows += reads_of(f"s{s}", texts)
        want[f"s{s}"] = twin_choice(texts)
    got = fuse(spark, rows)
    assert {k: r.fused for k, r in got.items()} == want


@pytest.mark.parametrize("distance, task_edges", [(2, 200_000), (2, 0), (5, 40)])
def test_near_duplicates_greedy(spark, distance, task_edges):
    """Whole 64-bit hashes, equal ones, none, and a chain whose members decide one after the other."""
    from marktrace.operators.disagreement import near_duplicate_groups

    rng = random.Random(3)
    rows, want, signed = [], {}, lambda v: v - (1 << 64) if v >> 63 else v
    pool = [rng.getrandbits(64) for _ in range(6)]
    for k in range(3):
        reps, drift = [], rng.getrandbits(64)
        for i in range(60):
            drift ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            near = rng.choice(pool) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
            h = rng.choice([None, near, near, drift, drift, pool[0], (1 << 64) - 1])
            rows.append((k, i, None if h is None else signed(h)))
            hit = None if h is None else next((j for v, j in reps if (v ^ h).bit_count() <= distance), None)
            if h is not None and hit is None:
                reps.append((h, i))
            want[(k, i)] = i if hit is None else hit
    df = spark.createDataFrame(rows, "k int, i long, h long")
    got = near_duplicate_groups(df, ["k"], "h", "i", distance, task_edges).collect()
    assert {(r.k, r.i): r.representative for r in got} == want


LONG = {i: LETTERS + DIGITS for i in range(1, 18)} | {1: "K", 2: "DE", 3: "T", 4: LETTERS, 5: "CD5", 9: DIGITS, 13: LETTERS} | {i: DIGITS for i in range(14, 18)}


def long_session(rng, s):
    """Reads of one 17-character text with misreads, more of them in some sessions and at the key position."""
    truth = "".join(rng.choice(LONG[i]) for i in range(1, 18))
    noise, rows = rng.choice([0.0, 0.02, 0.1]), []
    for i in range(rng.randint(0, 9)):
        text = "".join(rng.choice("0168BDTC5K") if rng.random() < (noise * 3 if k == 4 else noise) else ch for k, ch in enumerate(truth))
        text = text[:-1] if rng.random() < 0.05 else text.lower() if rng.random() < 0.1 else text
        group = rng.randint(1, 3)
        rows.append((f"s{s}", i, group, group, rng.choice(["raw", "sharp", "raw@3", "relief", "sharp@-3"]), rng.choice([0.31, 0.57, 0.83, 0.915, 0.97]), text, rng.choice([0.4, 0.9, 1.0]), rng.choice([0.0, 0.8, 1.0])))
    return rows or [(f"s{s}", 0, 1, 1, "raw", 0.9, "short", 1.0, 1.0)]


def test_grouped_twin_equals_expressions(spark):
    """10,000 random sessions of 17 positions: status, gates, both rescues and mean confidence by two implementations."""
    from marktrace.operators.fusion_twin import RESULT, fuse_groups

    rng = random.Random(29)
    p = U.FusionParams(
        models=("M1", "M2"), constants={1: "K", 3: "T"}, prefixes={"KD": "M1", "KE": "M2"}, prefix_width=2, trusted_variants=("raw", "sharp"), risky=(5, 10), serial=(14, 15, 16, 17), key=5,
        suspects="08", rescue_raw="6", final_score=0.75, single_read=True, single_score=0.9, rescue_b_score=0.7, rescue_b_support=0.7, rescue_conf=0.5,
    )
    rows = [r for s in range(10_000) for r in long_session(rng, s)]
    schema = "session_id string, read_seq int, crop_index int, evidence_group int, variant_name string, ocr_conf double, raw_text string, crop_quality double, variant_weight double"
    reads = spark.createDataFrame(rows, schema).repartition(8)
    rules = spark.createDataFrame([(m, i, ch) for m in ("M1", "M2") for i, cs in LONG.items() for ch in (cs if m == "M1" or i != 5 else "D56")], "model string, pos int, allowed_char string")
    confusions = spark.createDataFrame([*CONF, ("6", "D", 2), ("5", "S", 1)], "char string, alt string, rank int")
    names = [f.split()[0] for f in RESULT.split(", ")]
    twin = {r.session_id: r for r in fuse_groups(reads, rules, confusions, p).collect()}
    got = {r.session_id: r for r in U.fuse_reads(reads, rules, confusions, p).select("session_id", *names).collect()}
    assert set(got) == set(twin) and len(got) == 10_000
    for s, row in got.items():
        for n in names:
            a, b = row[n], twin[s][n]
            # the mean confidence has three digits, and its sum is made in another order
            assert a == pytest.approx(b, abs=1.01e-3 if n == "exact_mean_conf" else 1e-9) if isinstance(a, float) else a == b, (s, n, a, b)
    kinds = {(r.status, r.rescue) for r in got.values()}
    assert kinds >= {("ACCEPT", None), ("ACCEPT", "DIRECT"), ("ACCEPT", "STRUCTURE"), ("OCR_AMBIGUOUS", None), ("NO_READ", None)}
    failing = {g for r in got.values() for g in r.reasons or []}
    assert failing >= {"final_score", "crops_or_consensus", "structurally_valid", "risky_margin", "variable_margin", "serial_margin", "exact_conflict", "key_position"}


@pytest.mark.parametrize("slice_rows", [10_000, 5])
def test_twin_decides_many_sessions_at_once(spark, sliced, monkeypatch, slice_rows):
    """Sessions meet in small chunks, some with unknown confidences, groups, variants, read numbers or id; a constant key position is rescued by structure."""
    from marktrace.operators import fusion_twin as X

    monkeypatch.setattr(X, "CHUNK_CELLS", 40)
    sliced(slice_rows)
    rng = random.Random(7)
    p = U.FusionParams(
        models=("M1", "M2"), constants={1: "K", 3: "T", 5: "C"}, prefixes={"KD": "M1", "KE": "M2"}, prefix_width=2, trusted_variants=("raw", "sharp"), risky=(5, 10), serial=(14, 15, 16, 17), key=5,
        suspects="08", rescue_raw="6", final_score=0.3, key_margin=0.9, serial_margin=0.0, rescue_b_score=0.3, rescue_b_support=0.5, rescue_conf=0.3,
    )
    rows = [r for s in range(600) for r in long_session(rng, s)]
    lost = lambda r, i: r[:i] + (None,) + r[i + 1 :]
    for i, share in ((1, 0.1), (3, 0.2), (4, 0.2), (5, 0.3), (8, 0.1), (7, 0.1)):
        rows = [lost(r, i) if rng.random() < share else r for r in rows]
    rows = [lost(r, 5) if r[0][-1] in "369" else r for r in rows]
    good = "KDTACC123A12C1230"
    key = lambda ch: good[:4] + ch + good[5:]
    rows += [("rescued", i, 1, i % 3, v, 0.9, key(ch), 1.0, 1.0) for i, (v, ch) in enumerate([("raw", "C"), ("sharp", "C"), ("raw", "6"), ("raw", "6"), ("sharp", "6"), ("relief", "D")])]
    rows += [(None, 1, 1, 1, "raw", 0.9, good, 1.0, 1.0), (None, 2, 1, 2, "sharp", 0.9, good.lower(), 1.0, 1.0)]
    schema = "session_id string, read_seq int, crop_index int, evidence_group int, variant_name string, ocr_conf double, raw_text string, crop_quality double, variant_weight double"
    reads = spark.createDataFrame(rows, schema).repartition(4)
    rules = spark.createDataFrame([(m, i, ch) for m in ("M1", "M2") for i, cs in LONG.items() for ch in (cs if m == "M1" or i != 5 else "D56C")], "model string, pos int, allowed_char string")
    confusions = spark.createDataFrame([*CONF, ("6", "D", 2), ("5", "S", 1)], "char string, alt string, rank int")
    names = [f.split()[0] for f in X.RESULT.split(", ")]
    grouped = X.fuse_groups(reads, rules, confusions, p)
    # one call for many sessions, and the reads are dealt out once
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and (slice_rows < 10_000 or plan.count("Exchange hashpartitioning") == 1)
    twin = {r.session_id: r for r in grouped.collect()}
    got = {r.session_id: r for r in U.fuse_reads(reads, rules, confusions, p).select("session_id", *names).collect()}
    assert set(got) == set(twin) and len(got) == 602
    for s, row in got.items():
        for n in names:
            a, b = row[n], twin[s][n]
            assert a == pytest.approx(b, abs=1.01e-3 if n == "exact_mean_conf" else 1e-9) if isinstance(a, float) else a == b, (s, n, a, b)
    assert (twin["rescued"].status, twin["rescued"].rescue) == ("ACCEPT", "STRUCTURE")
    assert {r.status for r in got.values()} == {"ACCEPT", "OCR_AMBIGUOUS", "NO_READ"}


def test_halves_round_up_as_decimals():
    import numpy as np
    from marktrace.operators.fusion_twin import half_up

    assert half_up(np.array([0.865, 0.8645, 1.0005, 2.0, 0.1234999999]), 3).tolist() == [0.865, 0.865, 1.001, 2.0, 0.123]
    assert half_up(np.array([5e-10, 4.9e-10, 123456789.1234567895, 0.3 - 0.1, 1e16]), 9).tolist() == [1e-9, 0.0, 123456789.12345679, 0.2, 1e16]


def test_choice_where_reads_agree_and_where_not(spark):
    """Positions of one character, allowed or not, overruled or not, and of several: as the rules written out give them."""
    texts = [(1, "raw", 0.9, "KDTA0C1230"), (2, "sharp", 0.9, "KDTA0C1230"), (3, "relief", 0.8, "XDTA0C8B30")]
    row = fuse(spark, reads_of("s", texts))["s"]
    at = {d.pos: d for d in row.decisions}
    # seen everywhere and allowed: no rival, all evidence
    assert (at[2].chosen, at[2].prob, at[2].margin, at[2].support, at[2].others, at[2].forced) == ("D", 1.0, 1.0, 3, [], False)
    # seen everywhere, not allowed: the look-alike takes it
    assert (at[5].raw_char, at[5].chosen, at[5].allowed, at[5].prob, at[5].seen, at[5].structure_corrected) == ("0", "D", True, 1.0, False, True)
    # a constant that one read has otherwise
    assert (at[1].chosen, at[1].forced, at[1].support, at[1].others) == ("K", True, 2, ["X"])
    # two allowed characters, and one with a disallowed one that moves to its look-alike
    weight = lambda c: max(c * 0.9, 1e-6)
    total = 2 * weight(0.9) + weight(0.8)
    assert at[7].chosen == "1" and at[7].margin == pytest.approx((2 * weight(0.9) - weight(0.8)) / total)
    moved = weight(0.8) * 0.6
    assert at[8].chosen == "2" and at[8].margin == pytest.approx((2 * weight(0.9) - moved) / (2 * weight(0.9) + moved))

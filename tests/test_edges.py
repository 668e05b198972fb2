"""Signal fixtures and a step-by-step twin of the debouncer."""

import random

import pytest
from pyspark.sql import functions as F

from marktrace.operators import edges as E
from marktrace.operators.ordered import order_rows

P = E.DebounceParams()


def pulse(low_ms, high_ms, tail_ms=1000, start=0):
    levels = [0] * (low_ms // 100) + [1] * (high_ms // 100) + [0] * (tail_ms // 100)
    return [("st1", start + 100 * i, v) for i, v in enumerate(levels)]


def edges_of(spark, rows):
    df = spark.createDataFrame(rows, "station_id string, ts_ms long, raw int")
    out = E.pulse_widths(E.debounce_edges(df, ["station_id"], P), P).plain().orderBy("ts_ms")
    return out.collect()


@pytest.mark.parametrize("high,decision", [(3000, "FALLING"), (1000, "INVALID_PLC_PULSE"), (5000, "INVALID_PLC_PULSE"), (150, None)])
def test_pulse_width_band(spark, high, decision):
    got = edges_of(spark, pulse(1000, high))
    if decision is None:
        assert got == []
    else:
        assert [r.edge_type for r in got] == ["RISING", "FALLING"]
        assert got[1].pulse_decision == decision
        assert abs(got[1].pulse_width_ms - high) <= 100


@pytest.mark.parametrize("gap_s,second", [(20, "SUSPICIOUS_EARLY_TRIGGER"), (89, "SUSPICIOUS_EARLY_TRIGGER"), (90, "ACCEPTED"), (91, "ACCEPTED")])
def test_interval_gate(spark, gap_s, second):
    df = spark.createDataFrame([("s", 0), ("s", gap_s * 1000)], "k string, ts_ms long")
    got = E.trigger_acceptance(order_rows(df, ["k"], ["ts_ms"]), E.TriggerParams()).orderBy("ts_ms").collect()
    assert [r.decision for r in got] == ["ACCEPTED", second]


def test_precedence_and_reference_point(spark):
    rows = [("s", 0, True, False), ("s", 10_000, False, True), ("s", 20_000, False, False), ("s", 60_000, False, False), ("s", 110_000, False, False)]
    df = spark.createDataFrame(rows, "k string, ts_ms long, hi boolean, act boolean")
    got = E.trigger_acceptance(order_rows(df, ["k"], ["ts_ms"]), E.TriggerParams(), "hi", "act").orderBy("ts_ms").collect()
    assert [r.decision for r in got] == ["STARTUP_HIGH", "DUPLICATE_TRIGGER_IGNORED", "ACCEPTED", "SUSPICIOUS_EARLY_TRIGGER", "ACCEPTED"]


def twin(rows, on, off):
    out, value, since, level = [], None, None, 0
    for t, v in rows:
        if v != value:
            value, since = v, t
        if v != level and t - since >= (on if v else off):
            level = v
            out.append((t, v))
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 17])
def test_debounce_equals_twin_on_random_timelines(spark, sliced, slice_rows):
    sliced(slice_rows)
    rng = random.Random(5)
    rows, want = [], set()
    for k in range(30):
        t, v, line = 0, 0, []
        for _ in range(60):
            t += rng.choice([50, 100, 100, 250])
            v = 1 - v if rng.random() < 0.3 else v
            line.append((t, v))
        rows += [(k, *x) for x in line]
        want |= {(k, *x) for x in twin(line, 300, 300)}
    df = spark.createDataFrame(rows, "k int, ts_ms long, raw int")
    got = E.debounce_edges(df, ["k"], P).plain().select("k", "ts_ms", "value").collect()
    assert {tuple(r) for r in got} == want


def test_ring_context_holds_the_last_seven_seconds(spark):
    df = spark.createDataFrame(pulse(9000, 3000), "station_id string, ts_ms long, raw int")
    e = E.debounce_edges(df, ["station_id"], P).plain()
    ring = E.ring_context(df, e.filter("value = 1"), ["station_id"]).first()
    assert len(ring.ring) == 71 and ring.ring[-1].ts == ring.ts_ms and ring.ring[0].ts == ring.ts_ms - 7000


def test_null_key_is_one_key(spark, sliced):
    sliced(10)
    df = spark.createDataFrame([(None if i % 2 else 1, i) for i in range(200)], "k int, ts long")
    from marktrace.operators.ordered import ranked

    rows = order_rows(df, ["k"], ["ts"])
    assert rows.hot
    assert ranked(rows).plain().groupBy("k").agg(F.max("rn").alias("m")).orderBy("k").collect() == [(None, 100), (1, 100)]

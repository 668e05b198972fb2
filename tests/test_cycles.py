"""Capture cycles: the state machine on golden cases, the stream against the machine, and all ends and verdicts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marktrace.plans.cycles import CycleParams
from marktrace.streaming.ownership import Cycle, map_state, stream_cycles
from marktrace.streaming.run import drain_slices

FIELDS = ["at_ms", "event_id", "kind", "session_id", "value", "confidence", "waited_ms"]


def play(p, events, clock=None):
    """Records of one station, as {(record, id): (verdict or end, cause, status, identifier, tag)}."""
    machine = Cycle(p, None, None, None, {}, lambda sid: False)
    rows = [(at, i, kind, *(rest + (None,) * 3)[:3], waited) for i, (at, kind, waited, *rest) in enumerate(events, 1) for rest in [tuple(rest)]]
    machine.take(pd.DataFrame(rows, columns=FIELDS, dtype=object), clock)
    ends = {r[1]: (r[6], r[7], r[8], r[10], r[12]) for r in machine.rows if r[0] == "session"}
    verdicts = {r[2]: r[3] for r in machine.rows if r[0] != "session"}
    return ends, verdicts


EXIT = CycleParams(min_interval_ms=2_000)


def test_grace_session_and_next_one_are_open_at_once():
    ends, verdicts = play(EXIT, [(10, "trigger", 0), (5_000, "exit", 0), (5_500, "trigger", 0), (6_000, "id", 0, 1, "A", 0.5), (6_100, "id", 0, 3, "B", 0.6), (7_500, "tag", 0, 1, "t"), (7_501, "id", 0, 1, "C", 0.9), (90_000, "clock", 0)])
    assert verdicts == {1: "ACCEPTED", 3: "ACCEPTED", 4: "ACCEPTED", 5: "ACCEPTED", 6: "ACCEPTED", 7: "FINALIZED_REJECTED"}
    # a result exactly at the end of grace still counts and completes the session
    assert ends[1] == (7_500, "EXIT_COMPLETE", "SUCCESS", "A", "t") and ends[3] == (35_500, "EXIT_TIMEOUT", "PARTIAL_SUCCESS", "B", "NO_TAG")


def test_duplicates_early_triggers_and_missed_window():
    ends, verdicts = play(CycleParams(), [(10, "trigger", 0), (20, "trigger", 0), (1_000, "exit", 0), (50_000, "trigger", 0), (90_010, "trigger", 4_001), (90_011, "id", 0, 5, "X", 1.0), (200_000, "clock", 0)])
    assert verdicts == {1: "ACCEPTED", 2: "DUPLICATE_TRIGGER_IGNORED", 4: "SUSPICIOUS_EARLY_TRIGGER", 5: "ACCEPTED", 6: "FINALIZED_REJECTED"}
    assert ends[1][:3] == (3_500, "GRACE_EXPIRED", "TIMEOUT") and ends[5][:4] == (90_010, "MISSED_CAPTURE_WINDOW", "MISSED_CAPTURE_WINDOW", "NO_READ")


def test_handover_keeps_results_and_mismatch_does_not():
    p = CycleParams(min_interval_ms=2_000)
    events = [(10, "trigger", 0), (3_000, "handover", 0), (4_000, "trigger", 0), (5_000, "id", 0, 1, "A", 0.5), (6_000, "id", 0, 9, "Z", 0.5)]
    assert play(p, events)[1] == {1: "ACCEPTED", 3: "ACCEPTED", 4: "ACCEPTED", 5: "UNKNOWN_SESSION"}
    free = CycleParams(min_interval_ms=2_000, cycle_guard=False)
    assert play(free, [events[0], *events[2:]])[1] == {1: "ACCEPTED", 2: "ACCEPTED", 3: "SESSION_MISMATCH", 4: "UNKNOWN_SESSION"}
    shut = CycleParams(grace_allowed=False)
    assert play(shut, [(10, "trigger", 0), (20, "exit", 0), (30, "id", 0, 1, "A", 0.5)])[1][3] == "LATE"


@pytest.mark.parametrize(
    "hold, events, end",
    [
        (False, [(10, "trigger", 0), (50, "id", 0, 1, "A", 0.5), (60, "tag", 0, 1, "t"), (99_999, "clock", 0)], (60, "EARLY_COMPLETE", "SUCCESS", "A", "t")),
        (False, [(10, "trigger", 0), (50, "id", 0, 1, "A", 0.5), (99_999, "clock", 0)], (30_010, "TIMEOUT", "TIMEOUT", "A", "NO_TAG")),
        (True, [(10, "trigger", 0), (50, "id", 0, 1, "A", 0.5), (60, "tag", 0, 1, "t"), (99_999, "clock", 0)], (30_010, "HARD_DEADLINE", "SUCCESS", "A", "t")),
        # a read in flight at the deadline moves it, and its result ends the session
        (True, [(10, "trigger", 0), (60, "tag", 0, 1, "t"), (29_000, "read", 0, 1), (40_000, "id", 0, 1, "A", 0.5), (99_999, "clock", 0)], (40_000, "HARD_DEADLINE", "SUCCESS", "A", "t")),
        (True, [(10, "trigger", 0), (29_000, "read", 0, 1), (40_000, "read_end", 0, 1), (99_999, "clock", 0)], (40_000, "HARD_DEADLINE", "TIMEOUT", "NO_READ", "NO_TAG")),
        (True, [(10, "trigger", 0), (29_000, "read", 0, 1), (99_999, "clock", 0)], (45_010, "HARD_DEADLINE", "TIMEOUT", "NO_READ", "NO_TAG")),
        (True, [(10, "trigger", 0), (29_000, "read", 0, 1), (29_500, "read_end", 0, 1), (99_999, "clock", 0)], (30_010, "HARD_DEADLINE", "TIMEOUT", "NO_READ", "NO_TAG")),
    ],
)
def test_single_signal_modes(hold, events, end):
    assert play(CycleParams(exit_mode=False, hold_to_deadline=hold), events)[0] == {1: end}


def test_events_behind_the_clock_are_late():
    ends, verdicts = play(EXIT, [(10_000, "trigger", 0), (9_000, "trigger", 0), (9_500, "id", 0, 1, "A", 0.5), (10_500, "id", 0, 1, "B", 0.5)])
    assert verdicts == {1: "ACCEPTED", 3: "LATE", 4: "ACCEPTED"}


@pytest.mark.parametrize("p", [EXIT, CycleParams(exit_mode=False, min_interval_ms=100), CycleParams(exit_mode=False, hold_to_deadline=True, min_interval_ms=100, inflight_ms=2_000)])
def test_stream_equals_machine(spark, p):
    """Random events of several stations in four micro-batches; timers end sessions without a further event of the station."""
    rng = random.Random(p.exit_mode + 2 * p.hold_to_deadline)
    rows, at, ids = [], 1_000_000, 0
    for _ in range(400):
        at, ids = at + rng.choice([0, 10, 900, 4_000]), ids + 1
        kind = rng.choice(["trigger", "trigger", "exit", "handover", "id", "tag", "id", "tag", "read", "read_end", "clock"])
        named = ids - rng.randint(1, 40) if kind in ("id", "tag", "read", "read_end") else None
        rows.append((at, ids, kind, named, f"v{ids}" if kind in ("id", "tag") else None, 0.5 if kind == "id" else None, float(rng.choice([0, 0, 9_000])) if kind == "trigger" else None, f"s{rng.randrange(3)}"))
    schema = "at_ms long, event_id long, kind string, session_id long, value string, confidence double, waited_ms double, station string"
    want = []
    for station in ("s0", "s1", "s2"):
        machine = Cycle(p, None, None, None, {}, lambda sid: False)
        machine.take(pd.DataFrame([r[:7] for r in rows if r[7] == station], columns=FIELDS, dtype=object), None)
        machine.pass_time(at + 10**6)
        want += [(station, *r) for r in machine.rows]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("at_ms"))
    cut = [df.filter((F.col("event_id") > a) & (F.col("event_id") <= a + 100)) for a in range(0, 400, 100)]
    # only another station reports at the end, so these sessions end by their timers
    last = spark.createDataFrame([(at + 10**6, 10**6, "clock", None, None, None, None, "other")], schema).withColumn("ts", F.timestamp_millis("at_ms"))
    with map_state(spark):
        out = drain_slices([*cut, last], lambda s: stream_cycles(s.withWatermark("ts", "0 seconds"), ["station"], p), "cycles").collect()
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert plain(out) == plain(want)


def test_silence_is_told_by_the_clock(spark):
    """One feed goes on while the other is silent: the silent one is told without any further event of it, each once."""
    import threading
    import time

    from marktrace.session import scratch_path
    from marktrace.streaming.silence import drain_silence, stream_silence

    root = scratch_path(spark, "silence")
    write = lambda n, feeds: spark.createDataFrame([(f, 1_000 * n, 10 * n + i) for i, f in enumerate(feeds)], "feed string, at_ms long, event_id long").coalesce(1).write.mode("append").parquet(f"{root}/in")
    write(0, ["a", "b"])

    def go_on():
        for n in range(1, 6):
            time.sleep(1)
            write(n, ["a"])

    other = threading.Thread(target=go_on)
    other.start()
    with map_state(spark):
        stream = stream_silence(spark.readStream.schema("feed string, at_ms long, event_id long").parquet(f"{root}/in"), ["feed"], 6_000)
        told = {r.feed: (r.last_ms, r.last_event, r.events) for r in drain_silence(stream, root, 2, 90).collect()}
    other.join()
    assert told == {"a": (5_000, 50, 6), "b": (0, 1, 1)}


class Kept:
    """A state of one station that tells what was written."""

    def __init__(self, log, name):
        self.log, self.name, self.value, self.items = log, name, None, {}

    def exists(self):
        return self.value is not None or bool(self.items)

    def get(self):
        return self.value

    def update(self, value):
        self.log.append(self.name)
        self.value = value

    def iterator(self):
        return iter(list(self.items.items()))

    def containsKey(self, key):
        return key in self.items

    def updateValue(self, key, value):
        self.log.append(self.name)
        self.items[key] = value

    def removeKey(self, key):
        self.log.append(f"-{self.name}")
        del self.items[key]


def test_only_what_changed_is_written_back():
    """A station's events come as rows, and sessions, timers and head that stay as they are cost no call."""
    from pyspark.sql import Row

    from marktrace.streaming import ownership as O

    class Handle:
        def __init__(self):
            self.log = []

        def getValueState(self, name, schema):
            return Kept(self.log, name)

        def getMapState(self, name, key, value, **ttl):
            return Kept(self.log, name)

        def registerTimer(self, at):
            self.log.append(f"timer {at}")

        def deleteTimer(self, at):
            self.log.append(f"-timer {at}")

    handle, processor = Handle(), O.CycleProcessor(["station"], EXIT, None)
    processor.init(handle)
    event = Row(*FIELDS)

    def step(*events):
        handle.log.clear()
        out = list(processor.handleInputRows(("s",), iter([event(*e) for e in events]), None))
        return [r.asDict()["verdict"] if r.record != "session" else r.close_cause for r in out], sorted(handle.log)

    # a whole number beyond 2**53 comes back as it was
    big = 2**60 + 1
    assert step((6_000, big + 1, "trigger", None, None, None, 0), (5, 1, "clock", None, None, None, None)) == (["ACCEPTED"], ["head", "sessions", "timer 36001"])
    assert step((6_000, big + 2, "clock", None, None, None, None)) == ([], [])
    assert step((6_500, big + 3, "clock", None, None, None, None)) == ([], ["head"])
    assert step((7_000, big + 4, "id", big + 1, "A", None, None)) == (["ACCEPTED"], ["head", "sessions"])
    assert step((7_001, big + 5, "tag", big + 1, "t", None, None), (7_002, big + 6, "exit", None, None, None, None)) == (["ACCEPTED", "EXIT_COMPLETE"], ["-sessions", "-timer 36001", "ended", "head"])
    assert step((7_003, big + 7, "id", big + 1, "B", 0.5, None)) == (["FINALIZED_REJECTED"], ["head"])
    # a timer closes its session and is not deleted again
    step((20_000, big + 8, "trigger", None, None, None, 0))
    handle.log.clear()
    expired = type("Expired", (), {"getExpiryTimeInMs": lambda self: 50_001})()
    (row,) = processor.handleExpiredTimer(("s",), None, expired)
    assert (row.session_id, row.finalised_ms, row.close_cause) == (big + 8, 50_000, "EXIT_TIMEOUT") and sorted(handle.log) == ["-sessions", "ended", "head"]

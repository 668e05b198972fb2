"""Capture cycles as a stream: any number of sessions of a station may be open, results find theirs by id (ST2, ST3)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marktrace.plans.cycles import ACCEPTED, DUPLICATE, EARLY, MISSED, CycleParams

OUT = (
    "record string, session_id bigint, event_id bigint, verdict string, start_ms bigint, exit_ms bigint, finalised_ms bigint, close_cause string, "
    "status string, failure_reason string, identifier string, confidence double, tag string"
)
NAMES = [f.split()[0] for f in OUT.split(", ")]
OPEN = "start_ms bigint, exit_ms bigint, handed boolean, limit_ms bigint, moved boolean, reading boolean, identifier string, confidence double, tag string"
OPEN_NAMES = [f.split()[0] for f in OPEN.split(", ")]
EVENT = ("at_ms", "event_id", "kind", "session_id", "value", "confidence", "waited_ms")
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cycle:
    """The sessions of one station and what an event does to them; rows that leave are collected in ``rows``."""

    def __init__(self, p: CycleParams, last: int | None, owner: int | None, active: int | None, sessions: dict[int, dict], is_closed):
        self.p, self.last, self.owner, self.active, self.open, self.is_closed = p, last, owner, active, sessions, is_closed
        self.rows: list[tuple] = []
        self.closed: dict[int, int] = {}

    def _close(self, sid: int, at: int, cause: str) -> None:
        s, p = self.open.pop(sid), self.p
        has_id, has_tag = s["identifier"] is not None, s["tag"] is not None
        full = has_id and (has_tag or not p.tag_required)
        if cause == MISSED:
            status, reason = MISSED, MISSED
        elif full:
            status, reason = "SUCCESS", None
        elif p.exit_mode:
            status = "PARTIAL_SUCCESS" if has_id or has_tag else "TIMEOUT"
            reason = "VIN_OK_RFID_TIMEOUT" if has_id else "RFID_OK_VIN_TIMEOUT" if has_tag else "BOTH_TIMEOUT"
        else:
            status, reason = "TIMEOUT", "RESULT_TIMEOUT"
        tag = s["tag"] if has_tag else "NO_TAG" if p.tags_enabled else None
        ident, conf = (s["identifier"], s["confidence"]) if has_id else ("NO_READ", 0.0)
        self.rows.append(("session", sid, None, None, s["start_ms"], s["exit_ms"], at, cause, status, reason, ident, conf, tag))
        self.closed[sid] = at
        self.owner, self.active = (None if x == sid else x for x in (self.owner, self.active))

    def pass_time(self, now: int) -> None:
        """Close what has its limit behind it; under hold a read in flight moves the limit once."""
        p = self.p
        while due := [(s["limit_ms"], sid) for sid, s in self.open.items() if s["limit_ms"] < now]:
            limit, sid = min(due)
            s = self.open[sid]
            if not p.exit_mode and p.hold_to_deadline and s["reading"] and s["identifier"] is None and not s["moved"] and p.inflight_ms > 0:
                s["moved"], s["limit_ms"] = True, limit + p.inflight_ms
                continue
            cause = ("GRACE_EXPIRED" if s["exit_ms"] is not None else "EXIT_TIMEOUT") if p.exit_mode else "HARD_DEADLINE" if p.hold_to_deadline else "TIMEOUT"
            self._close(sid, limit, cause)

    def _settle(self, sid: int, at: int) -> None:
        s, p = self.open[sid], self.p
        full = s["identifier"] is not None and (s["tag"] is not None or not p.tag_required)
        if full and p.exit_mode and s["exit_ms"] is not None:
            self._close(sid, at, "EXIT_COMPLETE")
        elif full and not p.exit_mode and not p.hold_to_deadline and self.active == sid:
            self._close(sid, at, "EARLY_COMPLETE")

    def trigger(self, sid: int, at: int, waited: float | None) -> None:
        p = self.p
        if p.cycle_guard and self.owner is not None:
            verdict = DUPLICATE
        elif self.last is not None and at < self.last + p.min_interval_ms:
            verdict = EARLY
        else:
            verdict, self.last, self.owner, self.active = ACCEPTED, at, sid, sid
            self.open[sid] = {"start_ms": at, "exit_ms": None, "handed": False, "limit_ms": at + p.deadline_ms, "moved": False, "reading": False, "identifier": None, "confidence": None, "tag": None}
            if waited is not None and waited > p.max_wait_ms:
                self._close(sid, at, MISSED)
        self.rows.append(("trigger", sid, sid, verdict, *[None] * 9))

    def left(self, at: int) -> None:
        """Exit signal: the newest session goes into grace; its capture is free."""
        sid = self.active
        if self.p.exit_mode and sid in self.open and self.open[sid]["exit_ms"] is None:
            self.open[sid].update(exit_ms=at, limit_ms=at + self.p.grace_ms)
            self.active, self.owner = None, None if self.owner == sid else self.owner
            self._settle(sid, at)

    def handover(self) -> None:
        if self.owner in self.open:
            self.open[self.owner]["handed"] = self.open[self.owner]["exit_ms"] is None
            self.owner = None

    def reading(self, sid: int, at: int, on: bool) -> None:
        if sid in self.open:
            s = self.open[sid]
            s["reading"] = on
            if not on and s["moved"]:
                self._close(sid, at, "HARD_DEADLINE")

    def result(self, sid: int | None, event: int, at: int, kind: str, value: str | None, confidence: float | None, late: bool) -> None:
        s, p = self.open.get(sid), self.p
        if s is None:
            known = sid is not None and (sid in self.closed or self.is_closed(sid))
            verdict = "FINALIZED_REJECTED" if known else "UNKNOWN_SESSION"
        elif late:
            verdict = "LATE"
        elif s["exit_ms"] is not None:
            verdict = ACCEPTED if p.grace_allowed else "LATE"
        elif s["handed"] or self.active == sid:
            verdict = ACCEPTED
        else:
            verdict = "SESSION_MISMATCH"
        self.rows.append(("result", sid, event, verdict, *[None] * 9))
        if verdict == ACCEPTED:
            if kind == "id" and s["identifier"] is None and value is not None:
                s["identifier"], s["confidence"] = value, confidence or 0.0
            elif kind == "tag" and s["tag"] is None:
                s["tag"] = value
            self._settle(sid, at)
        if kind == "id" and s is not None and not late:
            self.reading(sid, at, False)

    def take(self, events: Mapping[str, Sequence], clock: int | None) -> int | None:
        """Apply events, given by column, in order; those behind ``clock`` are late: results are told so, others change nothing."""
        number = lambda v: None if v is None or v != v else int(v)
        for at, event, kind, named, value, confidence, waited in zip(*(events[c] for c in EVENT)):
            at, event, sid = int(at), int(event), number(named)
            late = clock is not None and at < clock
            if not late:
                clock = at
                self.pass_time(at)
            if kind in ("id", "tag"):
                self.result(sid, event, at, kind, value, None if confidence != confidence else confidence, late)
            elif late:
                continue
            elif kind == "trigger":
                self.trigger(event, at, number(waited))
            elif kind == "exit":
                self.left(at)
            elif kind == "handover":
                self.handover()
            elif kind in ("read", "read_end"):
                self.reading(sid, at, kind == "read")
        return clock


class CycleProcessor(StatefulProcessor):
    """Keeps open sessions and the ids of closed ones as maps in the state store, with one timer per open limit.

    A station brings few events at a time, so they come and go as rows, and only what has changed is written back.
    """

    def __init__(self, keys: Sequence[str], p: CycleParams, remember_ms: int | None):
        self.keys, self.p, self.remember_ms = list(keys), p, remember_ms
        self.row = Row(*self.keys, *NAMES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last bigint, owner bigint, active bigint, clock bigint")
        self.sessions = handle.getMapState("sessions", "session_id bigint", OPEN)
        ttl = {} if self.remember_ms is None else {"ttlDurationMs": self.remember_ms}
        self.ended = handle.getMapState("ended", "session_id bigint", "at_ms bigint", **ttl)

    def _load(self) -> tuple[Cycle, int | None, tuple | None, dict[int, tuple]]:
        head = self.head.get()
        last, owner, active, clock = head or (None,) * 4
        # every station that has been seen has a head
        held = {k[0]: tuple(v) for k, v in self.sessions.iterator()} if head else {}
        opened = {sid: dict(zip(OPEN_NAMES, v, strict=True)) for sid, v in held.items()}
        return Cycle(self.p, last, owner, active, opened, lambda sid: self.ended.containsKey((sid,))), clock, head, held

    def _save(self, key: tuple, cycle: Cycle, clock: int | None, head: tuple | None, held: dict[int, tuple], fired: int | None = None) -> Iterator[Row]:
        for sid, at in cycle.closed.items():
            self.ended.updateValue((sid,), (at,))
            if sid in held:
                self.sessions.removeKey((sid,))
        for sid, s in cycle.open.items():
            if held.get(sid) != (now := tuple(s.values())):
                self.sessions.updateValue((sid,), now)
        if head != (now := (cycle.last, cycle.owner, cycle.active, clock)):
            self.head.update(now)
        limit = OPEN_NAMES.index("limit_ms")
        timers, due = {s[limit] + 1 for s in held.values()} - {fired}, {s["limit_ms"] + 1 for s in cycle.open.values()}
        for old in timers - due:
            self.handle.deleteTimer(old)
        for new in due - timers:
            self.handle.registerTimer(new)
        return iter([self.row(*key, *r) for r in cycle.rows])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cycle, clock, head, held = self._load()
        events = sorted(rows, key=lambda r: (r.at_ms, r.event_id))
        clock = cycle.take({c: [r[c] for r in events] for c in EVENT}, clock)
        return self._save(key, cycle, clock, head, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cycle, clock, head, held = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        cycle.pass_time(now)
        # the timer that has just fired is gone already
        return self._save(key, cycle, now if clock is None else max(now, clock), head, held, now)

    def close(self) -> None:
        pass


def stream_cycles(events: DataFrame, keys: Sequence[str], p: CycleParams, remember_ms: int | None = None) -> DataFrame:
    """Records ``session`` (one per session, when it ends), ``result`` (one per result, with its verdict) and ``trigger``.

    events: keys, at_ms, event_id, kind (trigger, exit, handover, id, tag, read, read_end; anything else moves time
    only), session_id (of results and reads), value, confidence, waited_ms (of triggers), and a watermarked time.
    Closed sessions are remembered for ``remember_ms`` of processing time, for ever without it; a result for a
    forgotten one is UNKNOWN_SESSION.
    """
    schema = T.StructType([*[events.schema[k] for k in keys], *T.StructType.fromDDL(OUT).fields])
    whole = {n: F.col(n).cast("bigint") for n in ("at_ms", "event_id", "session_id", "waited_ms")}
    return events.withColumns(whole).groupBy(*keys).transformWithState(CycleProcessor(keys, p, remember_ms), schema, "Append", "EventTime")


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, new streams use the state store that can keep maps and timers."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)

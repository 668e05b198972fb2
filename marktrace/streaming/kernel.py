"""Keyed streaming folds on event time, with the same step functions the batch folds use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string"
#: parts that keys are dealt to by their hash; checkpoints hold a state for each, so it must not change
PARTS = 1024
#: keys travel as text, exactly
AS_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Run:
    """Rows of one key by column, each a list that is made when it is asked for."""

    def __init__(self, column: Callable[[str], list], at: list[int], late: bool):
        self.column, self.at, self.late = column, at, late

    def __getitem__(self, name: str) -> list:
        if name == "late":
            return [self.late] * len(self.at)
        values = self.column(name)
        return [values[i] for i in self.at]

    def __len__(self) -> int:
        return len(self.at)


def stream_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, out: str, on_timer: Callable | None = None, timer_at: Callable | None = None) -> DataFrame:
    """Fold each key's rows in order; the state survives between micro-batches in the state store.

    ``step(state, run) -> (state, rows)``: ``run`` gives columns by name, ``rows`` are tuples of the columns in ``out``
    (keys are added). ``timer_at(state)`` gives the event time in ms at which ``on_timer(state, now_ms) -> (state, rows)``
    runs if no newer row came first. Rows of a key that arrive behind the last folded one go to ``step`` as a run with
    ``late`` set, so nothing is dropped silently.

    Keys are dealt to ``PARTS`` parts by their hash and a call folds a part's keys one after the other, so the cost of a
    call and of its state is shared. A task holds one part's rows of one micro-batch: its size is bounded by the source's
    admission limit (maxFilesPerTrigger / maxOffsetsPerTrigger).
    """
    keys, names = list(keys), [f.name for f in T.StructType.fromDDL(out).fields]
    key_type = T.StructType([T.StructField(k, stream.schema[k].dataType) for k in keys])
    ts = order[0]

    def run(part: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs() if timer_at else 0
        made: list[tuple] = []

        def keep(key: str, current: tuple | None, last: int | None) -> None:
            due = timer_at(current) if timer_at else None
            plain = None if current is None else [v.item() if hasattr(v, "item") else v for v in current]
            held[key] = [plain, last, None if due is None else max(int(due) + 1, now + 1)]

        seen = {}
        if not state.hasTimedOut:
            column = columns(list(frames))
            rank = [column(c) for c in order]
            for i, key in enumerate(column("_key")):
                seen.setdefault(key, []).append(i)
            for key, at in seen.items():
                at.sort(key=lambda i: [(r[i] is None, r[i]) for r in rank])
                current, last, _ = held.get(key, (None, None, None))
                current = None if current is None else tuple(current)
                behind = 0 if last is None else sum(rank[0][i] < last for i in at)
                for late, some in ((True, at[:behind]), (False, at[behind:])):
                    if some:
                        current, rows = step(current, Run(column, some, late))
                        made += [(key, *r) for r in rows]
                newest = max(int(rank[0][i]) for i in at)
                keep(key, current, newest if last is None else max(newest, last))
        # time has passed for keys without a new row
        for key, (current, last, due) in list(held.items()):
            if due is not None and due < now and key not in seen:
                current, rows = on_timer(None if current is None else tuple(current), now) if on_timer else (current, [])
                made += [(key, *r) for r in rows]
                keep(key, current, last)
        state.update((json.dumps(held),))
        timers = [due for _, _, due in held.values() if due is not None]
        if timers:
            state.setTimeoutTimestamp(max(min(timers), now + 1))
        if made:
            yield pd.DataFrame(made, columns=["_key", *names], dtype=object)

    def columns(frames: list[pd.DataFrame]) -> Callable[[str], list]:
        found: dict[str, list] = {}

        def column(name: str) -> list:
            if name not in found:
                found[name] = values = [v for f in frames for v in f[name].tolist()]
                if name in whole:
                    found[name] = [None if v is None else int(v) for v in values]
            return found[name]

        return column

    # whole numbers travel as text: pandas would turn a column with a NULL into floats and lose digits
    whole = {f.name for f in stream.schema.fields if f.name not in keys and isinstance(f.dataType, (T.LongType, T.IntegerType))}
    stream = stream.withColumns({"_key": F.to_json(F.struct(*keys), AS_TEXT), "_part": F.pmod(F.xxhash64(*keys), F.lit(PARTS))} | {n: F.col(n).cast("string") for n in whole})
    timeout = GroupStateTimeout.EventTimeTimeout if timer_at else GroupStateTimeout.NoTimeout
    schema = T.StructType([T.StructField("_key", T.StringType()), *T.StructType.fromDDL(out).fields])
    folded = stream.groupBy("_part").applyInPandasWithState(run, schema, STATE, "append", timeout)
    return folded.withColumn("_key", F.from_json("_key", key_type, AS_TEXT)).select("_key.*", *names)

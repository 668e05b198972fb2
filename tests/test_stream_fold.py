"""The keyed streaming fold: many keys in one part, their state, late rows and timers."""

import json

import pytest

from marktrace.streaming import kernel as K

BIG = 2**60 + 1


@pytest.mark.parametrize("parts", [3, 1024])
def test_keys_of_a_part_are_folded_apart(spark, tmp_path, monkeypatch, parts):
    """Sums per key over three batches; a part has one state, and keys keep their types, NULL among them."""
    monkeypatch.setattr(K, "PARTS", parts)
    keys = [(i, f'k"{i % 2}', None) for i in range(40)] + [(None, "a", 1.5), (BIG, None, None)]
    batches = [
        [(*k, at * 1000, i, v) for i, k in enumerate(keys) for at, v in ((30, BIG), (10, 1))],
        # every other key, for each a row behind the last one and a newer one without a value
        [(*k, at * 1000, i, v) for i, k in enumerate(keys[::2]) for at, v in ((20, 5), (40, None))],
        [(-1, "clock", None, 10_000_000 + i, 0, 0) for i in range(2)],
        [(-1, "clock", None, 90_000_000 + i, 0, 0) for i in range(2)],
    ]
    schema = "a long, b string, c double, ts_ms long, event_id long, v long"

    def step(state, run):
        total, at = state if state else (0, None)
        rows = []
        for t, e, v, late in zip(run["ts_ms"], run["event_id"], run["v"], run["late"]):
            total, at = total + (v or 0), max(t, at or t)
            rows.append((t, total, "late" if late else "row", v))
        return (total, at), rows

    def on_timer(state, now):
        return (state[0], None), [(state[1], state[0], "timer", None)]

    progress, out = [], None
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").selectExpr("*", "timestamp_millis(ts_ms) AS ts").withWatermark("ts", "0 seconds")
        out = K.stream_fold(s, ["a", "b", "c"], ["ts_ms", "event_id"], step, "at bigint, total bigint, kind string, v bigint", on_timer, lambda state: None if state[1] is None else state[1] + 500_000)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [json.loads(x.json) if hasattr(x, "json") and isinstance(x.json, str) else x for x in q.recentProgress]
    assert out.columns == ["a", "b", "c", "at", "total", "kind", "v"] and [t for _, t in out.dtypes][:3] == ["bigint", "string", "double"]
    got = {}
    for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect():
        got.setdefault((r.a, r.b, r.c), []).append((r.kind, r["at"], r.total, r.v))
    want = {}
    for i, k in enumerate(keys):
        want[k] = [("row", 10_000, 1, 1), ("row", 30_000, BIG + 1, BIG)]
        if i % 2 == 0:
            # the watermark is behind the late row when the first batch has passed, so Spark itself drops it
            want[k] += [("row", 40_000, BIG + 1, None)]
        last = want[k][-1]
        want[k].append(("timer", last[1], last[2], None))
    assert {k: sorted(v, key=str) for k, v in got.items() if k[0] != -1} == {k: sorted(v, key=str) for k, v in want.items()}
    held = max(o["numRowsTotal"] for p in progress for o in p["stateOperators"])
    assert 0 < held <= min(parts, len(keys) + 1)


def test_late_rows_of_a_batch_come_first(spark, tmp_path):
    """Without timers nothing is dropped: rows behind the last folded one are marked late, newer ones are not."""
    schema = "k string, ts_ms long, event_id long"

    def step(state, run):
        n = state[0] if state else 0
        return (n + len(run),), [(t, e, late, n + i) for i, (t, e, late) in enumerate(zip(run["ts_ms"], run["event_id"], run["late"]))]

    for rows in ([("x", 5, 1), ("y", 50, 2), ("x", 3, 0)], [("y", 60, 6), ("y", 20, 5), ("x", 5, 3), ("y", 10, 4), ("x", 4, 9)]):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        out = K.stream_fold(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k"], ["ts_ms", "event_id"], step, "t bigint, e bigint, late boolean, n bigint")
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("x", 3, 0, False, 0), ("x", 4, 9, True, 2), ("x", 5, 1, False, 1), ("x", 5, 3, False, 3), ("y", 10, 4, True, 1), ("y", 20, 5, True, 2), ("y", 50, 2, False, 0), ("y", 60, 6, False, 3)]

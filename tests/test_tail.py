"""Tail of growing files: half-written lines wait, appended ones come once, stretches meet at any byte."""

import os
import time

import pytest

from marktrace.session import scratch_path
from marktrace.sources.tail import TailReader, last_line_end, tail_lines


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_stretches_give_every_line_once(tmp_path, split):
    path = tmp_path / "a.log"
    lines = ["", "one", "é" * 5, "", "a longer line than the others", "x\r"]
    path.write_bytes(("\n".join(lines) + "\nhalf").encode())
    reader = TailReader({"path": str(tmp_path), "minAge": "0", "splitBytes": str(split)})
    end = reader.latestOffset()
    got = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [x.rstrip("\r") for x in lines]
    assert len({r[1] for r in got}) == len(lines)
    with path.open("ab") as f:
        f.write(b" done\n")
    again = [r[2] for p in reader.partitions(end, reader.latestOffset()) for r in reader.read(p)]
    assert again == ["half done"]
    path.write_bytes(b"new\n")
    assert [r[2] for p in reader.partitions(end, reader.latestOffset()) for r in reader.read(p)] == ["new"]


def test_last_line_end_and_age(tmp_path):
    path = tmp_path / "b.log"
    path.write_bytes(b"x\n" + b"y" * 200_000)
    assert last_line_end(str(path)) == 2
    path.write_bytes(b"no feed")
    assert last_line_end(str(path)) == 0
    young = TailReader({"path": str(tmp_path), "minAge": "60"})
    assert young.latestOffset() == young.initialOffset()
    os.utime(path, (time.time() - 61,) * 2)
    assert "b.log" in young.latestOffset()["files"]


def test_lines_between_batches_come_once(spark):
    root = scratch_path(spark, "tail").removeprefix("file:")
    os.makedirs(f"{root}/in")

    def run():
        s = tail_lines(spark, f"{root}/in", "*.log", 0.0, 64)
        s.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.schema(s.schema).parquet(f"{root}/out").collect())

    def add(name, text):
        with open(f"{root}/in/{name}", "a", encoding="utf-8") as f:
            f.write(text)

    add("a.log", "a1\na2\na3 has")
    add("b.txt", "not asked for\n")
    assert run() == ["a1", "a2"]
    add("a.log", " its end\n")
    add("c.log", "".join(f"c{i}\n" for i in range(100)))
    want = sorted(["a1", "a2", "a3 has its end", *(f"c{i}" for i in range(100))])
    assert run() == want and run() == want

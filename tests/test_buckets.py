"""The keyed table in buckets: untouched files stay, replays change nothing, half-written versions are not seen."""

import glob
import os

from marktrace.session import scratch_path
from marktrace.sources.buckets import BucketTable


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


def rows(table):
    return sorted(map(tuple, table.read().select("k", "at", "v").collect()))


def test_touched_buckets_only_replay_and_failed_version(spark):
    root = scratch_path(spark, "buckets").removeprefix("file:")
    held = BucketTable(spark, root, "k", ["at"], 8)
    frame = lambda *r: spark.createDataFrame(r, "k long, at long, v string")
    assert held.version() == 0 and held.apply(frame(*((i, 1, "a") for i in range(100))), "s", 0) == 8
    before, first = files(root), rows(held)
    assert held.apply(frame((3, 5, "b"), (3, 4, "old"), (3, 0, "older")), "s", 1) == 1
    after = files(root)
    assert before.items() <= after.items() and len(after) - len(before) == 1
    assert rows(held) == sorted([r for r in first if r[0] != 3] + [(3, 5, "b")])
    assert held.apply(frame((3, 9, "again")), "s", 1) == 0 and files(root) == after and held.version() == 2
    # an older row loses, an equal one is replaced by the batch's, a new key is added; other streams count on their own
    assert held.apply(frame((3, 4, "late"), (4, 1, "same"), (1000, 1, "new")), "t", 0) in (2, 3)
    got = rows(held)
    assert (3, 5, "b") in got and (4, 1, "same") in got and (1000, 1, "new") in got and len(got) == 101
    # a version whose manifest was never finished is not read, and the next batch takes its place
    os.makedirs(f"{root}/data/v=4/bucket=0")
    os.makedirs(f"{root}/manifest/v=4")
    assert held.version() == 3 and rows(held) == got
    assert held.apply(frame(), "s", 2) == 0 and held.version() == 4 and rows(held) == got

"""The tail of growing files as a stream of whole lines."""

from __future__ import annotations

import fnmatch
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tail_lines"
BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Lines that begin in bytes ``begin`` to ``end`` of ``path``; ``first`` if a line begins at ``begin``."""

    path: str
    begin: int
    end: int
    first: bool


def last_line_end(path: str) -> int:
    """Byte behind the last line feed, found from the end in blocks; 0 without any."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            step = min(BLOCK, at)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.glob = options.get("pathglobfilter", options.get("pathGlobFilter", "*"))
        self.min_age_s = float(options.get("minage", options.get("minAge", "2")))
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", str(32 << 20))))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """End of the last whole line of every file that has been left alone long enough."""
        now, ends = time.time(), {}
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                path = os.path.join(folder, name)
                if name[0] not in "._" and fnmatch.fnmatch(name, self.glob) and now - os.stat(path).st_mtime >= self.min_age_s:
                    ends[path] = last_line_end(path)
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, stop in after.items():
            begin = before.get(path, 0)
            if stop < begin:  # the file was made anew
                begin = 0
            for at in range(begin, stop, self.split_bytes):
                out.append(Stretch(path, at, min(at + self.split_bytes, stop), at == begin))
        return out or [Stretch("", 0, 0, True)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            if not partition.first:
                # the line across the border belongs to the stretch that it begins in
                f.seek(partition.begin - 1)
                f.readline()
            else:
                f.seek(partition.begin)
            at = f.tell()
            while at < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: path, pathGlobFilter, minAge (seconds since the last change), splitBytes (one task's share of a file)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, position bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, glob: str = "*", min_age_s: float = 2.0, split_bytes: int = 32 << 20) -> DataFrame:
    """``path, position, line`` of every line appended below ``path``, each once, whatever batch it falls into.

    A last line without line feed waits for its end, and a file for ``min_age_s`` without change. Where a line
    was read up to is kept in the query's checkpoint as byte offsets per file. Files must be on a path that
    all workers can open, as logs on a shared mount; a file that has become shorter is read from its start. A
    file that vanishes is forgotten with the next offset.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).options(path=path, pathGlobFilter=glob, minAge=str(min_age_s), splitBytes=str(split_bytes)).load()


__all__ = ["TailSource", "last_line_end", "tail_lines"]

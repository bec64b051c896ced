"""Growing, rotated logs as a streaming source that executors read.

An offset holds, for every log, the file's identity and the byte up to which whole
lines count.  The driver looks at names, sizes and the last line end only; each
task reads one byte range of one log, so a backlog is read in parallel and no file
is held.  If a log's name has come to stand for another file, what was left of the
old one is read first, under the name that it was moved to (a file that is gone by
then cannot be read); a file that became shorter is read from its begin.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16  #: bytes looked at in one step for the last line end
CHUNK = 32 << 20  #: bytes of one task


def _plain(path: str) -> str:
    return path[5:] if path.startswith("file:/") else path


class GrowingLogs(DataSource):
    """Options: ``path`` (a log, a folder of logs or a glob; a folder that all
    executors see), ``from_end`` (begin where the logs end now), ``most`` (bytes of a log
    that one batch takes, as long as its place is known; after a restart the first
    batch takes all that is there), ``chunk``."""

    @classmethod
    def name(cls):
        return "growing_logs"

    def schema(self):
        return "file string, place long, value string"

    def streamReader(self, schema):
        return GrowingLogsReader(self.options)


@dataclass
class Range(InputPartition):
    """Bytes of the file of an identity, wherever it lies when it is read."""

    file: str
    node: int
    begin: int
    start: int
    end: int


def last_line_end(path: str, begin: int, end: int) -> int:
    """The place after the last line end between two places, else ``begin``."""
    with open(path, "rb") as f:
        while end > begin:
            start = max(begin, end - BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return begin


def place_of(file: str, node: int) -> str | None:
    """Where the file of an identity lies now: under its log's name or another of the folder."""
    for f in [file, *sorted(glob.glob(os.path.join(os.path.dirname(file), "*")))]:
        if os.path.isfile(f) and os.stat(f).st_ino == node:
            return f
    return None


class GrowingLogsReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.from_end = _plain(options["path"]), str(options.get("from_end", "")).lower() == "true"
        self.most, self.chunk = int(options.get("most", 0)), int(options.get("chunk", CHUNK))
        self.known: dict | None = None

    def _logs(self) -> list[str]:
        return sorted(f for f in glob.glob(f"{self.path}/*" if os.path.isdir(self.path) else self.path) if os.path.isfile(f))

    def initialOffset(self) -> dict:
        logs = {f: os.stat(f) for f in self._logs()} if self.from_end else {}
        self.known = {f: {"node": s.st_ino, "at": last_line_end(f, 0, s.st_size)} for f, s in logs.items()}
        return self.known

    def latestOffset(self) -> dict:
        out = dict(self.known or {})
        named = {x["node"] for x in out.values()}
        for f in self._logs():
            try:
                s = os.stat(f)
                was = out.get(f)
                if was is None and s.st_ino in named and self.known is not None:
                    continue  # a log under the name that it was moved to
                at = was["at"] if was and was["node"] == s.st_ino and was["at"] <= s.st_size else 0
                end = s.st_size if self.known is None or not self.most else min(s.st_size, at + self.most)
                stop = last_line_end(f, at, end)
                if stop == at < end < s.st_size:  # one line is longer than a batch
                    stop = last_line_end(f, at, s.st_size)
            except FileNotFoundError:
                continue
            out[f] = {"node": s.st_ino, "at": stop}
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, read = [], {x["node"] for x in start.values()}
        for file, to in sorted(end.items()):
            was = start.get(file)
            if was == to or was is None and to["node"] in read:  # nothing new, or a log that was moved here
                continue
            if was and was["node"] != to["node"]:
                old = place_of(file, was["node"])
                if old:
                    out += self._ranges(file, was["node"], was["at"], os.stat(old).st_size)
                was = None
            begin = was["at"] if was and was["at"] <= to["at"] else 0
            out += self._ranges(file, to["node"], begin, to["at"])
        return out or [Range("", 0, 0, 0, 0)]

    def _ranges(self, file: str, node: int, begin: int, end: int) -> list[Range]:
        return [Range(file, node, begin, at, min(end, at + self.chunk)) for at in range(begin, end, self.chunk)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that begin in the range, each read to its end."""
        path = place_of(partition.file, partition.node) if partition.file else None
        if path is None:
            return
        with open(path, "rb") as f:
            f.seek(max(partition.begin, partition.start - 1))
            if partition.start > partition.begin:
                f.readline()  # the line before, which the range before reads
            place = f.tell()
            while place < partition.end:
                line = f.readline()
                if not line:
                    break
                yield partition.file, place, line.rstrip(b"\r\n").decode("utf-8", "replace")
                place += len(line)

"""A streaming source for files that only grow: whole lines from where the last batch ended.

The offset is a map from path to (bytes read, hash of the first line,
generation).  A file that is shorter than what was read, or whose first line
has changed, was rewritten: it is read from the start again and its rows carry
a higher ``generation``, so a sink can drop the older ones.  A restarted query
asks for new offsets before it tells the old ones, so those it gets then have
the generation -1; where a batch begins is decided by comparing the old
offset's hash with the new one's, whatever was remembered.  The driver only
lists files, reads first lines and finds the last newline; tasks read the
bytes, in ranges of whole lines.

Files are opened by path, so they must lie in a folder that all executors
mount, as append-only logs do; immutable files are better read by Spark's own
file source.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

READ_BYTES = 32 << 20
UNKNOWN = -1


class Range(InputPartition):
    """Bytes ``lo`` up to ``hi`` of a file, both at the start of a line."""

    def __init__(self, path: str, lo: int, hi: int, generation: int) -> None:
        self.path, self.lo, self.hi, self.generation = path, lo, hi, generation


def _first_line(path: str) -> str | None:
    """The hash of the first line, however long; None if it hasn't ended yet."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.readline(READ_BYTES):
            digest.update(part)
            if part.endswith(b"\n"):
                return digest.hexdigest()
    return None


def _whole(path: str, lo: int) -> int:
    """The end of the last whole line after ``lo``."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > lo:
            start = max(lo, end - (1 << 16))
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return lo


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str) -> None:
        self.pattern = pattern
        self.state: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in sorted(glob(self.pattern, recursive=True)):
            head = _first_line(path)
            if head is None:
                continue
            read, known, generation = self.state.get(path, [0, head, UNKNOWN])
            if known != head or os.path.getsize(path) < read:
                read, generation = 0, generation + 1 if generation >= 0 else UNKNOWN
            self.state[path] = [_whole(path, read), head, generation]
        return {p: list(v) for p, v in self.state.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (hi, head, generation) in sorted(end.items()):
            read, known, before = start.get(path, [0, head, UNKNOWN])
            goes_on = known == head and read <= hi and UNKNOWN in (before, generation) or before == generation >= 0
            lo = read if goes_on else 0
            if generation == UNKNOWN:  # as the old offset has it, or else as this run has found it
                _, _, held = self.state.get(path, [0, head, UNKNOWN])
                generation = before + (not goes_on) if before >= 0 else max(held, 0)
            if self.state.setdefault(path, [hi, head, generation])[2] == UNKNOWN:
                self.state[path][2] = generation
            while lo < hi:  # long files are cut so that a task reads a bounded part
                upto = hi if hi - lo <= READ_BYTES else max(_line_start(path, lo + READ_BYTES, hi), lo + 1)
                out.append(Range(path, lo, upto, generation))
                lo = upto
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.lo)
            at = partition.lo
            while at < partition.hi and (line := f.readline()):
                yield partition.path, at, partition.generation, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)


def _line_start(path: str, at: int, hi: int) -> int:
    with open(path, "rb") as f:
        f.seek(at)
        f.readline()
        return min(f.tell(), hi)


class Tail(DataSource):
    """``spark.readStream.format("tail").load("/logs/**/*.jsonl")`` once registered with ``spark.dataSource.register(Tail)``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, generation int, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])

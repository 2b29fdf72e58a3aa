"""Turn chunks of a stream of messages, right under any order of arrival.

Each session keeps the rows of its newest turns and what it has told of them.
A row that comes late falls in the turn where it belongs, or splits it if it is
a prompt; every turn whose range or text has changed is told anew, and one that
is no more is told without pieces.  A turn is told when the next prompt is
there, and the last one once the session has been quiet; if that goes on, what
was told stands until the turn is told again.  What is told of a
(session, seq_start) replaces what was told before, so a sink that replaces by
that key ends with the same chunks as the batch form over all rows.

State is bounded by the ``newest`` turns of a session.  A row older than those
isn't dropped: it is told as a session to ``rebuild`` from the stored messages
with ``operators.turnchunks``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from convolake.operators.chunking import split_text
from convolake.operators.turnchunks import LABELS

QUIET_MS = 600_000
NEWEST = 64
TOLD = "session string, seq_start long, seq_end long, uuid string, ts string, pieces array<string>, rebuild boolean"
_COLUMNS = [c.split()[0] for c in TOLD.split(", ")]


def turn_text(rows: list[tuple]) -> str:
    """The text of a turn of rows (seq, role, is_prompt, text, uuid, ts)."""
    said: list[str] = []
    before = None
    for _, role, is_prompt, text, *_ in rows:
        label = "User" if role == "user" and is_prompt else LABELS.get(role)
        text = (text or "").strip(" ")
        if label and text:
            said.append(text if label == before == "Assistant" else f"{label}: {text}")
            before = label
    return "\n\n".join(said)


def turns(rows: list[tuple]) -> list[list[tuple]]:
    """Rows in order of seq, cut at prompts."""
    out: list[list[tuple]] = []
    for row in sorted(rows, key=lambda r: r[0]):
        if not out or row[1] == "user" and row[2]:
            out.append([])
        out[-1].append(row)
    return out


class TurnChunks(StatefulProcessor):
    def __init__(self, quiet_ms: int, newest: int) -> None:
        self.quiet_ms, self.newest = quiet_ms, newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "seq long", "role string, is_prompt boolean, text string, uuid string, ts string")
        self.told = handle.getMapState("told", "seq_start long", "seq_end long, digest long")
        self.floor = handle.getValueState("floor", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        floor = self.floor.get()[0] if self.floor.exists() else None
        late = False
        for pdf in rows:
            columns = (pdf[c].tolist() for c in ("seq", "role", "is_prompt", "text", "uuid", "ts"))
            for seq, role, is_prompt, *rest in zip(*columns, strict=True):
                if floor is not None and seq < floor:
                    late = True
                    continue
                known = [x if isinstance(x, str) else None for x in (role, *rest)]
                self.rows.updateValue((int(seq),), (known[0], is_prompt is True, *known[1:]))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._changed(key[0], False, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._changed(key[0], True, False)

    def _changed(self, session: str, quiet: bool, late: bool) -> pd.DataFrame:
        """The turns that are to be told; those beyond the newest leave the state."""
        out: list[tuple] = [(session, None, None, None, None, None, True)] if late else []
        found = turns([(k[0], *v) for k, v in self.rows.iterator()])
        told = {k[0]: tuple(v) for k, v in self.told.iterator()}
        for start in told.keys() - {t[0][0] for t in found}:
            out.append((session, start, told[start][0], None, None, [], False))
            self.told.removeKey((start,))
        for turn in found if quiet else found[:-1]:
            start, end, text = turn[0][0], turn[-1][0], turn_text(turn)
            uuid, ts = (next((r[k] for r in turn if r[k] is not None), None) for k in (4, 5))
            digest = hash_of(text, uuid, ts)
            if told.get(start) != (end, digest):
                self.told.updateValue((start,), (end, digest))
                out.append((session, start, end, uuid, ts, split_text(text), False))
        for turn in found[: max(0, len(found) - self.newest)]:
            for row in turn:
                self.rows.removeKey((row[0],))
            if self.told.containsKey((turn[0][0],)):
                self.told.removeKey((turn[0][0],))
        if len(found) > self.newest:
            self.floor.update((found[-self.newest][0][0],))
        return pd.DataFrame(out, columns=_COLUMNS)


def hash_of(text: str, uuid: str | None, ts: str | None) -> int:
    """A signed 64-bit digest that every worker agrees on."""
    joined = "\x1f".join((text, uuid or "", ts or "")).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)


def turn_chunks(stream: DataFrame, quiet_ms: int = QUIET_MS, newest: int = NEWEST) -> DataFrame:
    """What is to be told of the turns of a stream (session, seq, role, is_prompt, text, uuid, ts), in update mode.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    grouped = stream.groupBy("session")
    return grouped.transformWithStateInPandas(TurnChunks(quiet_ms, newest), TOLD, "update", "processingTime")

"""Intent of sessions, kept up to date over a stream of tool calls.

State is a map of a session's last KEPT calls by number: a call is put in and the oldest one taken out, so a batch
writes what is new in it and no more. A timer in event time clears a session that has been idle. It needs the RocksDB
state store, which ``codeloom.session`` sets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.hints import INTENTS, KEPT, RECENT

STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _best(tools: list[str]) -> tuple[str, int]:
    score = {i: sum(t in own for t in tools[-RECENT:]) for i, own in INTENTS.items()}
    best = min(score, key=lambda i: (-score[i], i))
    return (best, score[best]) if score[best] else ("exploring", 0)


class SessionIntent(StatefulProcessor):
    """(session, seq, tool, ts) -> (session, intent, score, n) after each batch with calls of the session. The last
    calls are those of the largest numbers, in whatever order they come; equal numbers are one call, the later one."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "seq long", "tool string")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: v[0] for k, v in self.calls.iterator()}
        kept, last = dict(known), 0
        for frame in rows:  # a piece of the session's rows of this batch, however many there are
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
            kept.update(zip(frame["seq"].tolist(), frame["tool"].tolist()))
            if len(kept) > KEPT:
                kept = {s: kept[s] for s in heapq.nlargest(KEPT, kept)}
        for seq in known.keys() - kept.keys():
            self.calls.removeKey((seq,))
        for seq in kept:
            if known.get(seq) != kept[seq]:
                self.calls.updateValue((seq,), (kept[seq],))
        until = max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        before = self.until.get()
        if before is None or until > before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(until)
            self.until.update((until,))
        intent, score = _best([kept[s] for s in sorted(kept)])
        yield pd.DataFrame({"session": [key[0]], "intent": [intent], "score": [score], "n": [len(kept)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.calls.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def intents(calls: DataFrame, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """(session, intent, score, n) after each batch of (session, seq, tool, ts): the intent of its last calls, and how
    many of them are kept. A session's state goes when the watermark has passed its last call by ``idle_ms``."""
    if calls.sparkSession.conf.get(STORE, None) != ROCKSDB:
        raise RuntimeError(f"set {STORE} to {ROCKSDB}")
    rows = calls.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "tool", "ts").withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(SessionIntent(idle_ms), "session string, intent string, score long, n long", "Update", "EventTime")

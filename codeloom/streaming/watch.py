"""Streams of file events: removals at once, other changes after a quiet period."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..functions import keys
from ..operators import store as tables
from ..operators.basic import IGNORE_PATTERNS, is_ignored
from ..scratch import Scratch
from ..sources import files as tree
from ..sources.parser import parse_files, parsed_graph
from .tree_source import TreeEvents

QUIET_MS = Settings.from_env().quiet_ms
QUIET = f"{QUIET_MS} milliseconds"
EVENTS = "path string, op string, ts timestamp"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events landed as JSON lines: path, op (create, write, remove), ts."""
    return spark.readStream.schema(EVENTS).json(folder)


def tree_events(spark: SparkSession, root: str, state: str, partitions: int = 1) -> DataFrame:
    """A stream of the changes of a tree since its last listing in ``state``."""
    spark.dataSource.register(TreeEvents)
    return spark.readStream.format(TreeEvents.name()).option("root", root).option("state", state).option("partitions", partitions).load()


def relevant(events: DataFrame, patterns: tuple[str, ...] = IGNORE_PATTERNS) -> DataFrame:
    """Events of files of a known language that no pattern ignores; renames are none of them."""
    known = keys.detect_language(F.col("path")) != ""
    return events.filter(F.col("op").isin("create", "write", "remove") & known & ~is_ignored(F.col("path"), patterns))


def debounced(events: DataFrame, late: str = "10 seconds", quiet: str = QUIET) -> DataFrame:
    """(path, begin, end, n): bursts of events of a path that lie within ``quiet`` of each other. Late events are
    waited for by the watermark, which bounds the state."""
    w = F.session_window("ts", quiet)
    rows = events.withWatermark("ts", late).groupBy(w, "path").agg(F.count("*").alias("n"))
    return rows.select("path", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, gap: int = 300_000) -> DataFrame:
    """The same for a table, by gaps: (key, session, begin, last, n). An event at least ``gap`` microseconds after
    the one before begins a session. ``events``: (key, moment)."""
    own = W.partitionBy(key).orderBy("moment")
    pause = F.col("moment") - F.lag("moment").over(own)
    rows = events.withColumn("first", F.when(pause.isNull() | (pause >= gap), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("first").over(own.rangeBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("moment").alias("begin"), F.max("moment").alias("last"), F.count("*").alias("n"))


def settled(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(path, op, ts): the last event of each path once ``quiet_ms`` have passed without another of it; a removal at
    once. The state is one event a path that hasn't settled; it is kept by the stream's checkpoint."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            op, ts = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "op": [op], "ts": [ts]})
            return
        rows = pd.concat([f[["op", "ts"]] for f in frames])
        if state.exists:
            rows = pd.concat([pd.DataFrame([state.get], columns=["op", "ts"]), rows])
        op, ts = max(zip(rows["op"], rows["ts"]), key=lambda r: (r[1], r[0]))
        if op == "remove":
            if state.exists:
                state.remove()
            yield pd.DataFrame({"path": [key[0]], "op": [op], "ts": [ts]})
        else:
            state.update((op, ts))
            state.setTimeoutDuration(max(1, quiet_ms))

    return events.groupBy("path").applyInPandasWithState(step, "path string, op string, ts timestamp", "op string, ts timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_batch(spark: SparkSession, root: str, store: tables.GraphStore, events: DataFrame) -> None:
    """One batch of events: the last of each path counts; removed files' slices go, other files are parsed again.
    Only these files are read, and only their buckets of the store are written."""
    last = events.groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))
    paths = last.collect()  # the paths of one batch
    if not paths:
        return
    fresh = [r.path for r in paths if r.op != "remove"]
    scratch = Scratch(spark, "watch")
    parsed = scratch.write(parse_files(tree.read_files(spark, root, fresh, tree.ignore_patterns(root))), "parsed")
    named = spark.createDataFrame([(r.path,) for r in paths], "file_path string")
    store.replace_slices(named, parsed_graph(parsed))
    scratch.close()
    store.set_metadata(last_updated=spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\") as t").first().t)


def watch(spark: SparkSession, events: DataFrame, root: str, store: tables.GraphStore, checkpoint: str, trigger: dict | None = None,
          then: Callable[[int], None] | None = None, quiet_ms: int = QUIET_MS) -> StreamingQuery:
    """Keeps a stored graph up to date with a stream of events, each path once it has settled. A run that ends with
    what is there (trigger availableNow) applies all events of it at once. A batch that runs again has the same
    result: slices are replaced as wholes."""

    def batch(rows: DataFrame, n: int) -> None:
        apply_batch(spark, root, store, rows)
        if then:
            then(n)

    rows = relevant(events)
    if not (trigger or {}).get("availableNow"):
        rows = settled(rows, quiet_ms)
    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"processingTime": QUIET})).start()


# --- events from a tree -------------------------------------------------------------------------

def tree_state(root: str | Path) -> dict[str, tuple[int, int]]:
    """{path: (modified, size)} of the files under root, folders that ignore patterns name left out; new folders are
    found like any others."""
    out = {}
    for path in tree.walked_files(root):
        try:
            at = os.stat(os.path.join(root, path))
        except OSError:  # gone since
            continue
        out[path] = (at.st_mtime_ns, at.st_size)
    return out


def land_changes(root: str | Path, folder: str | Path, before: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Writes what has changed in a tree since ``before`` as events into the folder, by a rename; the state now."""
    now = tree_state(root)
    stamp = pd.Timestamp.now("UTC").isoformat()
    ops = [(p, "create" if p not in before else "write") for p in now if before.get(p) != now[p]] + [(p, "remove") for p in before if p not in now]
    if ops:
        Path(folder).mkdir(parents=True, exist_ok=True)
        name = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.json"
        (Path(folder) / f".{name}").write_text("".join(json.dumps({"path": p, "op": op, "ts": stamp}) + "\n" for p, op in ops))
        os.rename(Path(folder) / f".{name}", Path(folder) / name)
    return now


def follow(root: str | Path, folder: str | Path, stop: threading.Event, every: float = QUIET_MS / 1000) -> threading.Thread:
    """Lands the changes of a tree in the background until ``stop``. What there is at the beginning is no event."""
    state = tree_state(root)

    def run() -> None:
        nonlocal state
        while not stop.wait(every):
            state = land_changes(root, folder, state)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread

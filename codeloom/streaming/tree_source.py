"""A streaming source of the changes of a file tree.

    spark.dataSource.register(TreeEvents)
    spark.readStream.format("tree_events").option("root", "/src").option("state", "/shared/listings").load()

An offset is the number of a *listing* of the tree (path, time of change, size), which is kept in the ``state`` folder;
events (path, op, ts) are what differs between two listings. So a batch that runs again, after a failure or a restart
from the checkpoint, has the same events, and what changes while the stream is down is found when it is up again.
Listings before the last batch that was done go. ``partitions`` deals the events of a batch out, by path.

Defined cases: what there is when the first listing is made is no event (with the option ``all`` true, each file is
one); a file that changes and changes back between two listings is none; two streams need two state folders. The root
and the state are folders of the driver, and of the executors if there are any others.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENTS = "path string, op string, ts timestamp"


class Slice(InputPartition):
    def __init__(self, start: int, end: int, part: int, parts: int):
        self.start, self.end, self.part, self.parts = start, end, part, parts


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["root"], Path(options["state"].removeprefix("file://"))
        self.everything, self.parts = options.get("all", "false").lower() == "true", int(options.get("partitions", "1"))

    # --- listings

    def _numbers(self) -> list[int]:
        return sorted(int(p.stem) for p in self.state.glob("[0-9]*.json"))

    def _load(self, number: int) -> dict:
        return json.loads((self.state / f"{number:012d}.json").read_text())

    def _keep(self, number: int, files: dict) -> None:
        self.state.mkdir(parents=True, exist_ok=True)
        new = self.state / f".{number:012d}.{os.getpid()}"
        new.write_text(json.dumps({"at": time.time(), "files": files}))
        os.replace(new, self.state / f"{number:012d}.json")

    def _now(self) -> dict[str, list[int]]:
        from .watch import tree_state

        return {path: list(about) for path, about in tree_state(self.root).items()}

    # --- the source

    def _begin(self) -> None:
        if not self._numbers():
            self._keep(0, {} if self.everything else self._now())

    def initialOffset(self) -> dict:
        self._begin()
        return {"listing": self._numbers()[0]}

    def latestOffset(self) -> dict:
        self._begin()
        number, now = self._numbers()[-1], self._now()
        if self._load(number)["files"] != now:
            number += 1
            self._keep(number, now)
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(start["listing"], end["listing"], i, self.parts) for i in range(self.parts)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        before, after = self._load(partition.start)["files"], self._load(partition.end)
        now, at = after["files"], datetime.fromtimestamp(after["at"], UTC)
        for path in sorted({*before, *now}):
            if zlib.crc32(path.encode("utf-8", "surrogateescape")) % partition.parts == partition.part and before.get(path) != now.get(path):
                yield path, "create" if path not in before else "remove" if path not in now else "write", at

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["listing"]:
                (self.state / f"{number:012d}.json").unlink(missing_ok=True)


class TreeEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that one run of an operator writes to the shared folder, so that a lost executor costs no more
    than its own tasks. ``drop`` deletes what no later step reads; the rest goes when the driver ends, or, in a
    driver that goes on and on, KEEP_SECONDS after the run began: results that are read later are to be written."""

    KEEP_SECONDS = 24 * 3600
    _open: list[Scratch] = []
    _at_exit: list = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._tables = 0
        self.began = time.monotonic()
        if not Scratch._at_exit:  # once a session is there, so that it goes before the session does
            Scratch._at_exit.append(atexit.register(Scratch.sweep, 0))
        Scratch.sweep(self.KEEP_SECONDS)
        Scratch._open.append(self)

    @classmethod
    def sweep(cls, older_than: float) -> int:
        """Deletes the tables of this driver's runs that began that many seconds ago; how many runs."""
        now = time.monotonic()
        gone = [s for s in cls._open if now - s.began >= older_than]
        for s in gone:
            s.close()
        return len(gone)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._tables += 1
        path = f"{self.base}/{self._tables:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, self._paths.pop(id(t)))

    def close(self) -> None:
        if self in Scratch._open:
            Scratch._open.remove(self)
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.base)
        except Exception:  # noqa: BLE001  the session has ended; its folder is cleaned with it
            pass


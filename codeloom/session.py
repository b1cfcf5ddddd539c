"""Spark sessions with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans coalesce small shuffle partitions, split skewed ones and turn joins of small sides into broadcasts
#: at run time; the initial number of partitions is therefore a ceiling and left to the cluster's default.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # State with maps and timers needs this store; it spills to local disk and is kept by the stream's checkpoint.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "codeloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

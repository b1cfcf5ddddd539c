"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch


def rank_within(rows: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with the place of each in its group by ``order``, from 1. ``order`` should tell all rows of a group apart.

    Rows are dealt out by ranges of the whole order, counted by range, and ranked within a range: no group, however
    large, comes to one task.
    """
    scratch = Scratch(rows.sparkSession, "rank")
    ranged = scratch.write(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(group).orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(group, "_range").orderBy(*order))
    # A merge join, so that the window keeps the ranges apart.
    return ranged.join(before.hint("merge"), [group, "_range"]).withColumn(name, (F.col("_before") + own).cast("int")).drop("_range", "_before")

"""How tables that grow with the graph meet.

Spark guesses a side's size from its files and the number of its columns. Names compress well and fill most of a row,
so sides of many times the broadcast limit would be guessed below it, and each would come to the driver whole. Such
sides say that they are to be merged; those that were counted and are few go to every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of which a counted side is broadcast at most.
FEW_ROWS = 10_000


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: it is sorted and merged, never broadcast."""
    return df.hint("merge")


def hashed(df: DataFrame) -> DataFrame:
    """A side that grows with the graph, but is a small part of the other: both are shuffled, and each task hashes its
    share of this side, so that the other one isn't sorted. For keys that come once or a few times only."""
    return df.hint("shuffle_hash")


def counted(df: DataFrame, rows: int) -> DataFrame:
    """A side of so many rows."""
    return F.broadcast(df) if rows <= FEW_ROWS else large(df)

"""Connected components of a graph given as rows (a long, b long), by repeated contraction.

Each round takes every node to the smallest of itself and its neighbours, and keeps the edges whose ends went to
different nodes. Only nodes that are somebody's smallest neighbour last into the next round, so the graph shrinks
until no edge is left; the rounds' maps, one after the other, give each node's label. The minimum is pre-aggregated
before its shuffle, and maps are written tables, so that a join on a hub with many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Pairs of numbers of which a side of a join is broadcast at most.
FEW_PAIRS = 50_000
#: Minima that a large-star follows where they are few.
SHORTCUTS = 4


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the node's component. Nodes without edges don't appear;
    an edge from a node to itself counts as none; no edges give an empty table."""
    scratch = Scratch(spark, "components")
    edges = scratch.write(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    maps = []
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "up")
        maps.append(up)
        left, right = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")).filter("a <> b").distinct()
        fewer = scratch.write(moved, "edges")
        scratch.drop(edges)
        edges = fewer
        if edges.isEmpty():
            break
    labels = scratch.write(maps[-1].select("node", F.col("up").alias("label")), "labels")
    for up in reversed(maps[:-1]):
        above = labels.select(F.col("node").alias("up"), "label")
        fewer, labels = labels, scratch.write(up.join(above, "up", "left").select("node", F.coalesce("label", "up").alias("label")), "labels")
        scratch.drop(fewer)
    scratch.drop(edges, *maps)
    return labels


def _met(pairs: DataFrame, rows: int) -> DataFrame:
    """A side of a join of so many pairs of numbers: few go to every task, more are sorted and merged."""
    return F.broadcast(pairs) if rows <= FEW_PAIRS else pairs.hint("merge")


def star_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The same as ``components`` by alternating large-star and small-star.

    A large-star takes a node's larger neighbours to the smallest of its neighbourhood, a small-star takes a node's
    smaller neighbours and itself there; both keep the components. It ends when no node has two smaller neighbours, or
    one smaller and one larger: then each component is a star around its smallest node. Minima are pre-aggregated and
    written before they are joined, so no neighbourhood comes to one task and a join on a hub can be split.

    Where the minima go to every task, a large-star follows them SHORTCUTS times, from minimum to minimum: a node still
    stays with its own, as that is smaller and stays with its own. That saves rounds and shuffles nothing.

    A round gives as many edges as it takes, and repeated ones change no minimum: they aren't told apart, and a round
    shuffles for its two minima only, and for its joins where a side is large.
    """
    scratch = Scratch(spark, "stars")
    # Edges go from the larger to the smaller end.
    edges = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        both = edges.select("a", "b", F.lit(True).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("down")))
        least = both.groupBy(F.col("a").alias("u")).agg(
            F.least(F.col("u"), F.min("b")).alias("m"), F.max(F.when(F.col("down"), F.col("b"))).alias("top"), F.max(~F.col("down")).alias("up"))
        unlike = F.when(F.col("top").isNotNull() & ((F.col("top") != F.col("m")) | F.col("up")), 1)
        least = scratch.write(least.select("u", "m", unlike.alias("unlike")), "least")
        seen = least.agg(F.count("*").alias("n"), F.count("unlike").alias("unlike")).first()
        if not seen.unlike:
            break
        few = seen.n <= FEW_PAIRS
        large = edges
        for _ in range(SHORTCUTS if few else 1):
            large = large.join(_met(least.select("u", "m"), seen.n), F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
        if not few:
            large = scratch.write(large, "large")
        own = scratch.write(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "own")  # of the same nodes, no more
        down = large.join(_met(own, seen.n), F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.write(down.unionByName(own.select(F.col("u").alias("a"), F.col("m").alias("b"))), "edges")
        scratch.drop(edges, least, own)
        edges = small
    scratch.drop(edges)
    return least.select(F.col("u").alias("node"), F.col("m").alias("label"))

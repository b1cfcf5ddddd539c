"""Bounded traversals: impact radius and file dependents.

A traversal is an unrolled loop of frontier joins. Each level joins only the nodes found in the level before, and an
anti join keeps out what has been seen, so a node is expanded once however many walks lead to it. Each level is written
to the shared folder: no level is computed twice, the lineage stays short, and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import Scratch
from .joins import counted, large

#: A walk of more levels reads its steps from a table of their own and merges its levels: however few rows a broadcast
#: has, two for each level add up on the driver. One of fewer scans the edges again and broadcasts what is counted and few.
FEW_LEVELS = 3


def reach(seeds: DataFrame, steps: DataFrame | Callable[[DataFrame], DataFrame], max_depth: int | None, key: list[str] | None = None) -> DataFrame:
    """Everything within ``max_depth`` steps of the seeds (None: any number), with the least ``depth``.

    seeds: (*key, node), at depth 0. steps: (src, dst), or what finds those of a level (node, a written table). With a
    key, each key's seeds go their own way: rows are unique by (*key, node).
    """
    key = key or []
    own = [*key, "node"]
    spark = seeds.sparkSession
    scratch = Scratch(spark, "reach")
    found = Observation()
    frontier = scratch.write(seeds.select(*own).distinct().withColumn("depth", F.lit(0)).observe(found, F.count("*").alias("n")), "level")
    n = n_seen = found.get["n"]  # counted as it was written
    deep = max_depth is None or max_depth > FEW_LEVELS
    side = (lambda df, rows: large(df)) if deep else counted
    many = deep and not callable(steps)
    if many:
        steps = scratch.write(steps.select("src", "dst").distinct(), "steps")
    seen = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        own_steps = (steps(frontier) if callable(steps) else steps).select("src", "dst")
        step = side(frontier, n).join(own_steps, frontier["node"] == own_steps["src"]).select(*key, F.col("dst").alias("node")).distinct()
        found = Observation()
        step = step.join(side(seen.select(*own), n_seen), own, "left_anti").withColumn("depth", F.lit(depth))
        frontier = scratch.write(step.observe(found, F.count("*").alias("n")), "level")
        n = found.get["n"]
        if not n:
            break
        n_seen += n
        seen = seen.unionByName(frontier)
    if many:
        scratch.drop(steps)
    return seen


@dataclass(frozen=True)
class Impact:
    """nodes: the impacted ones with their least depth; files: theirs; edges: those among seeds and kept nodes."""

    seeds: DataFrame
    nodes: DataFrame
    files: DataFrame
    edges: DataFrame
    summary: DataFrame


def seeds_of(g: Graph, files: list[str]) -> DataFrame:
    return g.nodes.filter(F.col("file_path").isin(*files) if files else F.lit(False))


def impacted(g: Graph, files: list[str], max_depth: int = 2) -> DataFrame:
    """Nodes within ``max_depth`` edges of the files' nodes, either way, along edges of all kinds, without the seeds.

    The walk is over names: an unresolved name that two functions mention joins them, and is left out at the end.
    """
    seeds = seeds_of(g, files).select(F.col("qualified_name").alias("node"))
    forth = g.edges.select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    both = forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = reach(seeds, both, max_depth).filter("depth > 0").select(F.col("node").alias("qualified_name"), F.col("depth").alias("min_depth"))
    return g.nodes.join(large(found), "qualified_name")


def impact_radius(g: Graph, files: list[str], max_depth: int = 2, max_nodes: int = 500, found: DataFrame | None = None) -> Impact:
    """The impact of changed files: counted whole, then cut to the ``max_nodes`` nearest, by name among equals.

    The walk (``found``, if it was done elsewhere) is done once and written; nodes, files, edges and summary all come
    from that table."""
    every = Scratch(g.spark, "impact").write(impacted(g, files, max_depth) if found is None else found, "impacted")
    kept = every.orderBy("min_depth", "qualified_name").limit(max_nodes)
    seeds = seeds_of(g, files)
    names = seeds.select("qualified_name").unionByName(kept.select("qualified_name"))
    inner = g.edges.join(names.select(F.col("qualified_name").alias("source_qualified")), "source_qualified", "left_semi")
    inner = inner.join(names.select(F.col("qualified_name").alias("target_qualified")), "target_qualified", "left_semi")
    summary = every.agg(F.count("*").alias("total_impacted")).withColumn("truncated", F.col("total_impacted") > max_nodes)
    return Impact(seeds, kept, kept.select("file_path").distinct(), inner, summary)


def file_steps(g: Graph) -> DataFrame:
    """(src, dst): dst is a file that depends on src, by an import of it or by an edge into one of its nodes."""
    e = g.edges_of("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS").select("kind", "target_qualified", F.col("file_path").alias("dst"))
    into = e.join(large(g.nodes.select(F.col("qualified_name").alias("target_qualified"), F.col("file_path").alias("src"))), "target_qualified")
    direct = e.filter("kind = 'IMPORTS_FROM'").select(F.col("target_qualified").alias("src"), "dst")
    return into.select("src", "dst").unionByName(direct).filter("src <> dst").distinct()


def file_dependents(g: Graph, files: list[str], hops: int = 2) -> DataFrame:
    """(file_path, depth): files that depend on the given ones within ``hops``, the given ones left out."""
    spark = g.spark
    seeds = spark.createDataFrame([(f,) for f in files], "node string")
    found = reach(seeds, file_steps(g), hops).filter("depth > 0")
    return found.select(F.col("node").alias("file_path"), "depth")


def descendants(g: Graph, names: DataFrame) -> DataFrame:
    """(ancestor, qualified_name, depth): all that the given nodes (qualified_name) hold, at any depth. A row for each
    pair of an ancestor and what it holds: meant for the nodes that are shown, not for all of a graph."""
    steps = g.edges_of("CONTAINS").select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    seeds = names.select(F.col("qualified_name").alias("ancestor"), F.col("qualified_name").alias("node"))
    found = reach(seeds, steps, None, key=["ancestor"]).filter("depth > 0")
    return found.select("ancestor", F.col("node").alias("qualified_name"), "depth")

"""Lookups and traversals of a stored graph that read only the buckets that they need.

A store deals nodes and edges out by file and keeps ``links``: each edge as seen from both ends, dealt out by the file
that an end's name belongs to. So what is next to a name, whether it calls or is called, is in one bucket; what depends
on a file is in one bucket; a level of a walk reads the buckets of its own names. ``counts`` has the numbers of rows by
kind and language for each bucket, so totals read no nodes and no edges.

Each function gives what its namesake on a ``Graph`` gives. Links and counts are made when they are first asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .store import GraphStore
from .traverse import reach


def _named(store: GraphStore, names: list[str], column: str) -> DataFrame:
    return store.spark.createDataFrame([(n,) for n in names], f"{column} string")


def _links(store: GraphStore, names: DataFrame) -> DataFrame:
    store.derive("links")
    return store.near("links", names)


# --- lookups ------------------------------------------------------------------------------------

def nodes_named(store: GraphStore, names: DataFrame) -> DataFrame:
    """The nodes among ``names`` (qualified_name)."""
    return store.near("nodes", names.select("qualified_name")).join(names.select("qualified_name").distinct(), "qualified_name", "left_semi")


def node(store: GraphStore, qualified_name: str) -> DataFrame:
    return store.near("nodes", _named(store, [qualified_name], "qualified_name")).filter(F.col("qualified_name") == qualified_name)


def nodes_by_file(store: GraphStore, *files: str) -> DataFrame:
    return store.near("nodes", _named(store, list(files), "file_path")).filter(F.col("file_path").isin(*files) if files else F.lit(False))


def edges_by_source(store: GraphStore, qualified_name: str) -> DataFrame:
    """(kind, source_qualified, target_qualified, file_path, line)"""
    own = _links(store, _named(store, [qualified_name], "name")).filter((F.col("name") == qualified_name) & F.col("outgoing"))
    return own.select("kind", F.col("name").alias("source_qualified"), F.col("other").alias("target_qualified"), "file_path", "line")


def edges_by_target(store: GraphStore, qualified_name: str) -> DataFrame:
    own = _links(store, _named(store, [qualified_name], "name")).filter((F.col("name") == qualified_name) & ~F.col("outgoing"))
    return own.select("kind", F.col("other").alias("source_qualified"), F.col("name").alias("target_qualified"), "file_path", "line")


# --- traversals ---------------------------------------------------------------------------------

def impacted(store: GraphStore, files: list[str], max_depth: int = 2) -> DataFrame:
    """Nodes within ``max_depth`` edges of the files' nodes, either way, without the seeds, with their ``min_depth``."""
    scratch = Scratch(store.spark, "stored_impact")
    seeds = nodes_by_file(store, *files).select(F.col("qualified_name").alias("node"))
    steps = lambda level: _links(store, level.select("node")).select(F.col("name").alias("src"), F.col("other").alias("dst"))
    found = scratch.write(reach(seeds, steps, max_depth).filter("depth > 0"), "found")
    found = found.select(F.col("node").alias("qualified_name"), F.col("depth").alias("min_depth"))
    return store.near("nodes", found).join(found, "qualified_name")


def file_dependents(store: GraphStore, files: list[str], hops: int = 2) -> DataFrame:
    """(file_path, depth): files that depend on the given ones within ``hops``, the given ones left out."""

    def steps(level: DataFrame) -> DataFrame:
        into = _links(store, level.select("node")).filter("not outgoing and kind in ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS')")
        known = store.near("nodes", level.select("node")).select(F.col("qualified_name").alias("name"), F.col("file_path").alias("src"))
        calls = into.join(known, "name").select("src", F.col("file_path").alias("dst"))
        imports = into.filter("kind = 'IMPORTS_FROM'").select(F.col("name").alias("src"), F.col("file_path").alias("dst"))
        return calls.unionByName(imports).filter("src <> dst").distinct()

    found = reach(_named(store, files, "node"), steps, hops).filter("depth > 0")
    return found.select(F.col("node").alias("file_path"), "depth")


# --- totals -------------------------------------------------------------------------------------

def graph_stats(store: GraphStore) -> DataFrame:
    """One row: totals, counts by kind, languages and files."""
    store.derive("counts")
    rows = store.read("counts")
    by_kind = rows.groupBy("counted", "kind").agg(F.sum("n").alias("n"), F.collect_set(F.when(F.col("language") != "", F.col("language"))).alias("l"))
    node, edge = F.col("counted") == "nodes", F.col("counted") == "edges"
    of = lambda which: F.map_from_entries(F.array_sort(F.collect_list(F.when(which, F.struct("kind", "n")))))
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    return by_kind.agg(
        total(node).alias("total_nodes"), of(node).alias("nodes_by_kind"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("languages"),
        total(node & (F.col("kind") == "File")).alias("files_count"), total(edge).alias("total_edges"), of(edge).alias("edges_by_kind"))

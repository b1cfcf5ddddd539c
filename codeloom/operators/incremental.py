"""Full builds and incremental updates of a stored graph from a working tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..graph import Graph
from ..schema import conform
from ..scratch import Scratch
from ..sources import files as tree
from ..sources.parser import parse_files, parsed_graph
from . import flows, stored
from . import store as tables

DEPENDENT_HOPS = Settings.from_env().dependent_hops


@dataclass(frozen=True)
class Built:
    files: int
    nodes: int
    edges: int
    errors: int


def _built(parsed: DataFrame) -> Built:
    n = parsed.agg(F.count("*"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)), F.coalesce(F.sum(F.size("edges")), F.lit(0)), F.count("error")).first()
    return Built(*n)


def _note(store: tables.GraphStore, root: str, kind: str) -> None:
    branch, sha = tree.branch_info(root)
    now = store.spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\") as t").first().t
    store.set_metadata(last_updated=now, last_build_type=kind, git_branch=branch, git_head_sha=sha)


def _flow_changes(store: tables.GraphStore, before: Graph, files: DataFrame, new: Graph) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What ``replace_slices`` is to replace of the stored flows; nothing where none are stored."""
    if "flows" not in store.manifest()["tables"]:
        return {}
    own = Graph(conform(new.nodes, store.SCHEMAS["nodes"]), conform(new.edges, store.SCHEMAS["edges"]))
    after = tables.replace_files(before, files, own.nodes, own.edges)
    gone, rows = flows.changed_flows(before, after, files, int(store.metadata("flow_depth") or flows.MAX_DEPTH))
    return {"flows": (gone, rows), "memberships": (gone, flows.memberships(rows))}


def full_build(spark: SparkSession, root: str, store: tables.GraphStore) -> Built:
    """Parses every file of the tree; files no longer there are gone from the graph."""
    scratch = Scratch(spark, "build")
    listed = tree.tracked_files(root) or (None if "://" in root else tree.walked_files(root))
    parsed = scratch.write(parse_files(tree.read_sources(spark, root, tree.ignore_patterns(root), listed)), "parsed")
    store.write_graph(parsed_graph(parsed))
    _note(store, root, "full")
    built = _built(parsed)
    scratch.close()
    return built


def incremental_update(spark: SparkSession, root: str, store: tables.GraphStore, changed: list[str] | None = None, base: str = "HEAD~1",
                       hops: int = DEPENDENT_HOPS) -> Built:
    """Parses changed files and their dependents whose contents differ from the stored ones, and puts them in place
    of their slices; slices of files that are gone go. No other file is read. Dependents are found in the buckets of
    the changed files and of what depends on them; only buckets that hold one of these files are written. Where flows are stored, those that the update can have changed are traced
    anew, and they switch together with the graph."""
    changed = tree.changed_since(root, base) if changed is None else changed
    if not changed:
        return Built(0, 0, 0, 0)
    scratch = Scratch(spark, "update")
    g = store.graph()
    depend = stored.file_dependents(store, changed, hops).select("file_path")
    touched = sorted({*changed, *(r.file_path for r in depend.collect())})  # paths of the update
    present = scratch.write(tree.read_files(spark, root, touched, tree.ignore_patterns(root)), "present")
    gone = spark.createDataFrame([(p,) for p in touched], "file_path string").join(present.select("file_path"), "file_path", "left_anti")
    parsed = scratch.write(parse_files(tables.changed_files(g, present)), "parsed")
    new = parsed_graph(parsed)
    replaced = gone.unionByName(parsed.select("file_path"))
    store.replace_slices(replaced, new, **_flow_changes(store, g, replaced, new))
    _note(store, root, "incremental")
    built = _built(parsed)
    scratch.close()
    return built

"""The engine's entry points by name: each takes a context and arguments and returns DataFrames and scalars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..graph import Graph
from ..operators import basic, community, export, flows, hints, incremental, refactor, search, stored, traverse
from ..operators.store import GraphStore
from ..operators.text_index import TextIndex
from ..scratch import Scratch
from ..sources import files as tree


@dataclass
class Context:
    spark: SparkSession
    store: GraphStore
    root: str = "."
    wiki: str = ".codeloom/wiki"
    vectors: DataFrame | None = None
    embed_query: Callable[[str], list[float]] | None = None
    index: DataFrame | TextIndex | None = None
    refactorings: refactor.Refactorings = field(default_factory=refactor.Refactorings)
    session: hints.Session = field(default_factory=hints.Session)
    settings: Settings = field(default_factory=Settings.from_env)

    @property
    def graph(self) -> Graph:
        return self.store.graph()


def _changed(c: Context, files: list[str] | None, base: str) -> list[str]:
    return files or tree.changed_since(c.root, base) or tree.uncommitted(c.root)


def build_or_update_graph(c: Context, full_rebuild: bool = False, base: str = "HEAD~1") -> incremental.Built:
    return incremental.full_build(c.spark, c.root, c.store) if full_rebuild else incremental.incremental_update(
        c.spark, c.root, c.store, base=base, hops=c.settings.dependent_hops)


def get_minimal_context(c: Context) -> DataFrame:
    return stored.graph_stats(c.store).select("total_nodes", "total_edges", "files_count", "languages")


def get_impact_radius(c: Context, changed_files: list[str], max_depth: int | None = None, max_nodes: int | None = None) -> traverse.Impact:
    max_depth = c.settings.impact_depth if max_depth is None else max_depth
    found = stored.impacted(c.store, changed_files, max_depth)
    return traverse.impact_radius(c.graph, changed_files, max_depth, c.settings.impact_nodes if max_nodes is None else max_nodes, found)


def query_graph(c: Context, query_type: str, target: str) -> DataFrame:
    if query_type == "file_symbols":
        return basic.node_rows(stored.nodes_by_file(c.store, target))
    if query_type in ("callers_of", "dependents_of"):
        return basic.edge_rows(stored.edges_by_target(c.store, target))
    if query_type in ("callees_of", "dependencies_of"):
        return basic.edge_rows(stored.edges_by_source(c.store, target))
    raise ValueError(f"unknown query type {query_type}")


def semantic_search_nodes(c: Context, query: str, kind: str | None = None, limit: int | None = None, context_files: list[str] | None = None) -> DataFrame:
    vector = c.embed_query(query) if c.embed_query and c.vectors is not None else None
    return search.hybrid_search(c.graph, query, c.index, c.vectors, vector, kind, c.settings.search_results if limit is None else limit, context_files)


def list_graph_stats(c: Context) -> DataFrame:
    """Totals, when the graph was last updated, and how many rows have text and vector entries."""
    stats = stored.graph_stats(c.store).withColumn("last_updated", F.lit(c.store.metadata("last_updated")))
    count = lambda t: 0 if t is None else t.count()
    return stats.withColumns({"text_entries": F.lit(count(c.index)), "vector_entries": F.lit(count(c.vectors))})


def find_large_functions(c: Context, min_lines: int = 50, kind: str | None = None, limit: int = 50) -> DataFrame:
    return basic.large_nodes(c.graph, min_lines, kind, limit)


def get_review_context(c: Context, changed_files: list[str] | None = None, base: str = "HEAD~1") -> DataFrame:
    files = _changed(c, changed_files, base)
    return traverse.impact_radius(c.graph, files, 2, 200).summary.withColumn("changed_files", F.lit(len(files)))


def detect_changes(c: Context, base: str = "HEAD~1") -> DataFrame:
    files = _changed(c, None, base)
    return traverse.impact_radius(c.graph, files, 2, 500).summary.withColumn("changed_files", F.lit(len(files)))


def visualize_graph(c: Context, path: str) -> int:
    return export.write_html(c.graph, path)


def _stored_flows(c: Context) -> DataFrame:
    return c.store.read("flows")


def list_flows(c: Context, sort_by: str = "criticality", limit: int = 50) -> DataFrame:
    return flows.list_flows(_stored_flows(c), sort_by, limit)


def get_flow(c: Context, flow_id: int) -> DataFrame:
    return flows.flow_steps(c.graph, _stored_flows(c), flow_id)


def get_affected_flows(c: Context, changed_files: list[str]) -> DataFrame:
    touched = c.graph.nodes.filter(F.col("file_path").isin(*changed_files)).select(F.col("id").alias("node_id"))
    hit = c.store.read("memberships").join(touched, "node_id", "left_semi").select(F.col("flow_id").alias("id")).distinct()
    return _stored_flows(c).join(hit, "id", "left_semi").orderBy(F.col("criticality").desc(), "id")


def run_refactor(c: Context, operation: str, old_name: str = "", new_name: str = "", kind: str | None = None) -> Any:
    if operation == "rename":
        return c.refactorings.preview(c.graph, old_name, new_name)
    if operation == "dead_code":
        return refactor.dead_code(c.graph, kind)
    if operation == "suggest":
        return refactor.suggestions(c.graph)
    raise ValueError(f"unknown operation {operation}")


def apply_refactor(c: Context, refactor_id: str, dry_run: bool = False) -> dict:
    return c.refactorings.apply(refactor_id, c.root, dry_run)


def find_dead_code(c: Context, kind: str | None = None, file_pattern: str | None = None) -> DataFrame:
    return refactor.dead_code(c.graph, kind, file_pattern)


def _flow_parts(c: Context) -> tuple[DataFrame | None, DataFrame | None]:
    """(entry, criticality, depth) and (entry, node) of the stored flows; None if none are stored."""
    if _stored_flows(c).isEmpty():
        return None, None
    named = c.graph.nodes.select("id", "qualified_name")
    entries = _stored_flows(c).select(F.col("id").alias("flow_id"), F.col("entry_point_id").alias("id"), "criticality", "depth").join(named, "id")
    entries = entries.select("flow_id", F.col("qualified_name").alias("entry"), "criticality", "depth")
    members = c.store.read("memberships").join(entries, "flow_id").select("entry", F.col("node_id").alias("id")).join(named, "id")
    return entries.drop("flow_id"), members.select("entry", F.col("qualified_name").alias("node"))


def generate_wiki(c: Context, communities: DataFrame) -> dict[str, int]:
    return community.write_pages(community.pages(c.graph, communities, *_flow_parts(c)), c.wiki)


def get_wiki_page(c: Context, page_name: str) -> str | None:
    return community.read_page(c.wiki, page_name)


def rebuild_fts_index(c: Context, path: str) -> int:
    """Writes the full-text index and counts its rows; searches read the written one."""
    c.index = TextIndex.build(c.graph.nodes, path, "qualified_name")
    return c.index.count()


def postprocess(c: Context) -> int:
    """Traces and stores all flows; their number. Updates keep them up to date from then on."""
    g = c.graph
    rows = Scratch(c.spark, "postprocess").write(flows.build_flows(g, flows.trace(g, c.settings.flow_depth)), "flows")
    c.store.write(flows=rows, memberships=flows.memberships(rows))
    c.store.set_metadata(flow_depth=str(c.settings.flow_depth))
    return rows.count()


TOOLS: dict[str, Callable] = {
    "build_or_update_graph": build_or_update_graph, "get_minimal_context": get_minimal_context, "get_impact_radius": get_impact_radius,
    "query_graph": query_graph, "semantic_search_nodes": semantic_search_nodes, "list_graph_stats": list_graph_stats,
    "find_large_functions": find_large_functions, "get_review_context": get_review_context, "detect_changes": detect_changes,
    "visualize_graph": visualize_graph, "list_flows": list_flows, "get_flow": get_flow, "get_affected_flows": get_affected_flows,
    "refactor": run_refactor, "apply_refactor": apply_refactor, "find_dead_code": find_dead_code, "generate_wiki": generate_wiki,
    "get_wiki_page": get_wiki_page, "rebuild_fts_index": rebuild_fts_index,
}


def call(c: Context, name: str, **arguments: Any) -> tuple[Any, dict]:
    """A tool's result, and hints on what to do next."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool {name}")
    result = TOOLS[name](c, **arguments)
    return result, c.session.hints(name, result if isinstance(result, dict) else {})

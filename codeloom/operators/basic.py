"""Scans, filters, projections and aggregations over a graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..graph import Graph


# --- lookups ------------------------------------------------------------------------------------

def node(g: Graph, qualified_name: str) -> DataFrame:
    return g.nodes.filter(F.col("qualified_name") == qualified_name)


def nodes_by_file(g: Graph, file_path: str) -> DataFrame:
    return g.nodes.filter(F.col("file_path") == file_path)


def nodes_by_kinds(g: Graph, *kinds: str) -> DataFrame:
    return g.nodes.filter(F.col("kind").isin(*kinds))


def edges_by_source(g: Graph, qualified_name: str) -> DataFrame:
    return g.edges.filter(F.col("source_qualified") == qualified_name)


def edges_by_target(g: Graph, qualified_name: str) -> DataFrame:
    return g.edges.filter(F.col("target_qualified") == qualified_name)


def all_files(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'File'").select("file_path").distinct()


def batch_nodes(g: Graph, names: DataFrame) -> DataFrame:
    """The nodes among ``names`` (qualified_name)."""
    return g.nodes.join(names.select("qualified_name"), "qualified_name", "left_semi")


def edges_among(g: Graph, names: DataFrame) -> DataFrame:
    """Edges with both ends among ``names``: the induced subgraph."""
    inner = g.edges.join(names.select(F.col("qualified_name").alias("source_qualified")), "source_qualified", "left_semi")
    return inner.join(names.select(F.col("qualified_name").alias("target_qualified")), "target_qualified", "left_semi")


# --- filters ------------------------------------------------------------------------------------

def _like(word: str) -> str:
    """A LIKE pattern in which % and _ of the word stay wildcards and a backslash is itself."""
    return f"%{word}%".replace("\\", "\\\\")


def keyword_filter(query: str) -> Column | None:
    """Every word of the query in the name or the qualified name, whatever its case; None for a blank query."""
    words = query.lower().split()
    if not words:
        return None
    out = None
    for w in words:
        hit = F.lower("name").like(_like(w)) | F.lower("qualified_name").like(_like(w))
        out = hit if out is None else out & hit
    return out


def search_nodes(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Nodes that hold all words, in the order of their qualified names."""
    hit = keyword_filter(query)
    return g.nodes.filter(F.lit(False) if hit is None else hit).orderBy("qualified_name").limit(limit)


def large_nodes(g: Graph, min_lines: int = 50, kind: str | None = None, limit: int = 50) -> DataFrame:
    size = F.col("line_end") - F.col("line_start") + 1
    rows = g.nodes.filter(size >= min_lines)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows.withColumn("line_count", size.cast("long")).orderBy(F.col("line_count").desc(), "qualified_name").limit(limit)


def file_pattern(pattern: str) -> Column:
    return F.lower("file_path").like(_like(pattern.lower()))


# Fixed values that results depend on; the last holds the engine's own tables.
IGNORE_PATTERNS = (
    "node_modules/**", ".git/**", "__pycache__/**", "*.pyc", ".venv/**", "venv/**", "dist/**", "build/**", ".next/**", "target/**", "vendor/**",
    "bootstrap/cache/**", "public/build/**", ".bundle/**", ".gradle/**", "*.jar", ".dart_tool/**", ".pub-cache/**", "coverage/**", ".cache/**",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "*.db", "*.sqlite", "*.db-journal", "*.db-wal", ".codeloom/**",
)


def _glob(pattern: str) -> str:
    out = ""
    for c in pattern:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
    return f"^{out}$"


def is_ignored(path: Column, patterns: tuple[str, ...] = IGNORE_PATTERNS) -> Column:
    """A path that a pattern covers: ``x/**`` as a directory anywhere (of several segments: from a segment on),
    ``*.x`` as a suffix, any other as a glob of the whole path or of its last segment."""
    out = F.lit(False)
    padded = F.concat(F.lit("/"), path)
    for p in patterns:
        if p.endswith("/**"):
            out = out | padded.contains(f"/{p[:-3]}/")
        elif p.startswith("*.") and "*" not in p[1:] and "?" not in p:
            out = out | path.endswith(p[1:])
        else:
            out = out | path.rlike(_glob(p)) | keys.basename(path).rlike(_glob(p))
    return out


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes, or nothing at all."""
    return F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00"))) | (F.length(content) == 0)


# --- projections --------------------------------------------------------------------------------

def node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "id", "kind", keys.sanitize(F.col("name")).alias("name"), keys.sanitize(F.col("qualified_name")).alias("qualified_name"), "file_path",
        "line_start", "line_end", "language", "parent_name", "is_test")


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(
        "kind", keys.sanitize(F.col("source_qualified")).alias("source"), keys.sanitize(F.col("target_qualified")).alias("target"), "file_path", "line")


# --- aggregations -------------------------------------------------------------------------------

def count_by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def languages(g: Graph) -> DataFrame:
    return g.nodes.filter("language is not null and language <> ''").select("language").distinct()


def graph_stats(g: Graph) -> DataFrame:
    """One row: totals, counts by kind, languages and files. One pass over each table."""
    n = g.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("language") != "", F.col("language"))).alias("l"))
    n = n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_nodes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("nodes_by_kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("languages"),
        F.coalesce(F.sum(F.when(F.col("kind") == "File", F.col("n"))), F.lit(0)).cast("long").alias("files_count"))
    e = g.edges.groupBy("kind").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_edges"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("edges_by_kind"))
    return n.crossJoin(e)  # of one row each

"""Registry of the graph queries, each with SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..graph import Graph
from ..operators import basic, community, export, flows, hints, refactor, search, store, stored, traverse
from ..operators.joins import large
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..scratch import Scratch
from ..sources.fixture_graph import GRAPH_SQL, fixture_graph
from ..sources.parser import parse_files, parsed_graph
from ..streaming.watch import sessions

FILE = "src/Brand13/economy.py"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None, on_graph: bool = True, name: str | None = None):
    """Registers a query of a graph (or of (spark, sf_dir)) and its SQL; SQL of a graph query goes after the graph's."""

    def register(f):
        key = name or f.__name__
        _QUERIES[key] = (lambda spark, sf_dir: f(fixture_graph(spark, sf_dir))) if on_graph else f
        if sql:
            _SQL[key] = (GRAPH_SQL + sql) if on_graph else sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans, filters, counts ---------------------------------------------------------------------

_STATS = """
SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges,
  (SELECT count(*) FROM nodes WHERE kind = 'File') AS files_count,
  (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM nodes GROUP BY kind)) AS nodes_by_kind,
  (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM edges GROUP BY kind)) AS edges_by_kind,
  (SELECT string_agg(DISTINCT language, ',') FROM nodes) AS languages
"""


def _said(stats: DataFrame) -> DataFrame:
    said = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stats.select(
        "total_nodes", "total_edges", "files_count", said("nodes_by_kind").alias("nodes_by_kind"), said("edges_by_kind").alias("edges_by_kind"),
        F.array_join("languages", ",").alias("languages"))


@_query(_STATS)
def graph_stats(g: Graph) -> DataFrame:
    return _said(basic.graph_stats(g))


@_query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def nodes_by_kind(g: Graph) -> DataFrame:
    return basic.count_by_kind(g.nodes)


@_query("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(g: Graph) -> DataFrame:
    return basic.count_by_kind(g.edges)


@_query("SELECT DISTINCT language FROM nodes WHERE language <> ''")
def languages(g: Graph) -> DataFrame:
    return basic.languages(g)


@_query(f"SELECT kind, name, qualified_name, line_start, line_end FROM nodes WHERE qualified_name = '{FILE}'")
def node_lookup(g: Graph) -> DataFrame:
    return basic.node(g, FILE).select("kind", "name", "qualified_name", "line_start", "line_end")


@_query(f"SELECT kind, name, qualified_name, line_start, line_end, is_test FROM nodes WHERE file_path = '{FILE}'")
def file_symbols(g: Graph) -> DataFrame:
    return basic.node_rows(basic.nodes_by_file(g, FILE)).select("kind", "name", "qualified_name", "line_start", "line_end", "is_test")


@_query("SELECT DISTINCT file_path FROM nodes WHERE kind = 'File'")
def all_files(g: Graph) -> DataFrame:
    return basic.all_files(g)


@_query("SELECT qualified_name, kind FROM nodes WHERE kind IN ('Function', 'Test')")
def nodes_by_kinds(g: Graph) -> DataFrame:
    return basic.nodes_by_kinds(g, "Function", "Test").select("qualified_name", "kind")


@_query("SELECT kind, source_qualified AS source, target_qualified AS target, file_path, line FROM edges WHERE target_qualified = 'ext.lib_3'")
def callers_of(g: Graph) -> DataFrame:
    return basic.edge_rows(basic.edges_by_target(g, "ext.lib_3"))


@_query(f"SELECT kind, source_qualified AS source, target_qualified AS target, file_path, line FROM edges WHERE source_qualified = '{FILE}'")
def callees_of(g: Graph) -> DataFrame:
    return basic.edge_rows(basic.edges_by_source(g, FILE))


@_query("""SELECT qualified_name, kind, (line_end - line_start + 1)::BIGINT AS line_count FROM nodes
WHERE line_end - line_start + 1 >= 60 AND kind = 'Function' ORDER BY line_count DESC, qualified_name LIMIT 50""")
def large_functions(g: Graph) -> DataFrame:
    return basic.large_nodes(g, 60, "Function", 50).select("qualified_name", "kind", "line_count")


@_query("""SELECT qualified_name, CASE WHEN lower(name) = 'auth' THEN 3.0 WHEN starts_with(lower(name), 'auth') THEN 2.0 ELSE 1.0 END::DOUBLE AS score
FROM nodes WHERE lower(name) LIKE '%auth%' OR lower(qualified_name) LIKE '%auth%'""")
def keyword_search(g: Graph) -> DataFrame:
    return search.keyword_search(g.nodes, "auth", key="qualified_name")


@_query("""SELECT qualified_name FROM nodes WHERE (lower(name) LIKE '%handle_%' OR lower(qualified_name) LIKE '%handle_%')
AND (lower(name) LIKE '%brand1%' OR lower(qualified_name) LIKE '%brand1%') ORDER BY qualified_name LIMIT 20""")
def keyword_filter(g: Graph) -> DataFrame:
    return basic.search_nodes(g, "Handle_ BRAND1", 20).select("qualified_name")


_FROM_FILE = f"SELECT DISTINCT target_qualified AS q FROM edges WHERE file_path = '{FILE}'"


@_query(f"SELECT qualified_name, kind FROM nodes WHERE qualified_name IN ({_FROM_FILE})")
def batch_nodes(g: Graph) -> DataFrame:
    names = g.edges.filter(F.col("file_path") == FILE).select(F.col("target_qualified").alias("qualified_name"))
    return basic.batch_nodes(g, names).select("qualified_name", "kind")


@_query("""SELECT kind, source_qualified, target_qualified, line FROM edges
WHERE source_qualified IN (SELECT qualified_name FROM nodes WHERE file_path LIKE 'src/Brand1%')
  AND target_qualified IN (SELECT qualified_name FROM nodes WHERE file_path LIKE 'src/Brand1%')""")
def edges_among(g: Graph) -> DataFrame:
    names = g.nodes.filter(F.col("file_path").startswith("src/Brand1")).select("qualified_name")
    return basic.edges_among(g, names).select("kind", "source_qualified", "target_qualified", "line")


# --- traversal ----------------------------------------------------------------------------------

_WALK = f""", ways AS (
  SELECT source_qualified AS s, target_qualified AS t FROM edges UNION SELECT target_qualified, source_qualified FROM edges),
walk AS (
  SELECT qualified_name AS n, 0 AS depth FROM nodes WHERE file_path = '{FILE}'
  UNION SELECT t, depth + 1 FROM walk JOIN ways ON s = n WHERE depth < 2),
near AS (SELECT n, min(depth) AS min_depth FROM walk GROUP BY n),
hit AS (SELECT qualified_name, kind, file_path, min_depth FROM near JOIN nodes ON qualified_name = n WHERE min_depth > 0)
"""


@_query(_WALK + "SELECT * FROM hit")
def impact_radius(g: Graph) -> DataFrame:
    return traverse.impacted(g, [FILE], 2).select("qualified_name", "kind", "file_path", "min_depth")


@_query(_WALK + "SELECT * FROM hit ORDER BY min_depth, qualified_name LIMIT 100")
def impact_nearest(g: Graph) -> DataFrame:
    return traverse.impact_radius(g, [FILE], 2, 100).nodes.select("qualified_name", "kind", "file_path", "min_depth")


@_query(_WALK + "SELECT DISTINCT file_path FROM (SELECT * FROM hit ORDER BY min_depth, qualified_name LIMIT 500)")
def impact_files(g: Graph) -> DataFrame:
    return traverse.impact_radius(g, [FILE], 2, 500).files


@_query(_WALK + f""", own AS (SELECT qualified_name FROM (SELECT * FROM hit ORDER BY min_depth, qualified_name LIMIT 500)
  UNION SELECT qualified_name FROM nodes WHERE file_path = '{FILE}')
SELECT kind, source_qualified, target_qualified, line FROM edges
WHERE source_qualified IN (FROM own) AND target_qualified IN (FROM own)""")
def impact_edges(g: Graph) -> DataFrame:
    return traverse.impact_radius(g, [FILE], 2, 500).edges.select("kind", "source_qualified", "target_qualified", "line")


@_query(_WALK + "SELECT count(*) AS total_impacted, count(*) > 100 AS truncated FROM hit")
def impact_summary(g: Graph) -> DataFrame:
    return traverse.impact_radius(g, [FILE], 2, 100).summary


_DEPENDENTS = f""", step AS (
  SELECT DISTINCT n.file_path AS s, e.file_path AS t FROM edges e JOIN nodes n ON n.qualified_name = e.target_qualified
  WHERE e.kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS') AND n.file_path <> e.file_path
  UNION SELECT target_qualified, file_path FROM edges WHERE kind = 'IMPORTS_FROM' AND target_qualified <> file_path),
walk AS (SELECT '{FILE}' AS n, 0 AS depth UNION SELECT t, depth + 1 FROM walk JOIN step ON s = n WHERE depth < 2)
SELECT n AS file_path, min(depth) AS depth FROM walk GROUP BY n HAVING min(depth) > 0"""


@_query(_DEPENDENTS)
def file_dependents(g: Graph) -> DataFrame:
    return traverse.file_dependents(g, [FILE], 2)


@_query(""", walk AS (
  SELECT qualified_name AS ancestor, qualified_name, 0 AS depth FROM nodes WHERE kind = 'File'
  UNION SELECT ancestor, target_qualified, depth + 1 FROM walk JOIN edges ON kind = 'CONTAINS' AND source_qualified = walk.qualified_name)
SELECT ancestor, qualified_name, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0""")
def contained(g: Graph) -> DataFrame:
    return traverse.descendants(g, g.nodes.filter("kind = 'File'"))


# --- flows --------------------------------------------------------------------------------------

_ENTRY = r"regexp_matches(name, '^main$|^__main__$|^test_|^Test[A-Z]|^on_|^handle_')"
_CALLED = "(SELECT target_qualified FROM edges WHERE kind = 'CALLS')"
_SECURE = "|".join(keys.SECURITY_KEYWORDS)
_FLOWS = f""", entry_nodes AS (
  SELECT * FROM nodes WHERE kind IN ('Function', 'Test') AND (qualified_name NOT IN {_CALLED} OR {_ENTRY})),
step AS (SELECT DISTINCT source_qualified AS s, target_qualified AS t FROM edges
  WHERE kind = 'CALLS' AND target_qualified IN (SELECT qualified_name FROM nodes)),
walk AS (
  SELECT qualified_name AS entry, qualified_name AS node, 0 AS depth FROM entry_nodes
  UNION SELECT entry, t, depth + 1 FROM walk JOIN step ON s = node WHERE depth < 15),
every AS (SELECT entry, node, min(depth) AS depth FROM walk GROUP BY entry, node),
member AS (SELECT * FROM every WHERE entry IN (SELECT entry FROM every WHERE depth > 0))
"""
_METRICS = _FLOWS + f""", about AS (
  SELECT qualified_name AS node, file_path, (regexp_matches(lower(name), '{_SECURE}') OR regexp_matches(lower(qualified_name), '{_SECURE}'))::INT AS secure,
    (qualified_name IN (SELECT target_qualified FROM edges WHERE kind = 'TESTED_BY'))::INT AS tested, coalesce(o.n, 0) AS outside
  FROM nodes LEFT JOIN (SELECT source_qualified, count(*) AS n FROM edges WHERE kind = 'CALLS'
    AND target_qualified NOT IN (SELECT qualified_name FROM nodes) GROUP BY 1) o ON o.source_qualified = qualified_name),
per AS (
  SELECT entry, count(*) AS node_count, count(DISTINCT file_path) AS file_count, max(depth) AS depth, sum(secure)::BIGINT AS secure,
    sum(tested)::BIGINT AS tested, sum(outside)::BIGINT AS outside
  FROM member JOIN about USING (node) GROUP BY entry),
metric_rows AS (
  SELECT entry, node_count, file_count, depth, least(greatest(
    CASE WHEN file_count > 1 THEN least((file_count - 1) / 4.0::DOUBLE, 1.0) ELSE 0.0 END * 0.30::DOUBLE + least(outside / 5.0::DOUBLE, 1.0) * 0.20::DOUBLE
    + secure::DOUBLE / node_count * 0.25::DOUBLE + (1 - tested::DOUBLE / node_count) * 0.15::DOUBLE + least(depth / 10.0::DOUBLE, 1.0) * 0.10::DOUBLE, 0.0), 1.0) AS criticality
  FROM per),
metric AS (SELECT entry, node_count, file_count, depth, round(criticality, 6) AS criticality FROM metric_rows)
"""
#: To go after the graph's SQL: ``member`` (entry, node, depth) and ``metric_rows``, the metrics of each flow.
FLOW_METRICS_SQL = _METRICS


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("criticality", F.round("criticality", 6))


@_query(f"SELECT qualified_name, kind FROM nodes WHERE kind IN ('Function', 'Test') AND qualified_name NOT IN {_CALLED}")
def uncalled_functions(g: Graph) -> DataFrame:
    return flows.uncalled(g).select("qualified_name", "kind")


@_query(_FLOWS + "SELECT qualified_name, kind FROM entry_nodes")
def entry_points(g: Graph) -> DataFrame:
    return flows.entry_points(g).select("qualified_name", "kind")


@_query(_FLOWS + "SELECT entry, node, depth FROM member")
def flow_trace(g: Graph) -> DataFrame:
    return flows.trace(g)


@_query(_METRICS + "SELECT * FROM metric")
def flow_metrics(g: Graph) -> DataFrame:
    return _rounded(flows.traced(g).metrics(g))


@_query(_METRICS + "SELECT * FROM metric ORDER BY criticality DESC, entry LIMIT 50")
def list_flows(g: Graph) -> DataFrame:
    return flows.list_flows(_rounded(flows.traced(g).metrics(g)), "criticality", 50)


@_query(_FLOWS + """SELECT entry, node, (row_number() OVER (PARTITION BY entry ORDER BY depth, node) - 1)::INT AS position FROM member""")
def flow_steps(g: Graph) -> DataFrame:
    return flows.ordered_members(flows.trace(g)).select("entry", "node", "position")


@_query(_METRICS + """, ordered AS (SELECT entry, string_agg(node, ' > ' ORDER BY depth, node) AS path FROM member GROUP BY entry)
SELECT entry, depth, node_count, file_count, criticality, path FROM metric JOIN ordered USING (entry)""")
def stored_flows(g: Graph) -> DataFrame:
    """The rows that are stored of flows, with names in place of ids."""
    named = F.col("id").alias("node_id"), F.col("qualified_name").alias("node")
    built = _rounded(flows.build_flows(g, flows.trace(g)))
    steps = flows.memberships(built).join(g.nodes.select(*named), "node_id").groupBy(F.col("flow_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "node"))).alias("p"))
    entries = g.nodes.select(F.col("id").alias("entry_point_id"), F.col("qualified_name").alias("entry"))
    rows = built.drop("path").join(steps, "id").join(entries, "entry_point_id")
    return rows.select("entry", "depth", F.col("node_count").cast("long").alias("node_count"), F.col("file_count").cast("long").alias("file_count"), "criticality",
                       F.array_join("p.node", " > ").alias("path"))


@_query(_METRICS + f"""SELECT * FROM metric WHERE entry IN (SELECT entry FROM member JOIN nodes ON qualified_name = node WHERE file_path = '{FILE}')""")
def affected_flows(g: Graph) -> DataFrame:
    return _rounded(flows.affected_flows(g, [FILE]))


# The graph without one file, as other_nodes and other_edges, and SQL over these.


_OTHER_GRAPH = f""", other_nodes AS (SELECT * FROM nodes WHERE file_path <> '{FILE}'), other_edges AS (SELECT * FROM edges WHERE file_path <> '{FILE}')"""


def _other(sql: str) -> str:
    return _OTHER_GRAPH + re.sub(r"\b(nodes|edges)\b", r"other_\1", sql)


@_query(_other(_METRICS) + "SELECT * FROM metric")
def updated_flows(g: Graph) -> DataFrame:
    """Stored flows after a file is gone: only those that it can have changed are traced again."""
    scratch = Scratch(g.spark, "updated_flows")
    g = Graph(scratch.write(g.nodes, "nodes"), scratch.write(g.edges, "edges"))
    stored = scratch.write(flows.build_flows(g, flows.trace(g)), "stored")
    files = g.spark.createDataFrame([(FILE,)], "file_path string")
    after = store.remove_files(g, files)
    now = flows.refreshed(stored, *flows.changed_flows(g, after, files))
    entries = after.nodes.select(F.col("id").alias("entry_point_id"), F.col("qualified_name").alias("entry"))
    rows = _rounded(now.join(large(entries), "entry_point_id"))
    return rows.select("entry", F.col("node_count").cast("long").alias("node_count"), F.col("file_count").cast("long").alias("file_count"), "depth", "criticality")


@_query("""SELECT source_qualified AS node, count(*) AS outside FROM edges WHERE kind = 'CALLS'
AND target_qualified NOT IN (SELECT qualified_name FROM nodes) GROUP BY 1""")
def external_calls(g: Graph) -> DataFrame:
    calls = g.edges_of("CALLS")
    outside = calls.join(g.nodes.select(F.col("qualified_name").alias("target_qualified")), "target_qualified", "left_anti")
    return outside.groupBy(F.col("source_qualified").alias("node")).agg(F.count("*").alias("outside"))


@_query("SELECT qualified_name FROM nodes WHERE qualified_name IN (SELECT target_qualified FROM edges WHERE kind = 'TESTED_BY')")
def tested_nodes(g: Graph) -> DataFrame:
    tested = g.edges_of("TESTED_BY").select(F.col("target_qualified").alias("qualified_name"))
    return g.nodes.join(tested, "qualified_name", "left_semi").select("qualified_name")


# --- refactoring --------------------------------------------------------------------------------

_LIVE = "(SELECT target_qualified FROM edges WHERE kind IN ('CALLS', 'TESTED_BY', 'IMPORTS_FROM', 'REFERENCES'))"
_DEAD = f"SELECT qualified_name, kind, name FROM nodes WHERE kind IN ('Function', 'Class') AND NOT is_test AND NOT {_ENTRY} AND qualified_name NOT IN {_LIVE}"
_MOVES = """, caller AS (
  SELECT e.target_qualified AS q, min(n.community_id) AS low, max(n.community_id) AS high
  FROM edges e JOIN nodes n ON n.qualified_name = e.source_qualified WHERE e.kind = 'CALLS' AND n.community_id IS NOT NULL GROUP BY 1)
"""
_MOVE = """SELECT qualified_name, community_id, low AS target_community FROM nodes JOIN caller ON q = qualified_name
WHERE kind = 'Function' AND low = high AND low <> community_id"""


@_query(_DEAD)
def dead_code(g: Graph) -> DataFrame:
    return refactor.dead_code(g).select("qualified_name", "kind", "name")


@_query(f"SELECT qualified_name FROM ({_DEAD.replace('SELECT qualified_name, kind, name', 'SELECT *')}) WHERE kind = 'Class' AND lower(file_path) LIKE '%brand2%'")
def dead_classes(g: Graph) -> DataFrame:
    return refactor.dead_code(g, "Class", "BRAND2").select("qualified_name")


@_query(_MOVES + _MOVE)
def suggest_move(g: Graph) -> DataFrame:
    return refactor.suggest_moves(g)


@_query(_MOVES + f"""SELECT 'remove' AS type, qualified_name, 'no inbound references' AS detail FROM ({_DEAD})
UNION ALL SELECT 'move', qualified_name, 'to community ' || target_community FROM ({_MOVE})""")
def suggestions(g: Graph) -> DataFrame:
    return refactor.suggestions(g)


_RENAME = """, target AS (SELECT * FROM nodes WHERE lower(name) LIKE '%auth%' OR lower(qualified_name) LIKE '%auth%' ORDER BY name = 'auth' DESC, qualified_name LIMIT 1),
site AS (
  SELECT file_path, line_start AS line, name, 0 AS rank FROM target
  UNION ALL SELECT e.file_path, e.line, t.name, CASE e.kind WHEN 'CALLS' THEN 1 ELSE 2 END FROM edges e JOIN target t ON e.target_qualified = t.qualified_name
  WHERE e.kind IN ('CALLS', 'IMPORTS_FROM'))
SELECT DISTINCT file_path, line, name AS old, 'identify' AS new, 'high' AS confidence FROM site"""


@_query(_RENAME)
def rename_preview(g: Graph) -> DataFrame:
    return refactor.rename_edits(g, "auth", "identify")


@_query(_RENAME.replace("SELECT DISTINCT file_path, line, name AS old, 'identify' AS new, 'high' AS confidence FROM site", "SELECT 'high' AS confidence, count(*) AS n FROM (SELECT DISTINCT file_path, line FROM site)"))
def rename_stats(g: Graph) -> DataFrame:
    return refactor.edit_stats(refactor.rename_edits(g, "auth", "identify"))


# --- communities and export ---------------------------------------------------------------------

@_query("""SELECT community_id, count(*) AS size, any_value(language) AS dominant_language FROM nodes WHERE community_id IS NOT NULL GROUP BY 1""")
def community_sizes(g: Graph) -> DataFrame:
    return community.summaries(g)


@_query("""SELECT community_id, rank, qualified_name, kind FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY qualified_name)::INT AS rank
FROM nodes WHERE community_id IS NOT NULL) WHERE rank <= 50""")
def community_members(g: Graph) -> DataFrame:
    return community.first_members(g).select("community_id", "rank", "qualified_name", "kind")


_CROSS = """, ends AS (
  SELECT e.source_qualified, e.target_qualified, a.community_id AS cs, b.community_id AS ct FROM edges e
  LEFT JOIN nodes a ON a.qualified_name = e.source_qualified LEFT JOIN nodes b ON b.qualified_name = e.target_qualified),
crossing AS (
  SELECT cs AS community_id, 'outgoing' AS direction, target_qualified AS name, count(*) AS n FROM ends WHERE cs IS NOT NULL AND cs IS DISTINCT FROM ct GROUP BY ALL
  UNION ALL
  SELECT ct, 'incoming', source_qualified, count(*) FROM ends WHERE ct IS NOT NULL AND cs IS DISTINCT FROM ct GROUP BY ALL)
"""


@_query(_CROSS + "SELECT * FROM crossing")
def cross_community_edges(g: Graph) -> DataFrame:
    return community.crossing(g)


@_query(_CROSS + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community_id, direction ORDER BY n DESC, name)::INT AS rank FROM crossing) WHERE rank <= 15""")
def cross_community_deps(g: Graph) -> DataFrame:
    return community.top_dependencies(g)


@_query(_FLOWS + "SELECT DISTINCT community_id, entry FROM member JOIN nodes ON qualified_name = node WHERE community_id IS NOT NULL")
def community_flows(g: Graph) -> DataFrame:
    return community.community_flows(g, flows.traced(g))


_PAGES = _METRICS + _CROSS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY qualified_name) AS rank, count(*) OVER (PARTITION BY community_id) AS n FROM nodes WHERE community_id IS NOT NULL),
member_table AS (SELECT community_id, string_agg('| ' || name || ' | ' || kind || ' | ' || file_path || ' | ' || line_start || '-' || line_end || ' |', chr(10) ORDER BY rank) AS t
  FROM ranked WHERE rank <= 50 AND kind <> 'File' GROUP BY 1),
top AS (SELECT m.*, n.name FROM metric m JOIN nodes n ON n.qualified_name = m.entry ORDER BY criticality DESC, entry LIMIT 200),
through AS (SELECT community_id, t.*, row_number() OVER (PARTITION BY community_id ORDER BY criticality DESC, entry) AS rank, count(*) OVER (PARTITION BY community_id) AS n
  FROM (SELECT DISTINCT community_id, entry FROM member JOIN nodes ON qualified_name = node WHERE community_id IS NOT NULL) JOIN top t USING (entry)),
flow_list AS (SELECT community_id, max(n) AS n, string_agg('1. `' || name || '`, weighs ' || round(criticality::DECIMAL(18, 6), 2)::VARCHAR || ', goes ' || depth || ' calls deep', chr(10) ORDER BY rank) AS t
  FROM through WHERE rank <= 10 GROUP BY 1),
tied AS (SELECT community_id, direction, string_agg(n || ' x `' || name || '`', chr(10) ORDER BY rank) AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY community_id, direction ORDER BY n DESC, name) AS rank FROM crossing) WHERE rank <= 15 GROUP BY 1, 2),
sizes AS (SELECT community_id, count(*) AS size FROM nodes WHERE community_id IS NOT NULL GROUP BY 1)
SELECT community_id AS id, 'Brand ' || community_id AS name, 'brand-' || community_id AS slug, size, replace(
  '# Brand ' || community_id || '~~' || size || ' symbols and files, cohesion 0.5000~Mostly written in python~~## What belongs to it~~'
  || coalesce('| symbol | is a | defined in | from-to |~|---|---|---|---|~' || m.t, 'Files only.') || CASE WHEN size > 50 THEN '~~(and ' || (size - 50) || ' others)' ELSE '' END
  || '~~## Flows through it~~' || coalesce(f.t, 'Nothing that was traced comes through here.') || CASE WHEN f.n > 10 THEN '~(and ' || (f.n - 10) || ' others)' ELSE '' END
  || '~~## What it is tied to~~' || CASE WHEN o.t IS NULL AND i.t IS NULL THEN 'It stands alone.~' ELSE
    coalesce('It needs:~~' || o.t || '~', '') || CASE WHEN o.t IS NOT NULL AND i.t IS NOT NULL THEN '~' ELSE '' END || coalesce('Needed by:~~' || i.t || '~', '') END, '~', chr(10)) AS page
FROM sizes LEFT JOIN member_table m USING (community_id) LEFT JOIN flow_list f USING (community_id)
LEFT JOIN tied o ON o.community_id = sizes.community_id AND o.direction = 'outgoing' LEFT JOIN tied i ON i.community_id = sizes.community_id AND i.direction = 'incoming'"""


@_query(_PAGES)
def community_pages(g: Graph) -> DataFrame:
    rows = community.summaries(g).select(
        F.col("community_id").alias("id"), F.concat(F.lit("Brand "), F.col("community_id").cast("string")).alias("name"), F.lit(0.5).alias("cohesion"), "size",
        "dominant_language", F.lit(None).cast("string").alias("description"))
    found = flows.traced(g)
    return community.pages(g, rows, _rounded(found.metrics(g)), found)


@_query(_METRICS + _CROSS + """SELECT community_id, 'member' AS section, NULL::DOUBLE AS weight, qualified_name AS key,
  '| ' || name || ' | ' || kind || ' | ' || file_path || ' | ' || line_start || '-' || line_end || ' |' AS line
FROM nodes WHERE community_id IS NOT NULL AND kind <> 'File'
UNION ALL SELECT community_id, direction, n::DOUBLE, name, n || ' x `' || name || '`' FROM crossing
UNION ALL SELECT c.community_id, 'flow', criticality, entry,
  '1. `' || n.name || '`, weighs ' || round(criticality::DECIMAL(18, 12), 2)::VARCHAR || ', goes ' || depth || ' calls deep'
FROM (SELECT DISTINCT community_id, entry FROM member JOIN nodes ON qualified_name = node WHERE community_id IS NOT NULL) c
JOIN (SELECT entry, depth, round(criticality, 12) AS criticality FROM metric_rows) USING (entry) JOIN nodes n ON n.qualified_name = entry""")
def community_page_lines(g: Graph) -> DataFrame:
    """All that belongs on the pages, of which ``community_pages`` shows the first lines. Rounded to 12 digits: to six,
    0.6771875 goes up or down by the last bit of a sum."""
    # The graph is written once: plans that make it anew for each of its uses fill the driver.
    scratch = Scratch(g.spark, "community_page_lines")
    g = Graph(scratch.write(g.nodes, "nodes"), scratch.write(g.edges, "edges"))
    found = flows.traced(g)
    return community.page_lines(g, found.metrics(g).withColumn("criticality", F.round("criticality", 12)), found)


# Rounds enough for all labels to stay, or to swing between two, on the fixture at any of its sizes.
@_query(""", pairs AS (
  SELECT DISTINCT source_qualified AS a, target_qualified AS b FROM edges
  WHERE source_qualified <> target_qualified AND source_qualified IN (SELECT qualified_name FROM nodes) AND target_qualified IN (SELECT qualified_name FROM nodes)),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
spread(round, node, label, was) AS (
  SELECT 0, qualified_name, ('0x' || substr(md5(qualified_name), 1, 15))::BIGINT, NULL::BIGINT FROM nodes
  UNION ALL
  SELECT l.round + 1, l.node, coalesce(v.label, l.label), l.label FROM spread l LEFT JOIN (
    SELECT a, label FROM (SELECT a, label, count(*) AS n FROM both_ways JOIN spread ON node = b GROUP BY a, label)
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1) v ON v.a = l.node
  WHERE l.round < 80)
SELECT node AS qualified_name, least(label, was) AS community_id FROM spread WHERE round = 80""")
def detect_communities(g: Graph) -> DataFrame:
    return community.detect(g)


@_query(f"""SELECT qualified_name, round(least(coalesce(c.n, 0) / 20.0::DOUBLE, 1.0) * 0.4::DOUBLE + CASE WHEN t.q IS NULL THEN 0.35 ELSE 0.0 END::DOUBLE
    + CASE WHEN regexp_matches(lower(name), '{_SECURE}') OR regexp_matches(lower(qualified_name), '{_SECURE}') THEN 0.25 ELSE 0.0 END::DOUBLE, 6) AS risk_score,
  coalesce(c.n, 0) AS caller_count, CASE WHEN t.q IS NULL THEN 'untested' ELSE 'tested' END AS test_coverage
FROM nodes LEFT JOIN (SELECT target_qualified AS q, count(DISTINCT source_qualified) AS n FROM edges WHERE kind = 'CALLS' GROUP BY 1) c ON c.q = qualified_name
LEFT JOIN (SELECT DISTINCT target_qualified AS q FROM edges WHERE kind = 'TESTED_BY') t ON t.q = qualified_name WHERE kind IN ('Function', 'Class')""")
def risk_index(g: Graph) -> DataFrame:
    return community.risk_index(g).select("qualified_name", "risk_score", "caller_count", "test_coverage")


_RAW = r""", raw_nodes AS (SELECT kind, regexp_replace(name, '_[0-9]+$', '') AS name, qualified_name, file_path FROM nodes),
raw_edges AS (
  SELECT e.kind, e.source_qualified, CASE WHEN e.kind = 'CALLS' AND e.target_qualified LIKE '%::%'
      THEN regexp_replace(split_part(e.target_qualified, '::', 2), '_[0-9]+$', '')
    WHEN e.kind = 'IMPORTS_FROM' THEN replace(regexp_replace(e.target_qualified, '\.py$', ''), '/', '.') ELSE e.target_qualified END AS target_qualified, e.line
  FROM edges e),
named AS (
  SELECT name AS key, qualified_name FROM raw_nodes
  UNION SELECT split_part(qualified_name, '/', -1), qualified_name FROM raw_nodes WHERE qualified_name LIKE '%::%'
  UNION SELECT replace(regexp_replace(file_path, '\.py$', ''), '/', '.') || CASE WHEN kind = 'File' THEN '' ELSE '.' || name END, qualified_name FROM raw_nodes
  UNION SELECT array_to_string(p[i:], '/'), qualified_name FROM (SELECT string_split(file_path, '/') AS p, unnest(range(1, 4)) AS i, qualified_name FROM raw_nodes WHERE kind = 'File')
    WHERE i <= len(p)),
asked AS (
  SELECT e.*, n.qualified_name IS NOT NULL AS exact, split_part(e.source_qualified, '::', 1) AS home FROM raw_edges e
  LEFT JOIN raw_nodes n ON n.qualified_name = e.target_qualified WHERE e.source_qualified IN (SELECT qualified_name FROM raw_nodes)),
best AS (
  SELECT key, home, arg_min(qualified_name, (CASE WHEN starts_with(qualified_name, home) THEN 0 ELSE 1 END, qualified_name)) AS target
  FROM (SELECT DISTINCT target_qualified AS key, home FROM asked WHERE NOT exact) JOIN named USING (key) GROUP BY key, home)
SELECT a.kind, a.source_qualified, CASE WHEN exact THEN a.target_qualified ELSE b.target END AS target_qualified, a.target_qualified AS raw_target, a.line
FROM asked a LEFT JOIN best b ON b.key = a.target_qualified AND b.home = a.home WHERE exact OR b.target IS NOT NULL
"""


@_query(_RAW)
def resolve_edges(g: Graph) -> DataFrame:
    short = lambda c: F.regexp_replace(c, "_[0-9]+$", "")
    target = F.col("target_qualified")
    raw = F.when((F.col("kind") == "CALLS") & target.contains("::"), short(F.substring_index(target, "::", -1))).when(
        F.col("kind") == "IMPORTS_FROM", keys.module_of(target)).otherwise(target)
    rough = Graph(g.nodes.withColumn("name", short(F.col("name"))), g.edges.withColumn("target_qualified", raw))
    return export.resolve_edges(rough).select("kind", "source_qualified", "target_qualified", "raw_target", "line")


@_query("SELECT qualified_name, kind FROM nodes WHERE file_path IN (SELECT file_path FROM nodes WHERE kind = 'File')")
def export_nodes(g: Graph) -> DataFrame:
    return export.export_nodes(g).select("qualified_name", "kind")


# --- search -------------------------------------------------------------------------------------

def _bm25_sql(key: str, source: str, columns: list[str], phrase: list[str]) -> str:
    """BM25 of a phrase over columns of a table, as CTEs that end in ``found`` (key, score)."""
    needle = " " + "  ".join(phrase) + " "
    lower = [f"translate(lower(coalesce({c}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')" for c in columns]
    cells = [f"list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')" for c in lower]
    count = " + ".join(f"(length(l{i}) - length(replace(l{i}, '{needle}', ''))) // {len(needle)}" for i in range(len(columns)))
    return f"""cells AS (SELECT {key} AS key, {', '.join(f'{c} AS c{i}' for i, c in enumerate(cells))} FROM {source}),
lines AS (SELECT key, {' + '.join(f'len(c{i})' for i in range(len(columns)))} AS n_tokens,
  {', '.join(f"' ' || array_to_string(c{i}, '  ') || ' ' AS l{i}" for i in range(len(columns)))} FROM cells),
counted AS (SELECT key, n_tokens, ({count})::DOUBLE AS f FROM lines),
total AS (SELECT count(*)::DOUBLE AS n, avg(n_tokens) AS mean, count(*) FILTER (f > 0)::DOUBLE AS df FROM counted),
found AS (
  SELECT key, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n_tokens / mean)) AS score
  FROM counted, total WHERE f > 0)"""


@_query("WITH " + _bm25_sql("doc_id", "documents", ["text"], ["is", "the"]) + " SELECT key AS doc_id, round(score, 6) AS score FROM found", on_graph=False)
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'postings').base}/index"
    index = TextIndex.build(_table(spark, sf_dir, "documents"), path, "doc_id", ("text",), stem=False)  # SQL has no stemmer
    return index.search("is the").withColumn("score", F.round("score", 6))


@_query("WITH " + _bm25_sql("doc_id", "documents", ["text"], ["the", "thing"]) + " SELECT key AS doc_id, round(score, 6) AS score FROM found", on_graph=False)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.fts_index(_table(spark, sf_dir, "documents"), "doc_id", ("text",), stem=False)  # SQL has no stemmer
    return search.bm25(index, "The thing", key="doc_id", stem=False).withColumn("score", F.round("score", 6))


@_query(""", said AS (SELECT qualified_name, name || ' ' || lower(kind) || ' python' AS text FROM nodes WHERE kind <> 'File')
SELECT qualified_name, text, sha256(text) AS text_hash FROM said WHERE NOT (length(qualified_name) % 3 = 0)""")
def pending_embeddings(g: Graph) -> DataFrame:
    """A third of the nodes has vectors of their present texts, another third of former ones."""
    text = F.concat_ws(" ", "name", F.lower("kind"), "language")
    third = F.length("qualified_name") % 3
    stored = g.nodes.filter("kind <> 'File'").filter(third < 2).select(
        "qualified_name", F.array(F.lit(0.0)).cast("array<float>").alias("vector"), F.sha2(F.when(third == 0, text).otherwise("former"), 256).alias("text_hash"), F.lit("p").alias("provider"))
    nodes = g.nodes.withColumns({c: F.lit(None).cast("string") for c in ("params", "return_type")})
    return search.pending_embeddings(nodes, stored, "p")


@_query("""SELECT vec_id, embedding[1] AS head FROM embeddings WHERE vec_id % 7 <> 0""", on_graph=False)
def remove_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "qualified_name")
    kept = search.remove_embeddings(rows, rows.filter("qualified_name % 7 = 0"))
    return kept.select(F.col("qualified_name").alias("vec_id"), F.element_at("embedding", 1).alias("head"))


@_query(", " + _bm25_sql("qualified_name", "nodes", ["name", "qualified_name", "file_path"], ["auth"]) + " SELECT key AS qualified_name, round(score, 6) AS score FROM found")
def fts_nodes(g: Graph) -> DataFrame:
    index = search.fts_index(g.nodes, "qualified_name")
    return search.bm25(index, "auth", key="qualified_name").withColumn("score", F.round("score", 6))


_COSINE = """CASE WHEN list_inner_product(v::DOUBLE[], v::DOUBLE[]) > 0 THEN list_inner_product(v::DOUBLE[], q.v0::DOUBLE[])
  / (sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_inner_product(q.v0::DOUBLE[], q.v0::DOUBLE[]))) ELSE 0 END"""


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@_query(f"""SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {_COSINE} AS score FROM (SELECT vec_id, embedding AS v FROM embeddings),
  (SELECT embedding AS v0 FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20)""", on_graph=False)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return search.vector_topk(rows, _first_vector(spark, sf_dir), 20, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@_query(f"""SELECT query, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id // 50 AS query, e.vec_id, {_COSINE.replace("q.v0", "q.v")} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id)::INT AS rank
  FROM (SELECT vec_id, embedding AS v FROM embeddings) e, (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id IN (0, 50, 100)) q) WHERE rank <= 20""".replace(
    "list_inner_product(v::", "list_inner_product(e.v::").replace(", v::DOUBLE", ", e.v::DOUBLE"), on_graph=False)
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries through cells around centroids: what a scan finds."""
    rows = _table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(rows, f"{Scratch(spark, 'vectors').base}/index", "vec_id", "embedding")
    asked = {r.vec_id: r.embedding for r in rows.filter("vec_id in (0, 50, 100)").collect()}
    return index.search([asked[i] for i in (0, 50, 100)], 20).withColumn("query", F.col("query").cast("long")).withColumn("score", F.round("score", 6))


@_query("""SELECT qualified_name, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
  SELECT qualified_name, row_number() OVER (ORDER BY line_end - line_start DESC, qualified_name) AS rank FROM nodes WHERE kind <> 'File' QUALIFY rank <= 200
  UNION ALL SELECT qualified_name, row_number() OVER (ORDER BY line_end DESC, qualified_name) AS rank FROM nodes WHERE kind <> 'File' QUALIFY rank <= 200) GROUP BY 1""")
def rrf_merge(g: Graph) -> DataFrame:
    rows = g.nodes.filter("kind <> 'File'")
    best = lambda score: rows.select("qualified_name", score.cast("double").alias("score")).orderBy(F.col("score").desc(), "qualified_name").limit(200)
    fused = search.rrf([best(F.col("line_end") - F.col("line_start")), best(F.col("line_end"))], "qualified_name")
    return fused.withColumn("score", F.round("score", 9))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, vectors = _with_vectors(spark, sf_dir)
    return search.semantic_search(g, "", vectors, _first_vector(spark, sf_dir), 30).select("qualified_name", "kind", "score")


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = fixture_graph(spark, sf_dir)
    key = F.regexp_extract("name", r"_(\d+)$", 1)
    parts = g.nodes.filter("kind <> 'File'").select("qualified_name", (key.cast("long") - 1).alias("vec_id"))
    return g, _table(spark, sf_dir, "embeddings").join(parts, "vec_id").select("qualified_name", F.col("embedding").alias("vector"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, vectors = _with_vectors(spark, sf_dir)
    index = search.fts_index(g.nodes, "qualified_name")
    found = search.hybrid_search(g, "auth_", index, vectors, _first_vector(spark, sf_dir), limit=20, context_files=[FILE])
    return found.select("qualified_name", "kind", F.round("score", 9).alias("score"))


_QUERIES["semantic_search"] = _semantic
_SQL["semantic_search"] = GRAPH_SQL + f""", vectors AS (SELECT s.file_path || '::' || s.name AS qualified_name, embedding AS v FROM embeddings JOIN symbols s ON s.key = vec_id + 1),
near AS (SELECT qualified_name, {_COSINE} AS score FROM vectors, (SELECT embedding AS v0 FROM embeddings WHERE vec_id = 0) q)
SELECT qualified_name, kind, round(score, 4) AS score FROM (SELECT * FROM near ORDER BY score DESC, qualified_name LIMIT 30) JOIN nodes USING (qualified_name)"""
_QUERIES["hybrid_search"] = _hybrid
_SQL["hybrid_search"] = GRAPH_SQL + ", " + _bm25_sql("qualified_name", "nodes", ["name", "qualified_name", "file_path"], ["auth"]) + f""",
vectors AS (SELECT s.file_path || '::' || s.name AS qualified_name, embedding AS v FROM embeddings JOIN symbols s ON s.key = vec_id + 1),
near AS (SELECT qualified_name AS key, {_COSINE} AS score FROM vectors, (SELECT embedding AS v0 FROM embeddings WHERE vec_id = 0) q),
fused AS (SELECT key, sum(part) AS score FROM (
  SELECT key, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) AS part FROM (SELECT * FROM found ORDER BY score DESC, key LIMIT 60)
  UNION ALL SELECT key, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) FROM (SELECT * FROM near ORDER BY score DESC, key LIMIT 60)) GROUP BY key)
SELECT qualified_name, kind, round(score * CASE WHEN kind = 'Function' THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN file_path = '{FILE}' THEN 1.5 ELSE 1.0 END::DOUBLE, 9) AS score
FROM fused JOIN nodes ON qualified_name = key ORDER BY 3 DESC, 1 LIMIT 20"""


@_query("""SELECT repo, qualified_name, CASE WHEN starts_with(lower(name), 'handle') THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM (
  SELECT 'one' AS repo, * FROM nodes WHERE file_path LIKE 'src/Brand1%' UNION ALL SELECT 'two', * FROM nodes WHERE file_path LIKE 'src/Brand2%')
WHERE lower(name) LIKE '%handle%' OR lower(qualified_name) LIKE '%handle%' ORDER BY score DESC, repo, qualified_name LIMIT 30""")
def cross_repo_search(g: Graph) -> DataFrame:
    part = lambda p: Graph(g.nodes.filter(F.col("file_path").startswith(p)), g.edges)
    found = search.cross_repo_search({"1": ("one", part("src/Brand1")), "2": ("two", part("src/Brand2"))}, "handle", 30)
    return found.select(F.col("repo_path").alias("repo"), "qualified_name", "score")


# --- maintenance --------------------------------------------------------------------------------

@_query(""", fresh AS (
  SELECT kind, name || '_v' || v AS name, CASE WHEN v = 2 THEN qualified_name || '_new' ELSE qualified_name END AS qualified_name, line_start + v AS line_start, v
  FROM nodes, (SELECT unnest([0, 1, 2]) AS v) WHERE kind = 'Class'),
latest AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY v DESC) = 1)
SELECT kind, name, qualified_name, line_start FROM nodes WHERE qualified_name NOT IN (SELECT qualified_name FROM latest)
UNION ALL SELECT kind, name, qualified_name, line_start FROM latest""")
def node_upsert(g: Graph) -> DataFrame:
    v = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    new = g.nodes.filter("kind = 'Class'").withColumn("seq", v)
    new = new.withColumn("name", F.concat("name", F.lit("_v"), F.col("seq").cast("string"))).withColumn("line_start", F.col("line_start") + F.col("seq"))
    new = new.withColumn("qualified_name", F.when(F.col("seq") == 2, F.concat("qualified_name", F.lit("_new"))).otherwise(F.col("qualified_name")))
    return store.upsert_nodes(g.nodes, new).select("kind", "name", "qualified_name", "line_start")


@_query("""SELECT kind, source_qualified, target_qualified, file_path, line FROM edges WHERE kind <> 'INHERITS'
UNION ALL SELECT DISTINCT kind, source_qualified, target_qualified, file_path, line FROM edges WHERE kind = 'INHERITS'
UNION ALL SELECT DISTINCT 'REFERENCES', source_qualified, target_qualified, file_path, line FROM edges WHERE kind = 'INHERITS'""")
def edge_upsert(g: Graph) -> DataFrame:
    own = g.edges.filter("kind = 'INHERITS'")
    new = own.unionByName(own.withColumn("kind", F.lit("REFERENCES"))).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return store.upsert_edges(g.edges, new)


@_query(f"""SELECT qualified_name, line_start FROM nodes WHERE file_path <> '{FILE}'
UNION ALL SELECT qualified_name, line_start + 5 FROM nodes WHERE file_path = '{FILE}' AND kind <> 'Test'""")
def slice_replace(g: Graph) -> DataFrame:
    files = g.nodes.sparkSession.createDataFrame([(FILE,)], "file_path string")
    new = g.nodes.filter((F.col("file_path") == FILE) & (F.col("kind") != "Test")).withColumn("line_start", F.col("line_start") + 5)
    return store.replace_files(g, files, new, g.edges.filter(F.col("file_path") == FILE)).nodes.select("qualified_name", "line_start")


def _kept(g: Graph) -> store.GraphStore:
    """A store of the graph, in a folder of its own."""
    kept = store.GraphStore(g.spark, f"{Scratch(g.spark, 'stored').base}/graph")
    kept.write_graph(Graph(g.nodes.withColumns({c: F.lit(None).cast("string") for c in ("params", "return_type", "modifiers", "file_hash")}), g.edges))
    return kept


@_query(f"""SELECT qualified_name, line_start, community_id FROM nodes WHERE file_path <> '{FILE}'
UNION ALL SELECT qualified_name, line_start + 5, NULL FROM nodes WHERE file_path = '{FILE}' AND kind <> 'Test'""")
def stored_update(g: Graph) -> DataFrame:
    """The same by a store: written whole, one file's slice put in place, read back."""
    kept = _kept(g)
    nodes = kept.graph().nodes
    new = nodes.filter((F.col("file_path") == FILE) & (F.col("kind") != "Test"))
    new = new.withColumn("line_start", F.col("line_start") + 5).withColumn("community_id", F.lit(None).cast("long"))
    kept.replace_slices(g.spark.createDataFrame([(FILE,)], "file_path string"), Graph(new, g.edges.filter(F.col("file_path") == FILE)))
    return kept.graph().nodes.select("qualified_name", "line_start", "community_id")


@_query(_WALK + "SELECT * FROM hit")
def stored_impact(g: Graph) -> DataFrame:
    """The impact by a store's links: a level reads the buckets of its own names."""
    return stored.impacted(_kept(g), [FILE], 2).select("qualified_name", "kind", "file_path", "min_depth")


@_query(_DEPENDENTS)
def stored_dependents(g: Graph) -> DataFrame:
    return stored.file_dependents(_kept(g), [FILE], 2)


@_query(f"""SELECT 'node' AS said, kind, qualified_name AS name, file_path AS other FROM nodes WHERE file_path = '{FILE}'
  UNION ALL SELECT 'caller', kind, target_qualified, source_qualified FROM edges WHERE target_qualified = 'ext.lib_3'
  UNION ALL SELECT 'callee', kind, source_qualified, target_qualified FROM edges WHERE source_qualified = '{FILE}'""")
def stored_lookups(g: Graph) -> DataFrame:
    """Nodes by name, edges by either end: each reads the buckets of what is asked for."""
    kept = _kept(g)
    nodes = stored.nodes_named(kept, stored.nodes_by_file(kept, FILE).select("qualified_name"))
    return nodes.select(F.lit("node").alias("said"), "kind", F.col("qualified_name").alias("name"), F.col("file_path").alias("other")).unionByName(
        stored.edges_by_target(kept, "ext.lib_3").select(F.lit("caller").alias("said"), "kind", F.col("target_qualified").alias("name"), F.col("source_qualified").alias("other"))).unionByName(
        stored.edges_by_source(kept, FILE).select(F.lit("callee").alias("said"), "kind", F.col("source_qualified").alias("name"), F.col("target_qualified").alias("other")))


@_query(_other(_STATS))
def stored_stats(g: Graph) -> DataFrame:
    """Totals after a file is gone, from the counts that the store keeps for each bucket."""
    kept = _kept(g)
    stored.graph_stats(kept)
    kept.replace_slices(g.spark.createDataFrame([(FILE,)], "file_path string"), Graph(g.nodes.limit(0), g.edges.limit(0)))
    return _said(stored.graph_stats(kept))


@_query(f"SELECT kind, source_qualified, target_qualified FROM edges WHERE file_path <> '{FILE}'")
def remove_file(g: Graph) -> DataFrame:
    files = g.nodes.sparkSession.createDataFrame([(FILE,)], "file_path string")
    return store.remove_files(g, files).edges.select("kind", "source_qualified", "target_qualified")


@_query("""SELECT file_path, sha256(file_path || CASE WHEN length(file_path) % 3 = 0 THEN '!' ELSE '' END) AS file_hash
FROM (SELECT DISTINCT file_path FROM nodes) WHERE length(file_path) % 3 = 0""")
def hash_skip(g: Graph) -> DataFrame:
    stored = Graph(g.nodes.withColumn("file_hash", F.sha2("file_path", 256)), g.edges)
    edited = F.when(F.length("file_path") % 3 == 0, "!").otherwise("")
    current = g.nodes.select("file_path").distinct().withColumn("file_hash", F.sha2(F.concat("file_path", edited), 256))
    return store.changed_files(stored, current)


@_query("SELECT DISTINCT file_path FROM nodes WHERE file_path LIKE '%economy%'")
def stale_files(g: Graph) -> DataFrame:
    return store.stale_files(g, g.nodes.filter(~F.col("file_path").contains("economy")).select("file_path").distinct())


# --- scalar functions ---------------------------------------------------------------------------

_EXTENSIONS = [*keys.LANGUAGES, ".md", ""]
_PATHS = f"""WITH ext AS (SELECT {_EXTENSIONS!r} AS e),
paths AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/node_modules/b/' WHEN 2 THEN 'bootstrap/cache/x/' WHEN 3 THEN 'src/test_' ELSE 'src/' END
  || replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '.min' WHEN 1 THEN '_test' ELSE '' END || upper(e[p_partkey % {len(_EXTENSIONS)} + 1][1:2]) || e[p_partkey % {len(_EXTENSIONS)} + 1][3:] AS path
  FROM part, ext)
"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    e = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (k % len(_EXTENSIONS) + 1).cast("int"))
    where = F.when(k % 7 == 0, "node_modules/").when(k % 7 == 1, "a/node_modules/b/").when(k % 7 == 2, "bootstrap/cache/x/").when(k % 7 == 3, "src/test_").otherwise("src/")
    mark = F.when(k % 5 == 0, ".min").when(k % 5 == 1, "_test").otherwise("")
    path = F.concat(where, F.replace("p_name", F.lit(" "), F.lit("_")), mark, F.upper(F.substring(e, 1, 2)), F.substring(e, 3, 20))
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name", path.alias("path"))


_LANG = "CASE lower(regexp_extract(split_part(path, '/', -1), '(\\.[^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in keys.LANGUAGES.items()) + " ELSE '' END"


@_query(_PATHS + f"SELECT p_partkey, path, {_LANG} AS language FROM paths", on_graph=False)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("p_partkey", "path", keys.detect_language(F.col("path")).alias("language"))


@_query(_PATHS + """SELECT p_partkey, path FROM paths WHERE NOT (
  contains('/' || path, '/node_modules/') OR contains('/' || path, '/bootstrap/cache/') OR path LIKE '%.min.js' OR path LIKE '%.min.css' OR path LIKE '%.pyc')""", on_graph=False)
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).filter(~basic.is_ignored(F.col("path"))).select("p_partkey", "path")


_TESTS = " OR ".join(f"(language = '{lang}' AND starts_with(name, '{p}'))" for lang, ps in keys.TEST_PREFIXES.items() for p in ps)
_MARKS = " OR ".join(f"contains(split_part(path, '/', -1), '{m}')" for m in keys.TEST_FILE_MARKS)


@_query(_PATHS.rstrip() + f""", named AS (SELECT p_partkey, path, {_LANG} AS language,
  CASE p_partkey % 4 WHEN 0 THEN 'test_x' WHEN 1 THEN 'TestX' WHEN 2 THEN 'Benchmark' ELSE 'run' END AS name FROM paths)
SELECT p_partkey, name, ({_TESTS} OR {_MARKS}) AS is_test FROM named""", on_graph=False)
def is_test_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "test_x").when(k % 4 == 1, "TestX").when(k % 4 == 2, "Benchmark").otherwise("run")
    rows = _paths(spark, sf_dir).withColumn("name", name)
    return rows.select("p_partkey", "name", keys.is_test_function(F.col("name"), keys.detect_language(F.col("path")), F.col("path")).alias("is_test"))


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '::' || p_type || '.' || p_name ELSE p_brand || '::' || p_name END AS qualified_name,
  CASE WHEN trim(regexp_replace(lower(p_name || ' #' || p_type), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'unnamed'
    ELSE trim(regexp_replace(lower(p_name || ' #' || p_type), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
  left(p_name || chr(9) || 'x', 10) AS clean FROM part""", on_graph=False)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "File").otherwise("Function")
    parent = F.when(k % 3 == 1, F.col("p_type"))
    dirty = F.concat(F.col("p_name"), F.lit("\x01\t\x00x"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", keys.qualified_name(kind, F.col("p_name"), F.col("p_brand"), parent).alias("qualified_name"),
        keys.slugify(F.concat("p_name", F.lit(" #"), "p_type")).alias("slug"), keys.sanitize(dirty, 10).alias("clean"))


# --- events -------------------------------------------------------------------------------------

_TOOL = {"view": "query_graph", "click": "get_flow", "signup": "list_flows", "purchase": "refactor", "error": "detect_changes"}
_CALLS = "WITH calls AS (SELECT user_id AS session, event_id AS seq, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TOOL.items()) + " END AS tool FROM events)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.create_map(*[F.lit(x) for pair in _TOOL.items() for x in pair])
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.try_element_at(tool, F.col("event_type")).alias("tool"))


_INTENT = "CASE " + " ".join(f"WHEN tool IN ({', '.join(repr(t) for t in tools)}) THEN '{i}'" for i, tools in hints.INTENTS.items()) + " END"


@_query(_CALLS + f""", recent AS (SELECT session, {_INTENT} AS intent FROM calls QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 10),
per AS (SELECT session, intent, count(*) AS n FROM recent WHERE intent IS NOT NULL GROUP BY ALL)
SELECT session, coalesce(intent, 'exploring') AS intent, coalesce(n, 0)::BIGINT AS score FROM (SELECT DISTINCT session FROM calls) LEFT JOIN (
  SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC, intent) = 1) USING (session)""", on_graph=False)
def session_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.session_intent(_calls(spark, sf_dir))


_NEXT = ", ".join(f"('{t}', '{n}', {i})" for t, steps in hints.NEXT.items() for i, (n, _) in enumerate(steps))


@_query(_CALLS + f""", kept AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rank FROM calls QUALIFY rank <= 100),
step(last, tool, place) AS (VALUES {_NEXT})
SELECT k.session, s.tool, s.place FROM kept k JOIN step s ON s.last = k.tool WHERE k.rank = 1
  AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.session = k.session AND x.tool = s.tool)
QUALIFY row_number() OVER (PARTITION BY k.session ORDER BY s.place) <= 3""", on_graph=False)
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hints.next_steps(_calls(spark, sf_dir))


@_query("""WITH e AS (SELECT user_id, epoch_us(ts) AS moment FROM events),
g AS (SELECT *, CASE WHEN moment - lag(moment) OVER o < 3600000000 THEN 0 ELSE 1 END AS first FROM e WINDOW o AS (PARTITION BY user_id ORDER BY moment)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY moment)::BIGINT AS session FROM g)
SELECT user_id, session, min(moment) AS begin, max(moment) AS last, count(*) AS n FROM s GROUP BY ALL""", on_graph=False)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    return sessions(_table(spark, sf_dir, "events").select("user_id", moment.alias("moment")), "user_id", 3_600_000_000)


@_query("""SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type""", on_graph=False)
def json_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.from_json("props", "k long")["k"]
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(own).alias("total"))


@_query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""", on_graph=False)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return _table(spark, sf_dir, "pages").select("page_id", links.alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


_SOURCE = """WITH p AS (SELECT 'm' || (p_partkey % 50) || '/f' || p_partkey || '.py' AS path, 'run_' || p_partkey AS fn, 'Box' || p_partkey AS cls, 'run_' || (p_partkey + 1) AS callee FROM part)
"""


@_query(_SOURCE + """SELECT 'CONTAINS' AS kind, path AS source_qualified, path || '::' || cls AS target_qualified, 3 AS line FROM p
UNION ALL SELECT 'INHERITS', path || '::' || cls, 'Base', 3 FROM p
UNION ALL SELECT 'CONTAINS', path || '::' || cls, path || '::' || cls || '.go', 4 FROM p
UNION ALL SELECT 'CALLS', path || '::' || cls || '.go', 'self.' || callee, 5 FROM p
UNION ALL SELECT 'CONTAINS', path, path || '::' || fn, 7 FROM p
UNION ALL SELECT 'CALLS', path || '::' || fn, callee, 8 FROM p
UNION ALL SELECT 'IMPORTS_FROM', path, 'os.path', 1 FROM p""", on_graph=False)
def parse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = parse_files(_files(spark, sf_dir), spark.sparkContext.defaultParallelism).select(F.explode("edges").alias("e"))
    return edges.select("e.kind", "e.source_qualified", "e.target_qualified", "e.line")


@_query(_SOURCE + """SELECT 'File' AS kind, path AS qualified_name, 1 AS line_start, 8 AS line_end, NULL AS params, NULL AS return_type FROM p
UNION ALL SELECT 'Class', path || '::' || cls, 3, 5, NULL, NULL FROM p
UNION ALL SELECT 'Function', path || '::' || cls || '.go', 4, 5, '(self)', NULL FROM p
UNION ALL SELECT 'Function', path || '::' || fn, 7, 8, '(x: int)', 'str' FROM p""", on_graph=False)
def parsed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parsed_graph(parse_files(_files(spark, sf_dir), spark.sparkContext.defaultParallelism)).nodes
    return nodes.select("kind", "qualified_name", "line_start", "line_end", "params", "return_type")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    code = F.format_string("from os.path import join\n\nclass Box%s(Base):\n    def go(self):\n        self.run_%s()\n\ndef run_%s(x: int) -> str:\n    return run_%s(x)\n",
                           k, (F.col("p_partkey") + 1).cast("string"), k, (F.col("p_partkey") + 1).cast("string"))
    path = F.concat(F.lit("m"), (F.col("p_partkey") % 50).cast("string"), F.lit("/f"), k, F.lit(".py"))
    return _table(spark, sf_dir, "part").select(path.alias("file_path"), code.cast("binary").alias("content")).withColumn("file_hash", F.sha2("content", 256))

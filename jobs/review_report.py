"""Ranks the files of a code graph by how carefully a change of them should be reviewed.

    python -m jobs.review_report --tables DIR --output DIR [--config jobs/review_report.json]

``tables`` holds the tables ``part`` and ``lineitem``, which are read as a code graph. For each file: its symbols, long
functions, functions and classes without a test, dead ones, other files that depend on it directly, execution flows
that come through it, the highest criticality of these, and a risk of 0 to 1 from all that. Files are ranked by risk
within their area, the folder below ``src``. The report is written in a directory for each area.

A run replaces the directories of the areas that it reports on, by dynamic partition overwrite, and no others; with the
same tables and settings it writes the same rows again. ``areas`` limits a run to some areas (all if empty), ``long``
says from how many lines on a function is long, ``weights`` how much each part of the risk weighs.

Defined cases: ties of risk are ranked by path; a file of no symbols has no untested or dead share; tables without rows
give an empty report and leave what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import Graph
from codeloom.operators import flows, refactor, traverse
from codeloom.operators.joins import large
from codeloom.operators.ranking import rank_within
from codeloom.scratch import Scratch
from codeloom.sources.fixture_graph import fixture_graph

from .common import command_line, log, read_config

DEFAULTS = {"areas": [], "long": 60, "weights": {"criticality": 0.4, "dependents": 0.3, "untested": 0.2, "dead": 0.1}}
#: Direct dependents from which on a file counts as one that everything depends on.
MANY = 10
COLUMNS = ("area", "rank", "file_path", "risk", "symbols", "long_functions", "untested", "dead", "dependents", "flows", "criticality")


def area_of(path) -> F.Column:
    return F.split_part(path, F.lit("/"), F.lit(2))


def flows_through(g: Graph, found: flows.Traced, metrics: DataFrame) -> DataFrame:
    """(file_path, flows, criticality): how many flows come through a file, and their highest criticality. Files that a
    class of flows reaches count for all flows of it; an entry's own file counts for itself where its class doesn't
    reach that. ``metrics``: (entry, criticality)."""
    where = g.nodes.select(F.col("qualified_name").alias("node"), "file_path")
    reached = found.places(where, "file_path")
    each = found.entries.join(large(metrics), "entry")
    per = each.groupBy("cls").agg(F.count("*").alias("n"), F.max("criticality").alias("criticality"))
    shared = reached.join(large(per), "cls").select("file_path", "n", "criticality")
    own = each.join(large(where.withColumnRenamed("node", "entry")), "entry").join(large(reached), ["cls", "file_path"], "left_anti")
    every = shared.unionByName(own.select("file_path", F.lit(1).cast("long").alias("n"), "criticality"))
    return every.groupBy("file_path").agg(F.sum("n").alias("flows"), F.max("criticality").alias("criticality"))


def review_rows(g: Graph, settings: dict) -> DataFrame:
    """The report's rows (COLUMNS) for all areas."""
    scratch = Scratch(g.spark, "review_rows")
    symbols = g.nodes.filter("kind <> 'File'")
    checked = F.col("kind").isin("Function", "Class")
    tested = g.edges_of("TESTED_BY").select(F.col("target_qualified").alias("qualified_name")).distinct().withColumn("tested", F.lit(True))
    dead = refactor.dead_code(g).select("qualified_name").withColumn("dead", F.lit(True))
    about = symbols.join(large(tested), "qualified_name", "left").join(large(dead), "qualified_name", "left")
    about = about.groupBy("file_path").agg(
        F.count("*").alias("symbols"), F.count_if((F.col("kind") == "Function") & (F.col("line_end") - F.col("line_start") + 1 >= settings["long"])).alias("long_functions"),
        F.count_if(checked & F.col("tested").isNull()).alias("untested"), F.count_if(F.col("dead").isNotNull()).alias("dead"))
    dependents = traverse.file_steps(g).groupBy(F.col("src").alias("file_path")).agg(F.count("*").alias("dependents"))
    found = flows.traced(g)
    through = flows_through(g, found, scratch.write(found.metrics(g).select("entry", "criticality"), "metrics"))
    rows = g.nodes.select("file_path").distinct()
    for part in (about, dependents, through):
        rows = rows.join(large(part), "file_path", "left")
    rows = rows.fillna(0)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("symbols")), F.lit(0.0))
    w = settings["weights"]
    risk = (F.col("criticality") * w["criticality"] + F.least(F.col("dependents") / MANY, F.lit(1.0)) * w["dependents"] + share("untested") * w["untested"] + share("dead") * w["dead"])
    rows = rows.withColumn("risk", F.round(risk, 6)).withColumn("criticality", F.round("criticality", 6)).withColumn("area", area_of(F.col("file_path")))
    return rank_within(rows, "area", F.col("risk").desc(), F.col("file_path")).select(*COLUMNS)


def report(spark: SparkSession, tables: str, output: str, config: str | None = None) -> dict:
    """Writes the report of the given tables; what was read and written."""
    settings = read_config(spark, config, DEFAULTS)
    output, tables = output.rstrip("/"), tables.rstrip("/")
    scratch = Scratch(spark, "review")
    g = fixture_graph(spark, tables)
    g = Graph(scratch.write(g.nodes, "nodes"), scratch.write(g.edges, "edges"))  # each is read by every part of the report
    rows = review_rows(g, settings)
    if settings["areas"]:
        rows = rows.filter(F.col("area").isin(*settings["areas"]))
    rows = scratch.write(rows, "report")
    rows.repartition("area").sortWithinPartitions("area", "rank").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area").parquet(output)
    read = g.nodes.agg(F.count("*").alias("n")).first().n, g.edges.agg(F.count("*").alias("n")).first().n
    wrote = rows.agg(F.count("*").alias("n"), F.countDistinct("area").alias("areas")).first()
    scratch.close()
    about = {"nodes": read[0], "edges": read[1], "files": wrote.n, "areas": wrote.areas}
    log.info("%s: read %d nodes and %d edges from %s; wrote %d files of %d areas", output, *read, tables, wrote.n, wrote.areas)
    return about


if __name__ == "__main__":
    command_line(__doc__, "review-report", {"tables": "folder of the tables", "output": "folder of the report"}, report)

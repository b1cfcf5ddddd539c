"""A code graph as a deterministic projection of a star schema, in Spark and in SQL.

Files are the distinct (brand, type) of parts, symbols are parts, calls are neighbouring order lines of high quantity.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.joins import hashed, large


def fixture_graph(spark: SparkSession, sf_dir: str) -> Graph:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), F.lower("p_type"), F.lit(".py"))
    kind = F.when(k % 10 == 0, "Test").when(k % 10 == 1, "Class").when(k % 10 == 2, "Type").otherwise("Function")
    prefix = F.when(k % 10 == 0, "test_").when(k % 50 == 3, "handle_").when(k % 20 == 5, "auth_").otherwise("")
    symbols = part.select(
        k.alias("key"), kind.alias("kind"), F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string")).alias("name"),
        path.alias("file_path"), (k % 1000 + 1).cast("int").alias("line_start"), (k % 1000 + 1 + 2 * F.col("p_size")).cast("int").alias("line_end"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("community_id"),
    ).withColumn("qualified_name", F.concat("file_path", F.lit("::"), "name"))
    files = symbols.groupBy("file_path").agg(F.max("line_end").alias("line_end")).select(
        F.lit("File").alias("kind"), F.col("file_path").alias("name"), "file_path", F.lit(1).alias("line_start"), "line_end",
        F.lit(None).cast("long").alias("community_id"), F.col("file_path").alias("qualified_name"))
    shape = ["kind", "name", "qualified_name", "file_path", "line_start", "line_end", "community_id"]
    nodes = files.select(*shape).unionByName(symbols.select(*shape)).select(
        F.xxhash64("qualified_name").alias("id"), *shape, F.lit("python").alias("language"), F.lit(None).cast("string").alias("parent_name"),
        F.lit(None).cast("string").alias("signature"), (F.col("kind") == "Test").alias("is_test"), F.lit(None).cast("map<string,string>").alias("extra"))
    of = symbols.select(F.col("key"), F.col("qualified_name").alias("qn"), F.col("file_path").alias("fp"), F.col("kind").alias("sk"), F.col("line_start").alias("ls"))
    first = line.filter("l_quantity >= 48").select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    second = line.select("l_orderkey", F.col("l_partkey").alias("b"), "l_linenumber")
    pairs = second.join(hashed(first), ["l_orderkey", "l_linenumber"]).filter("a <> b").select("a", "b").distinct()
    source = of.select(F.col("key").alias("a"), F.col("qn").alias("source_qualified"), F.col("fp").alias("file_path"), F.col("sk"), F.col("ls").alias("line"))
    target = of.select(F.col("key").alias("b"), F.col("qn").alias("target_qualified"), F.col("fp").alias("target_file"))
    resolved = pairs.join(large(source), "a").join(large(target), "b")
    phantom = line.filter("l_returnflag = 'R' and l_quantity = 1").select(
        F.col("l_partkey").alias("a"), F.concat(F.lit("ext.lib_"), (F.col("l_suppkey") % 10).cast("string")).alias("target_qualified")).distinct().join(large(source), "a")
    ends = ["source_qualified", "target_qualified", "file_path", "line"]
    calls = resolved.select(*ends, "sk").unionByName(phantom.select(*ends, "sk"))
    imports = resolved.filter("file_path <> target_file").select(
        F.col("file_path").alias("source_qualified"), F.col("target_file").alias("target_qualified"), "file_path", F.lit(1).alias("line")).distinct()
    classes = of.filter("sk = 'Class'")
    base = classes.select((F.col("key") + 10).alias("key"), F.col("qn").alias("target_qualified"))
    inherits = classes.join(large(base), "key").select(F.col("qn").alias("source_qualified"), "target_qualified", F.col("fp").alias("file_path"), F.col("ls").alias("line"))
    contains = of.select(F.col("fp").alias("source_qualified"), F.col("qn").alias("target_qualified"), F.col("fp").alias("file_path"), F.col("ls").alias("line"))

    def as_kind(df, kind):
        return df.select(F.lit(kind).alias("kind"), *ends)

    edges = (
        as_kind(calls, "CALLS").unionByName(as_kind(resolved.filter("sk = 'Test'"), "TESTED_BY")).unionByName(as_kind(imports, "IMPORTS_FROM"))
        .unionByName(as_kind(inherits, "INHERITS")).unionByName(as_kind(contains, "CONTAINS")))
    return Graph(nodes, edges)


#: The same graph as SQL: the views nodes and edges, to go before a query.
GRAPH_SQL = r"""
WITH RECURSIVE symbols AS (
  SELECT p_partkey AS key,
    CASE p_partkey % 10 WHEN 0 THEN 'Test' WHEN 1 THEN 'Class' WHEN 2 THEN 'Type' ELSE 'Function' END AS kind,
    (CASE WHEN p_partkey % 10 = 0 THEN 'test_' WHEN p_partkey % 50 = 3 THEN 'handle_' WHEN p_partkey % 20 = 5 THEN 'auth_' ELSE '' END)
      || replace(p_name, ' ', '_') || '_' || p_partkey AS name,
    'src/' || replace(p_brand, '#', '') || '/' || lower(p_type) || '.py' AS file_path,
    (p_partkey % 1000 + 1)::INT AS line_start, (p_partkey % 1000 + 1 + 2 * p_size)::INT AS line_end,
    regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS community_id
  FROM part),
nodes AS (
  SELECT 'File' AS kind, file_path AS name, file_path AS qualified_name, file_path, 1 AS line_start, max(line_end) AS line_end,
    NULL::BIGINT AS community_id, 'python' AS language, FALSE AS is_test
  FROM symbols GROUP BY file_path
  UNION ALL
  SELECT kind, name, file_path || '::' || name, file_path, line_start, line_end, community_id, 'python', kind = 'Test' FROM symbols),
sym AS (SELECT key, kind, file_path, line_start, file_path || '::' || name AS qn FROM symbols),
resolved AS (
  SELECT x.qn AS source_qualified, y.qn AS target_qualified, x.file_path, x.line_start AS line, x.kind AS sk, y.file_path AS target_file
  FROM (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 48 AND a.l_partkey <> b.l_partkey)
  JOIN sym x ON x.key = a JOIN sym y ON y.key = b),
calls AS (
  SELECT source_qualified, target_qualified, file_path, line, sk FROM resolved
  UNION ALL
  SELECT DISTINCT x.qn, 'ext.lib_' || (l_suppkey % 10), x.file_path, x.line_start, x.kind
  FROM lineitem JOIN sym x ON x.key = l_partkey WHERE l_returnflag = 'R' AND l_quantity = 1),
edges AS (
  SELECT 'CALLS' AS kind, source_qualified, target_qualified, file_path, line FROM calls
  UNION ALL SELECT 'TESTED_BY', source_qualified, target_qualified, file_path, line FROM resolved WHERE sk = 'Test'
  UNION ALL SELECT DISTINCT 'IMPORTS_FROM', file_path, target_file, file_path, 1 FROM resolved WHERE file_path <> target_file
  UNION ALL SELECT 'INHERITS', a.qn, b.qn, a.file_path, a.line_start FROM sym a JOIN sym b ON b.key = a.key - 10 WHERE a.kind = 'Class' AND b.kind = 'Class'
  UNION ALL SELECT 'CONTAINS', file_path, qn, file_path, line_start FROM sym)
"""

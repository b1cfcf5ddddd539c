"""The jobs as queries: each runs twice into one new folder of the shared ones, and what is there then is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.catalog import FLOW_METRICS_SQL
from codeloom.scratch import scratch_root
from codeloom.sources.fixture_graph import GRAPH_SQL

from . import refresh_index, review_report


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job1")
    for _ in range(2):
        refresh_index.refresh(spark, f"{sf_dir}/documents.parquet", f"{base}/index", f"{base}/checkpoint")
    return refresh_index.postings(spark, f"{base}/index")


JOB1_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
each AS (SELECT doc_id, unnest(w) AS token FROM words),
lengths AS (SELECT doc_id, max(len(w)) AS n_tokens FROM words GROUP BY doc_id)
SELECT doc_id, token, count(*) AS times, n_tokens FROM each JOIN lengths USING (doc_id) GROUP BY ALL
"""


def job2_review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job2")
    for _ in range(2):
        review_report.report(spark, sf_dir, f"{base}/report")
    return spark.read.parquet(f"{base}/report").select("area", *[F.col(c) for c in review_report.COLUMNS if c != "area"])


JOB2_SQL = GRAPH_SQL + FLOW_METRICS_SQL + """, dead_symbols AS (
  SELECT qualified_name FROM nodes WHERE kind IN ('Function', 'Class') AND NOT is_test AND NOT regexp_matches(name, '^main$|^__main__$|^test_|^Test[A-Z]|^on_|^handle_')
    AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind IN ('CALLS', 'TESTED_BY', 'IMPORTS_FROM', 'REFERENCES'))),
own AS (
  SELECT file_path, count(*) AS symbols, count(*) FILTER (kind = 'Function' AND line_end - line_start + 1 >= 60) AS long_functions,
    count(*) FILTER (kind IN ('Function', 'Class') AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind = 'TESTED_BY')) AS untested,
    count(*) FILTER (qualified_name IN (SELECT qualified_name FROM dead_symbols)) AS dead
  FROM nodes WHERE kind <> 'File' GROUP BY file_path),
needs AS (
  SELECT n.file_path AS src, e.file_path AS dst FROM edges e JOIN nodes n ON n.qualified_name = e.target_qualified WHERE e.kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS')
  UNION SELECT target_qualified, file_path FROM edges WHERE kind = 'IMPORTS_FROM'),
dependents AS (SELECT src AS file_path, count(*) AS dependents FROM needs WHERE src <> dst GROUP BY src),
through AS (
  SELECT file_path, count(*) AS flows, max(criticality) AS criticality FROM (SELECT DISTINCT entry, file_path FROM member JOIN nodes ON qualified_name = node) JOIN metric_rows USING (entry) GROUP BY file_path),
files AS (
  SELECT f.file_path, split_part(f.file_path, '/', 2) AS area, coalesce(symbols, 0) AS symbols, coalesce(long_functions, 0) AS long_functions, coalesce(untested, 0) AS untested,
    coalesce(dead, 0) AS dead, coalesce(dependents, 0) AS dependents, coalesce(flows, 0) AS flows, coalesce(criticality, 0.0) AS criticality
  FROM (SELECT DISTINCT file_path FROM nodes) f LEFT JOIN own USING (file_path) LEFT JOIN dependents USING (file_path) LEFT JOIN through USING (file_path)),
weighed AS (
  SELECT *, round(criticality * 0.4::DOUBLE + least(dependents / 10.0::DOUBLE, 1.0) * 0.3::DOUBLE + CASE WHEN symbols > 0 THEN untested::DOUBLE / symbols ELSE 0.0 END * 0.2::DOUBLE
    + CASE WHEN symbols > 0 THEN dead::DOUBLE / symbols ELSE 0.0 END * 0.1::DOUBLE, 6) AS risk FROM files)
SELECT area, row_number() OVER (PARTITION BY area ORDER BY risk DESC, file_path)::INT AS rank, file_path, risk, symbols, long_functions, untested, dead, dependents, flows,
  round(criticality, 6) AS criticality
FROM weighed
"""


def queries() -> dict:
    return {"job1_refresh_index": job1_refresh_index, "job2_review_report": job2_review_report}


def oracle_sql() -> dict[str, str]:
    return {"job1_refresh_index": JOB1_SQL, "job2_review_report": JOB2_SQL}

"""The jobs: growing input, repeated and interrupted runs, settings, and their queries against SQL."""

import json
import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.operators.text_index import TextIndex
from jobs import common, queries, refresh_index, review_report

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "checkpoint")


def put(spark, folder, rows, shape=DOC):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)


def counted(texts):
    out = {}
    for key, text in texts.items():
        words = re.findall(r"[a-z0-9]+", text.lower())
        out |= {(key, w): (words.count(w), len(words)) for w in words}
    return out


def held(spark, output):
    return {(r.doc_id, r.token): (r.times, r.n_tokens) for r in refresh_index.postings(spark, output).collect()}


# --- refresh_index ------------------------------------------------------------------------------

def test_index_takes_only_what_is_new(spark, folders):
    documents, output, checkpoint = folders
    put(spark, documents, [(i, f"word w{i} Word", "en") for i in range(20)] + [(None, "no key", "en"), (3, "word w3 Word", "en")])
    one = refresh_index.refresh(spark, documents, output, checkpoint)
    assert [(b["batch"], b["rows"], b["without_key"], b["texts"]) for b in one["batches"]] == [(0, 22, 1, 20)]
    first = {i: f"word w{i} Word" for i in range(20)}
    assert held(spark, output) == counted(first) | {(3, w): (2 * n, 3) for (k, w), (n, _) in counted({3: first[3]}).items()}
    assert refresh_index.refresh(spark, documents, output, checkpoint) == {"batches": []}

    # New texts, one that is there already, one that is taken away, one that is taken away and never was there.
    put(spark, documents, [(20, "Only new words", "de"), (3, "w3 changed", "en"), (5, None, "en"), (99, None, None)])
    files = {f for f in os.listdir(f"{output}/postings/segment=0/bucket=1")} if os.path.isdir(f"{output}/postings/segment=0/bucket=1") else set()
    two = refresh_index.refresh(spark, documents, output, checkpoint)
    assert [(b["batch"], b["rows"], b["texts"]) for b in two["batches"]] == [(1, 4, 20)]
    now = {k: v for k, v in first.items() if k != 5} | {20: "Only new words", 3: "w3 changed"}
    assert held(spark, output) == counted(now)
    assert not files or files == set(os.listdir(f"{output}/postings/segment=0/bucket=1"))  # nothing old was written again
    anew = TextIndex.build(spark.createDataFrame(list(now.items()), "doc_id long, text string"), f"{output}-anew", "doc_id", ("text",), False)
    index = TextIndex(spark, output)
    assert (index.rows, index.tokens) == (anew.rows, anew.tokens)
    assert sorted(index.search("w3").collect()) == sorted(anew.search("w3").collect())
    assert index.search("w5").isEmpty()


def test_index_takes_files_in_batches(spark, folders, tmp_path):
    documents, output, checkpoint = folders
    for i in range(5):
        put(spark, documents, [(i, f"a b{i}", "en"), (100, f"version {i}", "en")])
        os.utime(next(e.path for e in os.scandir(documents) if e.name.endswith(".parquet") and e.stat().st_mtime > 1e9), (2e8 + i, 2e8 + i))
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"max_files": 2, "buckets": 4}))
    done = refresh_index.refresh(spark, documents, output, checkpoint, str(config))
    assert [(b["batch"], b["rows"]) for b in done["batches"]] == [(0, 4), (1, 4), (2, 2)]
    index = TextIndex(spark, output)
    assert index.buckets == 4 and index.rows == 6
    assert index.search("version 4").count() == 1 and index.search("version 0").isEmpty()


def test_index_after_a_batch_that_was_not_finished(spark, folders, monkeypatch):
    """A run dies after the postings of a segment, before it counts: the next run writes the same segment."""
    documents, output, checkpoint = folders
    put(spark, documents, [(1, "one", "en")])
    refresh_index.refresh(spark, documents, output, checkpoint)
    put(spark, documents, [(2, "two", "en"), (1, "one more", "en")])
    with monkeypatch.context() as m:
        plain = TextIndex.add

        def dies(self, rows, segment, removed=None):
            (rows.select(F.col("doc_id").alias("key"), F.lit(9).cast("long").alias("n_tokens"), F.lit(segment).alias("segment"))
             .write.mode("append").partitionBy("segment").parquet(f"{self.path}/texts"))
            raise RuntimeError("lost")

        m.setattr(TextIndex, "add", dies)
        with pytest.raises(Exception, match="lost"):
            refresh_index.refresh(spark, documents, output, checkpoint)
        m.setattr(TextIndex, "add", plain)
    assert held(spark, output) == counted({1: "one"})
    again = refresh_index.refresh(spark, documents, output, checkpoint)
    assert [b["batch"] for b in again["batches"]] == [1]
    assert held(spark, output) == counted({1: "one more", 2: "two"}) and TextIndex(spark, output).rows == 2


def test_index_of_nothing(spark, folders):
    documents, output, checkpoint = folders
    put(spark, documents, [])
    refresh_index.refresh(spark, documents, output, checkpoint)
    put(spark, documents, [(1, "", "en"), (2, None, None)])
    refresh_index.refresh(spark, documents, output, checkpoint)
    index = TextIndex(spark, output)
    assert index.rows == 1 and index.tokens == 0 and refresh_index.postings(spark, output).isEmpty()


# --- review_report ------------------------------------------------------------------------------

@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_report_runs_again_and_by_area(spark, tmp_path):
    output = str(tmp_path / "report")
    about = review_report.report(spark, SF, output)
    first = sorted(map(tuple, spark.read.parquet(output).collect()))
    assert len(first) == about["files"] > 0 and about["areas"] == len([d for d in os.listdir(output) if d.startswith("area=")])
    assert review_report.report(spark, SF, output) == about and sorted(map(tuple, spark.read.parquet(output).collect())) == first

    area = sorted(d.removeprefix("area=") for d in os.listdir(output) if d.startswith("area="))[0]
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"areas": [area], "long": 1, "weights": {"criticality": 0, "dependents": 0, "untested": 0, "dead": 1}}))
    part = review_report.report(spark, SF, output, str(config))
    assert part["areas"] == 1
    now = spark.read.parquet(output)
    assert now.count() == len(first)
    kept = sorted(map(tuple, now.filter(F.col("area") != area).collect()))
    assert kept == [r for r in first if r[-1] != area]
    own = now.filter(F.col("area") == area).collect()
    assert all(r.risk == pytest.approx(r.dead / r.symbols, abs=1e-6) for r in own) and any(r.long_functions for r in own)
    assert [r.file_path for r in sorted(own, key=lambda r: r.rank)] == [r.file_path for r in sorted(own, key=lambda r: (-r.risk, r.file_path))]


def test_config_files_hold_the_defaults(spark, tmp_path):
    for job in (refresh_index, review_report):
        path = f"{ROOT}/jobs/{job.__name__.split('.')[1]}.json"
        assert json.load(open(path)) == job.DEFAULTS == common.read_config(spark, path, job.DEFAULTS) == common.read_config(spark, None, job.DEFAULTS)
    wrong = tmp_path / "wrong.json"
    wrong.write_text('{"areas": [], "lnog": 3}')
    with pytest.raises(ValueError, match="lnog"):
        common.read_config(spark, str(wrong), review_report.DEFAULTS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_command_line(tmp_path):
    run = subprocess.run(
        [sys.executable, "-m", "jobs.review_report", "--tables", SF, "--output", str(tmp_path / "out"), "--config", f"{ROOT}/jobs/review_report.json", "--master", "local[2]"],
        cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert re.search(r"read \d+ nodes and \d+ edges from .*; wrote 106 files", run.stderr)
    assert any(d.startswith("area=") for d in os.listdir(tmp_path / "out"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_job_query(spark, name):
    duck = duckdb.connect()
    for t in ("part", "lineitem", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(cell, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(cell, r)) for r in want.fetchall())


def test_jobs_stand_alone():
    for f in ("common", "refresh_index", "review_report", "queries"):
        source = open(f"{ROOT}/jobs/{f}.py").read()
        assert "codeloom.llm" not in source and "corpus_pipeline" not in source

"""The pipeline on a small corpus with planted cases, and every corpus query against its SQL."""

import hashlib
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import language_id, queries
from test_pairs import brute, brute_hits, brute_lines, brute_passages
from test_records import filled

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = c.execute(sql)
    columns = [d[0] for d in want.description]
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(cell(r[k]) for k in sorted(columns)) for r in rows) == sorted(tuple(cell(v) for _, v in sorted(zip(columns, r))) for r in want.fetchall())


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    syllables = {"en": ["th", "er", "ing", "on"], "fr": ["eau", "que", "oi", "é"]}

    def words(lang, n):
        return ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n)]

    def text(lang, n=80):
        return "\n".join(" ".join(words(lang, n // 4)) for _ in range(4))

    item = " ".join(words("en", 15))
    passage = " ".join(words("fr", 60))
    rows = [[i, text(rng.choice(["en", "fr"])), None, f"s{i % 3}"] for i in range(60)]
    for r in rows:
        r[2] = "en" if "th" in r[1] or "ing" in r[1] else "fr"
    rows[3][1] = rows[2][1].replace("\n", " ")
    near = rows[3][1].split()
    near[40] = "changed"
    rows[4][1] = " ".join(near)  # a near copy of 3
    rows[6][1] = rows[5][1]  # a copy of 5
    rows[8][1] += "\n" + passage
    rows[9][1] = passage + "\n" + rows[9][1]
    rows[10][1] = rows[10][1].replace("\n", f" {item.upper()} ", 1)
    rows[11][1], rows[12][1] = None, "12 34"
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit(1)).withColumn("copies", F.lit(1))
    spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns + (["copy"] if name == "mix_sources" else [])
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in at.collect()}
    assert set(range(60)) - set(seen["language_id"]) == {11, 12}
    assert set(seen["language_id"]) - set(seen["line_dedup"]) == {6}
    assert passage in seen["line_dedup"][8].text and passage not in seen["line_dedup"][9].text
    assert seen["line_dedup"][9].n_chars == len(seen["line_dedup"][9].text)
    assert set(seen["line_dedup"]) - set(seen["near_duplicates"]) in ({4}, {3, 4})  # 3 joins the lines of 2
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == {10}
    assert set(seen["mix_sources"]) <= set(seen["decontaminate"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "mix_sources"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["mix_sources"])


def test_stages_with_nulls_repeats_and_long_texts(spark, tmp_path):
    """Null ids, languages and sources, rows that are alike, a text of 200,000 words and columns of any name."""
    rng = random.Random(4)
    text = lambda n, lang: " ".join("".join(rng.choice({"en": ["th", "er", "ing"], "fr": ["eau", "que", "oi"]}[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, text(30, "en" if i % 2 else "fr"), "en" if i % 2 else "fr", f"s{i % 2}") for i in range(30)]
    rows += [(None, text(40, "en"), None, None), (None, text(40, "fr"), "fr", None), (None, None, None, None), (None, "", "en", "s0")]
    rows += [rows[3]] * 3 + [(100, text(200_000, "en"), None, "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "hash", "node", "cluster", "tie", "_s", "copies", "certainty", "content", "at", "text_key", "bucket"):
        docs = docs.withColumn(c, F.lit("x"))
    spark.createDataFrame([(None, None), (1, ""), (1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns + (["copy"] if name == "mix_sources" else [])
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(str(r.doc_id) for r in at.collect())
    assert kept["language_id"] == sorted([*(str(r[0]) for r in rows if r[1])])
    # Rows that are alike are one document to line dedup, which keeps all of them; one stays of near copies.
    assert kept["line_dedup"] == kept["language_id"] and kept["near_duplicates"] == sorted({*map(str, range(30)), "100"} | {"None"}) + ["None"]
    assert kept["decontaminate"] == sorted(set(kept["near_duplicates"]) - {"5", "None"}) + ["None", "None"]
    assert spark.read.parquet(str(tmp_path / "decontaminate")).filter("doc_id = 100").first().n_chars == len(rows[-1][1])
    assert set(kept["mix_sources"]) <= set(kept["decontaminate"])


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        assert at.isEmpty()


def mixed(rows):
    """{(doc_id, copy)} of (doc_id, text, source): systematic sampling, step by step."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words(t) for _, t, x in rows if x == s) for s in sources}
    target = filled(size)
    taken = set()
    for s in sources:
        each = math.floor(target[s] / size[s] * 2**28 + 0.5) if size[s] else 0
        at = int(hashlib.md5(f"offset:{s or ''}".encode()).hexdigest()[:7], 16)

        def order(row):
            n = words(row[1])
            digits = f"{n:b}"
            return (len(digits) * 8 + int(digits.ljust(4, "0")[1:4], 2) if n else 0, hashlib.md5(str(row[0]).encode()).hexdigest(), row[0])

        for doc_id, _, _ in sorted((r for r in rows if r[2] == s), key=order):
            at += each
            taken |= {(doc_id, c + 1) for c in range((at >> 28) - ((at - each) >> 28))}
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_run_by_brute_force(spark, tmp_path, seed):
    """The whole run on texts with shared lines, near copies, benchmark items and glued passages, each stage in plain
    Python on what the stage before it left; the language model is the one thing that is taken as it was fitted."""
    rng = random.Random(seed)
    syllables = {"en": ["th", "er", "ing", "on", "a"], "fr": ["eau", "que", "oi", "é", "le"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 6)))
    line = lambda lang: " ".join(word(lang) for _ in range(rng.choice([3, 6, 12, 20])))
    pool = [line("en") for _ in range(6)] + [line("fr") for _ in range(6)]
    items = [(i, " ".join(word("en") for _ in range(n))) for i, n in enumerate([4, 10, 15, 30])]
    passage = [word("fr") for _ in range(70)]
    docs = []
    for i in range(90):
        lang = rng.choice(["en", "fr"])
        lines = [line(lang) for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.3:
            lines[rng.randrange(len(lines) + 1):0] = rng.sample(pool, 2)
        if docs and rng.random() < 0.25:
            w = rng.choice(docs)[1].replace("\n", " ").split(" ")
            w[rng.randrange(len(w))] = word(lang)
            lines = [" ".join(w)]
        if rng.random() < 0.15:
            lines[-1] += " " + rng.choice(items)[1].title() + " " + word(lang)
        if rng.random() < 0.15:
            a = rng.randrange(15)
            lines[0] = word(lang) + " " + " ".join(passage[a:a + rng.choice([45, 52, 55])]) + " " + lines[0]
        docs.append((i, "\n".join(lines), lang, rng.choice(["a", "a", "a", "b", None])))
    docs += [(90, None, "en", "a"), (91, "12 -- 34", "en", "b"), (92, docs[0][1], "en", "a")]
    rows = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    source = {d[0]: d[3] for d in docs}
    field = language_id.train(rows, language_id.fold(F.col("doc_id"), 4) != 2)
    langs, _, certainty = language_id.Tagger(field).documents([d[1] for d in docs])
    at = [(d[0], d[1]) for d, lang, c in zip(docs, langs, certainty) if lang != "und" and c >= corpus_pipeline.LEAST_CERTAINTY]
    counts = [len(at)]
    at = [(d, t) for d, t, _ in brute_lines(at, 10) if t.strip()]
    counts.append(len(at))
    at = [(d, t) for (d, t), (_, _, least) in zip(sorted(at, key=lambda x: str(x[0])), brute(at, 5, 80, 100)) if str(d) == least]
    counts.append(len(at))
    at = sorted((d, t) for (d, t), hits in zip(sorted(at, key=lambda x: str((x[0],))), brute_hits(at, items)) if not hits[2])
    at = [(d, " ".join(w)) for d, w in brute_passages(at, 50)]
    counts.append(len(at))
    want = mixed([(d, t, source[d]) for d, t in at])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.copy) for r in got} == want and len(got) == len(want)
    text = dict(at)
    assert all(r.text.split() == text[r.doc_id].split() and r.n_chars == len(r.text) for r in got)
    assert 93 > counts[0] > counts[1] >= counts[2] > counts[3] > 20

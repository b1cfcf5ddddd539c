"""Line dedup by winnowing over line hashes, in DataFrame expressions only.

Lines are what newlines separate; a line without a word is transparent (it belongs to no run, and goes only when it
lies inside a deleted one). A *window* is a shortest run of lines with at least ``min_words`` words, by its first or
by its last line; every repeated run of that many words is a union of windows.

1. Winnowing: of each window the smallest line hash is selected, the last one among equals. Windows that follow each
   other mostly select the same line, so few positions are left; two equal runs of ``min_words`` words hold an equal
   window and so are guaranteed to share a selected fingerprint at the same line of it.
2. Positions are joined with the fingerprints that are selected at more than one position of the corpus (one
   pre-aggregated count per fingerprint); the others are done with.
3. From each matched position the match extends both ways, over the lines before and after it, until a window is
   full; a window whose lines stand around the same fingerprint earlier is repeated. Windows that overlap or touch are
   one run: the union is the maximal repeated run.
4. Later repeated runs are deleted; the first occurrence, in the order of (doc_id, hash of the text, line), stays.

So a line goes if and only if it lies in a run of at least ``min_words`` words that begins earlier in the corpus.
No pairs are made: what extends a position is compared with the first occurrence of the same lines only. Lines are
compared by two independent hashes, 128 bits in all. Joins are sort-merge joins at every size, so that plans, and
skewed keys that adaptive execution splits, are the same on small and large inputs.

Defined cases: a null text stays null and has no lines; null doc_ids come last in the order; rows with equal doc_id
and text are one document and keep the same lines; a line of any length is one line; an empty table gives an empty
table; other columns are carried along by ``drop_repeated_lines`` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, packed, split_by_key, unpacked

#: Words of the shortest run that counts as repeated: a window of ten words, as in decontamination. What is shorter
#: is a phrase, which texts may share by chance.
MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _signatures(docs: DataFrame) -> DataFrame:
    """Per document: where its worded lines are, their two hashes and their words."""
    line = F.transform(_lines(F.col("text")), lambda x, i: F.struct(
        i.alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    d = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.filter(line, lambda s: s["w"] > 0).alias("line"))
    return d.select("doc_id", "hash", *[F.col(f"line.{c}").alias(c) for c in ("at", "h", "g", "w")])


def _selected(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, hash, fingerprint, place, around): a row for each selected position. ``place`` is its line, ``around``
    the windows that selected it, as their lines: structs of at, h and g arrays."""
    n = F.size("w")

    high = 1 << 32

    def reach(words: Column) -> Column:
        """Lines from the front of ``words`` until they hold min_words words, times ``high``, and their words; of all
        lines if they don't. A plain number: nothing is allocated per line."""
        return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.when(a % high >= min_words, a).otherwise(a + w + high))

    def chosen(i: Column, m: Column) -> Column:
        """The window of m lines from line i with the line that it selects, by number from 1; 0 if it is none."""
        own = F.reverse(F.slice("h", i, m))
        return F.struct(i.alias("i"), m.alias("n"), F.when(m > 0, i + m - F.array_position(own, F.array_min(own)).cast("int")).otherwise(0).alias("p"))

    every = F.sequence(F.lit(1), n)
    size = lambda r: F.shiftright(r, 32).cast("int")
    # The window of each first line, and that of each last line unless it is one of a first line, too.
    forward = F.transform(F.transform(every, lambda i: reach(F.slice("w", i, F.lit(min_words)))), lambda r, k: chosen(
        k + 1, F.when(r % high >= min_words, size(r)).otherwise(0)))
    ahead = F.transform(every, lambda j: reach(F.reverse(F.slice("w", F.greatest(F.lit(1), j - min_words + 1), F.least(j, F.lit(min_words))))))
    back = F.transform(ahead, lambda r, k: chosen(k + 2 - size(r), F.when(r % high - F.element_at("w", k + 1) >= min_words, size(r)).otherwise(0)))
    some = lines.filter(n > 0).select("doc_id", "hash", "at", "h", "g", forward.alias("forward"), back.alias("back"))
    places = F.filter(F.array_distinct(F.concat("forward.p", "back.p")), lambda p: p > 0)
    # What selects line p begins, or ends, less than min_words lines from it.
    near = lambda p: F.filter(F.concat(
        F.slice("forward", F.greatest(p - min_words + 1, F.lit(1)), F.least(p, F.lit(min_words))), F.slice("back", p, F.lit(min_words))), lambda s: s["p"] == p)
    anchors = F.transform(places, lambda p: F.struct(
        F.element_at("h", p).alias("fingerprint"), F.element_at("at", p).alias("place"),
        F.transform(near(p), lambda s: F.struct(*[F.slice(c, s["i"], s["n"]).alias(c) for c in ("at", "h", "g")])).alias("around")))
    return some.select("doc_id", "hash", F.explode(anchors).alias("a")).select("doc_id", "hash", "a.fingerprint", "a.place", "a.around")


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, hash, runs): the line ranges to delete, apart and in order, of documents that have some.
    ``hash`` is xxhash64 of the text; runs are structs of first and last line number, from 0."""
    scratch = Scratch(spark, "line_dedup")
    lines = scratch.write(_signatures(docs.filter("text is not null")), "lines")
    positions = scratch.write(_selected(lines, min_words), "positions")
    scratch.drop(lines)
    spot = F.xxhash64("doc_id", "hash", "place")
    shared = positions.groupBy("fingerprint").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a <> b").select("fingerprint")
    shared = scratch.write(shared, "fingerprints")
    matched = positions.join(shared.hint("merge"), "fingerprint").select("doc_id", "hash", F.explode("around").alias("x"))
    matched = scratch.write(matched.select("doc_id", "hash", F.element_at("x.at", 1).alias("first"), F.element_at("x.at", -1).alias("last"),
                                           F.xxhash64("x.h").alias("content"), F.xxhash64("x.g").alias("content2")), "matched")
    scratch.drop(positions, shared)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "hash", "first")
    begins = matched.groupBy("content", "content2").agg(F.min(order).alias("earliest"), F.max(order).alias("latest"))
    begins = scratch.write(begins.filter("earliest < latest").select("content", "content2", "earliest"), "earliest")
    later = matched.join(begins.hint("merge"), ["content", "content2"]).filter(order > F.col("earliest")).select("doc_id", "hash", "first", "last")
    # Windows that overlap or touch are one run.
    own = W.partitionBy("doc_id", "hash").orderBy("first", "last")
    later = later.distinct().withColumn("open", F.max("last").over(own.rowsBetween(W.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.when(F.col("first") <= F.col("open") + 1, 0).otherwise(1)).over(own))
    runs = later.groupBy("doc_id", "hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = runs.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    runs = scratch.write(runs, "runs")
    scratch.drop(matched, begins)
    return runs


def _cut(spark: SparkSession, docs: DataFrame, min_words: int) -> DataFrame:
    """(row, new_text, n_lines, n_deleted) for each row of ``docs``."""
    runs = repeated_runs(spark, docs, min_words).select(F.col("doc_id").alias("d"), F.col("hash").alias("x"), "runs")
    rows = packed(docs, doc_id=F.col("doc_id"), hash=F.xxhash64("text"))
    # Only texts that may have a run to lose are shuffled.
    some, rest = split_by_key(rows, runs.select(F.col("x").alias("hash")), "hash")
    some = some.join(runs.hint("merge"), some["doc_id"].eqNullSafe(runs["d"]) & (some["hash"] == runs["x"]), "left")
    rest = rest.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    rows = some.select("row", "runs").unionByName(rest.select("row", "runs"))
    rows = rows.withColumn("lines", _lines(F.col("row.text")))
    n = F.size("lines")
    gone = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    # What stays lies between the runs.
    kept = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda k: F.struct(
        F.when(k == 0, 0).otherwise(F.try_element_at("runs", k)["last"] + 1).alias("a"),
        F.coalesce(F.try_element_at("runs", k + 1)["first"], n).alias("b")))
    text = F.array_join(F.flatten(F.transform(kept, lambda s: F.slice("lines", s["a"] + 1, s["b"] - s["a"]))), "\n")
    return rows.select(
        "row", F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(text).alias("new_text"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with later repeated runs cut from ``text``, and n_lines and n_deleted, the lines there
    were and those cut (in place of columns of these names)."""
    cut = _cut(spark, docs, min_words)
    return cut.select(*unpacked(docs, without=("n_lines", "n_deleted"), text=F.col("new_text")), "n_lines", "n_deleted")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of ``docs``, with later repeated runs cut from ``text``; n_chars, if there, follows.
    Rows of which no word is left go."""
    anew = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.length("new_text").cast(dict(docs.dtypes)["n_chars"])
    cut = _cut(spark, docs, min_words).filter((F.col("n_deleted") == 0) | F.col("new_text").rlike(WORD))
    return cut.select(*unpacked(docs, **anew))


# --- op4 ----------------------------------------------------------------------------------------

def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(spark, docs).select("doc_id", "n_lines", "n_deleted", "text")


OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0),
ranked AS (
  SELECT *, row_number() OVER o AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS c
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
whole AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM ranked GROUP BY doc_id),
spans AS (
  SELECT a.doc_id, a.i AS i, min(b.i) AS j FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {MIN_WORDS}
  GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= {MIN_WORDS}
  GROUP BY b.doc_id, b.i),
windows AS (
  SELECT s.doc_id, x.pos AS first, y.pos AS last, array_to_string(ls[s.i:s.j], chr(10)) AS content
  FROM spans s JOIN whole USING (doc_id) JOIN ranked x ON x.doc_id = s.doc_id AND x.i = s.i JOIN ranked y ON y.doc_id = s.doc_id AND y.i = s.j),
later AS (
  SELECT * FROM (SELECT *, min((doc_id, first)) OVER (PARTITION BY content) AS earliest FROM windows) WHERE (doc_id, first) > earliest),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later x ON l.doc_id = x.doc_id AND l.pos BETWEEN x.first AND x.last),
kept AS (
  SELECT l.doc_id, count(*) AS n, count(g.pos) AS n_gone, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(n_gone, 0)::BIGINT AS n_deleted,
  CASE WHEN d.text IS NOT NULL THEN k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

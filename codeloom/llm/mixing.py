"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Each source gets a share of all words by its weight, at most ``cap`` times its own words. Within a source the
expected copies of the documents are summed up in a fixed order; one random offset is added, and a document is
taken once for each whole number that its span crosses. Sums are whole numbers (copies times 2^28), so the order
of additions can't matter. The order within a source is by size class, then by a hash of doc_id: neighbours have
like sizes, so the words taken stay near the target whatever the sizes are.

The prefix sum never brings a source, or any other key, into one task: the rows are dealt out by ranges of the whole
order, in which every row has a place of its own, even one of many that are alike. The rows of a source are counted
by range, the counts summed up over the ranges, and only then the rows within a range.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a null doc_id hashes
as the empty string; rows with equal ids are in the order of their texts' hashes; rows that are alike are separate
documents, of which any may be the one that is taken once more; an empty table gives an empty table; other columns
are carried along by ``mix`` and may have any name. Weights by rank need one row per source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, packed, split_by_key, unpacked

#: A copy in the whole numbers that are summed.
UNIT_BITS = 28
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _size_class(size: Column) -> Column:
    """Binary digits of the size and the three digits after the first: eight classes an octave."""
    digits = F.rpad(F.bin(size), 4, "0")
    return F.when(size <= 0, 0).otherwise(F.length(F.bin(size)) * 8 + F.conv(F.substring(digits, 2, 3), 2, 10).cast("int"))


def targets(totals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> plus weight and target. Weights 1, 2, 3 repeat by code point, null last.

    Target = least(cap * size, level * weight): the level at which targets add up to all words. Sources reach
    their cap in the order of cap * size / weight, so the level follows from running sums. One row per source.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    s = s.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight"))
    s = s.select(
        "*",
        F.row_number().over(by_ratio).alias("_rn"),
        F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
        F.sum("source_size").over(everything).alias("_all"),
    )
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")).cast("double") / F.col("_open"))
    first = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_rn", "_level"))).over(everything)
    s = s.withColumn("_first", first)
    full = F.col("_first").isNull() | (F.col("_rn") < F.col("_first._rn"))
    target = F.when(full, F.col("_cap").cast("double")).otherwise(F.col("_first._level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _source_key(source: Column) -> Column:
    """The source, or for a null one a text that no source is."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def plan(spark: SparkSession, sized: DataFrame, seed: str = "", cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, hash, tie) -> the same with source_size, weight, target and copies.

    ``tie`` differs in all rows; ``sized`` should be a written table, as it is sampled before it is dealt out.
    """
    scratch = Scratch(spark, "mixing-plan")
    keyed = sized.select("*", _source_key(F.col("source")).alias("_s"), _size_class(F.col("size")).alias("_class"), _order_key(F.col("doc_id"), seed).alias("_h"))
    order = ["_class", "_h", "doc_id", "hash", "tie"]
    ranged = scratch.write(keyed.repartitionByRange("_s", *order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_copy = float(1 << UNIT_BITS)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"offset{seed}:"), F.coalesce("source", F.lit("")))), 1, 7), 16, 10).cast("long")
    sources = targets(totals, cap).select(
        _source_key(F.col("source")).alias("_s"), "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * per_copy + 0.5))
        .otherwise(0).cast("long").alias("_each"),
        offset.alias("_offset"),
    )
    ranges = ranged.groupBy("_s", "_range").agg(F.count("*").alias("_n"))
    ranges = ranges.withColumn("_before", F.sum("_n").over(W.partitionBy("_s").orderBy("_range")) - F.col("_n")).drop("_n").join(sources, "_s")
    rank = F.row_number().over(W.partitionBy("_s", "_range").orderBy(*order))
    # A merge join: were the rows broadcast, the window would take over how the ranges are dealt, by source.
    rows = ranged.join(ranges.hint("merge"), ["_s", "_range"]).withColumn("_upto", (F.col("_before") + rank) * F.col("_each") + F.col("_offset"))
    copies = F.shiftright("_upto", UNIT_BITS) - F.shiftright(F.col("_upto") - F.col("_each"), UNIT_BITS)
    return rows.select(*sized.columns, "source_size", "weight", "target", copies.alias("copies"))


def _sized(docs: DataFrame, hash_: Column) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_.alias("hash"), F.monotonically_increasing_id().alias("tie"))


def mix_sizes(spark: SparkSession, docs: DataFrame, seed: str = "", cap: int = CAP) -> DataFrame:
    """Per document: doc_id, source, size, source_size, weight, target, copies."""
    sized = Scratch(spark, "mixing").write(_sized(docs, F.xxhash64("text")), "sized")
    return plan(spark, sized, seed, cap).drop("hash", "tie")


def mix(spark: SparkSession, docs: DataFrame, seed: str = "", cap: int = CAP) -> DataFrame:
    """The mixed corpus: every row of ``docs`` once per copy taken, with a column ``copy`` from 1 (in place of one
    of that name). Of rows that are alike in all columns (but maps), one stands for all, with the copies of all."""
    scratch = Scratch(spark, "mixing")
    whole = F.xxhash64("text", *[f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    sized = scratch.write(_sized(docs, whole), "sized")
    taken = plan(spark, sized, seed, cap).groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("hash").alias("x"))
    taken = scratch.write(taken.agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("times")), "taken")
    rows = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), hash=whole)
    # Rows that are alike come to one before they are shuffled.
    some, rest = split_by_key(rows, taken.filter("times > 1").select(F.col("x").alias("hash")), "hash")
    rows = some.groupBy("doc_id", "source", "hash").agg(F.first("row").alias("row")).select(*rest.columns).unionByName(rest)
    same = rows["doc_id"].eqNullSafe(taken["d"]) & rows["source"].eqNullSafe(taken["s"]) & (rows["hash"] == taken["x"])
    joined = rows.join(taken.filter("copies > 0"), same)
    return joined.select(*unpacked(docs, without=("copy",)), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


# --- op1 ----------------------------------------------------------------------------------------

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sizes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
keyed AS (
  SELECT *, CASE WHEN size <= 0 THEN 0 ELSE length(bin(size)) * 8
      + CASE WHEN substr(rpad(bin(size), 4, '0'), 2, 1) = '1' THEN 4 ELSE 0 END
      + CASE WHEN substr(rpad(bin(size), 4, '0'), 3, 1) = '1' THEN 2 ELSE 0 END
      + CASE WHEN substr(rpad(bin(size), 4, '0'), 4, 1) = '1' THEN 1 ELSE 0 END END AS cls
  FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
ratios AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM weighted),
running AS (
  SELECT *, row_number() OVER o AS rn,
    coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    (sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open,
    (sum(source_size) OVER ())::BIGINT AS everything
  FROM ratios WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST)),
levels AS (SELECT *, (everything - before)::DOUBLE / open AS level FROM running),
chosen AS (SELECT rn AS first_rn, level AS first_level FROM levels WHERE ratio >= level ORDER BY rn LIMIT 1),
sources AS (
  SELECT source, source_size, weight,
    CASE WHEN first_rn IS NULL OR rn < first_rn THEN cap::DOUBLE ELSE first_level * weight END AS target
  FROM levels LEFT JOIN chosen ON TRUE),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 268435456.0::DOUBLE + 0.5)::BIGINT ELSE 0 END AS each_,
    ('0x' || substr(md5('offset:' || coalesce(source, '')), 1, 7))::BIGINT AS off
  FROM sources),
ranked AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.each_,
    row_number() OVER (PARTITION BY k.source ORDER BY cls, h, doc_id) * r.each_ + r.off AS upto
  FROM keyed k JOIN rates r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (((upto >> 28) - ((upto - each_) >> 28)) * size)::BIGINT AS taken,
  ((upto >> 28) - ((upto - each_) >> 28))::BIGINT AS copies
FROM ranked
"""

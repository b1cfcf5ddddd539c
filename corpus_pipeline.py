"""A training corpus from documents: language ID, line dedup, near duplicates, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor wrote, and returns a DataFrame. All but the
last return the columns of documents; the last adds ``copy``, the number of the copy taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, passages
from codeloom.llm.common import Scratch

#: A document whose words have their languages with less than this certainty is rejected, as is one of no language.
#: Documents in several languages stay.
LEAST_CERTAINTY = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language."""
    field = language_id.train(docs, language_id.fold(F.col("doc_id"), 4) != 2)
    return language_id.with_language(docs, field, LEAST_CERTAINTY)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of lines out of the texts; n_chars follows."""
    return line_dedup.without_repeated_lines(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more in five-word shingles, one document stays."""
    return ngram_join.one_of_each(spark, docs, shingle=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; of passages that are still repeated, wherever lines
    end, the first stays. These are cut only here: a cut would hide near copies and benchmark items from the stages
    that drop the whole document."""
    clean = decontaminate.uncontaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return passages.without_repeated_passages(spark, Scratch(spark, "clean").write(clean, "clean"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them repeatedly, so that sources come to their target shares."""
    return mixing.mix(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]

#: Language ID is a trained model, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs

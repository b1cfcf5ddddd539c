"""Keeps a full-text index of a growing folder of documents up to date.

    python -m jobs.refresh_index --documents DIR --output DIR --checkpoint DIR [--config jobs/refresh_index.json]

A file stream takes the files of ``documents`` that no earlier run took, in batches of ``max_files``, and ends when
there is none left. A batch becomes one segment of the index in ``output``: postings, dealt into directories by
segment and by a hash of the token. A document that comes again takes the place of its older text; one that comes
with a null text is removed. Search it with ``codeloom.operators.text_index.TextIndex``.

The checkpoint says which files were taken. A segment has its batch's number, so a batch that a run didn't finish is
written again in the same place by the next one, and a run without new files changes nothing. A checkpoint belongs to
one output: with a new checkpoint goes a new output.

Defined cases: rows without a key are counted in the log and left out; rows of one batch with the same key are one
text, unless all of them are null; a folder of no documents gives no index; a file that changes under its name is not
taken again; columns other than the key and the text are not read. ``documents`` may be a folder, a file or a pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.text_index import TextIndex

from .common import command_line, log, read_config

DEFAULTS = {"key": "doc_id", "text": "text", "stem": False, "buckets": 32, "max_files": 200}


def _has_index(spark: SparkSession, output: str) -> bool:
    """Whether a segment is there: a table of segments has rows."""
    try:
        return not spark.read.parquet(f"{output}/about").isEmpty()
    except Exception as e:  # no folder yet, or one without files
        if any(name in str(e) for name in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            return False
        raise


def as_pattern(path: str) -> str:
    """The path as a pattern that it alone matches: a file stream of a pattern takes a folder's files or one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def add_batch(spark: SparkSession, rows: DataFrame, number: int, output: str, settings: dict) -> dict:
    """Writes one batch as a segment; the counts of what it read and wrote."""
    key, text = settings["key"], settings["text"]
    own = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    counts = own.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("without_key")).first()
    own = own.filter(F.col(key).isNotNull())
    present, removed = own.filter(F.col(text).isNotNull()), own.filter(F.col(text).isNull()).select(key)
    if number and _has_index(spark, output):
        index = TextIndex(spark, output).add(present, number, removed)
    else:
        index = TextIndex.build(present, output, key, (text,), settings["stem"], settings["buckets"])
    about = {"batch": number, "rows": counts.rows, "without_key": counts.without_key, "texts": index.rows, "tokens": index.tokens, "segments": len(index.segments)}
    log.info("batch %(batch)d: read %(rows)d rows, %(without_key)d of them without a key; the index has %(texts)d texts of %(tokens)d tokens in %(segments)d segments", about)
    return about


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, config: str | None = None) -> dict:
    """Takes what is new in ``documents`` into the index; what the run did, batch by batch."""
    settings = read_config(spark, config, DEFAULTS)
    output = output.rstrip("/")
    batches: list[dict] = []
    documents = as_pattern(documents)
    schema = spark.read.parquet(documents).select(settings["key"], settings["text"]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["max_files"]).parquet(documents)

    def write(rows: DataFrame, number: int) -> None:
        batches.append(add_batch(rows.sparkSession, rows, number, output, settings))

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches of %d rows from %s", output, len(batches), sum(b["rows"] for b in batches), documents)
    return {"batches": batches}


def postings(spark: SparkSession, output: str) -> DataFrame:
    """(key, token, times, n_tokens) of what the index holds."""
    index = TextIndex(spark, output)
    return index.postings().select(F.col("key").alias(index.key), "token", F.size("places").cast("long").alias("times"), "n_tokens")


if __name__ == "__main__":
    command_line(__doc__, "refresh-index", {"documents": "folder of Parquet files", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}, refresh)

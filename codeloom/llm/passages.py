"""Repeated passages: runs of ``min_words`` words that occur earlier in the corpus, wherever lines begin and end.

A word goes if and only if it lies in a run of at least ``min_words`` words whose words follow each other in the same
order from an earlier place of the corpus, in the order of (doc_id, hash of the text, word). Words are what blanks
and newlines separate, A-Z lower-cased, as in the near-duplicate stage; the blanks around a passage stay.

1. Of each window of ``min_words`` words the smallest hash of ``GRAM`` words is selected (winnowing): equal windows
   select equal ones. Hashes selected at more than one place are kept.
2. Only documents with such a hash are read again: their windows that selected one are compared as a whole, by
   128 bits, with the first occurrence of their content. No pairs are made.
3. What later windows cover is cut.

Defined cases: a null text stays; null doc_ids come last in the order; rows with equal doc_id and text are one
document; an empty table gives an empty table; other columns are carried along and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, Scratch, Words, chunks, packed, signed, split_by_key, text_batches, text_bytes, unpacked

PASSAGE_WORDS = 50
#: Words of a selected hash, at most half of a window.
GRAM = 25
#: Bytes of text handled at once: a window of each word is held in all its hashes.
STEP_BYTES = 1 << 18


def _selected(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows, the word where each window's selected hash begins, hashes of all words)."""
    k = min(GRAM, max(1, min_words // 2))
    starts, gram = words.starts(min_words), words.shingles(k)
    if not len(starts):
        return starts, starts, gram
    least = np.lib.stride_tricks.sliding_window_view(gram, min_words - k + 1)[starts].argmin(axis=1)
    return starts, starts + least, gram


def repeated_windows(spark: SparkSession, docs: DataFrame, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, hash, at): the first words, from 0, of the windows that occur earlier, in an array per document."""
    scratch = Scratch(spark, "passages")
    text_batches(spark)
    docs = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    key = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("hash", T.LongType())]
    long = lambda name: T.StructField(name, T.LongType())

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", STEP_BYTES):
            words = Words(*text_bytes(batch.column(2)), BLANKS)
            _, place, gram = _selected(words, min_words)
            place = np.unique(place)
            doc = pa.array(words.doc[place])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(signed(gram[place]))], ["doc_id", "hash", "gram"])

    grams = scratch.write(docs.mapInArrow(select, T.StructType([*key, long("gram")])), "grams")
    # Written tables, here and below: joins with them on what very many documents have can be split.
    shared = scratch.write(grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared")
    marked = grams.join(shared.hint("merge"), "gram").groupBy("doc_id", "hash").agg(F.collect_set("gram").alias("grams"))
    marked = scratch.write(marked.select(F.col("doc_id").alias("d"), F.col("hash").alias("x"), "grams"), "marked")
    some, _ = split_by_key(docs, marked.select(F.col("x").alias("hash")), "hash")
    some = some.join(marked.hint("merge"), some["doc_id"].eqNullSafe(marked["d"]) & (some["hash"] == marked["x"])).select("doc_id", "hash", "text", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", STEP_BYTES):
            words = Words(*text_bytes(batch.column(2)), BLANKS)
            starts, place, gram = _selected(words, min_words)
            own, known = signed(gram[place]), batch.column(3)
            doc = words.doc[starts]
            edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            wanted = [np.isin(own[edge[i]:edge[i + 1]], np.array(known[i].as_py(), dtype=np.int64)) for i in range(batch.num_rows)]
            at = np.flatnonzero(np.concatenate(wanted))
            who = pa.array(doc[at])
            content = [pa.array(signed(words.shingles(min_words, salt)[starts[at]])) for salt in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(who), batch.column(1).take(who), pa.array((starts - words.first[doc])[at]), *content],
                ["doc_id", "hash", "at", "content", "content2"])

    windows = scratch.write(some.mapInArrow(compare, T.StructType([*key, long("at"), long("content"), long("content2")])), "windows")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "hash", "at")
    begins = windows.groupBy("content", "content2").agg(F.min(order).alias("earliest"), F.max(order).alias("latest"))
    begins = scratch.write(begins.filter("earliest < latest").select("content", "content2", "earliest"), "earliest")
    later = windows.join(begins.hint("merge"), ["content", "content2"]).filter(order > F.col("earliest"))
    later = scratch.write(later.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set("at")).alias("at")), "later")
    scratch.drop(grams, shared, marked, windows, begins)
    return later


def without_repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """The rows and columns of ``docs``, with later repeated passages cut from ``text``; n_chars, if there, follows.
    Rows of which no word is left go."""
    later = repeated_windows(spark, docs, min_words).select(F.col("doc_id").alias("d"), F.col("hash").alias("x"), "at")
    rows = packed(docs, doc_id=F.col("doc_id"), hash=F.xxhash64("text"))
    some, rest = split_by_key(rows, later.select(F.col("x").alias("hash")), "hash")
    some = some.join(later.hint("merge"), some["doc_id"].eqNullSafe(later["d"]) & (some["hash"] == later["x"]), "left")
    rest = rest.select("row", F.col("row.text").alias("new_text"))
    kept = some.filter("at is null").select("row", F.col("row.text").alias("new_text"))
    some = some.filter("at is not null").select("row", F.col("row.text").alias("text"), "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", STEP_BYTES):
            data, offsets = text_bytes(batch.column(1))
            words = Words(data, offsets, BLANKS)
            out, stay = [], []
            for i in range(batch.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                at = np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                open_ = np.zeros(b - a + 1, dtype=np.int64)
                np.add.at(open_, at, 1)
                np.add.at(open_, at + min_words, -1)
                gone = np.concatenate([[False], np.cumsum(open_[:-1]) > 0, [False]])
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                spans = [(words.begin[a + x], words.end[a + y - 1]) for x, y in edges]
                ends = [offsets[i], *(e for s in spans for e in s), offsets[i + 1]]
                out.append(b"".join(data[s:e].tobytes() for s, e in zip(ends[::2], ends[1::2])).decode())
                stay.append(not gone[1:-1].all())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], ["row", "new_text"])
            yield made.filter(pa.array(stay, type=pa.bool_()))

    some = some.mapInArrow(cut, T.StructType([some.schema["row"], T.StructField("new_text", T.StringType())]))
    anew = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        # Texts that weren't cut keep theirs.
        same = F.col("new_text").eqNullSafe(F.col("row.text"))
        anew["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("new_text")).cast(dict(docs.dtypes)["n_chars"])
    return rest.unionByName(kept).unionByName(some).select(*unpacked(docs, **anew))

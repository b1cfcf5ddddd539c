"""Shared pieces of the corpus operators: whole rows, text batches, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

__all__ = ["Scratch", "Table", "Words", "chunks", "mix64", "packed", "signed", "split_by_key", "text_batches", "text_bytes", "unpacked", "words_of"]

#: Separators of the two word definitions, as bytes of UTF-8 text with A-Z lower-cased.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

#: Bytes of text that one step of an Arrow operator handles at once; arrays of its characters take 50 times as much.
CHUNK_BYTES = 1 << 20
#: Texts in an Arrow batch between Spark and Python; Spark's own default is meant for narrow rows.
BATCH_ROWS = 1000


# --- rows ---------------------------------------------------------------------------------------

def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` whole, as the struct ``row``, beside the given keys: no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def unpacked(docs: DataFrame, without: tuple[str, ...] = (), **instead: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, some of them left out or computed anew."""
    return [(instead[c] if c in instead else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in without]


def split_by_key(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose long ``key`` may be among that of ``wanted``, rows whose key isn't): the first need a join.

    A filter of 2^23 bits goes to every task, 2^17 rows of 64 bits at most, whatever the size of ``wanted``; so most
    rows without a partner are never shuffled. Where it fills up, all rows are in the first part.
    """
    word, bit = f"pmod({key}, {1 << 17})", f"cast(pmod(shiftright({key}, 20), 64) as int)"
    bits = wanted.select(F.expr(word).alias("_word"), F.expr(f"shiftleft(1L, {bit})").alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    near = rows.withColumn("_word", F.expr(word)).join(F.broadcast(bits), "_word", "left")
    near = near.withColumn("_may", F.coalesce(F.expr(f"shiftright(_bits, {bit}) & 1L = 1"), F.lit(False))).drop("_word", "_bits")
    return near.filter("_may").drop("_may"), near.filter("not _may").drop("_may")


# --- hashes -------------------------------------------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd uint64 values."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * step) | np.uint64(1)


_BYTE = _stream(1, 256)
_PLACE = _stream(2, 1 << 10)
_IN_SHINGLE = _stream(3, 64)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _stream(2, 1 << int(n).bit_length())
    return _PLACE


class Words:
    """The words of some texts: lower-cased bytes, each word's place, hash and text; all texts in one array.

    Word ``i`` is ``data[begin[i]:end[i]]``; text ``d`` has the words ``first[d]`` up to ``first[d + 1]``.
    """

    __slots__ = ("data", "begin", "end", "hash", "first", "doc")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        inside = np.ones(256, dtype=bool)
        inside[np.frombuffer(separators, dtype=np.uint8)] = False
        self.data = lower[data]
        mask = inside[self.data]
        start = mask.copy()
        start[1:] &= ~mask[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        start[edges] |= mask[edges]
        at = np.flatnonzero(mask)
        s = np.flatnonzero(start[at])
        self.begin = at[s]
        length = np.diff(np.append(s, len(at)))
        self.end = self.begin + length
        if len(s):
            place = np.arange(len(at)) - np.repeat(s, length)
            table = _places(int(length.max()))
            self.hash = mix64(np.add.reduceat(_BYTE[self.data[at]] * table[place], s) + length.astype(np.uint64))
        else:
            self.hash = np.empty(0, dtype=np.uint64)
        self.first = np.searchsorted(self.begin, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def text(self, i: int, n: int) -> bytes:
        """n words from word i, joined by a blank."""
        return b" ".join(self.data[self.begin[j]:self.end[j]].tobytes() for j in range(i, i + n))

    def shingles(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of the k words from each word of the whole array; those that run past their text mean nothing.
        Another salt gives another hash of the same words."""
        n = max(0, len(self.hash) - k + 1)
        own = mix64(self.hash + np.uint64(salt)) if salt else self.hash
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out += own[j:j + n] * _IN_SHINGLE[j]
        return mix64(out + np.uint64(k + salt))

    def beginnings(self, which: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, words of ``which`` with more than n letters, the hash of their first n letters), for each length n."""
        place = np.arange(len(self.data)) - np.repeat(np.append(0, self.begin), np.diff(np.concatenate([[0], self.begin, [len(self.data)]])))
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.begin] += 1
        inside[self.end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        part = np.where(inside, _BYTE[self.data] * _places(int(place.max(initial=0)) + 1)[place], np.uint64(0))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part, dtype=np.uint64)])
        letter = np.flatnonzero(inside & (self.data & 0xC0 != 0x80))
        first, last = np.searchsorted(letter, self.begin[which]), np.searchsorted(letter, self.end[which])
        for n in lengths:
            long = last - first > n
            own = which[long]
            yield n, own, mix64(total[letter[first[long] + n]] - total[self.begin[own]] + np.uint64(n))

    def starts(self, k: int) -> np.ndarray:
        """Words from which k words of the same text follow."""
        n = max(0, len(self.hash) - k + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1:k - 1 + n])


class Table:
    """Sorted distinct hashes; a bit table turns most others away first."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(values >> np.uint64(48)).astype(np.int64)] = True

    def find(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions ``at``, those whose value is in the table, and the value's row there."""
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        own = values[at]
        near = self.bits[(own >> np.uint64(48)).astype(np.int64)]
        at, own = at[near], own[near]
        row = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        same = self.values[row] == own
        return at[same], row[same]


def words_of(texts: list[str | None], separators: bytes) -> Words:
    return Words(*text_bytes(pa.array(texts, type=pa.string())), separators)


# --- Arrow batches ------------------------------------------------------------------------------

def text_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
            j = min(batch.num_rows, max(i + 1, j))
            yield batch.slice(i, j - i)
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

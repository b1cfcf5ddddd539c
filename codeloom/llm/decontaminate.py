"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with whole documents.

An item has the windows of ``window`` consecutive words (an item of fewer words is one window). A window is the
set of its word shingles; to occur in a document it must be contained whole, so by the prefix principle for
containment 1 one shingle is a sufficient prefix: the rarest, by the number of documents that hold it. That order
comes from a first pass over all documents. In the second pass a document's shingles meet the prefix shingles;
length and position bounds (the window must begin and end within the document) come first, then the words
themselves are compared, byte by byte, over exactly the window's length.

The index is a few arrays per word of the benchmark. It is built, broadcast and dropped in blocks of about
``block_bytes`` of item text, so that neither the driver nor a task holds more than one block of a benchmark of any
size; each block is joined with all documents, and the blocks' hits are merged by document.

Defined cases: a null or wordless text has no words and no hits; an item with a null or wordless text has no
window; a null item_id counts as the empty string; items with equal ids are one item; equal documents have equal
results; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_ALNUM, Scratch, Table, Words, chunks, text_batches, text_bytes

WINDOW, SHINGLE = 10, 5
#: Item text of one block. Its index takes about 7 times as much in each task and 20 times on the driver.
BLOCK_BYTES = 16 << 20
#: Bytes of words that are compared at once.
COMPARE_BYTES = 16 << 20

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RESULT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"


def same_words(a, i: np.ndarray, b, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words of ``a`` from each i are those of ``b`` from the j beside it, byte by byte."""
    same = np.ones(len(i), dtype=bool)
    for t in range(n):
        same &= (a.end[i + t] - a.begin[i + t]) == (b.end[j + t] - b.begin[j + t])
    for t in range(n):
        left = np.flatnonzero(same)
        length = (a.end[i[left] + t] - a.begin[i[left] + t]).astype(np.int64)
        done = np.cumsum(length)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + COMPARE_BYTES, side="right")))
            own, size = left[at:to], length[at:to]
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            equal = a.data[np.repeat(a.begin[i[own] + t], size) + place] == b.data[np.repeat(b.begin[j[own] + t], size) + place]
            same[own] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
            at = to
    return same


class Windows:
    """The different windows of ``size`` words of a block of items."""

    def __init__(self, index: Index, starts: np.ndarray, size: int, shingle: int):
        self.size, self.k = size, min(size, shingle)
        hashes = index.words.shingles(size)[starts]
        order = np.lexsort((starts, hashes))
        starts, hashes = starts[order], hashes[order]
        again = np.zeros(len(starts), dtype=bool)
        equal = np.flatnonzero(hashes[1:] == hashes[:-1])
        again[equal + 1] = same_words(index.words, starts[equal], index.words, starts[equal + 1], size)
        first = np.flatnonzero(~again)
        #: Of each window its hash, its first word, and the items that have it: items[edge[w]:edge[w + 1]].
        self.hash, self.start = hashes[first], starts[first].astype(np.int32)
        self.items, self.edge = index.owner[index.words.doc[starts]], np.append(first, len(starts)).astype(np.int32)

    def shingles(self, grams: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, the hash of the shingle there) of all windows."""
        for o in range(self.size - self.k + 1):
            yield o, grams[self.start + o]

    def order(self, grams: np.ndarray, table: np.ndarray, seen: np.ndarray) -> None:
        """Chooses each window's prefix: its shingle that fewest documents hold."""
        best = None
        for o, h in self.shingles(grams):
            n = seen[np.searchsorted(table, h)]
            if best is None:
                best, least, at = n.copy(), h.copy(), np.zeros(len(h), dtype=np.uint8)
                continue
            fewer = (n < best) | ((n == best) & (h < least))
            best[fewer], least[fewer], at[fewer] = n[fewer], h[fewer], o
        values, row = np.unique(least, return_inverse=True)
        #: The prefixes, and for each the offsets, as bits, at which it stands in its windows.
        kind = np.uint8 if self.size - self.k < 8 else np.uint64
        self.prefix, self.offsets = Table(values), np.zeros(len(values), dtype=kind)
        np.bitwise_or.at(self.offsets, row, kind(1) << at.astype(kind))
        #: Of each window hash the windows that have it: from low[row] to low[row + 1].
        self.windows = Table(np.unique(self.hash))
        self.low = np.append(np.searchsorted(self.hash, self.windows.values), len(self.hash)).astype(np.int32)
        self.hash = None


class Index:
    """A block of items as arrays: their words, their windows and the prefixes of these."""

    def __init__(self, items: pa.Table, window: int = WINDOW, shingle: int = SHINGLE):
        if window - min(window, shingle) > 63:
            raise ValueError("a window may have 64 shingles at most")
        ids = items.column("item").combine_chunks().to_numpy(zero_copy_only=False)
        names, owner = np.unique(ids.astype(object), return_inverse=True) if len(ids) else (ids, np.empty(0, dtype=np.int64))
        self.ids, self.owner = pa.array(names, type=pa.string()), owner.astype(np.int32)
        self.words = _joined([Words(*text_bytes(b.column("text")), NON_ALNUM) for b in chunks(iter(items.to_batches()), "text")])
        n = np.diff(self.words.first)
        self.by_size = []
        for size in sorted({min(int(x), window) for x in np.unique(n)} - {0}):
            starts = self.words.starts(size) if size == window else self.words.first[:-1][n == size]
            self.by_size.append(Windows(self, starts, size, shingle))

    def vocabulary(self) -> dict[int, np.ndarray]:
        """By length: the sorted hashes of all shingles of the windows."""
        out: dict[int, np.ndarray] = {}
        for k in sorted({w.k for w in self.by_size}):
            grams = self.words.shingles(k)
            out[k] = np.unique(np.concatenate([h for w in self.by_size if w.k == k for _, h in w.shingles(grams)]))
        return out

    def order(self, vocabulary: dict[int, np.ndarray], counts: pa.Table) -> None:
        """Chooses the prefixes by the numbers of documents: rows (k, hash, n)."""
        ks, hashes, ns = (counts.column(c).to_numpy() for c in ("k", "hash", "n"))
        for k, table in vocabulary.items():
            seen = np.zeros(len(table), dtype=np.int64)
            own = ks == k
            seen[np.searchsorted(table, hashes[own].view(np.uint64))] = ns[own]
            grams = self.words.shingles(k)
            for w in self.by_size:
                if w.k == k:
                    w.order(grams, table, seen)
        words = self.words  # only the bytes of words are compared from now on
        words.hash = words.doc = None
        if len(words.data) < 1 << 31:
            words.begin, words.end = words.begin.astype(np.int32), words.end.astype(np.int32)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, number of words, window's place) of the windows that occur; places are (size, window) pairs
        as numbers into ``items_of``."""
        grams: dict[int, np.ndarray] = {}
        of = lambda k: grams[k] if k in grams else grams.setdefault(k, words.shingles(k))
        found = [(np.empty(0, dtype=np.int64),) * 3]
        for s, w in enumerate(self.by_size):
            at, row = w.prefix.find(of(w.k), words.starts(w.k))
            if not len(at):
                continue
            for o in range(w.size - w.k + 1):
                start = at[w.offsets[row] >> w.offsets.dtype.type(o) & w.offsets.dtype.type(1) == 1] - o
                start = start[start >= 0]
                doc = words.doc[start]
                start = start[(start + w.size <= words.first[words.doc[start + o] + 1]) & (doc == words.doc[start + o])]
                start, place = w.windows.find(of(w.size), start)
                more = w.low[place + 1] - w.low[place]  # of equal hash: one, but for collisions
                each = np.repeat(np.arange(len(start)), more)
                window = w.low[place][each] + np.arange(len(each)) - np.repeat(np.cumsum(more) - more, more)
                start = start[each]
                same = same_words(words, start, self.words, w.start[window].astype(np.int64), w.size)
                start, window = start[same], window[same]
                found.append((start, np.full(len(start), w.size), window * len(self.by_size) + s))
        return tuple(np.concatenate(x) for x in zip(*found))

    def items_of(self, doc: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs, sorted, of windows that occur in documents."""
        pairs = [np.empty((0, 2), dtype=np.int64)]
        for s, w in enumerate(self.by_size):
            own = places % len(self.by_size) == s
            each = np.unique(np.stack([doc[own], places[own] // len(self.by_size)], axis=1), axis=0)
            n = w.edge[each[:, 1] + 1] - w.edge[each[:, 1]]
            at = np.repeat(w.edge[each[:, 1]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([np.repeat(each[:, 0], n), w.items[at]], axis=1))
        every = np.unique(np.concatenate(pairs), axis=0)
        return every[:, 0], every[:, 1]


def _joined(parts: list[Words]) -> Words:
    """The words of several batches as those of one."""
    out = Words.__new__(Words)
    base = np.cumsum([0, *(len(p.data) for p in parts)])
    n = np.cumsum([0, *(len(p.hash) for p in parts)])
    docs = np.cumsum([0, *(len(p.first) - 1 for p in parts)])
    join = lambda xs, kind: np.concatenate([np.empty(0, dtype=kind), *xs]).astype(kind)
    out.data = join([p.data for p in parts], np.uint8)
    out.begin, out.end = (join([getattr(p, x) + b for p, b in zip(parts, base)], np.int64) for x in ("begin", "end"))
    out.hash = join([p.hash for p in parts], np.uint64)
    out.doc = join([p.doc + d for p, d in zip(parts, docs)], np.int32)
    out.first = np.concatenate([*(p.first[:-1] + b for p, b in zip(parts, n)), n[-1:]])
    return out


def _count_shingles(vocabulary):
    """Per task: of each benchmark shingle, the number of documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: (Table(v), np.zeros(len(v), dtype=np.int64)) for k, v in vocabulary.value.items()}
        for batch in chunks(batches, "text"):
            words = Words(*text_bytes(batch.column(0)), NON_ALNUM)
            for k, (table, n) in tables.items():
                at, row = table.find(words.shingles(k), words.starts(k))
                if len(at):
                    pairs = np.unique(words.doc[at].astype(np.int64) * len(n) + row)
                    n += np.bincount(pairs % len(n), minlength=len(n))
        for k, (table, n) in tables.items():
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(table.values[some].view(np.int64)), pa.array(n[some])],
                    ["k", "hash", "n"],
                )

    return count


def _ranges(doc: np.ndarray, n: int) -> np.ndarray:
    """Of sorted document numbers, where each of n documents begins."""
    return np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)


def found_in(index: Index, words: Words) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each document its hit words, the ids of the items that occur and the spans of its hit words."""
    n = len(words.first) - 1
    start, size, place = index.hits(words)
    edge = np.zeros(len(words.doc) + 1, dtype=np.int64)  # +1 where a window begins, -1 after its end
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    counts = np.bincount(words.doc[covered], minlength=n)
    doc, item = index.items_of(words.doc[start].astype(np.int64), place)
    ids = index.ids.take(pa.array(item))
    own = words.first[words.doc]  # of each word, its document's first
    begins = covered & np.append(True, ~covered[:-1])[: len(covered)] | (covered & (np.arange(len(covered)) == own))
    ends = covered & np.append(~covered[1:] | (words.doc[1:] != words.doc[:-1]), True)[: len(covered)]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    spans = pa.StructArray.from_arrays([pa.array((a - own[a]).astype(np.int32)), pa.array((b + 1 - own[b]).astype(np.int32))], ["start", "end"])
    return counts, pa.ListArray.from_arrays(pa.array(_ranges(doc, n)), ids), pa.ListArray.from_arrays(pa.array(_ranges(words.doc[a], n)), spans)


def _match(shared, hits_only: bool):
    """(key columns, text) -> the keys and what occurs in the text; of all rows, or of those that are hit."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = Words(*text_bytes(batch.column(batch.num_columns - 1)), NON_ALNUM)
            counts, items, spans = found_in(shared.value, words)
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(words.first)), pa.array(counts), pa.array(np.diff(items.offsets.to_numpy()).astype(np.int64)), items, spans],
                [*batch.schema.names[:-1], "n_words", "n_hit", "n_items", "items", "spans"])
            yield out.filter(pa.array(counts > 0)) if hits_only else out

    return match


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``block_bytes`` of text, whole items each; at least one block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toArrow()


def _indexed(texts: DataFrame, items: pa.Table, window: int, shingle: int):
    """The index of a block of items, its prefixes chosen by the documents' counts, sent to the tasks."""
    text_batches(texts.sparkSession)
    share = texts.sparkSession.sparkContext.broadcast
    index = Index(items, window, shingle)
    vocabulary = index.vocabulary()
    sent = share(vocabulary)
    counts = texts.select("text").mapInArrow(_count_shingles(sent), "k int, hash long, n long")
    index.order(vocabulary, counts.groupBy("k", "hash").agg(F.sum("n").alias("n")).toArrow())  # one row for each shingle of the block at most
    sent.destroy()
    return share(index)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items and spans of several blocks -> those of the document."""
    for batch in batches:
        rows = []
        for items, spans in zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            rows.append((sorted(set(items or ())), [{"start": a, "end": b} for a, b in merged]))
        sizes = [pa.array([f(r) for r in rows], type=pa.int64()) for f in (lambda r: sum(s["end"] - s["start"] for s in r[1]), lambda r: len(r[0]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), *sizes, pa.array([r[0] for r in rows], type=pa.list_(pa.string())), pa.array([r[1] for r in rows], type=_SPANS)],
            ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"])


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (hit word ranges, end excluded).

    The first block's pass gives a row to each document; what further blocks hit is written and merged into it.
    """
    key = docs.schema["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    keyed = T.StructType([key, T.StructField("hash", T.LongType()), *T.StructType.fromDDL(_RESULT).fields])
    out, more, scratch = None, None, Scratch(spark, "decontaminate")
    for items in _blocks(benchmark, block_bytes):
        shared = _indexed(texts, items, window, shingle)
        if out is None:
            out = texts.mapInArrow(_match(shared, hits_only=False), keyed)
            continue
        # Equal documents report the same: of repeated rows one is enough.
        own = texts.mapInArrow(_match(shared, hits_only=True), keyed).groupBy("doc_id", "hash").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))
        own = scratch.write(own, "block")
        shared.destroy()
        more = own if more is None else more.unionByName(own)
    if more is None:
        return out.drop("hash")
    gathered = more.groupBy(F.col("doc_id").alias("_d"), F.col("hash").alias("_x")).agg(
        F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))  # a row for each block at most
    none = lambda c, like: F.coalesce(c, F.array().cast(keyed[like].dataType))
    out = out.join(gathered, out["doc_id"].eqNullSafe(gathered["_d"]) & (out["hash"] == gathered["_x"]), "left").select(
        "doc_id", "n_words", F.concat("items", none(F.col("_items"), "items")).alias("items"), F.concat("spans", none(F.col("_spans"), "spans")).alias("spans"))
    return out.mapInArrow(_merge, T.StructType([key, *T.StructType.fromDDL(_RESULT).fields]))


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item. One pass for each block of items; no shuffle of texts."""
    text, scratch = docs.columns.index("text"), Scratch(spark, "uncontaminated")

    def keep(shared):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                words = Words(*text_bytes(batch.column(text)), NON_ALNUM)
                start, _, _ = shared.value.hits(words)
                yield batch.filter(pa.array(np.bincount(words.doc[start], minlength=batch.num_rows) == 0))

        return clean

    out, shared = docs, None
    for items in _blocks(benchmark, block_bytes):
        if shared is not None:
            out = scratch.write(out, "block")
            shared.destroy()
        shared = _indexed(out, items, window, shingle)
        out = out.mapInArrow(keep(shared), docs.schema)
    return out


# --- op2 ----------------------------------------------------------------------------------------

def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS content
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS content
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT g.r, g.n, g.p, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.content = x.content),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""

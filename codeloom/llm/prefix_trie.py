"""A prefix trie of conversations: sorted sequences, their LCP array, its Cartesian tree, and sums over intervals.

Nodes of the trie are the distinct sequences of the first d turns (role, text) of some conversation. The trie isn't
built turn by turn:

1. A turn is told by 128 bits of role and text, a conversation by the string of its turns' bits. Equal conversations
   are one *class*, pre-aggregated before they are shuffled.
2. The classes are sorted, by ranges of the whole order; a range is a *block*. ``lcp`` of a class is how many turns it
   shares with the one before it.
3. A node with several classes is an interval of the order that can't be made longer without its least LCP falling:
   the classes from the nearest smaller LCP before a place up to the nearest smaller one after it. All nearest smaller
   values are found in each block by a stack; what a block can't settle goes by the minima of the blocks to one other
   block, and there to its few records. Places of one interval are one node (equal LCPs merge). A class that no other
   one goes on from is a leaf.
4. Intervals lack the depths at which nothing branches or ends; those between a node's parent and itself are expanded.
   Members, leaves and bytes of a subtree are differences of prefix sums at the interval's ends, the smallest member is
   the least of the blocks' minima between and the ends' own.

What is collected on the driver is one row of counts for each block, that is for each partition. A conversation is one
row of 24 bytes a turn; that row, and a digest's list of the ids of equal conversations, are the largest pieces.

Defined cases: a null role or text is empty; turns go by ``turn``, null first, those of one turn by a digest of role
and text; repeated rows are repeated turns; rows without a conv_id belong to no conversation and are left out; an
empty table has no node, not even a root; other columns may have any name and are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes that tell a turn.
DIGEST = 16
#: A place in the whole order: its block, and its row there in so many bits.
ROW_BITS = 32
#: Ids of equal conversations that are joined in one step before those steps are.
PART_BITS = 12
_LONG = np.iinfo(np.int64).max


# --- sequences ----------------------------------------------------------------------------------

def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns array<struct<digest string, bytes long>>), one row each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    own = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(own, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % group in place of its own first h;
    h = crc32(c) % heads. ``own`` should be a written table, as it is read twice."""
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = own.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(first, "first", "left")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def classes(seqs: DataFrame) -> DataFrame:
    """(key, bytes, cnt, conv, ends): the distinct sequences, how many conversations have each, the smallest of them,
    and the digest of all their ids."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key")
    rows = seqs.select("conv_id", key, F.transform("turns", lambda t: t["bytes"]).alias("bytes"), F.shiftright("conv_id", PART_BITS).alias("part"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    parts = rows.groupBy("key", "part").agg(F.first("bytes").alias("bytes"), F.count("*").alias("cnt"), F.min("conv_id").alias("conv"), ids.alias("ids"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"]), ",")
    return parts.groupBy("key").agg(F.first("bytes").alias("bytes"), F.sum("cnt").alias("cnt"), F.min("conv").alias("conv"), F.sha2(every.cast("binary"), 256).alias("ends"))


# --- blocks of the sorted order -----------------------------------------------------------------

def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // DIGEST


_ROW = "block int, rn long, len long, lcp long, cnt long, conv long, upto array<long>, ends string"


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, key, bytes, cnt, conv, ends) -> _ROW and ``edge``: the key of a block's first row (whose lcp
    is still unknown), and of its last one in a row of its own, of number -1."""
    before, rn, block = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(1).to_pylist()
        block = batch.column(0)[0].as_py()
        lcp = [None if x is None else common_turns(x, k) for x, k in zip([before, *keys[:-1]], keys)]
        offsets = batch.column(2).offsets.to_numpy()
        values = batch.column(2).values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
        offsets = offsets - offsets[0]
        total = np.concatenate([[0], np.cumsum(values)])
        upto = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.arange(rn, rn + len(keys))), pa.array([len(k) // DIGEST for k in keys], pa.int64()), pa.array(lcp, pa.int64()), batch.column(3),
             batch.column(4), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(upto)), batch.column(5),
             pa.array([keys[0] if rn == 0 else None] + [None] * (len(keys) - 1), pa.binary())],
            ["block", "rn", "len", "lcp", "cnt", "conv", "upto", "ends", "edge"])
        before, rn = keys[-1], rn + len(keys)
    if before is not None:
        yield pa.RecordBatch.from_pylist([{"block": block, "rn": -1, "edge": before}], schema=pa.schema(
            [("block", pa.int32()), ("rn", pa.int64()), ("len", pa.int64()), ("lcp", pa.int64()), ("cnt", pa.int64()), ("conv", pa.int64()),
             ("upto", pa.list_(pa.int64())), ("ends", pa.string()), ("edge", pa.binary())]))


def _edge_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block, key, before = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([-1 if b is None else common_turns(b, k) for k, b in zip(key, before)], pa.int64())], ["block", "lcp"])


class Blocks:
    """What all tasks know of all blocks, by number: the lcp of the first row, the least lcp, the smallest member."""

    def __init__(self, rows: DataFrame):
        edges = rows.filter("edge is not null").groupBy("block").agg(
            F.max(F.when(F.col("rn") == 0, F.col("edge"))).alias("first"), F.max(F.when(F.col("rn") == -1, F.col("edge"))).alias("last"))
        edges = edges.select("block", "first", F.lag("last").over(W.orderBy("block")).alias("before"))
        own = rows.filter("rn >= 0").groupBy("block").agg(F.min("lcp").alias("least"), F.min("conv").alias("conv"))
        own = own.join(edges.mapInArrow(_edge_lcp, "block int, lcp long").withColumnRenamed("lcp", "first"), "block").collect()  # a row for each partition
        n = 1 + max((r.block for r in own), default=-1)
        self.first, self.least, self.conv = (np.full(n, _LONG) for _ in range(3))
        for r in own:
            self.first[r.block], self.conv[r.block] = r.first, r.conv
            self.least[r.block] = r.first if r.least is None else min(r.first, r.least)

    def earlier(self, block: int, lcp: int) -> int:
        """The nearest block before with a smaller lcp; there is one, as the very first place has -1."""
        return int(np.flatnonzero(self.least[:block] < lcp)[-1])

    def later(self, block: int, lcp: int) -> int | None:
        found = np.flatnonzero(self.least[block + 1:] < lcp)
        return block + 1 + int(found[0]) if len(found) else None

    def after(self, block: int) -> int | None:
        """The next block that has rows."""
        return self.later(block, _LONG)


def nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest smaller value's place before (-1: none) and after (their number: none)."""
    n = len(values)
    before, after, stack = np.full(n, -1), np.full(n, n), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = i
        # An equal value's nearest smaller one before is this one's, too; both wait for the one after.
        before[i] = before[stack[-1]] if stack and values[stack[-1]] == v else stack[-1] if stack else -1
        stack.append(i)
    return before, after


_PLACES = ("kind int, block int, rn long, len long, lcp long, cnt long, conv long, upto array<long>, ends string, run long, leaf boolean, total long, next_block int, next_run long, next_lcp long, "
           "s_cnt long, s_all long, s_new long, s_leaf long, new long, from_here long, up_to_here long, "
           "d long, l long, lb int, r long, rb int, k long, least long, last_smaller array<struct<v: long, g: long>>, first_smaller array<struct<v: long, g: long>>")


def _settled(blocks: Blocks, schema: pa.Schema):
    """Rows sorted by (block, rn) -> the rows with their run of equal places, and sums before them (kind 0); the runs,
    with both ends or the block in which an end is (kind 1); a row for each block with its sums and records (kind 2)."""

    def rows_of(table: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        lcp = table["lcp"].fill_null(int(blocks.first[block])).to_numpy().copy()  # null in the first row only
        after = blocks.after(block)
        length, cnt, conv = (table[c].to_numpy() for c in ("len", "cnt", "conv"))
        upto = table["upto"].combine_chunks()
        cut, values = upto.offsets.to_numpy().astype(np.int64), np.append(upto.values.to_numpy(zero_copy_only=False), 0)
        total = np.where(length > 0, values[cut[1:] - 1], 0)
        new = total - np.where(lcp > 0, values[np.maximum(cut[:-1] + lcp - 1, 0)], 0)
        following = np.append(lcp[1:], -1 if after is None else blocks.first[after])
        leaf = length > following
        before, behind = nearest_smaller(lcp.tolist())
        _, run = np.unique(before * (n + 1) + behind, return_inverse=True)
        run = np.where(run == run[0], 0, np.where(run == 0, run[0], run))  # the first row's run is the first
        place = np.int64(block) << ROW_BITS
        sums = [np.cumsum(x) - x for x in (cnt, cnt * total, new, leaf.astype(np.int64))]
        so_far = np.minimum.accumulate(conv)
        whole = {
            "kind": np.zeros(n, np.int32), "block": np.full(n, block, np.int32), "rn": table["rn"], "len": length, "lcp": lcp, "cnt": cnt, "conv": conv, "upto": table["upto"], "ends": table["ends"],
            "run": run, "leaf": leaf, "total": total, "next_block": pa.array([block] * (n - 1) + [after], pa.int32()),
            "next_run": np.append(run[1:], 0), "next_lcp": following, **dict(zip(("s_cnt", "s_all", "s_new", "s_leaf"), sums)), "new": new,
            "from_here": np.minimum.accumulate(conv[::-1])[::-1], "up_to_here": pa.array([None, *so_far[:-1].tolist()], pa.int64())}
        yield from out(whole, n)
        _, one, k = np.unique(run, return_index=True, return_counts=True)
        own = lcp[one] >= 0  # all but that of the very first place
        one, k, number = one[own], k[own], np.flatnonzero(own)
        b, a, d = before[one], behind[one], lcp[one]
        here = (b >= 0) & (a < n)
        least = np.full(len(one), None)
        if here.any():
            least[here] = np.minimum.reduceat(np.append(conv, _LONG), np.stack([b[here], a[here]], axis=1).ravel())[::2]
        yield from out({
            "kind": np.ones(len(one), np.int32), "block": np.full(len(one), block, np.int32), "run": number, "d": d, "k": k,
            "l": pa.array([int(place + x) if x >= 0 else None for x in b], pa.int64()), "lb": pa.array([None if x >= 0 else blocks.earlier(block, v) for x, v in zip(b, d)], pa.int32()),
            "r": pa.array([int(place + x) if x < n else None for x in a], pa.int64()), "rb": pa.array([None if x < n else blocks.later(block, v) for x, v in zip(a, d)], pa.int32()),
            "least": pa.array(least.tolist(), pa.int64())}, len(one))

        def records(order) -> list[dict]:
            found, low = [], _LONG
            for i in order:
                if lcp[i] < low:
                    low = int(lcp[i])
                    found.append({"v": low, "g": int(place + i)})
            return found

        yield from out({
            "kind": np.full(1, 2, np.int32), "block": np.full(1, block, np.int32), "s_cnt": cnt.sum(keepdims=True), "s_all": (cnt * total).sum(keepdims=True),
            "s_new": new.sum(keepdims=True), "s_leaf": leaf.sum(keepdims=True).astype(np.int64),
            "last_smaller": pa.array([records(range(n - 1, -1, -1))], schema.field("last_smaller").type),
            "first_smaller": pa.array([records(range(n))], schema.field("first_smaller").type)}, 1)

    def out(columns: dict, n: int) -> Iterator[pa.RecordBatch]:
        if n:
            arrays = [pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema]
            yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(10_000)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(starts[:-1], starts[1:]):
                if i == j:
                    continue
                if now is not None and block[i] != now:
                    yield from rows_of(pa.Table.from_batches(held), now)
                    held = []
                now = int(block[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from rows_of(pa.Table.from_batches(held), now)

    return settled


# --- the trie -----------------------------------------------------------------------------------

def prefix_trie(spark: SparkSession, seqs: DataFrame) -> DataFrame:
    """(conv_id, turns) -> the nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    scratch = Scratch(spark, "prefix_trie")
    dealt = classes(seqs).repartitionByRange("key").sortWithinPartitions("key")
    dealt = dealt.select(F.spark_partition_id().cast("int").alias("block"), "key", "bytes", "cnt", "conv", "ends")
    rows = scratch.write(dealt.mapInArrow(_with_lcp, f"{_ROW}, edge binary"), "sorted")
    blocks = Blocks(rows)
    own = rows.filter("rn >= 0").drop("edge").repartition("block").sortWithinPartitions("block", "rn")
    settled = scratch.write(own.mapInArrow(_settled(blocks, to_arrow_schema(StructType.fromDDL(_PLACES))), _PLACES), "settled")
    scratch.drop(rows)

    # Ends in another block: the last smaller value of that block, or its first.
    records = scratch.write(settled.filter("kind = 2").select("block", "last_smaller", "first_smaller", "s_cnt", "s_all", "s_new", "s_leaf"), "records")
    runs = settled.filter("kind = 1").select("block", "run", "d", "l", "lb", "r", "rb", "k", "least")
    smaller = lambda c: F.filter(c, lambda x: x["v"] < F.col("d"))[0]["g"]
    away = runs.filter("lb is not null or rb is not null")
    away = away.join(records.select(F.col("block").alias("lb"), "last_smaller"), "lb", "left").join(records.select(F.col("block").alias("rb"), "first_smaller"), "rb", "left")
    away = away.select("block", "run", "d", F.coalesce("l", smaller("last_smaller")).alias("l"), F.coalesce("r", smaller("first_smaller")).alias("r"), "k", "least")
    runs = scratch.write(runs.filter("lb is null and rb is null").select(*away.columns).unionByName(away), "runs")
    merged = runs.groupBy("l", "d").agg(F.max("r").alias("r"), F.sum("k").alias("k"), F.min("least").alias("least"))

    sums = ["s_cnt", "s_all", "s_new", "s_leaf"]
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = scratch.write(records.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums]), "starts")
    whole = records.agg(*[F.sum(c).alias(c) for c in sums]).first()
    places = settled.filter("kind = 0").join(F.broadcast(starts), "block").select(
        (F.shiftleft(F.col("block").cast("long"), ROW_BITS) + F.col("rn")).alias("g"), "block", "run", "len", "lcp", "upto", "total", "new", "ends", "from_here", "up_to_here",
        *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])
    left, right = places.drop("up_to_here").alias("x"), places.select("g", "block", "run", "lcp", "up_to_here", *sums).alias("y")
    inner = merged.join(left, F.col("l") == F.col("x.g")).join(right, F.col("r") == F.col("y.g"), "left")
    spans = {c: F.coalesce(f"y.{c}", F.lit(whole[c] or 0)) - F.col(f"x.{c}") for c in sums}
    minima = F.from_json(F.lit(json.dumps(blocks.conv.tolist())), "array<bigint>")
    end = F.coalesce("y.block", F.lit(len(blocks.conv)))
    between = F.array_min(F.slice(minima, F.col("x.block") + 2, F.greatest(end - F.col("x.block") - 1, F.lit(0))))
    lcp_r = F.coalesce("y.lcp", F.lit(-1).cast("long"))
    inner = inner.select(
        "l", "d", F.greatest("x.lcp", lcp_r).alias("p"),
        F.when(F.col("x.lcp") >= lcp_r, F.struct(F.col("x.block"), F.col("x.run"))).otherwise(F.struct(F.col("y.block"), F.col("y.run"))).alias("q"),
        F.when(F.col("least").isNull(), F.least("x.from_here", "y.up_to_here", between)).otherwise(F.col("least")).alias("conv"),
        spans["s_cnt"].alias("n_convs"), spans["s_leaf"].alias("n_leaves"), (F.col("k") + (F.col("len") > F.col("d")).cast("long")).alias("children"),
        spans["s_all"].alias("all"), (spans["s_new"] - F.col("x.new") + F.col("total")).alias("own"), "upto", F.when(F.col("len") == F.col("d"), F.col("ends")).alias("ends"))
    inner = scratch.write(_path(inner), "inner")
    leaves = settled.filter("kind = 0 and leaf").select(
        F.lit(None).cast("long").alias("l"), F.col("len").alias("d"), F.greatest("lcp", "next_lcp").alias("p"),
        F.when(F.col("lcp") >= F.col("next_lcp"), F.struct("block", "run")).otherwise(F.struct(F.col("next_block").alias("block"), F.col("next_run").alias("run"))).alias("q"),
        "conv", F.col("cnt").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("children"),
        (F.col("cnt") * F.col("total")).alias("all"), F.col("total").alias("own"), "upto", "ends")
    above = scratch.write(runs.select("l", "d", "block", "run").join(inner.select("l", "d", F.col("conv").alias("above")), ["l", "d"]).select("block", "run", "above"), "above")
    nodes = inner.unionByName(_path(leaves)).select("*", "q.block", "q.run").join(above, ["block", "run"], "left")

    nodes = nodes.withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("d"))))
    passed = F.when(F.col("depth") <= 1, 0).otherwise(F.get("path", (F.col("depth") - 1 - F.greatest(F.col("p"), F.lit(1))).cast("int")))
    bottom = F.col("depth") == F.col("d")
    return nodes.select(
        "conv", "depth", F.when(F.col("depth") > F.col("p") + 1, F.col("conv")).when(F.col("depth") > 0, F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("all") - F.col("own") - (F.col("n_convs") - 1) * passed).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")).withColumnRenamed("conv", "conv_id")


def _path(nodes: DataFrame) -> DataFrame:
    """Of ``upto``, the bytes of the first turns of the path, what lies between a node's parent and itself."""
    start = F.greatest(F.col("p"), F.lit(1)).cast("int")
    return nodes.withColumn("path", F.slice("upto", start, F.greatest(F.col("d").cast("int") - start + 1, F.lit(0)))).drop("upto")


def conversation_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return prefix_trie(spark, sequences(conversations))


# --- op12 ---------------------------------------------------------------------------------------

def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Scratch(spark, "conversations").write(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "own")
    return prefix_trie(spark, rebuilt(own))


OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, xor(v >> 1, (v & 1) * 3988292384), k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS l FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, turn
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM turns),
ids AS (SELECT DISTINCT conv_id FROM turns),
heads AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM ids, crc_table),
rebuilt AS (
  SELECT h.conv_id, 0 AS part, pos, digest, bytes FROM heads h JOIN numbered n ON n.conv_id = h.conv_id - h.conv_id % 5 WHERE pos <= h.h
  UNION ALL SELECT h.conv_id, 1, pos, digest, bytes FROM heads h JOIN numbered n ON n.conv_id = h.conv_id WHERE pos > h.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, bytes, string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT prefix, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM prefixes p JOIN lengths USING (conv_id) GROUP BY prefix, depth),
children AS (SELECT substr(prefix, 1, length(prefix) - 32) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (prefix)),
below AS (
  SELECT a.prefix, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
  FROM full_nodes a JOIN full_nodes b ON starts_with(b.prefix, a.prefix) GROUP BY a.prefix)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = substr(n.prefix, 1, length(n.prefix) - 32)
"""

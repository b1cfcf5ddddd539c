"""N-gram Jaccard join: candidate clusters, size-banded tiles with bitmap signatures, exact intersections.

A document is the set of its word shingles, as sorted 64-bit hashes. Equal sets (by 128 bits) are one *node* from the
start, so copies, however many, cost one node.

Candidates. A partner of a set of n shingles lacks at most p = (1 - t)n of them, t being the least similarity. Every
node writes the shingles of one range of hashes, a little more than p of them; one count over all nodes tells which
of them any other node has. A node with more than p shingles of its own there has no partner and is done with. The
others keep a prefix: in the order of their own shingles first, then rare ones, then common ones, the first p + 1 of
the set, of which two partners must share one. Nodes that share a prefix shingle are joined with the smallest of
them, and the components of that star graph are the candidate clusters; pairs are never written out. (Shingles
beyond the range come last in the order; a node with fewer than p + 1 within it writes the next ones, too.) Clusters
of very many tiles go through the same count once more, with all shingles of their nodes, and fall apart into
those that hold real partners.

Tiles. A cluster's nodes are dealt into size bands, and large bands into blocks of bounded weight; bands that are
no further apart than t allows meet block by block in a tile. Within a tile, sets have bitmaps of hashed elements;
each differing bit stands for at least one differing element, so the count of differing bits bounds the overlap
from above. Pairs that pass, and are not yet in one component of the tile, get the exact intersection of their
sorted arrays. A tile reports the links that span its components. The components of all tiles' links are exact.

Pivots. Clusters of more than one block meet their pivots first: in each band the few sets whose elements are most
common in their own blocks, the likely originals. A block and the pivots of its bands are a tile. The component that
holds most of a cluster after that is its core, of which no two sets need to meet any more: blocks of the core only
meet blocks of the rest. So the work on a group of copies that are like an original grows with their number.

Defined cases: null and wordless texts are empty sets, linked with nothing; a text of fewer words than a shingle is
one shingle of all its words; rows with equal texts are one node, whatever their ids; a null doc_id is never a
component's smallest; a component of null ids only has a null component_id; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, Words, chunks, mix64, packed, signed, split_by_key, text_batches, text_bytes, unpacked
from .components import components

#: What one block of a tile weighs about: the elements of its sets, and SET_WEIGHT for each set.
BLOCK_WEIGHT, SET_WEIGHT = 50_000, 64
#: The same of the blocks that meet pivots: as a set is in one of them only, smaller ones cost nothing.
PIVOT_BLOCK_WEIGHT = 16_000
#: Sets of each band of a large cluster that all others are compared with first.
PIVOTS = 4

#: Elements beyond which a cluster is counted once more: dealing it out in blocks would move more than that.
REFINE_WEIGHT = 8_000_000
#: The range of hashes that is written out, beyond the share of a set that a partner can lack.
RANGE_MARGIN = 0.1


class Similarity:
    """Two sets link when ``den * intersection >= num * union``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.range_end = np.uint64(min(1.0, 1 - num / den + RANGE_MARGIN) * (2.0**64 - 2048))

    def largest_partner(self, n):
        return n * self.den // self.num

    def lacking(self, n: int) -> int:
        """Elements of a set of n that a partner can lack."""
        return n * (self.den - self.num) // self.den


def sets_of(words: Words, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles as a sorted uint64 array."""
    hashes = words.shingles(k)
    out = []
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= k:
            out.append(np.unique(hashes[a:b - k + 1]))
        elif n:
            part = Words.__new__(Words)
            part.hash = words.hash[a:b]
            out.append(part.shingles(n))
        else:
            out.append(words.hash[:0])
    return out


def identity(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    n = np.array([len(elements)], dtype=np.uint64)
    mixed = mix64(elements + np.uint64(0x5851F42D4C957F2D))
    one = mix64((elements * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64, keepdims=True) + n)
    two = mix64(mixed.sum(dtype=np.uint64, keepdims=True) + n * np.uint64(0x2545F4914F6CDD1D))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def _nodes(k: int, rule: Similarity, method):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = sets_of(Words(*text_bytes(batch.column(1)), BLANKS), k)
            ids = [identity(s) if len(s) else (0, 0) for s in sets]
            within = [int(np.searchsorted(s, rule.range_end)) for s in sets]
            few = method.kept(sets, rule)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in few])]).astype(np.int32)
            whole = [[len(s) for s in sets], within, [i for i, _ in ids], [j for _, j in ids]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, type=pa.int64()) for x in whole), *batch.columns[2:],
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(few))))],
                ["doc_id", "n", "n_range", "node", "check", "text_key", "text_check", "some"],
            )

    return nodes


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            own = sets_of(Words(*text_bytes(batch.column(0)), BLANKS), k)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            values = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))],
                ["node", "cluster", "elements"],
            )

    return sets


# --- tiles --------------------------------------------------------------------------------------

def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """(sets, width) uint64: one bit per element, by its hash."""
    out = np.zeros((len(sets), width * 64), dtype=bool)
    for i, s in enumerate(sets):
        out[i, (mix64(s) % np.uint64(width * 64)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def bitmap_screen(sets: list[np.ndarray], rule: Similarity):
    """(i, partners) -> those whose bits leave room for the overlap that a link needs."""
    width, sizes = 1, np.array([len(s) for s in sets], dtype=np.int64)
    while width * 64 < 2 * np.median(sizes) and width < 512:
        width *= 2
    maps = bitmaps(sets, width)

    def screen(i: int, near: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        return near[differ * (rule.den + rule.num) <= (sizes[near] + sizes[i]) * (rule.den - rule.num)]

    return screen


def tile_links(sets: list[np.ndarray], side: np.ndarray, rule: Similarity, labels: list | None = None, screens=bitmap_screen) -> list[tuple[int, int]]:
    """Links that span the components of a tile. side: 0 within one block, else 1 and 2 for two blocks that meet
    (pairs of one side belong to another tile). Sets of one label (not None) are linked already. ``screens`` makes
    the function that turns partners away before the exact intersection."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    first: dict = {}
    parent = [i if labels is None or labels[x] is None else first.setdefault(labels[x], i) for i, x in enumerate(order)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    screen = screens([sets[i] for i in order], rule) if len(order) > 2 else None
    sides = side[order]
    found = []
    for i in range(len(order) - 1):
        end = int(np.searchsorted(sizes, rule.largest_partner(int(sizes[i])), side="right"))
        if end <= i + 1:
            continue
        near = np.arange(i + 1, end)
        if sides[i]:
            near = near[sides[near] != sides[i]]
        if screen is not None and len(near):
            near = screen(i, near)
        for j in near.tolist():
            a, b = root(i), root(j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if rule.den * both >= rule.num * (int(sizes[i]) + int(sizes[j]) - both):
                parent[max(a, b)] = min(a, b)
                found.append((order[i], order[j]))
    return found


def _tiles(rule: Similarity, screens):
    """Rows sorted by tile -> links. A tile's rows follow each other; its weight is bounded."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(nodes, sides, labels, sets):
            links = tile_links(sets, np.array(sides), rule, labels, screens) if len(sets) > 1 else []
            return [(nodes[i], nodes[j]) for i, j in links]

        now, rows, out = None, ([], [], [], []), []
        for batch in batches:
            tile, node, side, label = (batch.column(c).to_pylist() for c in range(4))
            lists = batch.column(4)
            values, cut = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for r in range(batch.num_rows):
                if tile[r] != now:
                    out += done(*rows)
                    now, rows = tile[r], ([], [], [], [])
                for own, x in zip(rows, (node[r], side[r], label[r], values[cut[r]:cut[r + 1]].copy())):
                    own.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        out += done(*rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], ["a", "b"])

    return tiles


def _links(tiles: DataFrame, rule: Similarity, scratch: Scratch, screens) -> DataFrame:
    dealt = tiles.select("tile", "node", "side", "label", "elements").repartition("tile").sortWithinPartitions("tile")
    return scratch.write(dealt.mapInArrow(_tiles(rule, screens), "a long, b long"), "links")


def _dealt(members: DataFrame, rule: Similarity, scratch: Scratch) -> DataFrame:
    """(node, cluster, elements) -> plus the band of each set and the blocks of its cluster and band. All of a
    cluster of one block is one band."""
    n = F.size("elements").cast("long")
    # A written table, here and below: joins with it on a cluster that very many sets are in can be split.
    whole = scratch.write(members.groupBy("cluster").agg(F.sum(n + SET_WEIGHT).alias("weight")), "weights")
    rows = members.join(whole, "cluster").withColumn("large", F.col("weight") > BLOCK_WEIGHT)
    # Partners are at most one band apart: a band spans a factor den / num in size.
    band = F.floor(F.log(n.cast("double")) / F.lit(math.log(rule.den / rule.num))).cast("int")
    return scratch.write(rows.select("node", "cluster", "large", F.when(F.col("large"), band).otherwise(0).alias("band"), "elements"), "members")


def _blocks(rows: DataFrame, weight: int, *kind: str) -> DataFrame:
    """(cluster, band, kind, blocks): how many blocks each part of a cluster is dealt into."""
    return rows.groupBy("cluster", "band", *kind).agg(F.ceil(F.sum(F.size("elements").cast("long") + SET_WEIGHT) / F.lit(float(weight))).cast("int").alias("blocks"))


def _nearby(parts: DataFrame) -> DataFrame:
    """Rows of a band -> the same for each band that it can have links with, as ``band``; its own is ``own``."""
    return parts.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))


def _central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, node, cluster, band, elements) sorted by tile -> the PIVOTS sets of each tile whose elements are
    most common in the others of it, with that share over the tile's median one: tiles are not alike."""
    names = ["node", "cluster", "band", "share"]

    def done(keys, sets):
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        share = np.array([(times[np.searchsorted(values, s)].mean() - 1) / max(1, len(sets) - 1) for s in sets])
        share = share / (np.median(share) or 1.0)
        return [(*keys[i], float(share[i])) for i in np.argsort(-share, kind="stable")[:PIVOTS]]

    now, keys, sets, out = None, [], [], []
    for batch in batches:
        tile, *rest = (batch.column(c).to_pylist() for c in range(4))
        values, cut = batch.column(4).values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column(4).offsets.to_numpy()
        for r, key in enumerate(zip(*rest)):
            if tile[r] != now:
                out += done(keys, sets) if sets else []
                now, keys, sets = tile[r], [], []
            keys.append(key)
            sets.append(values[cut[r]:cut[r + 1]].copy())
    out += done(keys, sets) if sets else []
    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=pa.schema(
        [("node", pa.int64()), ("cluster", pa.int64()), ("band", pa.int32()), ("share", pa.float64())]))


def _pivot_links(rows: DataFrame, rule: Similarity, scratch: Scratch, screens) -> DataFrame:
    """Links of the sets of large clusters with the pivots of their bands: each set is written once."""
    large = rows.filter("large")
    blocks = scratch.write(_blocks(large, PIVOT_BLOCK_WEIGHT), "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tile = F.xxhash64("cluster", "band", "block").alias("tile")
    own = large.join(blocks, ["cluster", "band"]).withColumn("block", block).select(tile, "node", "cluster", "band", "elements")
    central = own.repartition("tile").sortWithinPartitions("tile").mapInArrow(_central, "node long, cluster long, band int, share double")
    rank = F.row_number().over(W.partitionBy("cluster", "band").orderBy(F.col("share").desc(), "node"))
    chosen = scratch.write(central.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("node", "cluster"), "chosen")
    pivots = scratch.write(large.join(chosen.hint("merge"), ["cluster", "node"]).select("node", "cluster", "band", "elements"), "pivots")
    none = F.lit(None).cast("long").alias("label")
    met = _nearby(pivots).join(blocks, ["cluster", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _links(own.select("tile", "node", F.lit(2).alias("side"), none, "elements").unionByName(
        met.select(tile, "node", F.lit(1).alias("side"), none, "elements")), rule, scratch, screens)


def _with_core(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with the label of their component so far, and whether that holds most of their cluster."""
    own = rows.join(labels.hint("merge"), "node", "left")
    weight = own.filter("label is not null").groupBy("cluster", "label").agg(F.sum(F.size("elements").cast("long")).alias("n"))
    most = scratch.write(weight.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("most")), "cores")
    own = own.join(most, "cluster", "left").withColumn("core", F.coalesce(F.col("label") == F.col("most"), F.lit(False)))
    return scratch.write(own.drop("most"), "labelled")


def _meet(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, cluster, band, core, label, elements) -> (tile, node, side, label, elements), each node in every tile
    where it can have a link that isn't known."""
    parts = scratch.write(_blocks(rows, BLOCK_WEIGHT, "core"), "blocks")
    around = _nearby(parts).groupBy("cluster", "band").agg(F.collect_list(F.struct(F.col("own").alias("band"), "core", "blocks")).alias("parts"))  # six at most
    here = scratch.write(parts.select("cluster", "band", "core", "blocks").join(around, ["cluster", "band"]), "around")
    rows = rows.join(here, ["cluster", "band", "core"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    me = F.struct(F.col("band").alias("band"), F.col("core").alias("core"), F.col("block").alias("block"))
    others = F.flatten(F.transform(F.filter("parts", lambda p: ~(p["core"] & F.col("core"))), lambda p: F.transform(
        F.sequence(F.lit(0), p["blocks"] - 1), lambda o: F.struct(p["band"].alias("band"), p["core"].alias("core"), o.alias("block")))))
    tiles = F.transform(others, lambda o: F.struct(
        F.xxhash64(F.col("cluster"), F.least(me, o), F.greatest(me, o)).alias("tile"), F.when(o == me, 0).when(me < o, 1).otherwise(2).alias("side")))
    return rows.select(F.explode(tiles).alias("t"), "node", "label", "elements").select("t.tile", "node", "t.side", "label", "elements")


# --- candidates ---------------------------------------------------------------------------------

def _numbered(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets with a number of its own for each: where two that differ have one, their other half decides anew."""
    halves = sets.filter("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    clash = scratch.write(halves.filter("low <> high").select("node", F.lit(True).alias("clash")), "clashes")
    return sets.join(clash, "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clash")


def _clusters(wide: DataFrame, rule: Similarity, scratch: Scratch) -> DataFrame:
    """(node, cluster): the components of nodes that share a shingle of their prefixes, each joined with the smallest
    that has it."""
    written = wide.select("node", "n", "n_range", F.posexplode("some").alias("at", "shingle"))
    shared = written.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("times"))
    shared = scratch.write(shared.filter("low < high").select("shingle", "times"), "shared")
    common = written.join(shared.hint("merge"), "shingle")
    beyond = F.col("at") >= F.col("n_range")
    own = W.partitionBy("node")
    common = common.withColumn("alone", F.col("n_range") - F.sum(F.when(beyond, 0).otherwise(1)).over(own))
    common = common.withColumn("rank", F.row_number().over(own.orderBy(beyond, "times", "shingle")))
    lacking = F.floor(F.col("n") * (rule.den - rule.num) / rule.den)
    prefix = common.filter((F.col("alone") <= lacking) & (F.col("rank") <= lacking + 1 - F.col("alone")))
    prefix = scratch.write(prefix.select("node", "shingle"), "prefixes")
    least = prefix.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("shingle", "low")
    least = scratch.write(least, "least")
    star = prefix.join(least.hint("merge"), "shingle").filter("node <> low")
    found = components(wide.sparkSession, star.select(F.col("node").alias("a"), F.col("low").alias("b")))
    scratch.drop(shared, prefix, least)
    return found.select("node", F.col("label").alias("cluster"))


def _refined(spark: SparkSession, members: DataFrame, rule: Similarity, scratch: Scratch) -> DataFrame:
    """(node, cluster, elements) with the clusters that outweigh many tiles split by a count of all their shingles."""
    weight = members.groupBy("cluster").agg(F.sum(F.size("elements")).alias("weight")).filter(F.col("weight") > REFINE_WEIGHT)
    large = scratch.write(weight.select("cluster"), "large")
    if large.isEmpty():
        return members
    small = members.join(large.hint("merge"), "cluster", "left_anti")
    whole = scratch.write(members.join(large.hint("merge"), "cluster", "left_semi").select("node", "elements"), "whole")
    n = F.size("elements").cast("long")
    again = _clusters(whole.select("node", n.alias("n"), n.alias("n_range"), F.col("elements").alias("some")), rule, scratch)
    again = whole.join(again, "node")
    # A label is a node of its cluster: clusters that were split don't meet one that wasn't.
    return small.select("node", "cluster", "elements").unionByName(again.select("node", "cluster", "elements"))


# --- the join -----------------------------------------------------------------------------------

class PrefixMethod:
    """How candidates are found, turned away in a tile, and how links become components."""

    name, screens = "ngram_join", staticmethod(bitmap_screen)

    def kept(self, sets: list[np.ndarray], rule: Similarity) -> list[np.ndarray]:
        """What each set writes for the search of candidates."""
        within = [int(np.searchsorted(s, rule.range_end)) for s in sets]
        return [s[: max(w, min(len(s), rule.lacking(len(s)) + 1))] for s, w in zip(sets, within)]

    def clusters(self, wide: DataFrame, rule: Similarity, scratch: Scratch) -> DataFrame:
        return _clusters(wide, rule, scratch)

    def components(self, spark: SparkSession, links: DataFrame) -> DataFrame:
        return components(spark, links)


def similar_groups(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, method=PrefixMethod()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_key (the hash
    of its text) and component (a number that the documents of a component share; null for empty sets)."""
    text_batches(spark)
    rule = Similarity(num, den)
    scratch = Scratch(spark, method.name)
    text_key, text_check = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    texts = docs.select("doc_id", "text", text_key.alias("text_key"), text_check.alias("text_check"))
    schema = "doc_id long, n long, n_range long, node long, check long, text_key long, text_check long, some array<long>"
    written = scratch.write(texts.mapInArrow(_nodes(shingle, rule, method), schema), "sets")
    sets = _numbered(written, scratch)
    every = scratch.write(sets.select("doc_id", "n", "node", "check", "text_key", "text_check"), "documents")
    wide = scratch.write(sets.filter("n > 0").groupBy("node", "check").agg(
        F.first("n").alias("n"), F.first("n_range").alias("n_range"), F.first("some").alias("some"),
        F.min("doc_id").alias("doc_id"), F.min(F.struct("text_key", "text_check")).alias("t")), "wide")
    scratch.drop(written)
    nodes = scratch.write(wide.select("node", "doc_id", "t.*"), "nodes")
    clusters = method.clusters(wide, rule, scratch)
    scratch.drop(wide)
    # The sets of the candidates alone, anew from their texts.
    wanted = scratch.write(nodes.select("node", "text_key", "text_check").join(clusters, "node"), "wanted")
    found, _ = split_by_key(texts.drop("doc_id"), wanted, "text_key")
    found = found.groupBy("text_key", "text_check").agg(F.first("text").alias("text")).join(wanted, ["text_key", "text_check"]).select("text", "node", "cluster")
    members = scratch.write(found.mapInArrow(_sets(shingle), "node long, cluster long, elements array<long>"), "candidates")
    rows = _dealt(_refined(spark, members, rule, scratch), rule, scratch)
    scratch.drop(wanted, members)
    near = _pivot_links(rows, rule, scratch, method.screens)
    labels = method.components(spark, near)
    labelled = _with_core(rows, labels, scratch)
    scratch.drop(rows)
    links = _links(_meet(labelled, scratch), rule, scratch, method.screens)
    scratch.drop(labelled)
    # What the pivots linked is known by its labels.
    joined = method.components(spark, labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
    led = nodes.select("node", "doc_id").join(joined, "node")
    least = scratch.write(led.groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    linked = led.join(least, "label").select("node", "label", "least")
    final = scratch.write(nodes.select("node", "doc_id").join(linked, "node", "left").select(
        "node", F.when(F.col("label").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("label", "node").alias("component")), "final")
    rows = every.select("doc_id", "n", "node", "text_key").filter("n > 0").join(final, "node")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key", "component")
    empty = every.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("component"))
    return rows.unionByName(empty)


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest (doc_id, hash of the text), nulls
    last; of equal ones, any. Empty sets all stay."""
    scratch = Scratch(spark, "one_of_each")
    groups = similar_groups(spark, docs, shingle, num, den).filter("component is not null")
    groups = scratch.write(groups.groupBy("doc_id", "text_key", "component").agg(F.count("*").alias("times")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")
    first = groups.groupBy("component").agg(F.min(order).alias("w"))
    rows = groups.join(first.hint("merge"), "component").withColumn("first", order == F.col("w"))
    # Rows to look at: those that aren't their component's first, and first ones that are there several times.
    odd = scratch.write(rows.filter("not first or times > 1").select(F.col("doc_id").alias("d"), F.col("text_key").alias("x"), "first"), "odd")
    rows = packed(docs, doc_id=F.col("doc_id"), key=F.xxhash64("text"))
    some, rest = split_by_key(rows, odd.select(F.col("x").alias("key")), "key")
    some = some.join(odd.hint("merge"), some["doc_id"].eqNullSafe(odd["d"]) & (some["key"] == odd["x"]), "left")
    again = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("doc_id", "key"))
    some = some.withColumn("again", again).filter("first is null or (first and again = 1)")
    return some.select("row").unionByName(rest.select("row")).select(*unpacked(docs))


# --- op7 ----------------------------------------------------------------------------------------

def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_groups(spark, docs, shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 90 * (nx.n + ny.n - common)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

"""MinHash near-duplicates: many universal hash minima, banding, signature verification, alternating stars.

A document is the set of its word shingles (four words). Each of MINIMA hash functions h(x) = (a x + b) mod 2^32, a
odd, is taken of all shingles of a set, and its minimum kept: two sets agree in a minimum with the probability of
their similarity s. ROWS minima in a row are a *band*; sets that agree in a band are candidates. Two sets of
s = 0.8 agree in no band with the probability (1 - 0.8^ROWS)^BANDS = 4.5e-11, so links are whole for all practical
purposes; higher similarities are missed less. Equal sets (by 128 bits) are one node and can't miss each other.

The sets that agree in a band are joined with the smallest of them; the components of those stars, by alternating
large-star and small-star, are clusters of candidates. No pairs are written. Within a cluster, dealt out in tiles of
bounded weight, a pair's signatures are compared first: a pair of the least similarity agrees in fewer minima than
asked for with a probability of LOST. Those that pass are confirmed by the exact intersection of their whole sets, and
the links' components are the groups, by alternating stars again.

Nothing is capped: a cluster of any size is dealt out whole, large groups of near copies meet their likely originals
first (see ``ngram_join``).

Defined cases: null and wordless texts are empty sets, linked with nothing, each kept; a text of fewer words than a
shingle is one shingle of all its words; equal texts are one node, whatever their ids; rows that repeat a doc_id have
that id's component; a null doc_id is never a component's smallest, so it isn't kept unless its group has no other
id; an empty table gives an empty table; other columns may have any name and are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64
from .components import star_components
from .ngram_join import Similarity, similar_groups

#: Minima of a band, and bands.
ROWS, BANDS = 5, 60
MINIMA = ROWS * BANDS
#: Minima that are compared in a tile, and the probability that they turn away a pair of the least similarity.
VERIFIED, LOST = 128, 1e-10


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n fixed pairs (a, b) of the universal family x -> a x + b mod 2^32, a odd."""
    drawn = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (drawn[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[n:] >> np.uint64(32)).astype(np.uint32)


_A, _B = _universal(MINIMA)


def signatures(sets: list[np.ndarray], n: int = MINIMA) -> np.ndarray:
    """(sets, n) uint32: the minimum of each function over each set. No set is empty."""
    out = np.empty((len(sets), n), dtype=np.uint32)
    if sets:
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        for i in range(n):
            out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS) uint64: a hash of each band's minima and number."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]) * np.uint64(0xD1342543DE82EF95)
    for j in range(ROWS):
        out = mix64(out + rows[:, :, j])
    return out


def least_agreeing(similarity: float, n: int = VERIFIED, lost: float = LOST) -> int:
    """The most agreeing minima of n that a pair of that similarity has but for a probability of ``lost``."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > lost:
            return k
    return n


def signature_screen(sets: list[np.ndarray], rule: Similarity):
    """(i, partners) -> those whose signatures agree in enough minima."""
    own, least = signatures(sets, VERIFIED), least_agreeing(rule.num / rule.den)
    return lambda i, near: near[(own[near] == own[i]).sum(axis=1) >= least]


def candidate_stars(wide: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, some: the band hashes) -> (a, b): each node and the smallest that agrees with it in a band."""
    written = wide.select("node", F.explode("some").alias("band"))
    least = written.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("band", "low")
    least = scratch.write(least, "bands")
    return written.join(least.hint("merge"), "band").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


class MinHashMethod:
    """Candidates by bands of minima, signatures compared in a tile, components by alternating stars."""

    name, screens = "minhash", staticmethod(signature_screen)

    def kept(self, sets: list[np.ndarray], rule: Similarity) -> list[np.ndarray]:
        full = [i for i, s in enumerate(sets) if len(s)]
        own = dict(zip(full, bands(signatures([sets[i] for i in full]))))
        return [own.get(i, sets[i][:0]) for i in range(len(sets))]

    def clusters(self, wide: DataFrame, rule: Similarity, scratch: Scratch) -> DataFrame:
        found = star_components(wide.sparkSession, candidate_stars(wide, scratch))
        return found.select("node", F.col("label").alias("cluster"))

    def components(self, spark: SparkSession, links: DataFrame) -> DataFrame:
        return star_components(spark, links)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    groups = similar_groups(spark, docs, shingle, num, den, MinHashMethod())
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return groups.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


# --- op11 ---------------------------------------------------------------------------------------

def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, num=80, den=100)


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

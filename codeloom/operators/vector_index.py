"""Exact nearest vectors by cosine, from cells around centroids that are pruned by the triangle inequality.

``build`` deals unit vectors out to the nearest of some centroids and keeps each one's distance r to it; a cell is a
directory, sorted by r. For unit vectors cosine and distance say the same: distance^2 = 2 - 2 cosine. By the triangle
inequality a row is at least |d - r| away from a query that is d away from the row's centroid. So ``search`` first
reads the cells nearest to the query that hold enough rows, which gives a distance that the result can't exceed, and
then the cells, and in them the rows, that can be as near as that. The result is that of a scan; how much is read
depends on how clustered the vectors are. Queries come in a list and share both scans.

Defined cases: vectors of norm 0, of another length, or null have cosine 0 to all, as in ``cosine``, and are a cell of
their own; a query of norm 0, or of another length, reads everything; equal scores are ranked by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Rows that centroids are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 5
#: Cells that are read first, at least: a cluster may have been dealt to some.
FIRST_CELLS = 3
#: Rounding errors of a distance are far below this.
SLACK = 1e-6
#: The cell of vectors whose cosine is 0 to all, and its distance to any query.
APART, RIGHT_ANGLE = -1, 2**0.5


def _units(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one."""
    out, fine = np.zeros((len(vectors), size)), np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size and None not in v:
            own = np.asarray(v, dtype=np.float64)
            norm = np.sqrt(own @ own)
            if np.isfinite(norm) and norm > 0:
                out[i], fine[i] = own / norm, True
    return out, fine


def _nearest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each, and the distance."""
    square = (units**2).sum(1)[:, None] + (centroids**2).sum(1)[None, :] - 2 * units @ centroids.T
    best = square.argmin(1)
    return best, np.sqrt(((units - centroids[best]) ** 2).sum(1))


def fitted(units: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by some rounds of k-means, from evenly spaced rows."""
    centroids = units[np.unique(np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int))].copy() if len(units) else units
    for _ in range(ROUNDS if len(units) else 0):
        best, _ = _nearest(units, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(best, minlength=len(centroids))
        np.add.at(sums, best, units)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class VectorIndex:
    """A written index. ``key`` and ``column`` name the columns of a row's key and vector."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = sorted(spark.read.parquet(f"{self.path}/cells").collect(), key=lambda r: r.cell)  # as many as cells
        self.rows = spark.read.schema(found[0].kinds).parquet(f"{self.path}/rows")
        self.key, self.column = self.rows.columns[:2]
        self.cells = {r.cell: (r.low, r.high, r.n) for r in found if r.n}
        self.centroids = {r.cell: np.array(r.centroid) for r in found}
        self.size = max((len(c) for c in self.centroids.values()), default=0)

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "qualified_name", column: str = "vector", cells: int = 256) -> VectorIndex:
        """Centroids are fitted on at most SAMPLE rows, by a hash of the key; every row is dealt to a cell."""
        spark, path = rows.sparkSession, path.rstrip("/")
        rows = rows.select(key, column)
        chosen = [r[0] for r in rows.filter(F.size(column) > 0).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(column).collect()]
        sizes = np.array([len(v) for v in chosen])
        size = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        units, fine = _units(chosen, size)
        centroids = fitted(units[fine], cells)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, has = _units(batch.column(1).to_pylist(), size)
                cell, far = np.full(len(own), APART), np.zeros(len(own))
                if has.any() and len(centroids):
                    cell[has], far[has] = _nearest(own[has], centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(cell.astype(np.int32))], [*batch.schema.names, "r", "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        kinds += ", r double, cell int"
        placed = rows.mapInArrow(dealt, kinds).repartitionByRange("cell", "r", key)
        placed.sortWithinPartitions("cell", "r").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        shape = spark.createDataFrame([(APART, [])] + [(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").withColumn("kinds", F.lit(kinds))
        written = spark.read.schema(kinds).parquet(f"{path}/rows")
        about = written.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
        shape.join(about, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    # --- search

    def _bounds(self, query: list[float]) -> dict[int, tuple[float, float]] | None:
        """For each cell the query's distance to its centroid and the least one to its rows; None: nothing is known."""
        unit, fine = _units([query], self.size)
        if not fine[0]:
            return None
        out = {}
        for cell, (low, high, _) in self.cells.items():
            d = RIGHT_ANGLE if cell == APART else float(np.sqrt(((unit[0] - self.centroids[cell]) ** 2).sum()))
            out[cell] = (d, d if cell == APART else max(0.0, d - high, low - d))
        return out

    def _scored(self, plan: list[tuple[int, int, float, float]], queries: list[list[float]], limit: int) -> DataFrame:
        """(query, key, score, rank) of the plan's rows: (query, cell, least r, most r)."""
        ranges = self.spark.createDataFrame(plan, "query int, cell int, low double, high double")
        wanted = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query int, q array<double>")
        cells = sorted({p[1] for p in plan})
        rows = self.rows.filter(F.col("cell").isin(*cells) if cells else F.lit(False))
        # A row for each query and cell, and one for each query: both as small as the list of queries.
        near = rows.join(F.broadcast(ranges), "cell").filter("r between low and high").join(F.broadcast(wanted), "query")
        near = near.select("query", self.key, cosine(F.col(self.column), F.col("q")).alias("score"))
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), self.key))
        return near.withColumn("rank", rank).filter(F.col("rank") <= limit)

    def plan(self, queries: list[list[float]], limit: int) -> list[tuple[int, int, float, float]]:
        """What a search reads: (query, cell, least r, most r)."""
        everything = float("inf")
        known = {i: self._bounds(q) for i, q in enumerate(queries)}
        out = [(i, c, -everything, everything) for i, b in known.items() if b is None for c in self.cells]
        first = []
        for i, b in known.items():
            have = 0
            for n, cell in enumerate(sorted(b or (), key=lambda c: b[c][0])):
                if n >= FIRST_CELLS and have >= 2 * limit:
                    break
                first.append((i, cell, -everything, everything))
                have += self.cells[cell][2]
        worst = self._scored(first, queries, limit).filter(F.col("rank") == limit).select("query", "score").collect() if first else []  # one a query
        reach = {r.query: max(0.0, 2 - 2 * r.score) ** 0.5 + SLACK for r in worst}
        for i, b in known.items():
            for cell, (d, least) in (b or {}).items():
                if least <= (far := reach.get(i, everything)):
                    out.append((i, cell, -everything, everything) if cell == APART else (i, cell, d - far, d + far))
        return out

    def search(self, queries: list[list[float]], limit: int) -> DataFrame:
        """(query, key, score, rank): for each query, by its place in the list, its ``limit`` nearest rows by cosine."""
        return self._scored(self.plan(queries, limit), queries, limit)

"""Stored tables: upserts, file slices, metadata; written as Parquet in versions that one manifest names.

Nodes and edges are dealt into buckets by their files. The manifest says of each bucket of each table which version
counts. A write makes new versions of the buckets that it touches and then puts a new manifest in place by a rename:
readers, and a job that dies, never see half a write, tables written together switch together, and an update of few
files writes few buckets. Versions that no manifest names any more stay for ``RETAIN_SECONDS``, so that a plan made
before a write can still be run after it. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys
from ..graph import Graph
from ..schema import (ADDED_IN, COMMUNITY, COMMUNITY_SUMMARY, COUNT, EDGE, FLOW, FLOW_SNAPSHOT, LINK, MEMBERSHIP, METADATA, NODE, RISK, SCHEMA_VERSION,
                      VECTOR, conform)

EDGE_KEY = ("kind", "source_qualified", "target_qualified", "file_path", "line")
#: Columns of a stored node that an upsert leaves alone.
KEPT = ("signature", "community_id")


def _last(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    latest = F.row_number().over(W.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", latest).filter("_n = 1").drop("_n")


def upsert_nodes(stored: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """``stored`` with the rows of ``new`` put in by qualified_name; of equal keys the last by ``order`` wins. Ids,
    signatures and communities of stored nodes stay."""
    latest = _last(new, ("qualified_name",), order).drop(order)
    kept = stored.select("qualified_name", F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in KEPT if c in stored.columns])
    merged = latest.join(kept, "qualified_name", "left")
    columns = []
    for c in stored.columns:
        if c == "id":
            columns.append(F.coalesce("_id", keys.stable_id(F.col("qualified_name"))).alias("id"))
        elif c in KEPT:
            own = F.col(c) if c in latest.columns else F.lit(None)
            columns.append(F.coalesce(F.col(f"_{c}"), own.cast(stored.schema[c].dataType)).alias(c))
        else:
            columns.append(F.col(c) if c in latest.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c))
    return stored.join(latest.select("qualified_name"), "qualified_name", "left_anti").select(*stored.columns).unionByName(merged.select(*columns))


def upsert_edges(stored: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """The same by (kind, source, target, file, line)."""
    latest = _last(new, EDGE_KEY, order).drop(order)
    kept = stored.join(latest.select(*EDGE_KEY), list(EDGE_KEY), "left_anti").select(*stored.columns)
    return kept.unionByName(latest.select(*stored.columns))


def replace_files(g: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame, order: str | None = None) -> Graph:
    """``g`` with the slices of ``files`` (file_path) replaced: their nodes and edges go, the new ones come. Of new
    nodes with one name the last by ``order`` wins; edges are kept as they are, repeats too."""
    gone = files.select("file_path").distinct()
    if order:
        nodes = _last(nodes, ("qualified_name",), order).drop(order)
    rest = g.nodes.join(gone, "file_path", "left_anti").select(*g.nodes.columns)
    other = g.edges.join(gone, "file_path", "left_anti").select(*g.edges.columns)
    return Graph(rest.unionByName(nodes.select(*g.nodes.columns)), other.unionByName(edges.select(*g.edges.columns)))


def remove_files(g: Graph, files: DataFrame) -> Graph:
    """``g`` without the rows that the files own; edges from other files into them stay."""
    gone = files.select("file_path").distinct()
    return Graph(g.nodes.join(gone, "file_path", "left_anti"), g.edges.join(gone, "file_path", "left_anti"))


def stale_files(g: Graph, current: DataFrame) -> DataFrame:
    """(file_path): files of the graph that are no longer there."""
    return g.nodes.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def changed_files(g: Graph, current: DataFrame) -> DataFrame:
    """The rows of ``current`` (file_path, file_hash, ...) whose hash differs from the stored one, or that are new."""
    known = g.nodes.select("file_path", "file_hash").filter("file_hash is not null").distinct()
    return current.join(known, ["file_path", "file_hash"], "left_anti")


def owner_of(name: Column) -> Column:
    """The file that a qualified name belongs to; a name of no file is its own owner."""
    return F.split_part(name, F.lit("::"), F.lit(1))


def links_of(edges: DataFrame) -> DataFrame:
    """Each edge as seen from both of its ends."""
    ends = [("source_qualified", "target_qualified", True), ("target_qualified", "source_qualified", False)]
    seen = F.array(*[F.struct(owner_of(F.col(a)).alias("owner"), F.col(a).alias("name"), F.col(b).alias("other"), F.lit(out).alias("outgoing")) for a, b, out in ends])
    return edges.select(F.explode(seen).alias("e"), "kind", "file_path", "line").select("e.*", "kind", "file_path", "line")


class GraphStore:
    """The tables of one graph under a path that all executors see."""

    SCHEMAS = {"nodes": NODE, "edges": EDGE, "metadata": METADATA, "flows": FLOW, "memberships": MEMBERSHIP, "vectors": VECTOR, "communities": COMMUNITY,
               "community_summaries": COMMUNITY_SUMMARY, "flow_snapshots": FLOW_SNAPSHOT, "risk": RISK, "links": LINK, "counts": COUNT}
    #: The column by which a table is dealt into buckets; the others have one bucket.
    DEALT_BY = {"nodes": "file_path", "edges": "file_path", "flows": "id", "memberships": "flow_id", "links": "owner", "counts": "part"}
    BY_FILE = ("nodes", "edges")
    #: Tables that are made from nodes and edges when they are first asked for, and kept up to date from then on.
    DERIVED = ("links", "counts")
    BUCKETS = 64
    RETAIN_SECONDS = 3600

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """{"buckets": n, "tables": {table: {bucket: version}}}"""
        where, fs = self._fs(f"{self.path}/MANIFEST")
        if not fs.exists(where):
            return {"buckets": self.BUCKETS, "tables": {}}
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        new, fs = self._fs(f"{self.path}/.MANIFEST-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._fs(f"{self.path}/MANIFEST")[0], rename)

    def vacuum(self, retain: float | None = None) -> int:
        """Deletes versions that the manifest doesn't name and that are older than ``retain`` seconds; how many."""
        retain = self.RETAIN_SECONDS if retain is None else retain
        named, gone = self.manifest()["tables"], 0
        for table in self.SCHEMAS:
            where, fs = self._fs(f"{self.path}/{table}")
            for status in fs.listStatus(where) if fs.exists(where) else ():
                version = status.getPath().getName()
                if version not in set(named.get(table, {}).values()) and status.getModificationTime() <= (time.time() - retain) * 1000:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    # --- tables

    def _bucket(self, buckets: int, key: str = "file_path"):
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some of its buckets. A column that a version lacks, since it was added later, is null."""
        return self._versions(self.manifest(), table, buckets)

    def _versions(self, manifest: dict, table: str, buckets: Iterable[int] | None) -> DataFrame:
        schema: T.StructType = self.SCHEMAS[table]
        named = manifest["tables"].get(table, {})
        paths = [f"{self.path}/{table}/{v}/bucket={b}" for b, v in named.items() if buckets is None or int(b) in buckets]
        return conform(self.spark.read.schema(schema).parquet(*paths), schema) if paths else self.spark.createDataFrame([], schema)

    def _write(self, table: str, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Writes rows as a new version; {bucket: version} of the buckets that have some."""
        version = uuid.uuid4().hex
        rows = conform(rows, self.SCHEMAS[table])
        if table in self.DEALT_BY:
            rows = rows.withColumn("bucket", self._bucket(buckets, self.DEALT_BY[table])).repartition("bucket")
        else:
            rows = rows.withColumn("bucket", F.lit(0))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{table}/{version}")
        where, fs = self._fs(f"{self.path}/{table}/{version}")
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return {n.removeprefix("bucket="): version for n in names if n.startswith("bucket=")}

    def write(self, **tables: DataFrame) -> None:
        """Puts whole tables in place of the stored ones, all at once."""
        buckets = self.manifest()["buckets"]
        written = {t: self._write(t, rows, buckets) for t, rows in tables.items()}
        manifest = self.manifest()
        manifest["tables"] |= written
        if set(tables) & set(self.BY_FILE):
            manifest["tables"] = {t: v for t, v in manifest["tables"].items() if t not in self.DERIVED}
        manifest["dealt"] = sorted({*manifest.get("dealt", []), *(t for t in written if t in self.DEALT_BY)})
        self._put(manifest)
        self.vacuum()

    def graph(self) -> Graph:
        return Graph(self.read("nodes"), self.read("edges"))

    def write_graph(self, g: Graph) -> None:
        self.write(nodes=g.nodes, edges=g.edges)

    def _of_keys(self, manifest: dict, table: str, *keys: DataFrame) -> list[int] | None:
        """The buckets of the keys (the first column of each); None if the table was stored before it was dealt out."""
        if table not in (*self.BY_FILE, *manifest.get("dealt", [])):
            return None
        own = [k.select(F.col(k.columns[0]).cast(self.SCHEMAS[table][self.DEALT_BY[table]].dataType).alias("k")).select(self._bucket(manifest["buckets"], "k").alias("b")) for k in keys]
        rows = own[0]
        for other in own[1:]:
            rows = rows.unionByName(other)
        return [r.b for r in rows.distinct().collect()]  # as many as buckets at most

    def replace_slices(self, files: DataFrame, new: Graph, **others: tuple[DataFrame, DataFrame]) -> None:
        """Puts the slices of ``files`` (file_path) in place of the stored ones: new ones come from ``new``. Of other
        tables, given as (keys, rows), the rows of these keys and of the new rows' keys go and the rows come. All of it
        switches at once, and only the buckets of these files and keys are read and written."""
        before = self.manifest()
        work = []
        derived = [t for t in self.DERIVED if t in before["tables"]]
        buckets = self._of_keys(before, "nodes", files.select("file_path"))
        if buckets:
            part = Graph(*(self.read(t, buckets) for t in self.BY_FILE))
            own = Graph(*(conform(rows, self.SCHEMAS[t]) for t, rows in zip(self.BY_FILE, (new.nodes, new.edges))))
            merged = replace_files(part, files, own.nodes, own.edges)
            work = [("nodes", buckets, merged.nodes), ("edges", buckets, merged.edges)]
            if "links" in derived:
                old, fresh = links_of(part.edges.join(files.select("file_path"), "file_path", "left_semi")), links_of(own.edges)
                some = self._of_keys(before, "links", old.select("owner"), fresh.select("owner"))
                rest = self.read("links", some).join(files.select("file_path"), "file_path", "left_anti").select(*LINK.names)
                work.append(("links", some, rest.unionByName(fresh)))
        for table, (gone, rows) in others.items():
            key = self.DEALT_BY[table]
            keys = gone.select(F.col(gone.columns[0]).alias(key))
            some = self._of_keys(before, table, keys, rows.select(key))
            every = keys.unionByName(rows.select(key)).distinct()
            work.append((table, some, self.read(table, some).join(every, key, "left_anti").unionByName(conform(rows, self.SCHEMAS[table]))))
        for table, some, rows in work:
            written = self._write(table, rows, before["buckets"])
            stored = before["tables"].setdefault(table, {})
            before["tables"][table] = ({} if some is None else {b: v for b, v in stored.items() if int(b) not in some}) | written
            before["dealt"] = sorted({*before.get("dealt", []), table})
        if buckets and "counts" in derived:
            counts = self._counts(before, buckets)
            parts = self.spark.createDataFrame([(b,) for b in buckets], "part int")
            some = self._of_keys(before, "counts", parts)
            written = self._write("counts", self.read("counts", some).join(parts, "part", "left_anti").select(*COUNT.names).unionByName(counts), before["buckets"])
            before["tables"]["counts"] = {b: v for b, v in before["tables"]["counts"].items() if int(b) not in some} | written
        if work:
            self._put(before)
            self.vacuum()

    # --- what is derived

    def _counts(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of COUNT for some buckets of the nodes and edges that the manifest names."""
        every = []
        for table in self.BY_FILE:
            rows = self._versions(manifest, table, buckets)
            language = F.col("language") if table == "nodes" else F.lit(None).cast("string")
            every.append(rows.groupBy(self._bucket(manifest["buckets"]).alias("part"), "kind", language.alias("language")).agg(F.count("*").alias("n")).withColumn("counted", F.lit(table)))
        return every[0].unionByName(every[1]).select(*COUNT.names)

    def derive(self, table: str) -> None:
        """Makes links or counts from nodes and edges, if they aren't there."""
        manifest = self.manifest()
        if table not in manifest["tables"]:
            self.write(**{table: links_of(self.read("edges")) if table == "links" else self._counts(manifest)})

    def near(self, table: str, names: DataFrame) -> DataFrame:
        """The buckets of a table in which what belongs to the names (the first column) is: nodes and edges by the file
        that a name begins with, links by either end. Others aren't read."""
        owner = names.select(owner_of(F.col(names.columns[0])).alias("owner"))
        return self.read(table, self._of_keys(self.manifest(), table, owner))

    def metadata(self, key: str) -> str:
        row = self.read("metadata").filter(F.col("key") == key).select("value").first()
        return row.value if row and row.value is not None else ""

    def set_metadata(self, **values: str) -> None:
        values.setdefault("schema_version", str(SCHEMA_VERSION))
        new = self.spark.createDataFrame(list(values.items()), "key string, value string")
        kept = self.read("metadata").filter(~F.col("key").isin(*values))
        rows = kept.unionByName(new).collect()  # a row a key
        self.write(metadata=self.spark.createDataFrame(rows, METADATA))

    def migrate(self) -> list[int]:
        """Brings a store of an older schema up to date, version by version; the versions that were applied. Columns
        added since are null until their rows are written again; tables added since are empty."""
        if not self.manifest()["tables"]:
            return []
        applied = []
        for version in range(int(self.metadata("schema_version") or 1) + 1, SCHEMA_VERSION + 1):
            tables, columns = ADDED_IN[version]
            changed = {t: self.spark.createDataFrame([], self.SCHEMAS[t]) for t in tables if t not in self.manifest()["tables"]}
            changed |= {t: self.read(t) for t in columns if t in self.manifest()["tables"]}
            self.write(**changed)
            self.set_metadata(schema_version=str(version))
            applied.append(version)
        return applied

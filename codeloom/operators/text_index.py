"""An inverted index for phrase search, as tables of postings that are pruned by token, in segments.

A segment is what one call of ``build`` or ``add`` wrote; it is never changed. Its postings have a row for each token
of each column of each text, (token, key, column, places, n_tokens), dealt into directories by a hash of the token and
sorted by token within a file. ``search`` reads the directories of the query's tokens only, and in them, by the files'
statistics, the row groups that hold these tokens: a query costs what its own tokens have, not what the table has.

A text that is added again takes the place of the older one; keys can be removed, too. Besides its postings a segment
has ``texts`` (key, n_tokens), ``gone`` (the texts of older segments that it replaces or removes) and one row ``about``
it. That row is written last, and a segment without one isn't read: a search sees all of a segment or nothing. Adding
the same rows under the same number again writes the segment again, by dynamic partition overwrite, so an interrupted
or repeated step can simply be run again. ``merged`` writes one segment of all that counts, elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as words
from .search import INDEXED, bm25_score

BUCKETS = 256
_ABOUT = "rows long, tokens long, key string, key_type string, columns array<string>, stem boolean, buckets int, segment int"


def _shape(table: str, key_type: str) -> str:
    own = {"postings": "token string, key {}, column int, places array<int>, n_tokens long, segment int, bucket int", "texts": "key {}, n_tokens long, segment int",
           "gone": "key {}, of int, n_tokens long, segment int"}
    return own[table].format(key_type)


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _by_token(cells: DataFrame) -> DataFrame:
    """(key, n_tokens, column, token, places) of (key, n_tokens, column, cell), cell by cell: the places of a token are
    brought together by sorting within the row, before anything is shuffled."""
    rows = cells.select("key", "n_tokens", "column", F.sort_array(F.transform("cell", lambda t, i: F.struct(t.alias("t"), i.alias("i")))).alias("s"))
    begins = F.transform("s", lambda x, i: F.when((i == 0) | (F.get("s", i - 1)["t"] != x["t"]), i))
    rows = rows.withColumn("b", F.filter(begins, lambda i: i.isNotNull()))
    runs = F.transform("b", lambda i, n: F.struct(F.get("s", i)["t"].alias("token"), F.transform(
        F.slice("s", i + 1, F.coalesce(F.get("b", n + 1), F.size("s")) - i), lambda x: x["i"]).alias("places")))
    return rows.select("key", "n_tokens", "column", F.explode(runs).alias("r")).select("key", "n_tokens", "column", "r.token", "r.places")


def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Of rows (key, segment, ...) those that no segment has replaced or removed."""
    gone = gone.select(F.col("key").alias("_k"), F.col("of").alias("_s"))
    return rows.join(gone, rows["key"].eqNullSafe(gone["_k"]) & (rows["segment"] == gone["_s"]), "left_anti")


class TextIndex:
    """A written index. ``key`` names the column that identifies a text; rows with equal keys are one text, whose
    tokens are those of all of them and whose length is that of the longest. Segments are added in the order of their
    numbers, by one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.schema(_ABOUT).parquet(f"{self.path}/about")
        first = about.orderBy("segment").first()
        self.key, self.key_type, self.columns, self.stem, self.buckets = first.key, first.key_type, tuple(first.columns), first.stem, first.buckets
        self.segments = sorted(r.segment for r in about.select("segment").collect())  # a row for each call
        sums = about.agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens")).first()
        self.rows, self.tokens = sums.rows, sums.tokens
        self.mean = self.tokens / self.rows if self.rows else 0.0

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "id", columns: tuple[str, ...] = INDEXED, stem: bool = True, buckets: int = BUCKETS) -> TextIndex:
        """A new index of one segment, number 0, in place of any that is there."""
        spark, path = rows.sparkSession, path.rstrip("/")
        for table, shape in [("about", _ABOUT), *((t, _shape(t, "long")) for t in ("postings", "texts", "gone"))]:  # nothing is read from now on
            spark.createDataFrame([], shape).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("segment").parquet(f"{path}/{table}")
        return cls._put(rows, path, 0, (), None, key, columns, stem, buckets)

    def add(self, rows: DataFrame, segment: int, removed: DataFrame | None = None) -> TextIndex:
        """The index with the rows as one more segment, without the texts of ``removed`` (the key's column); older
        segments are those of smaller numbers. A key that is added and removed is added."""
        older = tuple(s for s in self.segments if s < segment)
        return self._put(rows, self.path, segment, older, removed, self.key, self.columns, self.stem, self.buckets)

    @classmethod
    def _put(cls, rows: DataFrame, path: str, segment: int, older: tuple[int, ...], removed: DataFrame | None, key: str, columns: tuple[str, ...], stem: bool,
             buckets: int) -> TextIndex:
        spark = rows.sparkSession
        key_type = rows.schema[key].dataType.simpleString()

        def write(table: DataFrame, name: str, *within: str) -> None:
            table.withColumn("segment", F.lit(segment)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "segment", *within).parquet(f"{path}/{name}")

        def read(name: str, *segments: int) -> DataFrame:
            return spark.read.schema(_shape(name, key_type)).parquet(f"{path}/{name}").filter(F.col("segment").isin(*segments))

        cells = [words.tokens(F.col(c)) for c in columns]
        if stem:
            cells = [words.stems(c) for c in cells]
        own = rows.select(F.col(key).alias("key"), F.array(*cells).alias("cells"))
        own = own.withColumn("n_tokens", F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.size(c)))
        each = _by_token(own.select("key", "n_tokens", F.posexplode("cells").alias("column", "cell")))
        # By ranges of the whole order: a task has few buckets, and a common token is in as many files as it fills.
        each = each.withColumn("bucket", _bucket(F.col("token"), buckets)).repartitionByRange("bucket", "token", "key", "column")
        # A group is one token of one text, so that no token, however common, comes to one task. Rows of a text that is
        # given in several are in one range, so they are put together where they are.
        found = each.groupBy("bucket", "token", "key", "column").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"), F.max("n_tokens").alias("n_tokens"))
        write(found.sortWithinPartitions("bucket", "token"), "postings", "bucket")
        write(own.groupBy("key").agg(F.max("n_tokens").alias("n_tokens")), "texts")
        change = read("texts", segment).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
        if older:
            # Texts that count so far: one of each key at most.
            before = _live(read("texts", *older), read("gone", *older)).withColumnRenamed("segment", "of")
            named = read("texts", segment).select(F.col("key").alias("_k"))
            if removed is not None:
                named = named.unionByName(removed.select(F.col(key).alias("_k")))
            write(before.join(named, F.col("key").eqNullSafe(F.col("_k")), "left_semi").select("key", "of", "n_tokens"), "gone")
            lost = read("gone", segment).agg(F.count("*").alias("gone_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("gone_tokens"))
            change = change.join(F.broadcast(lost)).select((F.col("rows") - F.col("gone_rows")).alias("rows"), (F.col("tokens") - F.col("gone_tokens")).alias("tokens"))  # of one row
        write(change.select("rows", "tokens", F.lit(key).alias("key"), F.lit(key_type).alias("key_type"), F.array(*[F.lit(c) for c in columns]).alias("columns"),
                            F.lit(stem).alias("stem"), F.lit(buckets).alias("buckets")), "about")
        return cls(spark, path)

    # --- reading

    def _table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(_shape(name, self.key_type)).parquet(f"{self.path}/{name}")
        return rows.filter(F.col("segment").isin(*self.segments))

    def _live(self, rows: DataFrame) -> DataFrame:
        return _live(rows, self._table("gone")) if len(self.segments) > 1 else rows

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, key, column, places, n_tokens) of the texts that count; of some tokens, by reading their buckets."""
        found = self._table("postings")
        if tokens is not None:
            named = self.spark.createDataFrame(sorted(set(tokens)), "string").select(_bucket(F.col("value"), self.buckets).alias("b"))
            found = found.filter(F.col("bucket").isin(*(r.b for r in named.collect())) & F.col("token").isin(*tokens))
        return self._live(found).select("token", "key", "column", "places", "n_tokens")

    def texts(self) -> DataFrame:
        """(key, n_tokens) of the texts that count, those without tokens too."""
        return self._live(self._table("texts")).select("key", "n_tokens")

    def hits(self, phrase: list[str]) -> DataFrame:
        """(key, n_tokens, f): the rows that hold the phrase, and how often it begins in them."""
        found = self.postings(phrase)
        if len(phrase) == 1:
            return found.groupBy(F.col("key").alias(self.key)).agg(F.max("n_tokens").alias("n_tokens"), F.sum(F.size("places")).cast("long").alias("f"))
        # A phrase begins at a place from which its i-th token stands i places further on, for each i.
        at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(phrase)])
        each = found.select("key", "column", "n_tokens", "token", "places", F.explode(at).alias("q")).filter("token = q.t")
        each = each.select("key", "column", "n_tokens", F.explode(F.transform("places", lambda p: p - F.col("q.i"))).alias("start"))
        begins = each.groupBy("key", "column", "start").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("n")).filter(F.col("n") == len(phrase))
        return begins.groupBy(F.col("key").alias(self.key)).agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("f"))

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """(key, score) as ``bm25`` gives them."""
        phrase = words.query_tokens(query)
        phrase = [words.porter(w) for w in phrase] if self.stem else phrase
        if not phrase:
            return self.hits([""]).select(self.key, F.lit(0.0).alias("score")).limit(0)
        rows = self.hits(phrase)
        total = rows.agg(F.count("*").alias("df"))
        scored = rows.join(F.broadcast(total)).select(self.key, bm25_score(F.col("f"), F.col("n_tokens"), F.lit(self.rows), F.lit(self.mean), F.col("df")).alias("score"))  # of one row
        return scored if limit is None else scored.orderBy(F.col("score").desc(), self.key).limit(limit)

    def count(self) -> int:
        return self.rows

    def merged(self, path: str) -> TextIndex:
        """An index of one segment at another path, of the texts that count: its searches look for no replaced ones."""
        path = path.rstrip("/")
        rows = self.postings().withColumn("bucket", _bucket(F.col("token"), self.buckets)).withColumn("segment", F.lit(0))
        rows = rows.repartitionByRange("bucket", "token", "key", "column").sortWithinPartitions("bucket", "token")
        about = self.spark.createDataFrame([(self.rows, self.tokens, self.key, self.key_type, list(self.columns), self.stem, self.buckets, 0)], _ABOUT)
        for table, own, within in (("postings", rows, ["bucket"]), ("texts", self.texts().withColumn("segment", F.lit(0)), []),
                                   ("gone", self._table("gone").limit(0), []), ("about", about, [])):
            own.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("segment", *within).parquet(f"{path}/{table}")
        return TextIndex(self.spark, path)

"""Full-text, keyword, vector and hybrid search over nodes."""

from __future__ import annotations

import re
from functools import reduce
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as words
from ..functions.vectors import cosine
from ..graph import Graph
from .basic import keyword_filter

if TYPE_CHECKING:
    from .text_index import TextIndex

K1, B = 1.2, 0.75
RRF_K = 60
INDEXED = ("name", "qualified_name", "file_path", "signature")


# --- full text ----------------------------------------------------------------------------------

def fts_index(rows: DataFrame, key: str = "id", columns: tuple[str, ...] = INDEXED, stem: bool = True) -> DataFrame:
    """(key, lines, n_tokens): per column the spaced stems of its tokens, and all tokens' number. To be written once
    and read by searches; rebuilt when the nodes change."""
    cells = [words.tokens(F.col(c)) for c in columns]
    if stem:
        cells = [words.stems(c) for c in cells]
    own = rows.select(key, F.array(*cells).alias("cells"))
    return own.select(
        key, F.transform("cells", words.spaced).alias("lines"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.size(c)).alias("n_tokens"))


def bm25_score(f: Column, n_tokens: Column, n: Column, mean: Column, df: Column) -> Column:
    """Of a row that holds the phrase f times among n_tokens, in a table of n rows of which df hold it."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n_tokens / mean))


def bm25(index: DataFrame, query: str, limit: int | None = None, key: str = "id", stem: bool = True) -> DataFrame:
    """(key, score) of the rows that hold the whole query as a phrase, best first.

    The phrase counts as one term; its inverse document frequency is at least 1e-6. The query is stemmed as the
    index is (``stem`` says how both are made).
    """
    phrase = words.query_tokens(query)
    if stem:
        phrase = [words.porter(w) for w in phrase]
    if not phrase:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    found = F.aggregate("lines", F.lit(0), lambda n, line: n + words.phrase_count(line, phrase))
    rows = index.select(key, "n_tokens", found.alias("f"))
    total = rows.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), F.count_if(F.col("f") > 0).alias("df"))
    score = bm25_score(F.col("f"), F.col("n_tokens"), F.col("n"), F.col("mean"), F.col("df"))
    hits = rows.filter("f > 0").crossJoin(F.broadcast(total)).select(key, score.alias("score"))  # of one row
    return hits if limit is None else hits.orderBy(F.col("score").desc(), key).limit(limit)


def keyword_search(nodes: DataFrame, query: str, limit: int | None = None, key: str = "id") -> DataFrame:
    """(key, score): 3 for the very name, 2 for its beginning, 1 for any match of all words."""
    hit = keyword_filter(query)
    whole = query.lower().strip()
    rows = nodes.filter(F.lit(False) if hit is None else hit)
    name = F.lower("name")
    score = F.when(name == whole, 3.0).when(name.startswith(whole), 2.0).otherwise(1.0)
    rows = rows.select(key, score.alias("score"))
    return rows if limit is None else rows.orderBy(F.col("score").desc(), key).limit(limit)


# --- vectors ------------------------------------------------------------------------------------

def vector_topk(vectors: DataFrame, query: list[float], limit: int, key: str = "qualified_name", column: str = "vector") -> DataFrame:
    """(key, score) by cosine. Each task keeps its best ``limit`` rows; no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(column), q).alias("score")).orderBy(F.col("score").desc(), key).limit(limit)


# --- fusion -------------------------------------------------------------------------------------

def rrf(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of (key, score) lists, each already cut to its best: sum of 1 / (60 + rank)."""
    ranked = [
        one.select(key, (1.0 / (RRF_K + F.row_number().over(W.orderBy(F.col("score").desc(), key)))).alias("part")) for one in lists]
    return reduce(DataFrame.unionByName, ranked).groupBy(key).agg(F.sum("part").alias("score"))


def query_boosts(query: str) -> dict[str, float]:
    """Kinds, or ``qualified``, that the shape of a query speaks for."""
    out: dict[str, float] = {}
    if re.match(r"[A-Z][a-z]", query) and query != query.upper():
        out |= {"Class": 1.5, "Type": 1.5}
    if "_" in query and re.search("[A-Za-z]", query):
        out |= {"Function": 1.5}
    if "." in query:
        out |= {"qualified": 2.0}
    return out


def boost(query: str, context_files: list[str] | None = None) -> Column:
    shape = query_boosts(query)
    factors = [F.when(F.col("kind") == kind, by) .otherwise(1.0) for kind, by in shape.items() if kind != "qualified"]
    if "qualified" in shape:
        factors.append(F.when(F.lower("qualified_name").contains(query.lower()), shape["qualified"]).otherwise(1.0))
    if context_files:
        factors.append(F.when(F.col("file_path").isin(*context_files), 1.5).otherwise(1.0))
    return reduce(lambda a, b: a * b, factors, F.lit(1.0))


def hybrid_search(
    g: Graph, query: str, index: DataFrame | TextIndex | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    kind: str | None = None, limit: int = 20, context_files: list[str] | None = None,
) -> DataFrame:
    """Ranked nodes: full text and vectors fused by rank, or keywords where both find nothing; then boosts.

    ``index`` is a full-text index by qualified_name, as rows or postings (none yet: keywords answer), ``vectors``
    (qualified_name, vector).
    Candidates are the best 3 * limit of each list; a kind is filtered after ranking. All steps are one plan: the
    keyword list joins in only if the fused one is empty.
    """
    if not query.strip():
        return g.nodes.select("qualified_name", "kind", "name", "file_path", F.lit(0.0).alias("score")).limit(0)
    key, fetch = "qualified_name", 3 * limit
    lists = []
    if index is not None:
        lists.append(bm25(index, query, fetch, key) if isinstance(index, DataFrame) else index.search(query, fetch))
    if vectors is not None and query_vector is not None:
        lists.append(vector_topk(vectors, query_vector, fetch, key))
    plain = keyword_search(g.nodes, query, fetch, key)
    if lists:
        fused = rrf(lists, key)
        none = fused.agg(F.count("*").alias("n_fused"))
        plain = plain.crossJoin(F.broadcast(none)).filter("n_fused = 0").drop("n_fused")  # of one row
        plain = fused.unionByName(plain)
    ranked = g.nodes.join(plain, key).withColumn("score", F.col("score") * boost(query, context_files))
    ranked = ranked.orderBy(F.col("score").desc(), key).limit(fetch * max(1, len(lists)))
    if kind:
        ranked = ranked.filter(F.col("kind") == kind)
    return ranked.orderBy(F.col("score").desc(), key).limit(limit)


def semantic_search(g: Graph, query: str, vectors: DataFrame | None, query_vector: list[float] | None, limit: int = 20) -> DataFrame:
    """Nodes by cosine, rounded to 4 places; by keywords without vectors."""
    if vectors is None or query_vector is None:
        return g.nodes.join(keyword_search(g.nodes, query, limit, "qualified_name"), "qualified_name")
    hits = vector_topk(vectors, query_vector, limit).withColumn("score", F.round("score", 4))
    return g.nodes.join(hits, "qualified_name")


def cross_repo_search(graphs: dict[str, tuple[str, Graph]], query: str, limit: int = 20) -> DataFrame:
    """Keyword hits of several graphs: {alias: (repo_path, graph)}."""
    hits = [
        g.nodes.join(keyword_search(g.nodes, query, limit, "qualified_name"), "qualified_name")
        .select(F.lit(path).alias("repo_path"), F.lit(alias).alias("alias"), "qualified_name", "kind", "name", "file_path", "score")
        for alias, (path, g) in graphs.items()]
    return reduce(DataFrame.unionByName, hits).orderBy(F.col("score").desc(), "repo_path", "qualified_name").limit(limit)


# --- embeddings ---------------------------------------------------------------------------------

def pending_embeddings(nodes: DataFrame, stored: DataFrame, provider: str) -> DataFrame:
    """(qualified_name, text, text_hash) of nodes whose text has no vector by this provider yet; files have none."""
    from ..functions.keys import node_text

    own = nodes.filter("kind <> 'File'").select("qualified_name", node_text(
        F.col("kind"), F.col("name"), F.col("parent_name"), F.col("params"), F.col("return_type"), F.col("language")).alias("text"))
    own = own.withColumn("text_hash", F.sha2("text", 256))
    done = stored.filter(F.col("provider") == provider).select("qualified_name", "text_hash")
    return own.join(done, ["qualified_name", "text_hash"], "left_anti")


def embed_nodes(nodes: DataFrame, stored: DataFrame, provider: str, embed) -> DataFrame:
    """The vector table with new and changed nodes embedded. ``embed``: list of texts -> list of vectors, called on
    batches in the executors; old vectors of the same names are replaced."""
    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.tolist()))

    new = pending_embeddings(nodes, stored, provider).select(
        "qualified_name", vector("text").alias("vector"), "text_hash", F.lit(provider).alias("provider"))
    kept = stored.join(new.select("qualified_name"), "qualified_name", "left_anti")
    return kept.unionByName(new)


def remove_embeddings(stored: DataFrame, names: DataFrame) -> DataFrame:
    """The vector table without the rows of ``names`` (qualified_name)."""
    return stored.join(names.select("qualified_name"), "qualified_name", "left_anti")

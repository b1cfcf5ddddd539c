"""URL filter: rules first, then gradient-boosted trees on lexical features, all as Spark expressions.

The statistics of suffixes are counts over all URLs that the rules label, a row per suffix in a written table; rows
are joined with it by a broadcast if its size allows that, else by a sort-merge join, whose hot suffixes adaptive
execution splits. The trees are fitted on a sample of ``TRAIN_ROWS`` labelled URLs at most (the first by a hash of
the URL); fitting sees only the sample's binned features. The fitted trees become CASE expressions, so every row of
a table is judged by built-in expressions.

Defined cases: a null url, or one without ``://``, has an empty host and path, meets no rule and is judged by its
features (a null url as the empty string); equal rows are judged alike; without labelled URLs the method allows;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, rule): host and path in one.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 4096
#: Labelled URLs at the prior rate that a suffix's own are added to.
SMOOTH = 4
TREES, DEPTH, BINS, RATE = 24, 3, 16, 0.3

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    chars = F.array_distinct(F.split(F.lower(url), ""))
    share = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (n - F.length(F.replace(F.lower(url), c, F.lit("")))) / n)
    query = F.when(url.contains("?"), F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    return {
        "length": n.cast("double"),
        "depth": F.size(F.filter(F.split(path, "/", -1), lambda s: s != "")).cast("double"),
        "digits": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.round(-F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0)), 6),
        "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "labels": F.size(F.split(host, r"\.", -1)).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "host_length": F.length(host).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


# --- the trees ----------------------------------------------------------------------------------

@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: str
    above: float
    low: Leaf | Split
    high: Leaf | Split


@dataclass
class Model:
    base: float = -1.0
    trees: list[Leaf | Split] = field(default_factory=list)


def _grow(rows: list[int], x: dict[str, list[int]], cuts: dict[str, list[float]], g: list[float], h: list[float], depth: int) -> Leaf | Split:
    sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
    best = (1e-6, None, 0)
    if depth:
        for name, edges in cuts.items():
            hist = [[0.0, 0.0] for _ in range(len(edges) + 1)]
            own = x[name]
            for i in rows:
                cell = hist[own[i]]
                cell[0] += g[i]
                cell[1] += h[i]
            lg = lh = 0.0
            for b in range(len(edges)):
                lg, lh = lg + hist[b][0], lh + hist[b][1]
                if lh < 1.0 or sh - lh < 1.0:
                    continue
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, name, b)
    if best[1] is None:
        return Leaf(round(-RATE * sg / (sh + 1), 9))
    name, b = best[1], best[2]
    low, high = [i for i in rows if x[name][i] <= b], [i for i in rows if x[name][i] > b]
    return Split(name, cuts[name][b], _grow(low, x, cuts, g, h, depth - 1), _grow(high, x, cuts, g, h, depth - 1))


def value(tree: Leaf | Split, row: dict[str, float]) -> float:
    while isinstance(tree, Split):
        tree = tree.high if row[tree.feature] > tree.above else tree.low
    return tree.value


def fit(rows: list[dict]) -> Model:
    """rows: features by name and ``block`` (0 or 1). Second-order boosting of the logistic loss."""
    if not rows or len({r["block"] for r in rows}) < 2:
        return Model(base=4.0 if rows and rows[0]["block"] else -4.0)
    y = [r["block"] for r in rows]
    prior = sum(y) / len(y)
    model = Model(round(math.log(prior / (1 - prior)), 9))
    names = [k for k in rows[0] if k != "block"]
    cuts, x = {}, {}
    for name in names:
        column = sorted(r[name] for r in rows)
        cuts[name] = sorted({column[len(column) * b // BINS] for b in range(BINS)} - {column[-1]})
        x[name] = [sum(r[name] > c for c in cuts[name]) for r in rows]
    score = [model.base] * len(rows)
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grow(list(range(len(rows))), x, cuts, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], DEPTH)
        model.trees.append(tree)
        score = [s + value(tree, r) for s, r in zip(score, rows)]
    return model


def _expression(tree: Leaf | Split) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(F.col(f"_f.{tree.feature}") > tree.above, _expression(tree.high)).otherwise(_expression(tree.low))


def score(model: Model) -> Column:
    """The log odds of ``block``, from the struct column ``_f``."""
    total = F.lit(model.base)
    for tree in model.trees:
        total = total + _expression(tree)
    return total


def _labelled(pages: DataFrame, rules) -> DataFrame:
    """(page_id, url, host, path, suffix, rule, by_rule)."""
    rows = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("*", suffix_of(F.col("host")).alias("suffix"), rule.alias("rule"), verdict.alias("by_rule"))


def suffix_rates(pages: DataFrame, rules=RULES) -> DataFrame:
    """(suffix, rate): the smoothed share of blocked ones among all labelled URLs of a suffix; the suffix null has
    the share among all."""
    block = (F.col("by_rule") == "block").cast("long")
    per = _labelled(pages, rules).filter("by_rule is not null").groupBy("suffix").agg(F.sum(block).alias("k"), F.count("*").alias("n"))
    per = Scratch(pages.sparkSession, "url_filter").write(per, "suffixes")
    prior = per.agg((F.sum("k") / F.sum("n")).alias("rate"))
    share = F.lit(prior.first()[0]).cast("double")
    own = per.select("suffix", F.round((F.col("k") + SMOOTH * share) / (F.col("n") + SMOOTH), 6).alias("rate"))
    every = prior.select(F.lit(None).cast("string").alias("suffix"), F.round("rate", 6).alias("rate"))
    return Scratch(pages.sparkSession, "url_filter").write(own.unionByName(every), "rates")


def _featured(pages: DataFrame, rules, rates: DataFrame) -> DataFrame:
    """The labelled rows with the struct ``_f`` of their features."""
    prior = rates.filter("suffix is null").first().rate
    known = rates.filter("suffix is not null").withColumnRenamed("rate", "_rate")
    rows = _labelled(pages, rules).join(known, "suffix", "left")
    own = [v.alias(k) for k, v in features(F.col("url"), F.col("host"), F.col("path")).items()]
    own.append(F.coalesce(F.col("_rate"), F.lit(0.5 if prior is None else prior)).alias("suffix_rate"))
    return rows.withColumn("_f", F.struct(*own))


def train(pages: DataFrame, rates: DataFrame, rules=RULES, rows: int = TRAIN_ROWS) -> Model:
    labelled = _featured(pages, rules, rates).filter("by_rule is not null")
    sample = labelled.select(F.md5("url").alias("k"), "_f", (F.col("by_rule") == "block").cast("int").alias("block"))
    sample = sample.dropDuplicates(["k"]).orderBy("k").limit(rows).collect()  # rows at most
    return fit([r._f.asDict() | {"block": r.block} for r in sample])


def judge(pages: DataFrame, model: Model, rates: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score)."""
    rows = _featured(pages, rules, rates).withColumn("score", score(model))
    method = F.when(F.col("score") >= 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.round("score", 6).alias("score"))


# --- op10 ---------------------------------------------------------------------------------------

def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rates = suffix_rates(pages)
    return judge(pages, train(pages, rates), rates)

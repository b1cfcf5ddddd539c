"""Toxicity by non-negative positive-unlabelled learning, with a linear classifier in numpy.

Confirmed toxic documents are the positives; other texts, drawn without looking at their labels, are unlabelled: a
mixture in which the toxic share is the class prior. The risk of the unlabelled part counted as negative, less the
positives' share of it, estimates the negatives' risk; where that estimate falls below zero the step goes the other
way, so that the classifier doesn't fit the mixture's noise.

Features are the words of the whole text, their beginnings of 3 to 8 letters, and the beginnings that two or more
different words have: present or not, as hashes in arrays. The fit takes those that at least ``LEAST`` positives
hold, that are ``LIFT`` times as common there as in the unlabelled texts, and whose likelihood ratio against chance
is ``SURE`` or more. A penalty on absolute weights leaves out what doesn't help. The fit sees at most ``POSITIVES``
and ``UNLABELLED`` whole texts of up to ``TRAIN_CHARS`` characters (the first by a hash of doc_id), of near copies one.

Defined cases: a null or empty text has no features and the score of the intercept; labels of unknown documents, or
null ones, count for nothing; without positives every score is 0; a null doc_id counts as the empty text for the
held-out fold; equal rows have equal scores; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, Table, Words, chunks, mix64, text_batches, text_bytes

POSITIVES, UNLABELLED, TRAIN_CHARS = 2000, 4000, 20_000
LEAST, LIFT, SURE = 4, 4.0, 24.0
#: The penalty is PENALTY over the root of the number of positives: chance weighs less in larger samples.
STEPS, PENALTY = 1000, 2e-3
#: Of texts whose words are this similar, one is learned from.
ALIKE = 0.8

_BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: The last two bits of a feature tell its kind.
_WORD, _ONCE, _TWICE, _KIND = (np.uint64(x) for x in (0, 1, 2, 3))
_DOC = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> Words:
    """The words of texts, as runs of letters, marks, digits and underscores, in small letters."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{M}\p{N}_]+", " ")
    return Words(*text_bytes(plain), BLANKS)


def _by_doc(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One hash for each pair of a document and a value."""
    return mix64(values ^ mix64((doc.astype(np.uint64) + np.uint64(1)) * _DOC))


def distinct_words(words: Words) -> np.ndarray:
    """Of each document the first place of each of its words."""
    return np.sort(np.unique(_by_doc(words.doc, words.hash), return_index=True)[1])


def features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once; ``which``: distinct words of the documents."""
    docs, found = [words.doc[which]], [words.hash[which] & ~_KIND | _WORD]
    for _, own, h in words.beginnings(which, _BEGINNINGS):
        _, first, times = np.unique(_by_doc(words.doc[own], h), return_index=True, return_counts=True)
        docs += [words.doc[own[first]], words.doc[own[first[times > 1]]]]
        found += [h[first] & ~_KIND | _ONCE, h[first[times > 1]] & ~_KIND | _TWICE]
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Classifier:
    """Weights of features; the arrays that score texts are made from them."""

    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        kind, base = self.feature & _KIND, self.feature & ~_KIND
        self.tables = []
        for kinds in ((_WORD,), (_ONCE, _TWICE)):
            table = Table(np.unique(base[np.isin(kind, kinds)]))
            weights = np.zeros((2, len(table.values)))
            for row, k in enumerate(kinds):
                weights[row, np.searchsorted(table.values, base[kind == k])] = self.weight[kind == k]
            self.tables.append((table, weights))

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = words_of(texts)
        n = len(words.first) - 1
        z = np.full(n, self.intercept)
        every = np.arange(len(words.hash))

        def add(which: np.ndarray, hashes: np.ndarray, table: Table, weights: np.ndarray) -> None:
            at, row = table.find(hashes & ~_KIND, np.arange(len(which)))
            if not len(at):
                return
            doc = words.doc[which[at]].astype(np.int64)
            each = np.unique(np.stack([doc, row, words.hash[which[at]].view(np.int64)], axis=1), axis=0)[:, :2]  # different words
            pairs, times = np.unique(each, axis=0, return_counts=True)
            z[:] += np.bincount(pairs[:, 0], weights[0, pairs[:, 1]] + np.where(times > 1, weights[1, pairs[:, 1]], 0.0), n)

        add(every, words.hash, *self.tables[0])
        if len(self.tables[1][0].values):
            for _, own, h in words.beginnings(every, _BEGINNINGS):
                add(own, h, *self.tables[1])
        return np.where(z > -700, 1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0)


# --- the fit ------------------------------------------------------------------------------------

def risk(w: np.ndarray, b: float, doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk of the positives, of the negatives as estimated, slopes by w and by b) with the logistic loss. Where the
    negatives' risk is below zero the slopes are those that raise it, and it alone."""
    n_pos, n_unl = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    z = np.bincount(doc, w[feature], len(positive)) + b
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    as_negative, as_positive = np.logaddexp(0, z), np.logaddexp(0, -z)
    own_risk = prior * as_positive[positive].sum() / n_pos
    rest = as_negative[~positive].sum() / n_unl - prior * as_negative[positive].sum() / n_pos
    # Slopes of the loss: p - 1 as a positive, p as a negative.
    own = np.where(positive, prior * (p - 1) / n_pos, 0.0)
    others = np.where(positive, -prior * p / n_pos, p / n_unl)
    slope = own + others if rest >= 0 else -others
    return own_risk, rest, np.bincount(feature, slope[doc], len(w)), slope.sum()


def nn_pu(doc: np.ndarray, feature: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk.

    doc, feature: the pairs that are present; positive: of each document, whether it is a positive or unlabelled.
    """
    n_pos = max(1, int(positive.sum()))
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    moment, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        _, _, by_w, by_b = risk(w, b, doc, feature, positive, prior)
        grad = np.append(by_w, by_b)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        step = 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.05 * PENALTY / np.sqrt(n_pos) / (np.sqrt(square[:-1] / (1 - 0.999**t)) + 1e-4), 0)
        b -= step[-1]
    return w, float(b)


class _Distinct:
    """Tells texts from near copies of earlier ones: candidates agree in three minimal hashes, the sets decide."""

    def __init__(self):
        self.seen: dict[tuple[int, ...], list[np.ndarray]] = {}

    def is_new(self, own: np.ndarray) -> bool:
        key = tuple(int(mix64(own ^ np.uint64(salt)).min(initial=np.iinfo(np.uint64).max)) for salt in (1, 2, 3))
        for other in self.seen.get(key, ()):
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= ALIKE * (len(own) + len(other) - both):
                return False
        self.seen.setdefault(key, []).append(own)
        return True


def _sample(texts: list[str]) -> Iterator[tuple[Words, np.ndarray, int]]:
    """The words of texts, batch by batch, the distinct ones of those that aren't copies, and how many these are."""
    known = _Distinct()
    for batch in chunks(iter([pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string())], ["text"])]), "text"):
        words = words_of(batch.column(0))
        which = distinct_words(words)
        edge = np.searchsorted(words.doc[which], np.arange(batch.num_rows + 1))
        new = [known.is_new(np.sort(words.hash[which[a:b]])) for a, b in zip(edge[:-1], edge[1:])]
        number = np.cumsum(new) - 1  # copies have no number
        words.doc = number[words.doc] if len(words.doc) else words.doc
        yield words, which[np.repeat(new, np.diff(edge))], int(sum(new))


def _pairs(texts: list[str], known: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of texts without copies, documents, features): all, or the known ones as places in that sorted array."""
    n, docs, found = 0, [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64 if known is None else np.int64)]
    for words, which, new in _sample(texts):
        doc, own = features(words, which)
        if known is not None:
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            there = known[at] == own if len(known) else np.zeros(len(own), dtype=bool)
            doc, own = doc[there], at[there]
        docs.append(doc + n)
        found.append(own)
        n += new
    return n, np.concatenate(docs), np.concatenate(found)


def _frequent(texts: list[str], least: int) -> np.ndarray:
    """The features that at least ``least`` texts have, sorted. A count of hashed features, never too low, tells
    first which are worth keeping."""
    counts = np.zeros(1 << 22, dtype=np.int32)
    for words, which, _ in _sample(texts):
        counts += np.bincount((mix64(features(words, which)[1]) >> np.uint64(42)).astype(np.int64), minlength=len(counts)).astype(np.int32)
    kept = [np.empty(0, dtype=np.uint64)]
    for words, which, _ in _sample(texts):
        own = features(words, which)[1]
        kept.append(own[counts[(mix64(own) >> np.uint64(42)).astype(np.int64)] >= least])
    names, times = np.unique(np.concatenate(kept), return_counts=True)
    return names[times >= least]


def fit(positives: list[str], unlabelled: list[str], prior: float) -> Classifier:
    if not positives:
        return Classifier(np.empty(0, dtype=np.uint64), np.empty(0), -1000.0)
    prior = min(0.95, max(0.001, prior))
    names = _frequent(positives, min(LEAST, len(positives)))
    n_held, doc, feature = _pairs(positives, names)
    n_rest, rest_doc, rest_feature = _pairs(unlabelled, names)
    n = np.bincount(feature, minlength=len(names))
    base = np.bincount(rest_feature, minlength=len(names))
    # A feature of toxic texts alone is 1 / prior times as common among positives as in the mixture, at most.
    lift = (n / n_held) / ((base + 0.5) / (n_rest + 1))
    sure = 2 * n * np.log(np.maximum(n, 1) * (n_held + n_rest) / (np.maximum(n + base, 1) * n_held))
    chosen = np.flatnonzero((lift >= min(LIFT, 0.5 / prior)) & (sure >= SURE))
    place = np.full(len(names), -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    doc, feature = np.concatenate([doc, rest_doc + n_held]), place[np.concatenate([feature, rest_feature])]
    doc, feature = doc[feature >= 0], feature[feature >= 0]
    w, b = nn_pu(doc, feature, np.arange(n_held + n_rest) < n_held, len(chosen), prior)
    return Classifier(names[chosen[w != 0]], w[w != 0], b)


# --- Spark --------------------------------------------------------------------------------------

def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Fit on the given documents and labels (the caller leaves held-out rows out of both). Two passes over the
    texts: one for their hashes, one for the texts that are chosen."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, total = known.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    if not toxic:
        return fit([], [], 0.0)
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.filter(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("_x"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_k"))
    keyed = scratch.write(keyed, "keys")
    confirmed = keyed.join(known.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    pick = lambda d, n: [r._x for r in d.select("_k", "_x").orderBy("_k", "_x").limit(n).collect()]  # noqa: E731  n rows at most
    chosen = pick(confirmed, positives), pick(keyed, unlabelled)
    scratch.close()
    wanted = spark.createDataFrame([(k,) for k in sorted({*chosen[0], *chosen[1]})], "_x long")  # both bounds at most
    found = rows.select("text", F.xxhash64("text").alias("_x")).join(F.broadcast(wanted), "_x")
    text = {r._x: r.text for r in found.groupBy("_x").agg(F.first("text").alias("text")).collect()}
    return fit(*([text[k] for k in keys if k in text] for keys in chosen), toxic / total)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double")


# --- op6 ----------------------------------------------------------------------------------------

def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    usable = fold(F.col("doc_id"), 5) != 0
    model = train(docs.filter(usable), labels.filter(usable))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

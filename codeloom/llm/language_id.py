"""Language identification by a linear-chain conditional random field over words.

A text is cut into chains: its lines, long ones every ``CHAIN`` words. A word's features are its affixes, its letter
n-grams and itself (the lexicon), hashed into a table of weights per language; transitions between the languages of
neighbouring words are learned, too. Forward-backward gives every word of every text a distribution over languages;
``tag_words`` labels the stretches of a code-switched text with them. A document's language is the one with the most
words by that measure, its score that share, and its certainty the mean of the words' greatest probabilities: a text
in several known languages has a low score, one in none of them a low certainty.

The field is fitted with numpy on whole texts of ``TRAIN_DOCS`` labelled documents per language and ``TRAIN_ALL`` in
all at most (the first by a hash of doc_id, of up to ``TRAIN_CHARS`` characters each). Every word of a training document has the document's
language; so that transitions are learned, half of the chains are joined from pieces of two languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in code
point order; a null lang isn't learned from; a null doc_id counts as the empty text for the held-out fold; without
any labelled document everything is ``und``; equal rows have equal results; an empty table gives an empty table;
other columns are carried along by ``tag`` and ``tag_words`` and may have any name.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, mix64, text_batches

TRAIN_DOCS, TRAIN_ALL, TRAIN_CHARS = 150, 6000, 20_000
CHAIN = 256
BUCKETS = 1 << 16
ROUNDS = 24
CACHE_WORDS = 200_000

_TOKEN = re.compile(r"\n|[^\W\d_]+")


_AT = mix64(np.arange(1, 1 << 12, dtype=np.uint64)) | np.uint64(1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the features of all words: affixes of 1 to 4 letters, n-grams of 2 and 3 with the
    word's edges, and the word itself. All words are hashed at once, as arrays of code points."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(length + 2)[:-1]])
    number = np.arange(len(words))
    owner = np.repeat(number, length + 2)
    place = np.arange(len(code)) - start[owner]
    owners, hashes = [number], [np.add.reduceat(code * _AT[np.minimum(place, len(_AT) - 8) + 7], start) + np.uint64(1)]
    for n in (2, 3):
        at = np.flatnonzero(place <= length[owner] + 2 - n)
        owners.append(owner[at])
        hashes.append(sum(code[at + j] * _AT[j] for j in range(n)) + np.uint64(n))
    front, back = np.full(len(words), 10, dtype=np.uint64), np.full(len(words), 20, dtype=np.uint64)
    for n in range(1, 5):
        long = np.flatnonzero(length >= n)
        front[long] += code[start[long] + n] * _AT[n] + np.uint64(1)
        back[long] += code[start[long] + length[long] + 1 - n] * _AT[n] + np.uint64(1)
        owners += [long, long]
        hashes += [front[long], back[long]]
    return np.concatenate(owners), (mix64(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)


def lowered(text: str) -> str:
    """The text in small letters, character by character: places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def tokens(text: str | None) -> list[str]:
    """Letter words and the newlines between them."""
    return _TOKEN.findall(lowered(text)) if text else []


# --- forward-backward ---------------------------------------------------------------------------

def forward_backward(potential: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: np.ndarray, init: np.ndarray, pairs: bool = False):
    """Marginals of each word, the chains' log normalisers and the expected transitions.

    potential: (words, labels), exponentials of word scores; step, init: those of transitions and first words.
    All chains go forward together, longest first, so that those still running are always a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(longest), side="left")
    forward = np.empty_like(potential)
    scale = np.empty(len(potential), dtype=potential.dtype)
    last = None
    for t in range(longest):
        at = starts[: running[t]] + t
        now = potential[at] * (init if last is None else last[: running[t]] @ step)
        total = now.sum(axis=1)
        now /= total[:, None]
        forward[at], scale[at], last = now, total, now
    backward = np.ones_like(potential)
    expected = np.zeros_like(step)
    for t in range(longest - 2, -1, -1):
        at = starts[: running[t + 1]] + t
        ahead = backward[at + 1] * potential[at + 1] / scale[at + 1][:, None]
        backward[at] = ahead @ step.T
        if pairs:
            expected += forward[at].T @ ahead
    return forward * backward, np.log(scale), expected * step


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels)
    step: np.ndarray  # (labels, labels)
    init: np.ndarray  # (labels,)


def _chains(docs: list[tuple[str, int]], seed: int) -> tuple[list[list[str]], list[list[int]]]:
    """Training chains with a label per word; every other one is joined from pieces of two documents."""
    rng = random.Random(seed)
    lines: list[tuple[list[str], int]] = []
    for text, label in docs:
        for line in text.split("\n"):
            words = [w for w in tokens(line) if w != "\n"]
            lines += [(words[i:i + 64], label) for i in range(0, len(words), 64)]
    rng.shuffle(lines)
    chains, labels = [], []
    for i in range(0, len(lines) - 1, 2):
        (a, x), (b, y) = lines[i], lines[i + 1]
        if i % 4:
            at, to = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
            chains += [a[:at] + b[to:], b[:to] + a[at:]]
            labels += [[x] * at + [y] * (len(b) - to), [y] * to + [x] * (len(a) - at)]
        else:
            chains += [a, b]
            labels += [[x] * len(a), [y] * len(b)]
    kept = [k for k, c in enumerate(chains) if c]
    return [chains[k] for k in kept], [labels[k] for k in kept]


def fit(docs: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> Field:
    """(text, language) -> the field that maximises the penalised likelihood, by adaptive gradient steps."""
    names = sorted({lang for _, lang in docs})
    n = len(names)
    field = Field(names, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n))
    chains, labels = _chains([(text, names.index(lang)) for text, lang in docs], seed)
    if not chains:
        return field
    number: dict[str, int] = {}
    words = np.array([number.setdefault(w, len(number)) for c in chains for w in c])
    truth = np.array([y for own in labels for y in own])
    lengths = np.array([len(c) for c in chains])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner, feature = word_features(list(number))
    follows = np.ones(len(words), dtype=bool)
    follows[starts] = False
    seen_step = np.zeros((n, n))
    np.add.at(seen_step, (truth[np.flatnonzero(follows) - 1], truth[follows]), 1)
    seen_init = np.bincount(truth[starts], minlength=n).astype(float)
    squares = [np.full_like(x, 1e-8) for x in (field.weights, field.step, field.init)]
    onehot = np.eye(n)[truth]
    for _ in range(rounds):
        scores = _summed(field.weights, owner, feature, len(number))[words]
        potential = np.exp(scores - scores.max(axis=1, keepdims=True))
        marginal, _, expected = forward_backward(potential, starts, lengths, np.exp(field.step), np.exp(field.init), pairs=True)
        rest = onehot - marginal
        by_word = np.stack([np.bincount(words, rest[:, k], len(number)) for k in range(n)], axis=1)
        grad = np.stack([np.bincount(feature, by_word[owner, k], BUCKETS) for k in range(n)], axis=1) - 0.05 * field.weights
        for value, g, sq in zip(
            (field.weights, field.step, field.init),
            (grad, seen_step - expected - 0.05 * field.step, seen_init - marginal[starts].sum(axis=0) - 0.05 * field.init), squares,
        ):
            sq += g * g
            value += 0.3 * g / np.sqrt(sq)
    return field


def _summed(weights: np.ndarray, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """(n, labels): the weights of each word's features, added up."""
    return np.stack([np.bincount(owner, column[feature], n) for column in np.ascontiguousarray(weights.T)], axis=1)


class Tagger:
    """Applies a field to texts. Word scores are kept for up to CACHE_WORDS words."""

    def __init__(self, field: Field):
        self.field = field
        self.weights = field.weights.astype(np.float32)
        self.step, self.init = np.exp(field.step).astype(np.float32), np.exp(field.init).astype(np.float32)
        self.number: dict[str, int] = {}
        self.table = np.empty((1 << 12, len(field.labels)), dtype=np.float32)

    def _learn(self, new: list[str]) -> None:
        scores = _summed(self.weights, *word_features(new), len(new))
        at = len(self.number)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at:at + len(new)] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-6
        self.number.update(zip(new, range(at, at + len(new))))

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Distributions of all words, the text of each, and the texts' tokens."""
        split = [tokens(t) for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.number.clear()
            self.table = np.empty((1 << 12, len(self.field.labels)), dtype=np.float32)
        new = set().union(*split) - self.number.keys() - {"\n"}
        if new:
            self._learn(sorted(new))
        get = self.number.get
        ids = np.array([get(w, -1) for own in split for w in own], dtype=np.int64)  # a newline has no number
        doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
        word = np.flatnonzero(ids >= 0)
        if not len(word):
            return np.empty((0, len(self.field.labels)), dtype=np.float32), doc[word], split
        # A chain ends at a newline, at the end of its text and after CHAIN words.
        breaks = np.ones(len(word), dtype=bool)
        breaks[1:] = (np.diff(word) > 1) | (np.diff(doc[word]) > 0)
        start = np.flatnonzero(breaks)
        place = np.arange(len(word)) - np.repeat(start, np.diff(np.append(start, len(word))))
        start = np.flatnonzero(place % CHAIN == 0)
        lengths = np.diff(np.append(start, len(word)))
        marginal, _, _ = forward_backward(self.table[ids[word]], start, lengths, self.step, self.init)
        return marginal, doc[word], split

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and certainty of each text."""
        if not self.field.labels:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        return self._summary(*self.marginals(texts))

    def _summary(self, marginal: np.ndarray, doc: np.ndarray, split: list[list[str]]) -> tuple[list[str], list[float], list[float]]:
        n_labels, n = len(self.field.labels), len(split)
        sums = np.stack([np.bincount(doc, marginal[:, k], n) for k in range(n_labels)], axis=1)
        best, total = sums.argmax(axis=1), sums.sum(axis=1)
        # \w without digits holds a few signs that aren't letters.
        found = [t > 0 and any(c.isalpha() for w in s for c in w) for t, s in zip(total.tolist(), split)]
        score = sums[np.arange(n), best] / np.maximum(total, 1e-9)
        certainty = np.bincount(doc, marginal.max(axis=1, initial=0.0), n) / np.maximum(total, 1e-9)
        within = lambda values: [min(1.0, max(0.0, v)) if f else 0.0 for v, f in zip(values.tolist(), found)]
        return [self.field.labels[b] if f else "und" for b, f in zip(best.tolist(), found)], within(score), within(certainty)

    def stretches(self, texts: list[str | None]) -> tuple[list[list[dict]], tuple[list[str], list[float], list[float]]]:
        """Of each text the stretches of words in one language (start and end in characters, lang, words, and
        their mean probability), and what ``documents`` says of it, from the same marginals."""
        if not self.field.labels:
            return [[] for _ in texts], self.documents(texts)
        marginal, doc, split = self.marginals(texts)
        label, probability = marginal.argmax(axis=1).tolist(), marginal.max(axis=1, initial=0.0).tolist()
        out, k = [], 0
        for text in texts:
            own: list[dict] = []
            for m in _TOKEN.finditer(lowered(text)) if text else ():
                if m[0] == "\n":
                    continue
                lang = self.field.labels[label[k]]
                if own and own[-1]["lang"] == lang:
                    own[-1]["end"], own[-1]["words"], own[-1]["probability"] = m.end(), own[-1]["words"] + 1, own[-1]["probability"] + probability[k]
                else:
                    own.append({"start": m.start(), "end": m.end(), "lang": lang, "words": 1, "probability": probability[k]})
                k += 1
            for stretch in own:
                stretch["probability"] = min(1.0, stretch["probability"] / stretch["words"])
            out.append(own)
        summary = self._summary(marginal, doc, split)
        return [own if lang != "und" else [] for own, lang in zip(out, summary[0])], summary

    def words(self, text: str | None) -> list[tuple[str, str]]:
        """Each word of a text with its own language: the labelling of code-switched text."""
        marginal, _, split = self.marginals([text])
        return list(zip((w for w in split[0] if w != "\n"), (self.field.labels[b] for b in marginal.argmax(axis=1))))


# --- Spark --------------------------------------------------------------------------------------

def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, usable: Column, per_language: int = TRAIN_DOCS) -> Field:
    """Fit on a bounded sample of the rows where ``usable``; only text and lang are learned from."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = F.row_number().over(W.partitionBy("lang").orderBy("_k", "_x"))
    ids = rows.select("doc_id", "lang", key.alias("_k"), F.xxhash64("text").alias("_x")).withColumn("_n", first).filter(F.col("_n") <= per_language)
    ids = [(r._x, r.lang) for r in ids.orderBy("_n", "_k", "_x", "lang").limit(TRAIN_ALL).select("_x", "lang").collect()]  # TRAIN_ALL rows at most
    if not ids:
        return Field([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(ids, "_x long, _l string").distinct()
    found = rows.select("text", "lang", F.xxhash64("text").alias("_x")).join(F.broadcast(wanted), "_x")
    found = found.filter("lang = _l").groupBy("_x", "lang").agg(F.first("text").alias("text")).orderBy("_x", "lang").collect()
    return fit([(r.text, r.lang) for r in found])


def _applied(docs: DataFrame, field: Field, added: list[T.StructField], make) -> DataFrame:
    """The rows of ``docs`` with columns added (in place of those of their names): make(tagger, texts) -> arrays."""
    docs = docs.drop(*[f.name for f in added])
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    text = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in chunks(batches, "text"):
            columns = make(tagger, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *added]))


_SUMMARY = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType())]
_STRETCH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("probability", pa.float64())])


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and certainty."""
    return _applied(docs, field, _SUMMARY, lambda tagger, texts: [pa.array(x) for x in tagger.documents(texts)])


def tag_words(docs: DataFrame, field: Field) -> DataFrame:
    """The same with ``stretches``, the runs of words in one language: structs of start and end (characters of the
    text, end excluded), lang, words and probability."""

    def make(tagger: Tagger, texts: list[str | None]) -> list[pa.Array]:
        stretches, summary = tagger.stretches(texts)
        return [*(pa.array(x) for x in summary), pa.array(stretches, type=pa.list_(_STRETCH))]

    kind = T.ArrayType(T.StructType.fromDDL("start int, end int, lang string, words int, probability double"))
    return _applied(docs, field, [*_SUMMARY, T.StructField("stretches", kind)], make)


def with_language(docs: DataFrame, field: Field, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known, with a certainty of ``least`` or more."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    text = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in chunks(batches, "text"):
            langs, _, certainty = tagger.documents(batch.column(text).to_pylist())
            yield batch.filter(pa.array([x != "und" and c >= least for x, c in zip(langs, certainty)], type=pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


# --- op5 ----------------------------------------------------------------------------------------

def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    field = train(docs, ~held)
    return tag(docs.select("doc_id", "text", held.alias("held_out")), field).select("doc_id", "held_out", "lang_pred", "score")

"""The operators on shared content against brute force: near duplicates, decontamination, line dedup."""

import hashlib
import pickle
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import components, decontaminate, line_dedup, minhash, ngram_join, passages
from codeloom.llm.common import BLANKS, Words, words_of

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, DOC)
    if extra:  # names that the operators use inside
        for c in ("row", "key", "hash", "copy", "score", "lang_pred", "runs", "n_lines", "_word", "first", "doc_ids"):
            df = df.withColumn(c, F.lit(7))
    return df


def corpus(rng, n=60, words=400):
    vocab = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 12, 40, 120, 300]))]
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, " \n\t "), (903, out[0][1]), (903, out[0][1]), (904, out[1][1].upper()), (None, out[2][1])]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted((str(i), len(s), str(least.get(root(a)) if s else i)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k, num, den, seed", [(3, 90, 100, 1), (5, 80, 100, 2)])
def test_similar_groups(spark, k, num, den, seed, monkeypatch):
    texts = corpus(random.Random(seed))
    want = brute(texts, k, num, den)
    got = ngram_join.similar_groups(spark, docs_of(spark, texts), k, num, den)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == want
    if k == 5:  # blocks, bands and the second count, on clusters that are small
        monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 150)
        monkeypatch.setattr(ngram_join, "PIVOT_BLOCK_WEIGHT", 100)
        monkeypatch.setattr(ngram_join, "REFINE_WEIGHT", 300)
        got = ngram_join.similar_groups(spark, docs_of(spark, texts), k, num, den)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == want


def test_sets_of_one_number_stay_apart(spark, monkeypatch):
    """Half of a set's identity is the same for all: the other half tells them apart."""
    plain = ngram_join._nodes

    def poor(k, rule, method):
        def nodes(batches):
            for b in plain(k, rule, method)(batches):
                at = b.schema.get_field_index("node")
                yield b.set_column(at, "node", pa.array([x and 7 for x in b.column(at).to_pylist()], type=pa.int64()))

        return nodes

    monkeypatch.setattr(ngram_join, "_nodes", poor)
    texts = corpus(random.Random(3), 40)
    got = ngram_join.similar_groups(spark, docs_of(spark, texts), 5, 80, 100)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute(texts, 5, 80, 100)


def test_one_of_each(spark):
    texts = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z"), (4, ""), (6, None), (6, None), (None, "x y z")]
    got = ngram_join.one_of_each(spark, docs_of(spark, texts, extra=True))
    assert got.columns == docs_of(spark, texts, extra=True).columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(2, "a b c d e f g h"), (3, "x y z"), (4, ""), (6, None), (6, None)]))
    assert ngram_join.one_of_each(spark, docs_of(spark, [])).isEmpty()


def test_star_of_near_copies(spark):
    """Copies that are similar to one base and not to each other are one group."""
    base = [f"b{i}" for i in range(300)]
    texts = [(0, " ".join(base))]
    for i in range(1, 25):
        w = list(base)
        for p in random.Random(i).sample(range(10, 290), 5):
            w[p] = f"x{i}_{p}"
        texts.append((i, " ".join(w)))
    got = ngram_join.similar_groups(spark, docs_of(spark, texts), 3, 90, 100)
    assert {r.component_id for r in got.collect()} == {0}


def test_a_large_group_of_near_copies_meets_its_originals_only(spark, monkeypatch):
    """Sets of a core are written once for the pivots and never again; results stay those of all pairs."""
    rng = random.Random(7)
    texts = []
    for g, n in ((0, 300), (1, 40)):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(n):
            w = list(base)
            for p in rng.sample(range(5, 115), 2 if i else 0):
                w[p] = f"e{g}_{i}_{p}"
            texts.append((1000 * g + i, " ".join(w)))
    texts += [(5000 + i, " ".join([f"g0w{j}" for j in range(60)] + [f"z{i}_{j}" for j in range(60)])) for i in range(20)]
    monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 2000)
    monkeypatch.setattr(ngram_join, "PIVOT_BLOCK_WEIGHT", 2000)
    written = []
    meet = ngram_join._meet

    def watched(rows, scratch):
        out = meet(rows, scratch)
        written.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_meet", watched)
    got = ngram_join.similar_groups(spark, docs_of(spark, texts), 3, 90, 100)
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect())
    assert rows == brute(texts, 3, 90, 100)
    assert len({r[2] for r in rows}) == 22
    assert 0 < written[0] < 3 * 340  # all pairs of blocks would write each of 340 sets about 18 times


def test_similar_groups_of_a_hundred_thousand_near_copies(spark):
    """Each differs from one original in a word of its own."""
    n, words = 100_000, 24
    base = F.array(*[F.lit(f"w{i}") for i in range(words)])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.array_join(base, " ")).otherwise(
        F.array_join(F.transform(base, lambda w, i: F.when(i == 23, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(w)), " ")).alias("text"))
    began = time.perf_counter()
    got = ngram_join.similar_groups(spark, docs, 3, 90, 100)
    assert got.filter("component_id <> 0").isEmpty() and got.count() == n
    assert time.perf_counter() - began < 240


def test_bitmap_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, 120).astype(np.uint64))
        b = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
        m = ngram_join.bitmaps([a, b], 2)
        assert int(np.bitwise_count(m[0] ^ m[1]).sum()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_groups(spark, seed, monkeypatch):
    """All links of brute force, also where clusters are dealt out in many small blocks."""
    texts = corpus(random.Random(seed))
    want = brute(texts, 4, 80, 100)
    for small in (False, True):
        if small:
            monkeypatch.setattr(ngram_join, "BLOCK_WEIGHT", 150)
            monkeypatch.setattr(ngram_join, "PIVOT_BLOCK_WEIGHT", 100)
        got = minhash.near_duplicates(spark, docs_of(spark, texts, extra=True), 4).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_defined_cases(spark):
    assert minhash.near_duplicates(spark, docs_of(spark, [])).isEmpty()
    long = " ".join(f"w{i % 977}x{i // 1000}" for i in range(200_000))
    texts = [(1, None), (2, ""), (3, "a b"), (4, "A  b\n"), (None, "a b"), (5, long), (6, long + " end"), (None, "q r s t u"), (7, None)]
    got = {(r.doc_id, r.n_shingles > 1): (r.component_id, r.kept) for r in minhash.near_duplicates(spark, docs_of(spark, texts), 4).collect()}
    assert got == {(1, False): (1, True), (2, False): (2, True), (3, False): (3, True), (4, False): (3, False), (None, False): (3, False), (5, True): (5, True),
                   (6, True): (5, False), (None, True): (None, True), (7, False): (7, True)}


def test_minhash_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        agree, met = [], 0
        for _ in range(60):
            both = rng.integers(0, 2**64, int(300 * share), dtype=np.uint64)
            own = [np.concatenate([both, rng.integers(0, 2**64, (300 - len(both)) // 2, dtype=np.uint64)]) for _ in range(2)]
            sig = minhash.signatures(own)
            agree.append((sig[0] == sig[1]).mean())
            met += bool((minhash.bands(sig)[0] == minhash.bands(sig)[1]).any())
        assert abs(np.mean(agree) - share) < 0.02
        assert met == 60 or share < 0.8
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-10
    assert 60 < minhash.least_agreeing(0.8) < 102


def test_minhash_of_many_near_copies(spark):
    """30,000 texts that each differ from one original, as many exact copies of another: one group each."""
    n, words = 30_000, 40
    base = F.array(*[F.lit(f"w{i}") for i in range(words)])
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.when(F.col("id") >= n, "the same words for everybody").when(F.col("id") == 0, F.array_join(base, " ")).otherwise(
        F.array_join(F.transform(base, lambda w, i: F.when(i == 39, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(w)), " ")).alias("text"))
    got = minhash.near_duplicates(spark, docs, 4)
    assert got.groupBy("component_id").count().orderBy("component_id").collect() == [(0, n), (n, n)]
    assert got.filter("kept").count() == 2


@pytest.mark.parametrize("find", [components.components, components.star_components])
def test_components(spark, find):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in find(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert find(spark, spark.createDataFrame([], "a long, b long")).isEmpty()


def test_words_are_those_of_the_definition():
    text = "Äb\u00a0c  D-E\n" + "x" * 3000 + " \x0b q"
    w = words_of([text, None, "", "a"], BLANKS)
    own = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    assert [w.text(i, 1) for i in range(w.first[1])] == own and w.first.tolist() == [0, len(own), len(own), len(own), len(own) + 1]
    assert len(set(w.hash.tolist())) == len(set(own) | {b"a"})


# --- decontamination ----------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(texts, items):
    out = []
    for i, t in texts:
        w, hit, found = lowered(t), set(), set()
        for item, it in items:
            iw = lowered(it)
            n = min(10, len(iw))
            for p in range(len(iw) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q:q + n] == iw[p:p + n]:
                        hit.update(range(q, q + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def bench_case():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 7, 10, 14, 25, 1, 40, 12])] + [(20, None), (21, "-- !"), (3, "w1 w2 w3")]
    texts = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 60]))]
        if i % 3:
            it = rng.choice(items[:8])[1].upper().split()
            a = rng.randrange(len(it))
            at = rng.randrange(len(w) + 1)
            w[at:at] = it if i % 2 else it[a:a + 11]
        texts.append((i, ", ".join(w)))
    return texts + [(100, None), (101, ""), (101, ""), (None, items[4][1])], items


def test_decontamination(spark):
    texts, items = bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    spans = []
    for block in (decontaminate.BLOCK_BYTES, 150):  # one block, and several
        got = decontaminate.scan(spark, docs_of(spark, texts), bench, block_bytes=block).collect()
        rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got]
        assert sorted(rows, key=str) == want
        assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)
        spans.append(sorted(map(str, got)))
        assert spans[0] == spans[-1]
        clean = decontaminate.uncontaminated(spark, docs_of(spark, texts, extra=True), bench, block_bytes=block)
        assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(spark, docs_of(spark, texts), none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.scan(spark, docs_of(spark, []), bench).isEmpty()


def index_of(items, seen=None):
    index = decontaminate.Index(pa.table({"item": pa.array([str(i) for i, t in items if t is not None], type=pa.string()),
                                          "text": pa.array([t for _, t in items if t is not None], type=pa.string())}))
    index.order(index.vocabulary(), pa.table({"k": pa.array([], type=pa.int32()), "hash": pa.array([], type=pa.int64()), "n": pa.array([], type=pa.int64())}))
    return index


def local_hits(texts, items):
    words = words_of([t for _, t in texts], decontaminate.NON_ALNUM)
    counts, found, spans = decontaminate.found_in(index_of(items), words)
    rows = zip(texts, np.diff(words.first).tolist(), counts.tolist(), found.to_pylist())
    return sorted(((i, n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest()) for (i, _), n, hit, own in rows), key=str)


def test_decontamination_does_not_rest_on_hashes(monkeypatch):
    """With hashes of three bits, of which most are equal, the words themselves decide."""
    texts, items = bench_case()
    plain = Words.shingles
    monkeypatch.setattr(Words, "shingles", lambda self, k: plain(self, k) & np.uint64(7))
    assert local_hits(texts, items) == brute_hits(texts, items)
    monkeypatch.setattr(decontaminate, "COMPARE_BYTES", 7)
    assert local_hits(texts, items) == brute_hits(texts, items)


def test_decontamination_of_long_texts_and_common_words():
    texts = [(1, "the " * 300_000), (2, "x" * 2_000_000 + " the"), (3, " ".join(f"a{i}" for i in range(100_000)))]
    items = [(1, "the"), (2, "the the the"), (3, " ".join(f"a{i}" for i in range(50_000, 50_030))), (4, "x" * 2_000_000)]
    began = time.perf_counter()
    got = local_hits(texts, items)
    assert time.perf_counter() - began < 20
    assert [r[1:4] for r in got] == [(300_000, 300_000, 2), (2, 2, 2), (100_000, 30, 1)]


def test_the_index_takes_a_few_times_its_text():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50_000)]
    items = [(i, " ".join(words[j] for j in rng.integers(0, len(words), 200))) for i in range(5000)]
    size = sum(len(t) for _, t in items)
    index = index_of(items)
    assert len(pickle.dumps(index)) < 8 * size
    tracemalloc.start()
    index_of(items)
    assert tracemalloc.get_traced_memory()[1] < 40 * size  # of 16 MB, 640 MB at the very most
    tracemalloc.stop()


# --- line dedup ---------------------------------------------------------------------------------

def brute_lines(texts, least):
    """A line goes if it lies in a run of `least` words or more that occurs earlier."""
    n_words = lambda line: len(re.findall(r"[^\x20\x09-\x0D]+", line))
    rows = [(d, t.split("\n")) for d, t in texts]
    first, runs = {}, []
    for d, lines in rows:
        worded = [i for i, x in enumerate(lines) if n_words(x)]
        for a in range(len(worded)):
            total = 0
            for b in range(a, len(worded)):
                total += n_words(lines[worded[b]])
                if total >= least:
                    content = tuple(lines[i] for i in worded[a:b + 1])
                    runs.append((d, worded[a], worded[b], content))
                    first[content] = min(first.get(content, (d, worded[a])), (d, worded[a]))
    gone = {(d, i) for d, a, b, content in runs if (d, a) > first[content] for i in range(a, b + 1)}
    return [(d, "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone), sum((d, i) in gone for i in range(len(lines)))) for d, lines in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}_{j}" for j in range(rng.choice([1, 2, 3, 6]))) for i in range(9)] + ["", " "]
    texts = []
    for d in range(30):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {d} {i}" for i in range(rng.randrange(1, 10))]
        if texts and rng.random() < 0.5:
            other = rng.choice(texts)[1].split("\n")
            a = rng.randrange(len(other))
            lines[1:1] = other[a:a + 4]
        texts.append((d, "\n".join(lines)))
    got = line_dedup.drop_repeated_lines(spark, docs_of(spark, texts, extra=True), 7)
    assert sorted((r.doc_id, r.text, r.n_deleted) for r in got.collect()) == brute_lines(texts, 7)


def test_line_dedup_of_a_long_text_of_many_lines(spark):
    """100,000 different lines, of which the later half stand in another document, too; and one line of 1 MB, twice."""
    lines = [f"a{i} b{i} c{i} d" for i in range(100_000)]
    texts = [(1, "\n".join(lines)), (2, "x y\n" + "\n".join(lines[50_000:])), (3, "long " * 200_000), (4, "q\n" + "long " * 200_000)]
    df = docs_of(spark, texts).withColumn("n_lines", F.lit("x")).withColumn("n_deleted", F.lit("y"))
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark, df).collect()}
    assert time.perf_counter() - began < 60
    assert {i: (r.n_lines, r.n_deleted) for i, r in got.items()} == {1: (100_000, 0), 2: (50_001, 50_000), 3: (1, 0), 4: (2, 1)}
    assert got[2].text == "x y" and got[4].text == "q" and got[1].text == texts[0][1]


def test_positions_are_thinned(spark):
    """One position is selected for several windows, and equal runs select it at the same of their lines."""
    rng = random.Random(3)
    line = lambda: " ".join(str(rng.random()) for _ in range(2))
    shared = [line() for _ in range(30)]
    texts = [(i, "\n".join([line() for _ in range(20)] + shared + [line() for _ in range(20)])) for i in range(2)]
    rows = line_dedup._selected(line_dedup._signatures(docs_of(spark, texts)), 10).collect()
    assert len(rows) < 0.6 * 2 * 66 and sum(len(r.around) for r in rows) >= 2 * 66
    own = [{(r.fingerprint, r.place) for r in rows if r.doc_id == i and 24 <= r.place < 46} for i in range(2)]
    assert own[0] == own[1] and len(own[0]) >= 5


def test_line_dedup_cases(spark):
    line = " ".join(f"w{i}" for i in range(30))
    texts = [(1, None), (2, ""), (3, f"a\n{line}\nb"), (3, f"a\n{line}\nb"), (None, line), (4, line), (5, f"{line}\n{line}"), (6, "w1\n" * 5000)]
    got = sorted(((r.doc_id, r.text, r.n_deleted) for r in line_dedup.drop_repeated_lines(spark, docs_of(spark, texts)).collect()), key=str)
    kept = f"a\n{line}\nb"
    assert [g for g in got if g[0] != 6] == sorted([(1, None, 0), (2, "", 0), (3, kept, 0), (3, kept, 0), (None, "", 1), (4, "", 1), (5, "", 2)], key=str)
    assert next(g for g in got if g[0] == 6)[2] == 4999
    slim = line_dedup.without_repeated_lines(spark, docs_of(spark, texts, extra=True))
    assert slim.columns == docs_of(spark, texts, extra=True).columns
    assert sorted((r.doc_id for r in slim.collect()), key=str) == [1, 2, 3, 3, 6]
    assert line_dedup.drop_repeated_lines(spark, docs_of(spark, [])).isEmpty()


# --- passages -----------------------------------------------------------------------------------

def brute_passages(texts, least):
    """The words left of each text: one goes if it lies in a run of `least` words that occurs earlier."""
    first, out = {}, []
    for d, t in texts:
        w = (t or "").split()
        low, gone = [x.lower() for x in w], set()
        for a in range(len(w) - least + 1):
            if first.setdefault(tuple(low[a:a + least]), (d, a)) != (d, a):
                gone |= set(range(a, a + least))
        out.append((d, [x for i, x in enumerate(w) if i not in gone]))
    return [(d, w) for (d, w), (_, t) in zip(out, texts) if w or not (t or "").split()]


@pytest.mark.parametrize("least", [7, 50])
def test_passages(spark, least):
    rng = random.Random(least)
    vocab = [f"w{i}" for i in range(2000)]
    pool = [[rng.choice(vocab) for _ in range(least + n)] for n in (-1, 0, 1, 5, 2 * least)]
    texts = []
    for d in range(60):
        own = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 40, 300]))]
        for p in rng.sample(pool, rng.randrange(3)):  # glued into longer lines
            at = rng.randrange(len(own) + 1)
            own[at:at] = [x.upper() if d % 2 else x for x in p]
        texts.append((d, "".join(x + rng.choice([" ", " ", "\n", "\t "]) for x in own)))
    texts += [(100, None), (101, ""), (102, "é " * 3 * least), (103, " ".join(pool[1]))]
    rows = docs_of(spark, texts, extra=True)
    got = passages.without_repeated_passages(spark, rows, least)
    assert got.columns == rows.columns
    got = got.collect()
    assert sorted((r.doc_id, (r.text or "").split()) for r in got) == brute_passages(texts, least)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert passages.without_repeated_passages(spark, docs_of(spark, [])).isEmpty()


def test_glued_passages_are_cut_where_line_dedup_leaves_them(spark):
    p = " ".join(f"p{i}" for i in range(27)) + "\n" + " ".join(f"q{i}" for i in range(27))
    texts = [(1, f"one {p} two"), (2, f"three\nfour {p} five\nsix")]
    left = line_dedup.without_repeated_lines(spark, docs_of(spark, texts))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == texts
    got = passages.without_repeated_passages(spark, left)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [texts[0], (2, "three\nfour  five\nsix")]

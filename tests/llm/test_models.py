"""Language ID, toxicity and the URL filter: held-out accuracy and defined cases."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import language_id, toxicity, url_filter

SYLLABLES = {"aa": ["the", "ing", "th", "er"], "bb": ["que", "eau", "oi", "ment"], "cc": ["sch", "ung", "ein", "keit"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def docs(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, "\n".join(text(rng, lang, rng.randrange(1, 40)) for _ in range(3)), lang, "s", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    starts = np.array([0, 3, 4])
    potential, step, init = rng.random((8, 2)) + 0.1, rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    marginal, logs, pairs = language_id.forward_backward(potential, starts, lengths, step, init, pairs=True)
    expected = np.zeros((2, 2))
    for s, n in zip(starts, lengths):
        total, by = 0.0, np.zeros((n, 2))
        own = np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            w = init[path[0]] * math.prod(potential[s + i, y] for i, y in enumerate(path)) * math.prod(step[a, b] for a, b in zip(path, path[1:]))
            total += w
            for i, y in enumerate(path):
                by[i, y] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        assert np.allclose(marginal[s:s + n], by / total)
        assert np.isclose(logs[s:s + n].sum(), math.log(total))
        expected += own / total
    assert np.allclose(pairs, expected)


def test_language_id(spark):
    d = docs(spark)
    held = language_id.fold(F.col("doc_id"), 4) == 2
    field = language_id.train(d, ~held)
    rows = language_id.tag(d.withColumn("score", F.lit("x")), field).withColumn("held", held).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    tagger = language_id.Tagger(field)
    rng = random.Random(9)
    mixed = text(rng, "aa", 20) + " " + text(rng, "bb", 20)
    said = [lang for _, lang in tagger.words(mixed)]
    assert said[:15].count("aa") >= 13 and said[-15:].count("bb") >= 13
    odd = [None, "", "123 !", "²", "thing\n\nthing", "thing " * 3000, "x" * 50_000]
    langs, scores, certainty = tagger.documents(odd)
    assert certainty[:4] == [0.0] * 4 and all(c >= s - 1e-6 for c, s in zip(certainty, scores))
    assert langs[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and langs[4] == langs[5] == "aa"
    assert tagger.documents(odd) == language_id.Tagger(field).documents(odd)
    kept = language_id.with_language(d.limit(3).unionByName(spark.createDataFrame([(900, None, None, None, None)], d.schema)), field, 0.35)
    assert kept.columns == d.columns and kept.count() == 3


def test_stretches_of_code_switched_text(spark):
    d = docs(spark)
    field = language_id.train(d, F.lit(True))
    rng = random.Random(5)
    parts = [text(rng, lang, 25) for lang in ("aa", "bb", "cc")]
    # A letter whose small form is two characters doesn't move the places.
    texts = [" ".join(parts), "İ " + parts[0] + " -- 12\n" + parts[1], None, "", "½ ½", parts[2]]
    rows = language_id.tag_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("stretches", F.lit(1)), field).orderBy("doc_id").collect()
    plain = language_id.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).orderBy("doc_id").collect()
    for r, p in zip(rows, plain):
        assert (r.lang_pred, r.score, r.certainty) == (p.lang_pred, p.score, p.certainty)
        assert all(a.end <= b.start and a.lang != b.lang for a, b in zip(r.stretches, r.stretches[1:])) and all(0 < s.probability <= 1 for s in r.stretches)
        assert sum(s.words for s in r.stretches) == (len(re.findall(r"[^\W\d_]+", r.text)) if r.lang_pred != "und" else 0)
    assert [r.stretches for r in rows[2:5]] == [[], [], []]
    longest = sorted(sorted(rows[0].stretches, key=lambda s: -s.words)[:3], key=lambda s: s.start)
    assert [s.lang for s in longest] == ["aa", "bb", "cc"] and min(s.words for s in longest) > 15
    at = len(parts[0]) + 1
    assert abs(longest[1].start - at) < 60
    # Three languages in equal parts have a low score, yet they are known.
    assert rows[0].score < 0.5 < rows[0].certainty
    assert language_id.with_language(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), field, 0.35).count() == 1


def test_training_rows_are_bounded_over_all_languages(spark, monkeypatch):
    seen = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "TRAIN_ALL", 30)
    monkeypatch.setattr(language_id, "fit", lambda rows: seen.append(rows) or fit(rows, rounds=1))
    d = spark.createDataFrame([(i, f"word{i} here", f"l{i % 20}") for i in range(400)], "doc_id long, text string, lang string")
    field = language_id.train(d, F.lit(True))
    assert len(seen[0]) == 30 and len(field.labels) == 20


def test_signs_of_any_number_have_no_language():
    tagger = language_id.Tagger(language_id.fit([("the thing", "aa"), ("que eau", "bb")]))
    signs = ["²" + "\n" * 8, "½ " * 9, "½ " * 5000]
    assert tagger.documents(signs) == (["und"] * 3, [0.0] * 3, [0.0] * 3)
    assert tagger.documents(["½ " * 9 + "the"])[0] != ["und"]


def test_language_id_without_labels(spark):
    d = docs(spark, 5).withColumn("lang", F.lit(None).cast("string"))
    field = language_id.train(d, F.lit(True))
    assert {r.lang_pred for r in language_id.tag(d, field).collect()} == {"und"}
    assert language_id.tag(d.limit(0), field).isEmpty()


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["vilest", "vilen", "grubbing"]
    rows, labels = [], []
    for i in range(500):
        toxic = rng.random() < 0.2
        w = text(rng, rng.choice(sorted(SYLLABLES)), 60).split()
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(toxic)))
    d = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (77_777, 1), (3, None)], "doc_id long, toxic int")
    usable = toxicity.fold(F.col("doc_id"), 5) != 0
    model = toxicity.train(d.filter(usable), lab.filter(usable))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert len(got) == 502 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.5
    held = {r.doc_id for r in d.filter(~usable).collect()}
    truth = {i: any(b in t.split() for b in bad) for i, t in rows}
    wrong = [i for i in held if i < 500 and (got[i] >= 0.5) != truth[i]]
    assert len(wrong) <= 0.05 * len(held)
    nothing = toxicity.train(d, lab.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(d, nothing).collect()} == {0.0}
    assert toxicity.score(d.limit(0), model).isEmpty()


def named(text):
    """The features of a text by their names: words, beginnings (*), and beginnings of two words or more (**)."""
    own = set(re.findall(r"\w+", text.lower())) if text else set()
    times = Counter(w[:n] for n in range(3, 9) for w in own if len(w) > n)
    return own | {f"{b}*" for b in times} | {f"{b}**" for b, k in times.items() if k > 1}


def hashed(names):
    """The operator's number of each name, from a text that has this feature (and others)."""
    out = {}
    for name in names:
        base = name.rstrip("*")
        words = toxicity.words_of(pa.array([base if base == name else f"{base}a {base}b"]))
        kind = len(name) - len(base)
        if not kind:
            out[name] = int(words.hash[0] & ~np.uint64(3))
        else:
            out[name] = int(next(h for n, _, h in words.beginnings(np.array([0]), (len(base),)))[0] & ~np.uint64(3)) | kind
    return out


def odd_texts():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice(["ab", "é", "Zü", "x_1", "ßa", "日本", "q"]) for _ in range(rng.randrange(1, 6))) + rng.choice(["", ",", "!", "\n", "…"]) for _ in range(rng.randrange(40)))
             for _ in range(60)]
    return [*texts, texts[0], None, "", "...", "abab" * 20_000, "ab " * 30_000]


def test_toxicity_scores_by_brute_force():
    texts = odd_texts()
    every = sorted({f for t in texts for f in named(t)})
    rng = random.Random(3)
    weights = {f: rng.uniform(-1, 1) for f in rng.sample(every, 200)}
    number = hashed(weights)
    assert len(set(number.values())) == len(weights)
    model = toxicity.Classifier(np.array([number[f] for f in weights], dtype=np.uint64), np.array(list(weights.values())), -0.3)
    got = model.scores(pa.array(texts, type=pa.string()))
    assert np.allclose(got, [1 / (1 + math.exp(0.3 - sum(weights.get(f, 0.0) for f in named(t)))) for t in texts])
    assert np.allclose(got, [model.scores(pa.array([t], type=pa.string()))[0] for t in texts])


def test_toxicity_features_by_brute_force():
    texts = [t or "" for t in odd_texts()]
    n, doc, own = toxicity._pairs(texts)
    number = hashed({f for t in texts for f in named(t)})
    different = list(dict.fromkeys(frozenset(re.findall(r"\w+", t.lower())) for t in texts))
    assert n <= len(different)
    words = toxicity.words_of(pa.array(texts))
    pairs = sorted(zip(*(x.tolist() for x in toxicity.features(words, toxicity.distinct_words(words)))))
    assert pairs == sorted((i, number[f]) for i, t in enumerate(texts) for f in named(t))
    count = Counter(own.tolist())
    assert set(toxicity._frequent(texts, 4).tolist()) == {f for f, k in count.items() if k >= 4}


def test_only_near_copies_are_left_out():
    a, b = [f"w{i}" for i in range(100)], [f"v{i}" for i in range(100)]
    texts = [" ".join(a), " ".join(a[:95] + b[:5]), " ".join(a[:50] + b[:50]), " ".join(b), " ".join(b), "", ""]
    known = toxicity._Distinct()
    known_all = []
    for t in texts:
        own = np.sort(toxicity.words_of(pa.array([t])).hash)
        new = known.is_new(own)
        similar = any(len(set(own.tolist()) & o) >= 0.8 * len(set(own.tolist()) | o) for o in known_all)
        assert new or similar
        known_all.append(set(own.tolist()))
    assert toxicity._pairs(texts)[0] <= 5


def test_the_risk_and_its_slopes_by_brute_force():
    rng = np.random.default_rng(4)
    held = rng.random((30, 5)) < 0.4
    positive = np.arange(30) < 12
    doc, feature = np.nonzero(held)
    for prior, b in ((0.2, 0.1), (0.9, -2.0)):  # with the latter the negatives' risk is below zero
        w = rng.normal(size=5)

        def parts(w, b):
            z = [b + sum(w[f] for f in range(5) if held[i, f]) for i in range(30)]
            loss = lambda z, y: math.log(1 + math.exp(-z if y else z))
            own = prior * sum(loss(z[i], 1) for i in range(12)) / 12
            return own, sum(loss(z[i], 0) for i in range(12, 30)) / 18 - prior * sum(loss(z[i], 0) for i in range(12)) / 12

        own, rest, by_w, by_b = toxicity.risk(w, b, doc, feature, positive, prior)
        assert np.allclose((own, rest), parts(w, b))
        goal = (lambda w, b: sum(parts(w, b))) if rest >= 0 else (lambda w, b: -parts(w, b)[1])  # noqa: B023
        for f in range(5):
            step = np.eye(5)[f] * 1e-6
            assert by_w[f] == pytest.approx((goal(w + step, b) - goal(w - step, b)) / 2e-6, abs=1e-5)
        assert by_b == pytest.approx((goal(w, b + 1e-6) - goal(w, b - 1e-6)) / 2e-6, abs=1e-5)
    assert rest < 0


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    d = spark.createDataFrame([(i % 50, "vile word" if i % 3 else "fine word", 1, "x", 2) for i in range(200)] + [(900, "word " * 400_000, 1, "x", 2)],
                              "doc_id long, text string, score int, toxic string, _x int")
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 5) for i in range(50)] * 2, "doc_id long, toxic int, text int")
    rows = toxicity.score(d, toxicity.train(d, lab)).collect()
    assert len(rows) == 201 and len({r.score for r in rows}) <= 3


def test_the_risk_of_negatives_stays_non_negative():
    """A feature of all positives and of the prior's share of the mixture is what tells them apart."""
    n = 400
    positive = np.arange(n) < 100
    holds = np.concatenate([np.arange(100), 100 + np.arange(60)])  # 60 of 300 unlabelled: the toxic fifth
    w, b = toxicity.nn_pu(holds, np.zeros(len(holds), dtype=np.int64), positive, 1, 0.2)
    assert w[0] + b > 0.5 and b < -0.5


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang = rng.choice(["en", "de", "es", "fr"])
        tld = rng.choice(["com", "net", "org"])
        host = f"{rng.choice(['', 'www.', 'blog.'])}{'x' * rng.randrange(1, 9)}.example.{tld}"
        rows.append((i, f"https://{host}/{lang}/{rng.randrange(1000)}{rng.choice(['', '?a=1&b=2', '#top', '/'])}"))
    return spark.createDataFrame(rows, "page_id long, url string")


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for kind, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


def test_url_rules_are_those_of_the_contract(spark):
    want = {
        "http://com/en/1": ("com/en/", "block"), "http://example.com/en/7x": ("example.com/en/7", "allow"), "http://a.net/de/9": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://x.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    rates = url_filter.suffix_rates(pages)
    got = url_filter.judge(pages, url_filter.train(pages, rates), rates).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(want.values())


def test_url_rules_and_trees(spark, pages):
    odd = [(None, None), (1001, None), (1002, ""), (1003, "no scheme/en/"), (1004, "HTTP://EXAMPLE.Com/en/7x"), (1005, "http://com/en/1"), (1006, "http://xcom/en/1"),
           (1007, "http://a.net?x=/de/"), (1008, "x://y://z/en/"), (1009, "http://a.example.net/de/8#"), (1010, "http://h/" + "é" * 5000), (1010, "http://h/a\nb")]
    every = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    rates = url_filter.suffix_rates(every)
    model = url_filter.train(every, rates)
    got = url_filter.judge(every.withColumn("host", F.lit(1)).withColumn("_rate", F.lit(2)).withColumn("suffix", F.lit("x")), model, rates).collect()
    assert len(got) == 612 and len(model.trees) == url_filter.TREES
    want = {r.page_id: brute_rule(r.url) for r in pages.collect()} | {i: brute_rule(u) for i, u in odd[:-2]}
    for r in got:
        if r.page_id in want and r.page_id is not None:
            host, path, best = want[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
            assert r.verdict == (best[0] if best else "block" if r.score >= 0 else "allow")


def test_trees_learn_on_held_out_rows(spark, pages):
    """Labels that follow from the features: digits and depth."""
    f = url_filter._featured(pages, url_filter.RULES, url_filter.suffix_rates(pages))
    rows = [r._f.asDict() | {"block": int(r._f.parameters > 0 or r._f.length > 42)} for r in f.collect()]
    model = url_filter.fit(rows[:400])
    score = lambda r: model.base + sum(url_filter.value(t, r) for t in model.trees)
    assert np.mean([(score(r) >= 0) == r["block"] for r in rows[400:]]) > 0.95


def test_url_features(spark):
    row = spark.createDataFrame([("http://a-b.example.com/x/y/12?p=1&q=2#z",)], "u string")
    f = url_filter.features(F.col("u"), url_filter.host_of(F.col("u")), url_filter.path_of(F.col("u")))
    got = row.select(*[v.alias(k) for k, v in f.items()]).first()
    u = "http://a-b.example.com/x/y/12?p=1&q=2#z"
    entropy = -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u))
    assert (got.length, got.depth, got.parameters, got.labels, got.hyphens) == (len(u), 3, 2, 3, 1)
    assert got.entropy == pytest.approx(entropy, abs=1e-5) and got.digits == pytest.approx(4 / len(u))


def test_expressions_score_like_the_trees(spark, pages):
    """All rows by the trees in Python, over features and suffix rates counted in Python."""
    rates = url_filter.suffix_rates(pages)
    model = url_filter.train(pages, rates, rows=300)
    rows = pages.collect()
    label = {r.page_id: brute_rule(r.url)[2] for r in rows}
    suffix = {r.page_id: brute_rule(r.url)[0].rsplit(".", 1)[-1] for r in rows}
    prior = np.mean([x[0] == "block" for x in label.values() if x])
    rate = {}
    for s in set(suffix.values()):
        own = [x[0] == "block" for i, x in label.items() if x and suffix[i] == s]
        rate[s] = (sum(own) + 4 * prior) / (len(own) + 4)
    assert {r.suffix: r.rate for r in rates.collect()} == pytest.approx({**{s: rate[s] for s in rate if any(x and suffix[i] == s for i, x in label.items())}, None: prior}, abs=1e-6)
    plain = {r.page_id: r._f.asDict() for r in url_filter._featured(pages, url_filter.RULES, rates).select("page_id", "_f").collect()}
    for r in url_filter.judge(pages, model, rates).collect():
        f = plain[r.page_id]
        assert f["suffix_rate"] == pytest.approx(rate[suffix[r.page_id]], abs=1e-6)
        want = model.base + sum(url_filter.value(t, f) for t in model.trees)
        assert r.score == pytest.approx(want, abs=2e-6)
        assert r.verdict == (label[r.page_id][0] if label[r.page_id] else "block" if want >= 0 else "allow")


def test_all_suffixes_have_statistics(spark):
    rows = [(i, f"http://h{i}.s{i % 300}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/") for i in range(600)]
    rules = (("block", "com/en/"), *((("allow" if i % 3 else "block"), f"t{i}/x/") for i in range(200)))
    rows += [(1000 + i, f"http://a.t{i % 200}/x/{i}") for i in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    rates = url_filter.suffix_rates(d, rules)
    assert rates.count() == 1 + 1 + 200
    assert url_filter.judge(d, url_filter.train(d, rates, rules), rates, rules).count() == 1000


def test_no_labelled_urls_allow(spark):
    d = spark.createDataFrame([(1, "http://x/y")], "page_id long, url string")
    for own, n in ((d, 1), (d.limit(0), 0)):
        rates = url_filter.suffix_rates(own)
        assert [r.verdict for r in url_filter.judge(own, url_filter.train(own, rates), rates).collect()] == ["allow"] * n

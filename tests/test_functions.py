import pytest
from pyspark.sql import functions as F

from codeloom.functions import keys, text, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("path, language", [
    ("a.py", "python"), ("a.go", "go"), ("a.js", "javascript"), ("a.ts", "typescript"), ("a.tsx", "tsx"), ("a.rs", "rust"), ("a.java", "java"), ("a.rb", "ruby"),
    ("a.cpp", "cpp"), ("a.c", "c"), ("a.h", "c"), ("a.kt", "kotlin"), ("a.swift", "swift"), ("a.php", "php"), ("a.scala", "scala"), ("a.PY", "python"),
    ("a.xyz", ""), ("a.md", ""), ("Makefile", "")])
def test_detect_language(spark, path, language):
    assert one(spark, keys.detect_language(F.col("p")), p=path) == language


@pytest.mark.parametrize("name, language, path, expected", [
    ("TestMain", "go", "main_test.go", True), ("main", "go", "main.go", False), ("test_something", "python", "test_app.py", True),
    ("helper", "python", "app.py", False), ("test", "javascript", "app.test.js", True), ("helper", "python", "latest_x.py", True)])
def test_is_test_function(spark, name, language, path, expected):
    assert one(spark, keys.is_test_function(F.col("n"), F.col("l"), F.col("p")), n=name, l=language, p=path) is expected


@pytest.mark.parametrize("raw, most, clean", [("hello", 256, "hello"), ("a\x00b\x01c", 256, "abc"), ("tab\there", 256, "tab\there"), ("long string", 4, "long")])
def test_sanitize(spark, raw, most, clean):
    assert one(spark, keys.sanitize(F.col("s"), most), s=raw) == clean


def test_qualified_name(spark):
    name = keys.qualified_name(F.col("k"), F.col("n"), F.col("p"), F.col("c"))
    assert one(spark, name, k="Function", n="main", p="cmd/main.go", c=None) == "cmd/main.go::main"
    assert one(spark, name, k="Function", n="go", p="a.py", c="Box") == "a.py::Box.go"
    assert one(spark, name, k="File", n="a.py", p="a.py", c=None) == "a.py"


@pytest.mark.parametrize("name, slug", [("Core API!", "core-api"), ("  --", "unnamed"), ("", "unnamed"), ("a" * 90, "a" * 80)])
def test_slugify(spark, name, slug):
    assert one(spark, keys.slugify(F.col("n")), n=name) == slug


@pytest.mark.parametrize("name, entry", [("main", True), ("__main__", True), ("test_x", True), ("TestX", True), ("Testx", False), ("on_click", True), ("handle_x", True), ("domain", False)])
def test_entry_names(spark, name, entry):
    assert one(spark, keys.is_entry_name(F.col("n")), n=name) is entry


def test_decorators(spark):
    row = spark.createDataFrame([({"decorators": '["app.get(1)", "x"]'},), ({"decorators": "click.command()"},), ({"decorators": "plain"},), (None,)], "e map<string,string>")
    got = [r[0] for r in row.select(keys.has_framework_decorator(keys.decorators_of(F.col("e")))).collect()]
    assert got == [True, True, False, False]


def test_node_text(spark):
    t = keys.node_text(F.col("k"), F.col("n"), F.col("c"), F.col("p"), F.col("r"), F.col("l"))
    assert one(spark, t, k="Function", n="go", c="Box", p="(x)", r="int", l="python") == "go function in Box (x) returns int python"
    assert one(spark, t, k="File", n="a.py", c=None, p=None, r=None, l="python") == "a.py python"


def test_cosine(spark):
    c = vectors.cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[1.0, 2.0], b=[1.0, 2.0]) == pytest.approx(1)
    assert one(spark, c, a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, c, a=[0.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, c, a=[1.0], b=[0.0, 1.0]) == 0


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalizations", "gener"),
    ("triplicate", "triplic"), ("adjustable", "adjust"), ("probate", "probat"), ("controll", "control"), ("as", "as")])
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_tokens_and_phrases(spark):
    line = text.spaced(text.tokens(F.col("t")))
    assert one(spark, line, t="Créate_order getUserByID") == " create  order  getuserbyid "
    assert one(spark, text.phrase_count(line, ["a", "a"]), t="a a a b a a") == 3  # at each place where it begins, as full-text engines count
    assert one(spark, text.phrase_count(line, ["a", "b"]), t="a a a b a a b") == 2
    stemmed = text.stems(text.tokens(F.col("t")))
    assert one(spark, stemmed, t="Running orders") == ["run", "order"]

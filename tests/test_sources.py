import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from codeloom.operators import export, flows, incremental
from codeloom.operators.store import GraphStore
from codeloom.plans import tools
from codeloom.sources import files as tree
from codeloom.sources.parser import RULES, parse
from codeloom.sources.registry import Registry

PYTHON = b"""import os, sys
from a.b import c
from . import d

class Server(Base):
    @app.get('/x')
    def start(self, port: int) -> bool:
        return self.listen(port)

def main():
    def inner():
        helper()
    Server().start(1)
"""


def kinds(p):
    return {(n["kind"], n["name"]) for n in p.nodes}


def edges(p, kind):
    return [(e["source_qualified"], e["target_qualified"]) for e in p.edges if e["kind"] == kind]


def test_python():
    p = parse("app.py", PYTHON)
    assert kinds(p) == {("File", "app.py"), ("Class", "Server"), ("Function", "start"), ("Function", "main"), ("Function", "inner")}
    assert [t for _, t in edges(p, "IMPORTS_FROM")] == ["os", "sys", "a.b", "."]
    assert ("app.py::Server.start", "self.listen") in edges(p, "CALLS")
    assert edges(p, "CALLS").count(("app.py::main", "helper")) == 1 and ("app.py::inner", "helper") in edges(p, "CALLS")
    assert ("app.py::Server", "app.py::Server.start") in edges(p, "CONTAINS")
    start = next(n for n in p.nodes if n["name"] == "start")
    assert start["return_type"] == "bool" and "port: int" in start["params"] and json.loads(start["extra"]["decorators"]) == ["app.get('/x')"]
    assert (p.nodes[0]["line_start"], p.nodes[0]["line_end"]) == (1, 13)


def test_broken_python_is_a_file():
    assert kinds(parse("x.py", b"def (")) == {("File", "x.py")}


def test_go():
    p = parse("main.go", b'package main\n\nimport "fmt"\n\nimport (\n\t"os"\n\t"strings"\n)\n\ntype Server struct {\n\tport int\n}\n\n'
              b'func (s *Server) Start(p int) error {\n\tfmt.Println("go (x)") // call(y)\n\treturn nil\n}\n\nfunc main() {\n\ts := Server{}\n\ts.Start(1)\n}\n')
    assert kinds(p) == {("File", "main.go"), ("Class", "Server"), ("Function", "Start"), ("Function", "main")}
    assert [t for _, t in edges(p, "IMPORTS_FROM")] == ["fmt", "os", "strings"]
    assert edges(p, "CALLS") == [("main.go::Start", "fmt.Println"), ("main.go::main", "s.Start")]
    assert next(n for n in p.nodes if n["name"] == "Start")["line_end"] == 17


def test_javascript():
    p = parse("app.js", b"import x from './x';\nconst y = require(\"y\");\nexport class App {\n  run(a) {\n    return x.go(a);\n  }\n}\nfunction main() {\n  if (a) { new App().run(1); }\n}\nconst f = (q) => { g(q); };\n")
    assert kinds(p) == {("File", "app.js"), ("Class", "App"), ("Function", "run"), ("Function", "main"), ("Function", "f")}
    assert {t for _, t in edges(p, "IMPORTS_FROM")} == {"./x", "y"}
    assert ("app.js::App.run", "x.go") in edges(p, "CALLS") and ("app.js::f", "g") in edges(p, "CALLS")


@pytest.mark.parametrize("path, source, expected, imported", [
    ("a.rs", b"use std::io;\npub struct Box1 {}\nimpl Box1 {\n  pub fn open(&self) -> u8 { go() }\n}\n", {"Box1", "open"}, "std::io"),
    ("A.java", b"import java.util.List;\npublic class A {\n  public int run(int x) { return go(x); }\n}\n", {"A", "run"}, "java.util.List"),
    ("a.c", b"#include <stdio.h>\nint main(void) {\n  puts(\"x\");\n}\n", {"main"}, "stdio.h"),
    ("a.cpp", b"#include \"b.h\"\nclass A {\n public:\n  int go(int x) { return f(x); }\n};\n", {"A", "go"}, "b.h"),
    ("a.cs", b"using System.IO;\nclass A {\n  public void Go(int x) { F(x); }\n}\n", {"A", "Go"}, "System.IO"),
    ("a.kt", b"import a.b\nclass A {\n  fun go(x: Int): Int { return f(x) }\n}\n", {"A", "go"}, "a.b"),
    ("a.swift", b"import UIKit\nclass A {\n  func go(x: Int) { f(x) }\n}\n", {"A", "go"}, "UIKit"),
    ("a.php", b"<?php\nuse A\\B;\nclass C {\n  public function go($x) { return f($x); }\n}\n", {"C", "go"}, "A\\B"),
    ("a.scala", b"import a.b\nclass A {\n  def go(x: Int) = { f(x) }\n}\n", {"A", "go"}, "a.b"),
    ("a.rb", b"require 'json'\nclass A\n  def go(x)\n    f(x)\n  end\nend\n", {"A", "go"}, "json"),
    ("a.lua", b"local x = require('m')\nfunction go(a)\n  f(a)\nend\n", {"go"}, "m"),
    ("a.sh", b"source lib.sh\ngo() {\n  echo hi\n}\n", {"go"}, "lib.sh"),
    ("a.ts", b"import { x } from 'y';\nexport interface A {}\nexport async function go(a: number): Promise<void> { await f(a); }\n", {"A", "go"}, "y")])
def test_other_languages(path, source, expected, imported):
    p = parse(path, source)
    assert {n["name"] for n in p.nodes[1:]} == expected
    assert imported in [t for _, t in edges(p, "IMPORTS_FROM")]


@pytest.mark.parametrize("piece", ["function f(a) {\n", "  go (1\n", "class A {\n", "int f(int a)\n", "{", "}", "f((((", "def f\n", "a b c ", "x = (y) => {\n", "/* ", "'", "\n", "fn f(", "import "])
def test_hostile_files_take_linear_time(piece):
    began = time.perf_counter()
    for path in ("a.js", "b.go", "c.rb", "d.java", "e.rs", "f.cpp"):
        parse(path, (piece * (60_000 // len(piece))).encode())
    assert time.perf_counter() - began < 20


def test_lists_in_parentheses_may_hold_braces_and_lists():
    names = lambda path, code: [(n["name"], n["params"]) for n in parse(path, code).nodes if n["kind"] == "Function"]
    assert names("a.js", b"function f({a, b} = {}, c = g(1, h(2))) {\n  k();\n}\nconst q = ({x}) => { r(); };\n") == [("f", "({a, b} = {}, c = g(1, h(2)))"), ("q", "({x})")]
    assert names("b.go", b"func Run(f func(int) error, g func(a func()) int) error {\n}\n") == [("Run", "(f func(int) error, g func(a func()) int)")]


def test_unknown_language():
    with pytest.raises(ValueError):
        parse("file.xyz", b"x")
    with pytest.raises(ValueError):
        parse("a.dart", b"x")  # an extension that is known, a language without rules
    assert len(RULES) >= 15


def test_tests_are_marked():
    assert ("Test", "test_x") in kinds(parse("test_a.py", b"def test_x():\n  pass\n"))


def test_git_helpers():
    assert tree.parse_status([" M a.py", "R  old.py -> new.py", "?? b.py", "x"]) == ["a.py", "new.py", "b.py"]
    assert tree.is_safe_ref("HEAD~1") and tree.is_safe_ref("a/b-1.0^2") and not tree.is_safe_ref("--output=x") and not tree.is_safe_ref("a;b")
    assert tree.changed_since("/", "a;b") == []


def git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@example.com", *args], check=True, capture_output=True)


def content(g):
    return (sorted((r.kind, r.qualified_name, r.file_hash) for r in g.nodes.collect()), sorted((r.kind, r.source_qualified, r.target_qualified, r.line) for r in g.edges.collect()))


def test_links_are_no_files(spark, tmp_path):
    root = tmp_path / "r"
    (root / "d").mkdir(parents=True)
    (root / "d/a.py").write_text("def f():\n    pass\n")
    (root / "b.py").symlink_to("d/a.py")
    assert tree.walked_files(root) == ["d/a.py"]
    git(root, "init", "-q")
    git(root, "add", "-A")
    assert tree.tracked_files(root) == ["d/a.py"]
    assert [r.file_path for r in tree.read_files(spark, str(root), ["b.py", "d/a.py", "no.py"]).collect()] == ["d/a.py"]
    store = GraphStore(spark, str(tmp_path / "store"))
    assert incremental.full_build(spark, str(root), store).files == 1


def test_a_broken_file_keeps_what_can_be_read(spark, tmp_path):
    source = b"import os\n\n@cached\ndef one():\n    two()\n\nprint 'x'\n\nclass Box(Base):\n    def open(self):\n        one()\n\ndef torn(:\n    pass\n\nif os:\n    def inner():\n        pass\nelse:\n    three()\n"
    got = parse("a.py", source)
    assert [(n["kind"], n["name"], n["line_start"], n["line_end"]) for n in got.nodes] == [
        ("File", "a.py", 1, 20), ("Function", "one", 4, 5), ("Class", "Box", 9, 11), ("Function", "open", 10, 11), ("Function", "inner", 17, 18)]
    assert got.error.startswith("a.py:7: SyntaxError") and ("CALLS", "a.py::one", "two") in {(e["kind"], e["source_qualified"], e["target_qualified"]) for e in got.edges}
    assert parse("a.py", b"def f():\n    pass\n").error is None and len(parse("a.py", b"x = (" * 5000).nodes) == 1
    (tmp_path / "a.py").write_bytes(source)
    (tmp_path / "b.py").write_bytes(b"def f():\n    pass\n")
    built = incremental.full_build(spark, str(tmp_path), GraphStore(spark, str(tmp_path / "store")))
    assert (built.files, built.errors) == (2, 1)
    began = time.perf_counter()
    parse("a.py", b"def f(:\n" + b"x = 1\n" * 40_000)
    assert time.perf_counter() - began < 10


def test_build_update_and_tools(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg/a.py").write_text("import pkg.b\n\ndef main():\n    run()\n")
    (root / "pkg/b.py").write_text("def run():\n    pass\n")
    (root / "pkg/c.py").write_text("def gone():\n    pass\n")
    (root / "node_modules/x.js").write_text("function x() {}\n")
    (root / "empty.py").write_text("")
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    store = GraphStore(spark, str(tmp_path / "store"))
    built = incremental.full_build(spark, str(root), store)
    assert (built.files, built.errors) == (3, 0)
    assert {r.file_path for r in store.graph().nodes.collect()} == {"pkg/a.py", "pkg/b.py", "pkg/c.py"}
    assert store.metadata("last_build_type") == "full" and len(store.metadata("git_head_sha")) == 40
    ids = {r.qualified_name: r.id for r in store.graph().nodes.collect()}

    (root / "pkg/b.py").write_text("def run():\n    helper()\n\ndef helper():\n    pass\n")
    (root / "pkg/c.py").unlink()
    git(root, "add", "-A")
    git(root, "commit", "-qm", "two")
    assert sorted(tree.changed_since(root)) == ["pkg/b.py", "pkg/c.py"]
    asked = []
    read = tree.read_files
    monkeypatch.setattr(tree, "read_files", lambda s, r, paths, patterns: asked.append(paths) or read(s, r, paths, patterns))
    monkeypatch.setattr(tree, "read_sources", None)  # a scan of the tree would fail
    updated = incremental.incremental_update(spark, str(root), store)
    assert updated.files == 1  # what hasn't changed isn't parsed again
    assert asked == [["pkg/b.py", "pkg/c.py"]]
    monkeypatch.undo()
    after = content(store.graph())
    assert {r.qualified_name: r.id for r in store.graph().nodes.collect()}["pkg/a.py::main"] == ids["pkg/a.py::main"]
    incremental.full_build(spark, str(root), store)
    assert content(store.graph()) == after
    assert incremental.incremental_update(spark, str(root), store, []).files == 0

    c = tools.Context(spark, store, str(root), str(tmp_path / "wiki"))
    assert len(tools.TOOLS) == 19
    stats, said = tools.call(c, "list_graph_stats")
    assert stats.first().total_nodes == 5 and said["intent"] == "exploring"
    assert tools.call(c, "query_graph", query_type="file_symbols", target="pkg/b.py")[0].count() == 3
    assert tools.call(c, "get_impact_radius", changed_files=["pkg/b.py"])[0].nodes.count() >= 0
    assert tools.call(c, "rebuild_fts_index", path=str(tmp_path / "fts"))[0] == 5
    assert tools.call(c, "semantic_search_nodes", query="helper")[0].first().name == "helper"
    assert tools.postprocess(c) == 0  # raw calls don't resolve
    assert tools.call(c, "list_flows")[0].isEmpty()
    store.write_graph(export.resolved_graph(store.graph()))
    assert tools.postprocess(c) == 1
    pages = store.graph().nodes.withColumn("community_id", F.lit(1))
    store.write(nodes=pages)
    named = spark.createDataFrame([(1, "all", 0.5, 5, "python", None)], "id long, name string, cohesion double, size long, dominant_language string, description string")
    assert tools.call(c, "generate_wiki", communities=named)[0]["generated"] == 2
    assert "1. `main`, weighs" in tools.call(c, "get_wiki_page", page_name="all")[0]
    assert tools.call(c, "detect_changes")[0].first().changed_files == 2

    # Flows are kept up to date by updates: those of a trace of everything, and the others' rows are left alone.
    told = lambda rows: sorted((r.id, r.name, r.node_count, r.depth, r.criticality, tuple(r.path)) for r in rows.collect())
    (root / "pkg/d.py").write_text("def main():\n    helper()\n\ndef helper():\n    pass\n")
    for changed in (["pkg/d.py"], ["pkg/b.py"]):
        (root / "pkg/b.py").write_text("def run():\n    pass\n")
        incremental.incremental_update(spark, str(root), store, changed)
        assert told(store.read("flows")) == told(flows.build_flows(store.graph(), flows.trace(store.graph())))
        ids = {r.id for r in store.read("flows").collect()}
        assert {r.flow_id for r in store.read("memberships").collect()} == ids
    with pytest.raises(ValueError):
        tools.call(c, "query_graph", query_type="x", target="y")
    with pytest.raises(KeyError):
        tools.call(c, "nothing")


def test_registry(tmp_path):
    (tmp_path / "r/.git").mkdir(parents=True)
    (tmp_path / "plain").mkdir()
    reg = Registry(tmp_path / "reg.json")
    reg.register(tmp_path / "r", "one")
    reg.register(tmp_path / "r", "two")
    assert [r["alias"] for r in Registry(tmp_path / "reg.json").list()] == ["two"]
    for bad in ("plain", "absent"):
        with pytest.raises(ValueError):
            reg.register(tmp_path / bad)
    assert reg.resolve("two") == tmp_path / "r" and reg.by_alias("one") is None
    assert reg.unregister("two") and not reg.unregister("two")
    (tmp_path / "reg.json").write_text("no json")
    assert Registry(tmp_path / "reg.json").list() == []

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.text import porter
from codeloom.graph import Graph
from codeloom.operators import basic, community, export, flows, hints, refactor, search, store, stored, traverse
from codeloom.operators.ranking import rank_within
from codeloom.operators.text_index import TextIndex
from codeloom.operators.vector_index import VectorIndex
from codeloom.plans import catalog
from codeloom.scratch import Scratch

NODE = ("id long, kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, "
        "params string, return_type string, signature string, is_test boolean, file_hash string, community_id long, extra map<string,string>")
EDGE = "kind string, source_qualified string, target_qualified string, file_path string, line int"


def graph(spark, nodes, edges=()):
    rows = []
    for i, n in enumerate(nodes):
        d = dict(kind="Function", file="a.py", lines=(1, 10), community=None, extra=None, qn=None, language="python") | n
        qn = d["qn"] or (d["name"] if d["kind"] == "File" else f"{d['file']}::{d['name']}")
        rows.append((i + 1, d["kind"], d["name"], qn, d["file"], *d["lines"], d["language"], None, None, None, None, d["kind"] == "Test", None, d["community"], d["extra"]))
    own = [(k, s, t, s.split("::")[0], line) for k, s, t, line in ((*e, 1) if len(e) == 3 else e for e in edges)]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(own, EDGE))


def names(df, column="qualified_name"):
    return sorted(r[0] for r in df.select(column).collect())


@pytest.fixture(scope="module")
def chain(spark):
    """a -> b -> c -> d; x and y mention one unknown name."""
    nodes = [dict(name=n, file=f"{n}.py") for n in "abcdxy"]
    edges = [("CALLS", "a.py::a", "b.py::b"), ("CALLS", "b.py::b", "c.py::c"), ("CALLS", "c.py::c", "d.py::d"), ("CALLS", "x.py::x", "ghost"), ("CALLS", "y.py::y", "ghost")]
    return graph(spark, nodes, edges)


def test_impact_depth_and_direction(chain):
    assert names(traverse.impacted(chain, ["b.py"], 1)) == ["a.py::a", "c.py::c"]
    assert names(traverse.impacted(chain, ["b.py"], 2)) == ["a.py::a", "c.py::c", "d.py::d"]
    assert names(traverse.impacted(chain, ["nowhere.py"], 2)) == names(traverse.impacted(chain, [], 2)) == []


def test_unknown_names_are_bridges_and_not_results(chain):
    got = traverse.impacted(chain, ["x.py"], 2).select("qualified_name", "min_depth").collect()
    assert [tuple(r) for r in got] == [("y.py::y", 2)]


def test_impact_is_symmetric_and_monotone(chain):
    near = {n: set(names(traverse.impacted(chain, [f"{n}.py"], 2), "file_path")) for n in "abcd"}
    assert all((f"{a}.py" in near[b]) == (f"{b}.py" in near[a]) for a in "abcd" for b in "abcd" if a != b)
    assert set(names(traverse.impacted(chain, ["a.py"], 1))) <= set(names(traverse.impacted(chain, ["a.py"], 3)))


def test_impact_truncation_counts_first(chain):
    got = traverse.impact_radius(chain, ["b.py"], 2, 1)
    assert names(got.nodes) == ["a.py::a"] and names(got.files, "file_path") == ["a.py"]
    assert tuple(got.summary.first()) == (3, True)
    assert got.edges.count() == 1


def test_deep_traversals_write_levels(chain):
    steps = chain.edges.select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"))
    seeds = chain.nodes.filter("name = 'a'").select(F.col("qualified_name").alias("node"))
    assert dict(map(tuple, traverse.reach(seeds, steps, 10).collect())) == {"a.py::a": 0, "b.py::b": 1, "c.py::c": 2, "d.py::d": 3}


def test_file_dependents(spark):
    g = graph(spark, [dict(name=f"{n}.py", kind="File", file=f"{n}.py") for n in "abc"], [("IMPORTS_FROM", "a.py", "b.py"), ("IMPORTS_FROM", "b.py", "c.py"), ("IMPORTS_FROM", "c.py", "c.py")])
    assert dict(map(tuple, traverse.file_dependents(g, ["c.py"], 2).collect())) == {"b.py": 1, "a.py": 2}


@pytest.fixture(scope="module")
def flow(spark):
    nodes = [dict(name="main"), dict(name="one"), dict(name="auth_two", file="b.py"), dict(name="three", file="b.py"), dict(name="test_one", kind="Test", file="t.py")]
    edges = [("CALLS", "a.py::main", "a.py::one", 1), ("CALLS", "a.py::main", "b.py::auth_two", 2), ("CALLS", "a.py::main", "b.py::three", 3), ("CALLS", "b.py::three", "a.py::main", 4),
             ("CALLS", "a.py::one", "print", 5), ("CALLS", "a.py::one", "print", 6), ("TESTED_BY", "t.py::test_one", "a.py::one", 7)]
    return graph(spark, nodes, edges)


def test_entry_points(flow):
    assert names(flows.entry_points(flow)) == ["a.py::main", "t.py::test_one"]  # main is called, but an entry by name
    assert names(flows.uncalled(flow)) == ["t.py::test_one"]


def test_flow_and_criticality(flow):
    members = flows.trace(flow)
    assert sorted(map(tuple, members.collect())) == [("a.py::main", "a.py::main", 0), ("a.py::main", "a.py::one", 1), ("a.py::main", "b.py::auth_two", 1), ("a.py::main", "b.py::three", 1)]
    got = flows.flow_metrics(flow, members).first()
    assert (got.node_count, got.file_count, got.depth) == (4, 2, 1)
    assert got.criticality == pytest.approx(0.30 * 0.25 + 0.20 * 2 / 5 + 0.25 * 1 / 4 + 0.15 * 3 / 4 + 0.10 * 0.1)


def test_stored_flows(flow):
    built = flows.build_flows(flow, flows.trace(flow))
    row = built.first()
    assert row.path == [1, 2, 3, 4] and row.name == "main"
    assert [tuple(r) for r in flows.memberships(built).orderBy("position").select("node_id", "position").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert [r.name for r in flows.flow_steps(flow, built, row.id).collect()] == ["main", "one", "auth_two", "three"]
    assert flows.flow_steps(flow, built, -1).isEmpty()
    assert flows.list_flows(built, "nonsense", 5).count() == 1


def test_affected_flows(flow):
    assert names(flows.affected_flows(flow, ["b.py"]), "entry") == ["a.py::main"]
    assert flows.affected_flows(flow, ["t.py"]).isEmpty() and flows.affected_flows(flow, []).isEmpty()
    assert flows.affected_flows(flow, ["b.py"]).drop("n").collect() == flows.flow_metrics(flow, flows.trace(flow)).collect()


def calls_of(rng, files, per_file, n_calls):
    """A random call graph with loops, calls of oneself, unknown names, tests, and entries that call the same."""
    nodes = [dict(name=f"{rng.choice(['f', 'f', 'auth', 'test_'])}{i}", file=f"{f}.py", kind=rng.choice(["Function", "Function", "Test"])) for f in range(files) for i in range(per_file)]
    qn = [f"{n['file']}::{n['name']}" for n in nodes]
    edges = [("CALLS", rng.choice(qn), rng.choice([*qn, "ext"]), 1) for _ in range(n_calls)] + [("TESTED_BY", rng.choice(qn), rng.choice(qn), 1) for _ in range(5)]
    return nodes, edges + [("CALLS", q, qn[0], 2) for q in qn[-6:]]


def flows_by_hand(nodes, edges, max_depth):
    known = {f"{n['file']}::{n['name']}": n for n in nodes}
    calls = {}
    for kind, a, b, _ in edges:
        if kind == "CALLS":
            calls.setdefault(a, []).append(b)
    called, tested = {b for bs in calls.values() for b in bs}, {b for kind, _, b, _ in edges if kind == "TESTED_BY"}
    members, metrics = set(), {}
    for e, n in known.items():
        if e in called and not re.match("test_|handle_|on_", n["name"]):
            continue
        depth, level = {e: 0}, [e]
        for d in range(1, max_depth + 1):
            level = sorted({b for a in level for b in calls.get(a, []) if b in known and b not in depth})
            depth |= dict.fromkeys(level, d)
        if len(depth) < 2:
            continue
        members |= {(e, m, d) for m, d in depth.items()}
        files = {known[m]["file"] for m in depth}
        outside = sum(b not in known for m in depth for b in calls.get(m, []))
        crit = (0.3 * (min((len(files) - 1) / 4, 1) if len(files) > 1 else 0) + 0.2 * min(outside / 5, 1) + 0.25 * sum("auth" in m for m in depth) / len(depth)
                + 0.15 * (1 - len(tested & set(depth)) / len(depth)) + 0.1 * min(max(depth.values()) / 10, 1))
        metrics[e] = (len(depth), len(files), max(depth.values()), round(crit, 9))
    return members, metrics


@pytest.mark.parametrize("seed, max_depth", [(1, 15), (2, 2), (3, 4), (4, 1)])
def test_flows_of_random_graphs(spark, seed, max_depth):
    nodes, edges = calls_of(random.Random(seed), 6, 6, 45)
    g = graph(spark, nodes, edges)
    members, metrics = flows_by_hand(nodes, edges, max_depth)
    found = flows.traced(g, max_depth)
    assert set(map(tuple, found.members().collect())) == members and found.members().count() == len(members)
    for got in (found.metrics(g), flows.flow_metrics(g, found.members())):
        assert {r.entry: (r.node_count, r.file_count, r.depth, round(r.criticality, 9)) for r in got.collect()} == metrics
    assert flows.traced(g, 0).members().isEmpty()


def test_a_shared_utility_is_walked_once(spark):
    """10,000 entries that call one utility, which reaches 200 nodes: the walk has the utility's rows, not 2 million."""
    name = lambda p, c: F.concat(F.lit(f"{p}.py::{p}"), c.cast("string"))
    node = lambda p, n: spark.range(n).select(F.lit("Function").alias("kind"), F.concat(F.lit(p), F.col("id").cast("string")).alias("name"), name(p, F.col("id")).alias("qualified_name"), F.lit(f"{p}.py").alias("file_path"))
    nodes = node("e", 10_000).unionByName(node("u", 200)).withColumn("id", F.xxhash64("qualified_name")).withColumn("extra", F.lit(None).cast("map<string,string>"))
    into = spark.range(10_000).select(name("e", F.col("id")).alias("source_qualified"), F.lit("u.py::u0").alias("target_qualified"))
    on = spark.range(199).select(F.when(F.col("id") < 100, F.lit("u.py::u0")).otherwise(name("u", F.col("id") - 99)).alias("source_qualified"), name("u", F.col("id") + 1).alias("target_qualified"))
    edges = into.unionByName(on).withColumn("kind", F.lit("CALLS")).withColumn("file_path", F.split_part("source_qualified", F.lit("::"), F.lit(1)))
    g = Graph(nodes, edges)
    found = flows.traced(g)
    assert found.reached.count() == 200 and found.entries.count() == 10_000
    rows = found.metrics(g)
    assert rows.count() == 10_000 and rows.select("node_count", "file_count", "depth").distinct().collect() == [(201, 2, 3)]


@pytest.mark.parametrize("seed, max_depth", [(5, 15), (6, 2), (7, 3)])
def test_changed_flows_are_a_full_trace(spark, seed, max_depth):
    """Files that lose, gain and change nodes, calls and tests: stored flows with the changed ones put in are those of
    a trace of everything, and flows that have nothing to do with the files aren't traced."""
    rng = random.Random(seed)
    nodes, edges = calls_of(rng, 8, 5, 40)
    qn = [f"{n['file']}::{n['name']}" for n in nodes]
    files = ["1.py", "4.py", "9.py"]
    own = lambda e: e[1].split("::")[0]
    later = [n for n in nodes if n["file"] not in files or rng.random() < 0.6] + [dict(name="fresh", file="9.py"), dict(name="ext", file="4.py")]
    new = [("CALLS", f"{f}::{rng.choice(['fresh', 'f1'])}", rng.choice(qn), 3) for f in files for _ in range(2)] + [("TESTED_BY", "4.py::t", rng.choice(qn), 3)]
    lines = [e for e in edges if own(e) not in files or rng.random() < 0.5] + new
    before, after = graph(spark, nodes, edges), graph(spark, later, lines)
    by_name = lambda g: Graph(g.nodes.withColumn("id", F.xxhash64("qualified_name")), g.edges)
    before, after = by_name(before), by_name(after)
    shape = ("id", "name", "entry_point_id", "depth", "node_count", "file_count", "criticality", "path")
    told = lambda df: sorted((tuple(tuple(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*shape).collect()))
    stored = flows.build_flows(before, flows.trace(before, max_depth))
    gone, rows = flows.changed_flows(before, after, spark.createDataFrame([(f,) for f in files], "file_path string"), max_depth)
    assert told(flows.refreshed(stored, gone, rows)) == told(flows.build_flows(after, flows.trace(after, max_depth)))
    assert max_depth > 3 or gone.count() < len(nodes)


def test_scratch_tables_go_with_time(spark):
    s = Scratch(spark, "old")
    kept = Scratch(spark, "new")
    path = s.write(spark.range(3)).inputFiles()[0].removeprefix("file:").removeprefix("//")
    other = kept.write(spark.range(2))
    s.began -= 100_000
    Scratch(spark, "next")
    assert not os.path.exists(path) and other.count() == 2


def test_dead_code(spark):
    nodes = [dict(name="lonely"), dict(name="Base", kind="Class"), dict(name="tested"), dict(name="handle_x"), dict(name="routed", extra={"decorators": "app.get('/')"}), dict(name="used")]
    edges = [("INHERITS", "a.py::used", "a.py::Base"), ("TESTED_BY", "t.py::t", "a.py::tested"), ("CALLS", "a.py::lonely", "a.py::used")]
    g = graph(spark, nodes, edges)
    dead = names(refactor.dead_code(g))
    assert dead == ["a.py::Base", "a.py::lonely"]
    assert names(refactor.dead_code(g, "Class")) == ["a.py::Base"]
    assert names(refactor.dead_code(g, None, "B.PY")) == []
    called = set(names(g.edges_of("CALLS"), "target_qualified"))
    assert not called & set(dead)


def test_move_suggestion(spark):
    g = graph(spark, [dict(name="f", community=1), dict(name="g", community=2), dict(name="h", community=1), dict(name="k", community=1)],
              [("CALLS", "a.py::g", "a.py::f"), ("CALLS", "a.py::h", "a.py::k"), ("CALLS", "a.py::g", "a.py::k")])
    assert [tuple(r) for r in refactor.suggest_moves(g).collect()] == [("a.py::f", 1, 2)]


def test_rename_edits_one_a_line(spark, tmp_path):
    g = graph(spark, [dict(name="old", lines=(1, 2)), dict(name="user", lines=(3, 5)), dict(name="older", lines=(6, 7))],
              [("CALLS", "a.py::user", "a.py::old", 4), ("CALLS", "a.py::user", "a.py::old", 4), ("IMPORTS_FROM", "b.py", "a.py::old", 1)])
    edits = refactor.rename_edits(g, "old", "new")
    assert sorted((r.file_path, r.line) for r in edits.collect()) == [("a.py", 1), ("a.py", 4), ("b.py", 1)]
    (tmp_path / "a.py").write_text("def old():\n  pass\ndef user():\n  old(older())\n")
    (tmp_path / "b.py").write_text("from a import old\n")
    now = [0.0]
    todo = refactor.Refactorings(lambda: now[0])
    p = todo.preview(g, "old", "new")
    assert todo.apply(p.id, tmp_path, dry_run=True)["files"] == ["a.py", "b.py"] and "old" in (tmp_path / "b.py").read_text()
    assert todo.apply(p.id, tmp_path) == {"files": ["a.py", "b.py"], "errors": [], "dry_run": False}
    assert (tmp_path / "a.py").read_text() == "def new():\n  pass\ndef user():\n  new(older())\n"
    with pytest.raises(LookupError):
        todo.apply(p.id, tmp_path)
    p = todo.preview(g, "old", "new")
    now[0] = 601
    with pytest.raises(LookupError):
        todo.apply(p.id, tmp_path)
    with pytest.raises(LookupError):
        todo.preview(g, "absent", "x")


def test_apply_stays_inside_the_root(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "rootish.py").write_text("def old(): pass\n")
    g = graph(spark, [dict(name="old", file="../rootish.py")])
    todo = refactor.Refactorings()
    got = todo.apply(todo.preview(g, "old", "new").id, tmp_path / "root")
    assert got["files"] == [] and "outside" in got["errors"][0]


SEARCH = [dict(name="getUserByID", file="auth/user.go", lines=(10, 25)), dict(name="create_order", file="orders/service.go", lines=(5, 40)),
          dict(name="UserService", kind="Class", file="auth/service.go", lines=(1, 100)), dict(name="OrderStatus", kind="Type", file="orders/types.go", lines=(3, 8)),
          dict(name="handleRequest", file="server/handler.go", lines=(15, 45))]


def test_search(spark):
    g = graph(spark, SEARCH)
    found = {r.name for r in search.hybrid_search(g, "user").collect()}  # no index: keywords answer
    assert {"getUserByID", "UserService"} <= found
    assert {r.kind for r in search.hybrid_search(g, "order", kind="Function").collect()} == {"Function"}
    assert search.hybrid_search(g, "order", kind="Class").isEmpty() and search.hybrid_search(g, "  ").isEmpty()
    assert "auth/user.go" in {r.file_path for r in search.hybrid_search(g, "user", context_files=["auth/user.go"]).collect()}
    index = search.fts_index(g.nodes, "qualified_name")
    assert index.count() == 5
    assert search.hybrid_search(g, "handleRequest", index).first().name == "handleRequest"
    assert search.hybrid_search(g, "getuser", index).first().name == "getUserByID"  # no such token: keywords answer


def test_keyword_scores_and_wildcards(spark):
    g = graph(spark, [dict(name="auth"), dict(name="authorize"), dict(name="reauth"), dict(name="a_b"), dict(name="axb"), dict(name="back\\slash")])
    got = {r.qualified_name.split("::")[1]: r.score for r in search.keyword_search(g.nodes, "AUTH", key="qualified_name").collect()}
    assert got == {"auth": 3.0, "authorize": 2.0, "reauth": 1.0}
    assert names(basic.search_nodes(g, "a_b"), "name") == ["a_b", "axb"]
    assert names(basic.search_nodes(g, "k\\s"), "name") == ["back\\slash"]
    assert basic.search_nodes(g, "").isEmpty()


def test_boosts():
    assert search.query_boosts("UserService") == {"Class": 1.5, "Type": 1.5}
    assert search.query_boosts("get_users") == {"Function": 1.5}
    assert search.query_boosts("auth.UserService") == {"qualified": 2.0}
    assert search.query_boosts("hello") == search.query_boosts("") == search.query_boosts("HTTP") == {}


def test_rrf(spark):
    def ranked(ids):
        return spark.createDataFrame([(i, float(-k)) for k, i in enumerate(ids)], "id long, score double")

    a, b = ranked([1, 2, 3]), ranked([2, 4, 1])
    got = {r.id: r.score for r in search.rrf([a, b]).collect()}
    assert got == {r.id: r.score for r in search.rrf([b, a]).collect()} and len(got) == 4
    assert got[1] == pytest.approx(1 / 61 + 1 / 63) and got[2] == pytest.approx(1 / 62 + 1 / 61)
    assert sorted(got, key=got.get)[-2:] == [1, 2]


def test_bm25_by_hand(spark):
    import math

    rows = spark.createDataFrame([(1, "a b c"), (2, "a a d e"), (3, "x"), (4, None)], "id long, t string")
    got = {r.id: r.score for r in search.bm25(search.fts_index(rows, "id", ("t",)), "a").collect()}
    idf = max(math.log((4 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    assert got == {i: pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / 2))) for i, f, n in ((1, 1, 3), (2, 2, 4))}
    assert search.bm25(search.fts_index(rows, "id", ("t",)), "!!").isEmpty()
    stemmed = search.fts_index(spark.createDataFrame([(1, "running orders")], "id long, t string"), "id", ("t",), stem=True)
    assert search.bm25(stemmed, "run order", stem=True).count() == 1


def test_embedding_upkeep(spark):
    g = graph(spark, [dict(name="f"), dict(name="g"), dict(name="a.py", kind="File")])
    empty = spark.createDataFrame([], "qualified_name string, vector array<float>, text_hash string, provider string")
    first = search.embed_nodes(g.nodes, empty, "p", lambda texts: [[float(len(t))] for t in texts])
    assert names(first) == ["a.py::f", "a.py::g"]
    kept = spark.createDataFrame(first.collect(), first.schema)
    assert search.pending_embeddings(g.nodes, kept, "p").isEmpty() and search.pending_embeddings(g.nodes, kept, "q").count() == 2
    assert names(search.semantic_search(g, "x", kept, [1.0])) == ["a.py::f", "a.py::g"]


def test_resolution_prefers_the_source_file(spark):
    g = graph(spark, [dict(name="run", file="a/x.py"), dict(name="run", file="b/y.py"), dict(name="go", file="b/y.py"), dict(name="b/y.py", kind="File", file="b/y.py"), dict(name="one", file="b/y.py")],
              [("CALLS", "b/y.py::go", "run"), ("CALLS", "a/x.py::run", "one"), ("CALLS", "b/y.py::go", "unknown"), ("IMPORTS_FROM", "b/y.py", "b.y"), ("IMPORTS_FROM", "b/y.py", "y.py")])
    got = sorted((r.raw_target, r.target_qualified) for r in export.resolve_edges(g).collect())
    assert got == [("b.y", "b/y.py"), ("one", "b/y.py::one"), ("run", "b/y.py::run"), ("y.py", "b/y.py")]


def test_export(spark, tmp_path):
    g = graph(spark, [dict(name="a.py", kind="File"), dict(name="f</script>"), dict(name="lost", file="z.py")])
    assert names(export.export_nodes(g)) == ["a.py", "a.py::f</script>"]
    assert export.write_html(g, tmp_path / "g.html") == 2
    assert "f<\\/script>" in (tmp_path / "g.html").read_text()


def test_communities(spark, tmp_path):
    g = graph(spark, [dict(name=f"f{i:02}", community=i % 2) for i in range(104)] + [dict(name="a.py", kind="File", community=0)],
              [("CALLS", "a.py::f00", "a.py::f01"), ("CALLS", "a.py::f02", "ext"), ("CALLS", "a.py::f02", "ext"), ("CALLS", "a.py::f02", "a.py::f00")])
    cross = sorted(map(tuple, community.crossing(g).collect()))
    assert cross == [(0, "outgoing", "a.py::f01", 1), (0, "outgoing", "ext", 2), (1, "incoming", "a.py::f00", 1)]
    rows = spark.createDataFrame([(0, "Core API", 0.5, 53, "python", None), (1, "core-api", 0.25, 52, None, "Second"), (2, "Empty", 0.0, 0, None, None)],
                                 "id long, name string, cohesion double, size long, dominant_language string, description string")
    pages = {r.id: r for r in community.pages(g, rows).collect()}
    assert [pages[i].slug for i in range(3)] == ["core-api", "core-api-2", "empty"]
    assert "| f00 | Function | a.py | 1-10 |" in pages[0].page and "others)" in pages[0].page and "2 x `ext`" in pages[0].page
    assert "It is empty." in pages[2].page and "It stands alone." in pages[2].page and "Second" in pages[1].page
    made = community.write_pages(community.pages(g, rows), tmp_path)
    assert made == {"generated": 4, "updated": 0, "unchanged": 0}
    assert community.write_pages(community.pages(g, rows), tmp_path) == {"generated": 0, "updated": 0, "unchanged": 4}
    assert community.read_page(tmp_path, "Core API").startswith("# Core API") and community.read_page(tmp_path, "empt").startswith("# Empty")
    assert community.read_page(tmp_path, "nothing") is None


def test_page_lines_have_what_pages_have_no_room_for(spark):
    people = [dict(name=f"m{i:02}", community=0) for i in range(60)] + [dict(name=f"e{i:03}", community=1) for i in range(205)]
    people += [dict(name="w", community=2), dict(name="z", community=2), dict(name="a.py", kind="File", community=2)]
    calls = [("CALLS", f"a.py::e{i:03}", t) for i in range(205) for t in ("a.py::m00", "ext")] + [("CALLS", "a.py::z", "a.py::w")]
    g = graph(spark, people, calls + [("CALLS", "a.py::m01", f"ext{i:02}") for i in range(20)])
    found = flows.traced(g)
    metrics = found.metrics(g)
    lines = {}
    for r in community.page_lines(g, metrics, found).collect():
        lines.setdefault((r.community_id, r.section), []).append((-(r.weight or 0), r.key, r.line))
    lines = {k: [line for *_, line in sorted(v)] for k, v in lines.items()}
    assert {k: len(v) for k, v in lines.items()} == {
        (0, "member"): 60, (0, "outgoing"): 20, (0, "incoming"): 205, (0, "flow"): 205, (1, "member"): 205, (1, "outgoing"): 2, (1, "flow"): 205, (2, "member"): 2, (2, "flow"): 1}
    rows = spark.createDataFrame([(i, f"c{i}", 0.5, n, None, None) for i, n in ((0, 60), (1, 205), (2, 3))],
                                 "id long, name string, cohesion double, size long, dominant_language string, description string")
    pages = {r.id: r.page.split("\n") for r in community.pages(g, rows, metrics, found).collect()}
    for (c, section), own in lines.items():
        most = {"member": community.MEMBERS, "flow": community.FLOWS}.get(section, community.DEPENDENCIES)
        at = pages[c].index(own[0]) if (c, section) != (2, "flow") else None
        assert at is None or pages[c][at:at + most][:len(own)] == own[:most]
    assert lines[2, "flow"] == ["1. `z`, weighs 0.16, goes 1 calls deep"] and "Nothing that was traced comes through here." in pages[2]
    assert {r.section for r in community.page_lines(g).collect()} == {"member", "outgoing", "incoming"}


def test_label_propagation(spark):
    nodes = [dict(name=n) for n in "abcdef"]
    edges = [("CALLS", f"a.py::{x}", f"a.py::{y}") for x, y in ("ab", "bc", "ca", "de", "ef", "fd")]
    got = {r.qualified_name[-1]: r.community_id for r in community.detect(graph(spark, nodes, edges)).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]


def test_communities_are_settled(spark):
    """A long chain beside a pair that swings: labels by brute force until they are those of two rounds before."""
    names = [f"n{i}" for i in range(30)]
    pairs = [(i, i + 1) for i in range(23)] + [(24, 25), (0, 2), (21, 23)]
    g = graph(spark, [dict(name=x) for x in names], [("CALLS", f"a.py::{names[a]}", f"a.py::{names[b]}") for a, b in pairs])
    rows = g.nodes.select("qualified_name", community.first_label(F.col("qualified_name")).alias("x")).collect()
    label = {r.qualified_name.split("::")[-1]: r.x for r in rows}
    near = {x: [names[b] if a == i else names[a] for a, b in pairs if i in (a, b)] for i, x in enumerate(names)}
    before, rounds = {}, 0
    while True:
        votes = {x: [label[y] for y in near[x]] for x in names}
        new = {x: min(v, key=lambda k: (-v.count(k), k)) if v else label[x] for x, v in votes.items()}
        if new == label or new == before:
            break
        before, label, rounds = label, new, rounds + 1
    want = {x: min(label[x], new[x]) for x in names}
    got = {r.qualified_name.split("::")[-1]: r.community_id for r in catalog.detect_communities(g).collect()}
    assert got == want and got["n24"] == got["n25"] and rounds > 4


def test_stats(spark):
    g = graph(spark, [dict(name="app.py", kind="File", file="app.py"), dict(name="run", file="app.py"), dict(name="App", kind="Class", file="app.py")],
              [("CONTAINS", "app.py", "app.py::run"), ("CALLS", "app.py::run", "x")])
    got = basic.graph_stats(g).first()
    assert (got.total_nodes, got.total_edges, got.files_count, got.languages) == (3, 2, 1, ["python"])
    assert got.nodes_by_kind == {"File": 1, "Function": 1, "Class": 1}
    empty = basic.graph_stats(Graph(g.nodes.limit(0), g.edges.limit(0))).first()
    assert (empty.total_nodes, empty.total_edges, empty.languages) == (0, 0, [])


@pytest.mark.parametrize("path, ignored", [
    ("node_modules/x", True), ("a/node_modules/b", True), ("x.min.js", True), ("src/app.py", False), ("bootstrap/cache/a/b.php", True), ("yarn.lock", True),
    ("sub/package-lock.json", True), ("builder/x.py", False), ("a.db", True)])
def test_ignore(spark, path, ignored):
    assert spark.createDataFrame([(path,)], "p string").select(basic.is_ignored(F.col("p"))).first()[0] is ignored


def test_binary(spark):
    rows = spark.createDataFrame([(bytearray(b"a\x00b"),), (bytearray(b"abc"),), (bytearray(b""),), (bytearray(b"a" * 9000 + b"\x00"),)], "c binary")
    assert [r[0] for r in rows.select(basic.is_binary(F.col("c"))).collect()] == [True, False, True, False]


# --- maintenance --------------------------------------------------------------------------------

def test_upsert_keeps_ids_and_is_idempotent(spark):
    g = graph(spark, [dict(name="f", community=7), dict(name="g")])
    new = g.nodes.filter("name = 'f'").drop("id", "community_id", "signature").withColumn("line_end", F.lit(99)).withColumn("seq", F.lit(1))
    new = new.unionByName(new.withColumn("line_end", F.lit(100)).withColumn("seq", F.lit(2)))
    once = store.upsert_nodes(g.nodes, new)
    row = once.filter("name = 'f'").first()
    assert (row.id, row.line_end, row.community_id, once.count()) == (1, 100, 7, 2)
    assert sorted(map(str, store.upsert_nodes(once, new).collect())) == sorted(map(str, once.collect()))


def test_file_slices(spark):
    g = graph(spark, [dict(name="f"), dict(name="g"), dict(name="h", file="b.py")], [("CALLS", "b.py::h", "a.py::f"), ("CALLS", "a.py::f", "x")])
    files = spark.createDataFrame([("a.py",)], "file_path string")
    less = store.remove_files(g, files)
    assert names(less.nodes) == ["b.py::h"] and less.edges.count() == 1  # the edge from b.py dangles
    fresh = g.nodes.filter("name = 'f'")
    swapped = store.replace_files(g, files, fresh, g.edges.filter("file_path = 'a.py'"))
    assert names(swapped.nodes) == ["a.py::f", "b.py::h"] and swapped.edges.count() == 2


def test_store_round_trip(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.graph().nodes.isEmpty() and s.metadata("missing") == ""
    g = graph(spark, [dict(name="f")], [("CALLS", "a.py::f", "x")])
    s.write_graph(g)
    s.set_metadata(test_key="test_value")
    s.set_metadata(other="1")
    assert names(s.graph().nodes) == ["a.py::f"] and s.metadata("test_key") == "test_value"
    before = s.graph().nodes
    s.write_graph(Graph(s.graph().nodes.withColumn("name", F.lit("z")), s.graph().edges))  # reads what it replaces
    assert names(s.graph().nodes, "name") == ["z"] and names(before, "name") == ["f"]  # a plan made before still runs
    assert s.vacuum(0) > 0 and names(s.graph().nodes, "name") == ["z"] and s.vacuum(0) == 0


def test_slices_write_their_buckets_only(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.write_graph(graph(spark, [dict(name=f"f{i}", file=f"{i}.py") for i in range(200)], [("CALLS", f"{i}.py::f{i}", "x") for i in range(200)]))
    first = s.manifest()["tables"]
    new = graph(spark, [dict(name="g", file="7.py")], [("CALLS", "7.py::g", "y")])
    s.replace_slices(spark.createDataFrame([("7.py",), ("8.py",)], "file_path string"), new)
    second = s.manifest()["tables"]
    for table in ("nodes", "edges"):
        assert sum(second[table].get(b) != v for b, v in first[table].items()) <= 2
    want = sorted([f"{i}.py::f{i}" for i in range(200) if i not in (7, 8)] + ["7.py::g"])
    assert names(s.graph().nodes) == want and names(s.graph().edges, "source_qualified") == want


def test_rows_by_key_switch_with_the_slices(spark, tmp_path):
    """Flows go and come with the graph, in their own buckets; a table from before it was dealt out is dealt out then."""
    s = store.GraphStore(spark, str(tmp_path / "g"))
    row = lambda i, depth=1: (i, f"f{i}", i, depth, 2, 1, 0.5, [i, i + 1])
    shape = "id long, name string, entry_point_id long, depth int, node_count int, file_count int, criticality double, path array<long>"
    s.write(nodes=graph(spark, [dict(name="f")]).nodes, flows=spark.createDataFrame([row(i) for i in range(300)], shape))
    first = s.manifest()["tables"]["flows"]
    files = spark.createDataFrame([("a.py",)], "file_path string")
    new = graph(spark, [dict(name="g")])
    s.replace_slices(files, new, flows=(spark.createDataFrame([(3,), (999,)], "id long"), spark.createDataFrame([row(5, 9), row(400)], shape)))
    second = s.manifest()["tables"]["flows"]
    assert 0 < sum(second.get(b) != v for b, v in first.items()) <= 4 and names(s.graph().nodes) == ["a.py::g"]
    want = sorted([(i, 9 if i == 5 else 1) for i in range(300) if i != 3] + [(400, 1)])
    assert sorted((r.id, r.depth) for r in s.read("flows").collect()) == want
    m = s.manifest()
    m["dealt"] = ["edges", "nodes"]
    s._put(m)
    s.replace_slices(files, new, flows=(spark.createDataFrame([(7,)], "id long"), spark.createDataFrame([], shape)))
    assert sorted((r.id, r.depth) for r in s.read("flows").collect()) == [w for w in want if w[0] != 7] and "flows" in s.manifest()["dealt"]


def buckets_read(df):
    """(table, bucket) of the files that a plan reads."""
    return {re.search(r"/(\w+)/[0-9a-f]+/bucket=(\d+)/", f).groups() for f in df.inputFiles()}


def test_links_and_counts_follow_updates(spark, tmp_path):
    """After each update, and after a full write: what a scan of nodes and edges finds."""
    rng = random.Random(1)
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.BUCKETS = 8
    whole = {f"{i}.py": slice_of(rng, i) for i in range(30)}

    def now():
        return graph(spark, [n for ns, _ in whole.values() for n in ns], [e for _, es in whole.values() for e in es])

    def agrees():
        g = now()
        plain = lambda rows: sorted(map(str, rows.collect()))
        shape = ("kind", "source_qualified", "target_qualified", "file_path", "line")
        for name in ("3.py::f0", "ext", "5.py"):
            assert plain(stored.edges_by_target(s, name).select(*shape)) == plain(basic.edges_by_target(g, name).select(*shape))
            assert plain(stored.edges_by_source(s, name).select(*shape)) == plain(basic.edges_by_source(g, name).select(*shape))
            assert names(stored.node(s, name)) == names(basic.node(g, name))
        for files, depth in ((["3.py"], 2), (["1.py", "7.py", "absent.py"], 1), ([], 2)):
            near = lambda df: sorted((r.qualified_name, r.min_depth) for r in df.collect())
            assert near(stored.impacted(s, files, depth)) == near(traverse.impacted(g, files, depth))
            if files:
                assert sorted(stored.file_dependents(s, files, depth).collect()) == sorted(traverse.file_dependents(g, files, depth).collect())
        columns = ("total_nodes", "total_edges", "files_count", "nodes_by_kind", "edges_by_kind", "languages")
        assert stored.graph_stats(s).select(*columns).first() == basic.graph_stats(g).select(*columns).first()

    s.write_graph(now())
    agrees()
    for _ in range(2):
        files = [f"{i}.py" for i in rng.sample(range(32), 3)]
        for f in files:
            whole.pop(f, None)
            if rng.random() < 0.7:
                whole[f] = slice_of(rng, f.removesuffix(".py"))
        new = graph(spark, [n for f in files if f in whole for n in whole[f][0]] or [dict(name="x", file="absent")], [e for f in files if f in whole for e in whole[f][1]])
        new = Graph(new.nodes.filter("file_path <> 'absent'"), new.edges)
        s.replace_slices(spark.createDataFrame([(f,) for f in files], "file_path string"), new)
        assert {"links", "counts"} <= set(s.manifest()["tables"])
        agrees()
    s.write_graph(now())
    assert not {"links", "counts"} & set(s.manifest()["tables"])
    agrees()


def slice_of(rng, i):
    f = f"{i}.py"
    nodes = [dict(name=f, kind="File", file=f)] + [dict(name=f"f{j}", file=f, kind=rng.choice(["Function", "Class", "Test"]), language=rng.choice(["python", "go", ""])) for j in range(rng.randrange(0, 4))]
    any_name = lambda: rng.choice([f"{rng.randrange(32)}.py::f{rng.randrange(3)}", "ext"])
    edges = [(rng.choice(["CALLS", "INHERITS", "TESTED_BY"]), f"{f}::f{rng.randrange(3)}", any_name(), rng.randrange(5)) for _ in range(rng.randrange(0, 5))]
    return nodes, edges + [("IMPORTS_FROM", f, f"{rng.randrange(32)}.py", 1)]


def test_pruned_reads_of_a_store(spark, tmp_path):
    """A lookup reads one bucket, dependents of a file those of the file and of what depends on it."""
    n = 300
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.write_graph(graph(spark, [dict(name=f"f{i}", file=f"{i}.py") for i in range(n)], [("CALLS", f"{i}.py::f{i}", f"{i + 1}.py::f{i + 1}") for i in range(n - 1)]))
    assert len(s.manifest()["tables"]["nodes"]) > 50
    for df in (stored.node(s, "7.py::f7"), stored.nodes_by_file(s, "7.py"), stored.edges_by_target(s, "7.py::f7"), stored.edges_by_source(s, "7.py::f7")):
        assert len(buckets_read(df)) == 1 and df.count() == 1
    two = spark.createDataFrame([("7.py::f7",), ("9.py::f9",), ("x",)], "qualified_name string")
    assert len(buckets_read(stored.nodes_named(s, two))) <= 3 and stored.nodes_named(s, two).count() == 2
    read, near = set(), s.near
    s.near = lambda table, names_: (read.update(buckets_read(near(table, names_))), near(table, names_))[1]
    assert sorted(map(tuple, stored.file_dependents(s, ["7.py"], 2).collect())) == [("5.py", 2), ("6.py", 1)]
    assert {t for t, _ in read} == {"links", "nodes"} and len(read) <= 4
    read.clear()
    assert stored.impacted(s, ["7.py"], 2).count() == 4 and len(read) <= 3 + 5
    assert {t for t, _ in buckets_read(stored.graph_stats(s))} == {"counts"}


def test_older_stores_are_brought_up_to_date(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.migrate() == []
    s.write_graph(graph(spark, [dict(name="f")]))
    s.set_metadata(schema_version="3")
    assert s.migrate() == [4, 5, 6] and s.migrate() == [] and s.metadata("schema_version") == "6"
    assert {"communities", "risk"} <= set(s.manifest()["tables"]) and names(s.graph().nodes) == ["a.py::f"]


def test_descendants(spark):
    g = graph(spark, [dict(name="a.py", kind="File"), dict(name="C", kind="Class"), dict(name="m")],
              [("CONTAINS", "a.py", "a.py::C"), ("CONTAINS", "a.py::C", "a.py::m"), ("CONTAINS", "a.py::m", "a.py"), ("CALLS", "a.py::C", "x")])
    got = {(r.ancestor, r.qualified_name): r.depth for r in traverse.descendants(g, g.nodes.filter("kind = 'File'")).collect()}
    assert got == {("a.py", "a.py::C"): 1, ("a.py", "a.py::m"): 2}


def test_search_finds_other_forms_of_a_word(spark):
    g = graph(spark, [dict(name="send_request"), dict(name="handle_requests"), dict(name="requesting_user"), dict(name="other")])
    index = search.fts_index(g.nodes, "qualified_name")
    hits = {r.qualified_name for r in search.bm25(index, "Requests", key="qualified_name").collect()}
    assert hits == {"a.py::send_request", "a.py::handle_requests", "a.py::requesting_user"}
    assert search.hybrid_search(g, "requested", index).count() == 3
    assert search.bm25(search.fts_index(g.nodes, "qualified_name", stem=False), "requests", key="qualified_name", stem=False).count() == 1


def test_stemmed_scores_by_brute_force(spark):
    texts = ["connection connected connecting", "connect the dots", "nothing here", None, "connections " * 5 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.score for r in search.bm25(search.fts_index(rows, "id", ("text",)), "connective").collect()}
    stems = [[porter(w) for w in (t or "").split()] for t in texts]
    f = [s.count(porter("connective")) for s in stems]
    mean, df = sum(map(len, stems)) / 5, sum(x > 0 for x in f)
    idf = max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6)
    assert got == pytest.approx({i: idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(stems[i]) / mean)) for i, x in enumerate(f) if x})


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gammas", "Gamma", "the"]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "the the the the"]
    rows = spark.createDataFrame([(i, t, f"n{i}") for i, t in enumerate(texts)], "id long, text string, name string")
    plain = search.fts_index(rows, "id", ("text", "name"))
    index = TextIndex.build(rows, str(tmp_path / "index"), "id", ("text", "name"), buckets=8)
    assert index.count() == 62
    for query in ("alpha", "beta gamma", "gammas the alpha", "the the", "n7", "nothing", "Alpha BETA"):
        want = {r.id: round(r.score, 9) for r in search.bm25(plain, query).collect()}
        assert {r.id: round(r.score, 9) for r in index.search(query).collect()} == want
    assert index.search("").isEmpty() and index.search("the", 3).count() == 3
    plan = index.hits(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*token", plan)


def test_segments_are_an_index_of_what_counts(spark, tmp_path):
    """Texts added, replaced, removed and added again, in several segments: as an index that is built anew."""
    rng = random.Random(11)
    vocab = ["alpha", "beta", "gamma", "the", "of", "naïve"]
    make = lambda i: (i, " ".join(rng.choices(vocab, k=rng.randrange(0, 9))) if i % 11 else None, f"n{i}")
    shape = "id long, text string, name string"
    now, path = {}, str(tmp_path / "index")
    first = [make(i) for i in range(40)]
    now.update({r[0]: r for r in first})
    index = TextIndex.build(spark.createDataFrame(first, shape), path, "id", ("text", "name"), buckets=8)
    steps = [(range(30, 60), []), (range(0, 5), range(10, 20)), ([], range(0, 3)), (range(12, 14), [1, 99])]
    for number, (added, removed) in enumerate(steps, 1):
        rows = [make(i) for i in added]
        now = {k: v for k, v in now.items() if k not in removed} | {r[0]: r for r in rows}
        for _ in range(2):  # a step that is run again changes nothing
            index = index.add(spark.createDataFrame(rows, shape), number, spark.createDataFrame([(i,) for i in removed], "id long"))
    anew = TextIndex.build(spark.createDataFrame(list(now.values()), shape), str(tmp_path / "anew"), "id", ("text", "name"), buckets=8)
    merged = index.merged(str(tmp_path / "merged"))
    assert merged.segments == [0] and index.segments == [0, 1, 2, 3, 4]
    for own in (index, merged):
        assert (own.rows, own.tokens) == (anew.rows, anew.tokens) == (len(now), anew.tokens)
        for query in ("alpha", "beta gamma", "the of", "n13", "nothing", "naive"):
            want = {r.id: round(r.score, 9) for r in anew.search(query).collect()}
            assert {r.id: round(r.score, 9) for r in own.search(query).collect()} == want
    # A segment that was interrupted before its last step isn't seen.
    half = spark.createDataFrame([(500, 3, 9)], "key long, n_tokens long, segment int")
    half.write.mode("append").partitionBy("segment").parquet(f"{path}/texts")
    assert 500 not in names(TextIndex(spark, path).texts(), "key") and TextIndex(spark, path).rows == len(now)
    # Few files whatever the number of tasks and buckets; an index of nothing can be searched.
    assert len(spark.read.parquet(f"{path}/postings").filter("segment = 0").inputFiles()) < 8 * 5 * 5
    assert TextIndex.build(spark.createDataFrame([], shape), path, "id", ("text",)).search("alpha").isEmpty()


def test_resolution_of_a_name_that_everybody_has(spark):
    """Two thousand files ask for a name that two thousand nodes have."""
    n = 2000
    nodes = spark.range(n).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".ts").otherwise(".tsx")).alias("file_path"))
    nodes = nodes.select("file_path", F.lit("run").alias("name"), F.lit("Function").alias("kind"), F.concat("file_path", F.lit("::run")).alias("qualified_name"))
    callers = spark.range(n).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".ts")).alias("file_path"))
    callers = callers.select("file_path", F.lit("call").alias("name"), F.lit("Function").alias("kind"), F.concat("file_path", F.lit("::call")).alias("qualified_name"))
    edges = callers.select(F.lit("CALLS").alias("kind"), F.col("qualified_name").alias("source_qualified"), F.lit("run").alias("target_qualified"), "file_path", F.lit(1).alias("line"))
    got = export.resolve_edges(Graph(nodes.unionByName(callers), edges)).collect()
    assert len(got) == n
    for r in got:  # 7.ts has no run of its own, but 7.tsx begins with its path
        i = int(r.file_path[2:-3])
        assert r.target_qualified == f"d/{i}.{'ts' if i % 2 == 0 else 'tsx'}::run"


def test_vector_cells_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    points = centres[rng.integers(0, 20, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(5000, [0.0] * 16), (5001, None), (5002, [1.0]), (5003, rows_0 := [float(x) for x in points[0]]), (5004, rows_0)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    index = VectorIndex.build(df, str(tmp_path / "index"), "id", "v", cells=20)
    assert sum(n for _, _, n in index.cells.values()) == len(rows)
    queries = [rows_0, [float(x) for x in centres[3]], [float(x) for x in rng.normal(size=16)], [-x for x in rows_0], [0.0] * 16, [1.0, 2.0]]
    for limit in (1, 25, 5000):
        got = index.search(queries, limit).collect()
        for i, q in enumerate(queries):
            want = [(r.id, round(r.score, 9)) for r in search.vector_topk(df, q, limit, "id", "v").collect()]
            assert [(r.id, round(r.score, 9)) for r in sorted((r for r in got if r.query == i), key=lambda r: r["rank"])] == want
    read = index.plan(queries[:2], 25)
    assert max(sum(1 for p in read if p[0] == i) for i in (0, 1)) <= 4 < len(index.cells)  # one cluster, some of its cells
    plan = index._scored(read, queries[:2], 25)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN|PartitionFilters: \[[^\]]*cell#\d+ = ", plan)
    none = VectorIndex.build(df.limit(0), str(tmp_path / "none"), "id", "v")
    assert none.search([rows_0], 3).isEmpty()


def test_ranks_of_a_large_group_are_made_in_many_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("g"), (F.col("id") * 7919 % 20_011).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rank_within(rows, "g", F.col("x").desc()).withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "ranked"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    got = spark.read.parquet(str(tmp_path / "ranked"))
    want = rows.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.col("x").desc())))
    assert got.drop("task").exceptAll(want).isEmpty() and got.count() == 20_000
    assert got.filter("g = 'many'").select("task").distinct().count() > 1


# --- sessions -----------------------------------------------------------------------------------

def test_intent_and_next_steps(spark):
    calls = spark.createDataFrame([("a", i, t) for i, t in enumerate(["refactor"] * 3 + ["query_graph"] * 9 + ["get_impact_radius"])] + [("b", 0, "unknown")], "session string, seq long, tool string")
    assert {r.session: (r.intent, r.score) for r in hints.session_intent(calls).collect()} == {"a": ("debugging", 9), "b": ("exploring", 0)}
    assert {r.tool for r in hints.next_steps(calls).collect()} == {"get_affected_flows", "detect_changes"}


def test_driver_session():
    s = hints.Session()
    assert s.intent() == "exploring"
    got = s.hints("get_impact_radius", {"impacted_files": ["a", "b", "c", "d"], "risk_score": 0.9, "test_gaps": [1]})
    assert got["intent"] == "reviewing" and got["related"] == ["a", "b", "c"] and len(got["warnings"]) == 2
    assert s.hints("get_impact_radius", {"impacted_files": ["a", "e"]})["related"] == ["e"]

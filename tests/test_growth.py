"""What grows with the input stays off the driver, and off the memory of a task."""

from pyspark.sql import functions as F

from codeloom.operators import flows, traverse
from codeloom.sources.fixture_graph import fixture_graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder):
    """Order lines of which some meet two next ones; parts in a few files."""
    part = spark.range(1, 61).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.concat(F.lit("Brand#1"), F.col("id") % 3).alias("p_brand"),
                                     F.concat(F.lit("T"), F.col("id") % 5).alias("p_type"), F.lit(3).alias("p_size"))
    line = spark.range(0, 240).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.xxhash64("id") % 30 + 31).alias("l_partkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"),
                                      F.when(F.col("id") % 3 < 2, 49).otherwise(1).alias("l_quantity"), F.col("id").alias("l_suppkey"), F.lit("R").alias("l_returnflag"))
    part.write.parquet(f"{folder}/part.parquet")
    line.write.parquet(f"{folder}/lineitem.parquet")
    return fixture_graph(spark, str(folder))


def test_order_lines_are_not_sorted_to_meet(spark, tmp_path):
    g = tables(spark, tmp_path)
    assert "ShuffledHashJoin [l_orderkey" in plan(g.edges_of("CALLS"))
    key = lambda k: f"src/Brand1{k % 3}/t{k % 5}.py::{'test_' if k % 10 == 0 else 'handle_' if k % 50 == 3 else 'auth_' if k % 20 == 5 else ''}a_b_{k}"
    rows = spark.read.parquet(f"{tmp_path}/lineitem.parquet").collect()
    want = {(key(a.l_partkey), key(b.l_partkey)) for a in rows for b in rows
            if a.l_quantity >= 48 and a.l_orderkey == b.l_orderkey and b.l_linenumber == a.l_linenumber + 1 and a.l_partkey != b.l_partkey}
    got = g.edges_of("CALLS").filter("target_qualified not like 'ext.%'").select("source_qualified", "target_qualified").collect()
    assert want and len(got) == len(want) and {tuple(r) for r in got} == want


def written(monkeypatch, cls, of):
    """What is written as a table of that name, by ``of`` its DataFrame."""
    seen, write = [], cls.write
    monkeypatch.setattr(cls, "write", lambda self, df, name="t": (seen.append((name, of(df))), write(self, df, name))[1])
    return seen


def test_flows_are_walked_by_numbers(spark, tmp_path, monkeypatch):
    g = tables(spark, tmp_path)
    seen = written(monkeypatch, flows.Scratch, lambda df: df.dtypes)
    found = flows.traced(g, 4)
    found.metrics(g)
    levels = [types for name, types in seen if name in ("level", "steps", "sets", "classes", "numbered", "files")]
    assert len(levels) > 6 and all(t != "string" for types in levels for _, t in types)
    assert not found.reached.isEmpty() and dict(found.members().dtypes)["node"] == "string"


def test_deep_walks_broadcast_nothing(spark, tmp_path, monkeypatch):
    """A chain with a branch: a walk of many levels sends none of them to the driver, one of a few may."""
    steps = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(2, 9), (9, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    seen = written(monkeypatch, traverse.Scratch, plan)
    assert {r.node: r.depth for r in traverse.reach(seeds, steps, 5).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 3, 4: 4, 5: 5}
    assert len(seen) == 7 and not any("Broadcast" in p for _, p in seen)
    assert {r.node for r in traverse.reach(seeds, steps, 2).collect()} == {0, 1, 2}

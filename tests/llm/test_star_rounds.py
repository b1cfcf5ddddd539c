"""Alternating stars: rounds shuffle for their minima only, and repeated edges change nothing."""

import random

import pytest

from codeloom.llm import components


def written(monkeypatch):
    """(name, shuffles of the plan) of the tables that are written from now on."""
    out, write = [], components.Scratch.write
    monkeypatch.setattr(components.Scratch, "write", lambda self, df, name="t": (
        out.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate"))), write(self, df, name))[1])
    return out


def test_a_round_shuffles_for_its_minima_only(spark, monkeypatch):
    tables = written(monkeypatch)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] * 3, "a long, b long")
    assert {tuple(r) for r in components.star_components(spark, path).collect()} == {(i, 0) for i in range(41)}
    assert {name: n for name, n in tables} == {"edges": 0, "least": 1, "own": 1}
    assert sum(name == "least" for name, _ in tables) <= 4


@pytest.mark.parametrize("few", [0, 50_000])
def test_stars_of_random_graphs(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_PAIRS", few)
    rng = random.Random(few)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)] + [(i, i + 1) for i in range(100, 130)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.star_components(spark, spark.createDataFrame(edges * 2, "a long, b long").repartition(3))
    assert {tuple(r) for r in got.collect()} == set(label.items())


def test_no_edges(spark):
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert components.star_components(spark, none).count() == components.star_components(spark, none.limit(0)).count() == 0

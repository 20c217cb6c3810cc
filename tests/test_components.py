"""Connected components: chains in any order, stars, self-loops, strings, convergence."""

import random

import pytest

from boxlens.operators.components import connected_components
from boxlens.session import pin, pin_scope, release


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def result(spark, edges, **kw):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["component"] for r in connected_components(df, **kw).collect()}


def test_shuffled_chain_star_and_worst_order(spark):
    rnd = random.Random(3)
    ids = list(range(1000))
    rnd.shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    worst = [(10_000 + i, 10_001 + i) for i in range(300)]
    star = [(50_000, 50_001 + i) for i in range(500)]
    loops = [(90_000, 90_000)]
    edges = chain + worst + star + loops
    assert result(spark, edges) == brute(edges)


def test_random_graphs_and_repeats(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    edges += edges[:50] + [(b, a) for a, b in edges[:50]]
    assert result(spark, edges) == brute(edges)


def test_unfinished_raises_and_empty(spark):
    with pytest.raises(RuntimeError):
        result(spark, [(i, i + 1) for i in range(200)], max_rounds=2)
    assert result(spark, []) == {}


def test_pins_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("boxlens.session.checkpoint_dir", lambda _: str(tmp_path))
    with pin_scope(spark):
        assert pin(spark.range(3)).count() == 3
    p = pin(spark.range(3))
    release(p)
    assert list(tmp_path.iterdir()) == []

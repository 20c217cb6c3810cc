"""Links of large groups in rounds, against all pairs, with the rows they copy."""

import random

import numpy as np
import pytest

from boxlens.llm import simjoin


def near(limit):
    def make(values):
        v = np.array(values)
        return lambda u, rest: np.abs(v[rest] - v[u]) <= limit
    return make


def components(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return root


def label(ids, links):
    at = {x: i for i, x in enumerate(sorted(ids))}
    root = components(len(at), [(at[a], at[b]) for a, b in links])
    return {x: root[i] for x, i in at.items()}


@pytest.fixture()
def copied(monkeypatch):
    """Counts of the rows of trees and of the copies made of them."""
    counts = []
    meet = simjoin.meeting_rows

    def counting(trees, group):
        out = meet(trees, group)
        counts.append((trees.count(), out.count()))
        return out
    monkeypatch.setattr(simjoin, "meeting_rows", counting)
    return counts


def clusters(spark, values):
    """verified_links over clusters {cluster: values}; ids are places in the order of ``values``."""
    rows = [(c, v) for c, vs in values.items() for v in vs]
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(rows)], "id long, cluster long, data long")
    links = simjoin.verified_links(df.select("id", "cluster"), df.select("id", "data"), near(1), simjoin.F.lit(1))
    return rows, [(r["a"], r["b"]) for r in links.collect()]


def expected(rows):
    """Rows of one cluster whose sorted values are a chain of steps of one."""
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    return [(a, b) for a, b in zip(order, order[1:]) if rows[a][0] == rows[b][0] and rows[b][1] - rows[a][1] <= 1]


def test_groups_of_every_kind(spark, monkeypatch, copied):
    """Chains across blocks, lone rows, families, and a group without links, blocks of 20 rows."""
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 20)
    rnd = random.Random(1)
    values = {1: list(range(300)), 2: [5 * k for k in range(100)], 3: [7] * 150 + [100 + 3 * k for k in range(30)],
              4: rnd.choices(range(400), k=250), 5: [1, 2, 9], 6: [rnd.randrange(10**6) for _ in range(19)], 7: [0] * 500, 8: [0] * 60 + [1] * 60 + [2] * 60 + [9] * 60}
    for v in values.values():
        rnd.shuffle(v)
    rows, links = clusters(spark, values)
    assert all(rows[a][0] == rows[b][0] for a, b in links)
    ids = range(len(rows))
    assert label(ids, links) == label(ids, expected(rows))
    assert len(copied) == 1


def test_a_large_family_is_copied_once(spark, monkeypatch, copied):
    """20,000 near copies and 50 strangers, blocks of 100 rows: the block pairs would copy each row 200 times."""
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 100)
    values = {1: [k % 2 for k in range(20_000)] + [10 + 5 * k for k in range(50)]}
    rows, links = clusters(spark, values)
    ids = range(len(rows))
    assert label(ids, links) == label(ids, expected(rows))
    (n, copies), = copied
    assert n == 20_050 and copies < 2 * n


def test_ids_as_signatures_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 10)
    rnd = random.Random(3)
    ids = rnd.sample(range(400), 220)
    keys = [(k, i) for i in ids for k in (i % 2, 7)] + [(50 + i, i) for i in ids]
    edges = simjoin.signature_edges(spark.createDataFrame(keys, "key long, id long"), None, near(1))
    got = [(r["a"], r["b"]) for r in edges.collect()]
    assert label(ids, got) == label(ids, [(a, b) for a, b in zip(sorted(ids), sorted(ids)[1:]) if b - a == 1])


def test_forest_with_trees():
    v = np.array([0, 1, 5, 6, 9, 2])
    match = lambda u, rest: np.abs(v[rest] - v[u]) <= 1
    assert label(range(6), simjoin.forest(6, match)) == label(range(6), [(0, 1), (1, 5), (2, 3)])
    edges = simjoin.forest(6, match, np.array([0, 0, 2, 4, 4, 5]))      # 0-1 and 3-4 are linked already
    assert sorted(tuple(sorted(e)) for e in edges) == [(1, 5), (2, 3)]
    assert simjoin.forest(0, match) == []


def test_stars_are_the_components():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (400, 380), (1000, 3000)):
        a, b = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        x, y = simjoin.stars(a, b)
        ids = sorted({*a.tolist(), *b.tolist()})
        assert label(ids, list(zip(x.tolist(), y.tolist()))) == label(ids, list(zip(a.tolist(), b.tolist())))
        assert len(set(x.tolist())) == len(x) and not set(x.tolist()) & set(y.tolist())
    chain = np.arange(3000)
    x, y = simjoin.stars(chain[1:], chain[:-1])
    assert x.tolist() == chain[1:].tolist() and not y.any()

"""Operator 9 against brute force: ties, copies, small cells, bad vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlens.llm import topk
from boxlens.llm.topk import MTree, top_k


def brute(rows, k=20, mod=20):
    ok = {(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for qi, q in ok:
        if qi % mod:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi)[:k]
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run(df, k=20):
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, k).collect())


def test_whole_table_in_small_cells(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    monkeypatch.setattr(topk, "CELL_ROWS", 90)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 10)
    assert run(df) == brute(rows)


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(0, 400, 2)]                # half of all rows are one vector
    rows += [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for i in range(1, 400, 2)]
    rows += [(1000, None), (1020, [None, 1.0, 2.0]), (1040, [float("nan"), 0.0, 0.0]), (1060, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (20, [0.5, -0.25, 1.0]), (2000, [1.0]), (2020, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string")
    exp = brute(rows)
    assert run(df) == exp
    monkeypatch.setattr(topk, "CELL_ROWS", 40)
    assert run(df) == exp
    assert run(df.limit(0)) == []
    few = df.filter("vec_id < 6")
    assert run(few) == brute([r for r in rows if r[0] is not None and r[0] < 6])


def test_tree_prunes_and_stays_exact(monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 16)
    monkeypatch.setattr(topk, "FANOUT", 4)
    rng = np.random.default_rng(2)
    centers = rng.integers(-60, 60, (12, 8))
    x = np.unique((centers[rng.integers(0, 12, 1500)] + rng.integers(-3, 4, (1500, 8))).astype(float), axis=0)
    m2 = float((x * x).sum(axis=1).max())
    tree = MTree(x, [np.array([i]) for i in range(len(x))], m2)
    for q in x[:60]:
        s, i = tree.search(q, 21)
        order = np.lexsort((np.arange(len(x)), -(x @ q)))[:21]
        assert i.tolist() == order.tolist() and s.tolist() == (x @ q)[order].tolist()


def test_scores_beyond_the_floats(spark, monkeypatch):
    """Squared norms far beyond 2^53, scores that differ in their last digits only."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) / 64 for x in rng.integers(-2 * 10**8, 2 * 10**8, 4)]) for i in range(300)]
    rows += [(1000 + i, [2e6, 2e6, 2e6, (1 + i % 7) / 64]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exp = brute(rows)
    assert max(abs(r[3]) for r in exp) > 2**55
    assert run(df) == exp
    monkeypatch.setattr(topk, "CELL_ROWS", 40)
    monkeypatch.setattr(topk, "PAGE", 8)
    assert run(df) == exp
    with pytest.raises(ValueError, match="long"):
        top_k(spark.createDataFrame([(0, [1e12])], "vec_id long, embedding array<double>"), F.lit(True))

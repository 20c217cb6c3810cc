import re
import math
import random

from pyspark.sql import functions as F

from boxlens.operators import vectors as V


def test_near_duplicates_exact_against_brute_force(spark):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(f"s{i:03d}", "d", v) for i, v in enumerate(base)]
    # near copies (noise) and exact scaled copies
    rows += [(f"n{i:03d}", "d", [x + rnd.gauss(0, 0.01) for x in base[i]]) for i in range(0, 60, 6)]
    rows += [(f"c{i:03d}", "d", [3 * x for x in base[i]]) for i in range(0, 60, 10)]
    emb = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    vec = {r[0]: r[2] for r in rows}
    ids = sorted(vec)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if cos(vec[a], vec[b]) >= 0.95:
                parent[find(b)] = find(a)
    want = {}
    for i in ids:
        want.setdefault(find(i), []).append(i)
    want = sorted(sorted(g) for g in want.values() if len(g) >= 2)
    got = sorted(sorted(r.members) for r in V.near_duplicate_groups(emb, "d", 0.95).collect())
    assert got == want


def test_find_similar_excludes_self(spark):
    emb = spark.createDataFrame([("a", "d", [1.0, 0.0]), ("b", "d", [1.0, 0.1]), ("c", "d", [0.0, 1.0])],
                                "sample_id string, dataset_id string, vector array<double>")
    r = V.find_similar(emb, "d", "a", 2).collect()
    assert [x.sample_id for x in r] == ["b", "c"]
    assert V.find_similar(emb, "d", "zzz", 2).count() == 0


def test_reduce_2d_shapes(spark):
    emb = spark.createDataFrame([(str(i), "d", [float(i), float(i % 3), 1.0]) for i in range(20)],
                                "sample_id string, dataset_id string, vector array<double>")
    out = V.reduce_2d(emb, "d")
    assert out.count() == 20 and out.filter(F.col("x").isNull()).count() == 0


def test_pairs_in_small_two_sided_blocks_and_zero_vectors(spark):
    rnd = random.Random(8)
    centers = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vec = {f"v{i:03d}": [x + rnd.gauss(0, 0.12) for x in centers[i % 5]] for i in range(90)}
    rows = [(k, "d", v) for k, v in vec.items()] + [("z1", "d", [0.0] * 6), ("z2", "d", [0.0] * 6)]
    emb = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    ids = sorted(vec)
    want = sorted((a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if cos(vec[a], vec[b]) >= 0.95)
    got = V.near_duplicate_pairs(emb, "d", 0.95, block_rows=7).collect()
    assert sorted((r.a, r.b) for r in got) == want and len(want) > 50


def test_long_chain_of_near_copies_is_one_group(spark):
    # neighbours on an arc are near, its ends are not; ids in shuffled order
    rnd = random.Random(9)
    order = list(range(150))
    rnd.shuffle(order)
    rows = [(f"s{order[i]:03d}", "d", [math.cos(i * 0.02), math.sin(i * 0.02)]) for i in range(150)]
    emb = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")
    groups = V.near_duplicate_groups(emb, "d", 0.99).collect()
    assert [(g.group_id, g["size"]) for g in groups] == [("s000", 150)]


def test_similar_results_with_samples(spark):
    emb = spark.createDataFrame([("a", "d", [1.0, 0.0]), ("b", "d", [1.0, 0.1]), ("c", "d", [0.0, 1.0])],
                                "sample_id string, dataset_id string, vector array<double>")
    samples = spark.createDataFrame([("b", "d", "b.jpg", "t/b.png"), ("b", "other", "x.jpg", None)],
                                    "id string, dataset_id string, file_name string, thumbnail_path string")
    r = V.similar_with_samples(emb, samples, "d", "a", 5).collect()
    assert [(x.sample_id, x.file_name, x.thumbnail_path) for x in r] == [("b", "b.jpg", "t/b.png"), ("c", None, None)]
    assert V.similar_with_samples(emb, samples.drop("thumbnail_path"), "d", "a", 1).first().thumbnail_path is None


def test_index_gives_the_rows_of_the_scan_and_prunes(spark, tmp):
    import numpy as np

    from boxlens.operators.vectors import build_index, find_similar, search_index
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 8))
    rows = [(f"s{i}", "d", [float(x) for x in centers[i % 12] + rng.normal(size=8) * 0.03]) for i in range(600)]
    rows += [("zero", "d", [0.0] * 8), ("other", "e", [1.0] * 8), ("copy", "d", [2 * x for x in rows[3][2]])]
    emb = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")
    build_index(emb, "d", f"{tmp}/index", 12)
    by = {r[0]: r[2] for r in rows}
    show = lambda df: [(r["sample_id"], round(r["score"], 9)) for r in df.collect()]
    for s, k in (("s3", 20), ("s77", 5), ("copy", 100), ("s0", 1)):
        got = search_index(spark, f"{tmp}/index", by[s], k, s)
        assert show(got) == show(find_similar(emb, "d", s, k))
    plan = search_index(spark, f"{tmp}/index", by["s3"], 20, "s3")._jdf.queryExecution().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "cell" in filters and len(re.findall(r"\b\d+\b", re.sub(r"#\d+", "", filters))) < 6       # a few of the twelve cells
    assert spark.read.parquet(f"{tmp}/index/cells").count() == 12
    assert search_index(spark, f"{tmp}/index", None).collect() == [] == search_index(spark, f"{tmp}/index", [0.0] * 8).collect()


def test_group_members_in_rows(spark):
    from boxlens.operators.vectors import near_duplicate_groups, near_duplicate_members
    rows = [(f"{i:02d}", "d", [1.0, 0.0, 0.001 * (i % 3), float(i // 10)]) for i in range(30)] + [("zz", "d", [0.0, 1.0, 0.0, 0.0])]
    emb = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")
    groups = {(r["group_id"], r["size"], m) for r in near_duplicate_groups(emb, "d").collect() for m in r["members"]}
    assert {(r["group_id"], r["size"], r["sample_id"]) for r in near_duplicate_members(emb, "d").collect()} == groups and groups


def test_blocks_of_a_cell_go_to_many_tasks(spark, monkeypatch):
    import random

    from boxlens.operators import vectors as V
    rnd = random.Random(5)
    rows = [(str(i), "d", [1.0 + rnd.random() / 3 for _ in range(6)]) for i in range(120)]
    e = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")
    want = {(r.a, r.b) for r in V.near_duplicate_pairs(e, "d", 0.99).collect()}
    monkeypatch.setattr(V, "BLOCKS_A_TASK", 1)
    pairs = V.near_duplicate_pairs(e, "d", 0.99, block_rows=16)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and {(r.a, r.b) for r in pairs.collect()} == want and want


def test_groups_of_a_dense_cluster_need_no_list_of_its_pairs(spark):
    rnd = random.Random(11)
    centers = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(f"c{i:04d}", "d", [x + rnd.gauss(0, 0.01) for x in centers[i % 3]]) for i in range(450)]
    emb = spark.createDataFrame(rows, "sample_id string, dataset_id string, vector array<double>")
    pairs = V.near_duplicate_pairs(emb, "d", 0.95)
    assert pairs.count() == 3 * 150 * 149 // 2
    # blocks of some 100 rows: the rows of one side join a tree each
    links = V.near_duplicate_pairs(emb, "d", 0.95, block_rows=100, spanning=True)
    assert links.count() < 20 * 450 and links.filter("a >= b").count() == 0
    assert links.join(pairs, ["a", "b"], "left_anti").count() == 0
    groups = {tuple(r.members) for r in V.near_duplicate_groups(emb, "d", 0.95).collect()}
    assert groups == {tuple(f"c{i:04d}" for i in range(k, 450, 3)) for k in range(3)}


def test_forest_joins_trees_over_strips():
    import numpy as np
    tree = np.arange(5)
    hits = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 0, 0, 0]], bool)
    assert [list(x) for x in V._forest(hits, tree)] == [[0, 0, 1, 1], [0, 1, 2, 3]]
    assert tree.tolist() == [0, 0, 2, 2, 4]
    # a later strip: one edge a tree, however many rows of it are hit
    qi, hi = V._forest(np.array([[1, 1, 1, 1, 0]], bool), tree)
    assert list(qi) == [0, 0] and list(hi) == [0, 2] and tree.tolist() == [0, 0, 0, 0, 4]


def test_chunks_grow_with_the_vectors(spark, monkeypatch):
    """A vector is sent to a fixed number of blocks, however many vectors there are; the pairs stay the same."""
    rnd = random.Random(2)
    emb = spark.createDataFrame([(f"{i:03d}", "d", [1.0 + rnd.random() / 3 for _ in range(6)]) for i in range(240)],
                                "sample_id string, dataset_id string, vector array<double>")
    want = {(r.a, r.b) for r in V.near_duplicate_pairs(emb, "d", 0.99).collect()}
    monkeypatch.setattr(V, "BLOCK_ROWS", 8)
    monkeypatch.setattr(V, "CHUNKS", 4)
    sizes = [V._block_size(emb.limit(n).withColumnRenamed("vector", "u")) for n in (10, 120, 240)]
    assert sizes == [8, 30, 60]
    monkeypatch.setattr(V, "_STRIP_PAIRS", 100)
    assert {(r.a, r.b) for r in V.near_duplicate_pairs(emb, "d", 0.99).collect()} == want and want
    monkeypatch.setattr(V, "BLOCK_BYTES", 12 * 6 * 8)
    assert V._block_size(emb.withColumnRenamed("vector", "u")) == 12

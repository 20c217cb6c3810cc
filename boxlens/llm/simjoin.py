"""Similarity links without emitting pairs: shared by the near-duplicate operators (7 and 10).

1. ``signature_edges``: rows that share a bucket key are compared by signature inside their
   bucket; a bucket yields a spanning forest of its threshold graph, never its pairs.
2. ``connected_components`` of those edges gives clusters: every pair under the signature
   threshold lies inside one cluster.
3. ``verified_links``: the full data of a cluster's rows are compared exactly, again lazily
   (a row already linked into a tree is compared only from the tree's side), and yield a
   spanning forest of the exact link graph of the cluster.

A bucket or cluster larger than a block is compared in rounds.  First its blocks are walked one by
one, which leaves trees of linked rows; then one row of each tree stands for it, and the
trees' rows are compared in blocks again, while that still joins trees.  What is left to compare
are rows of different trees: large trees fill blocks of their own, the others share some, and two
blocks meet unless they are of the same tree.  A family of copies is one tree after
two rounds, and its rows are copied once a round; a group without links still meets in all
its block pairs, so every pair is compared whatever the group's size, and no task holds
more than two blocks.  Small groups are packed many to a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.session import pin, release

BLOCK_ROWS = 2048           # rows of one block of a large group
BLOCK_WEIGHT = 4 << 20      # and its total weight (elements of the compared sets)
PACK_ROWS = 4_000           # rows of small groups packed into one task

Matcher = Callable[[int, np.ndarray], np.ndarray]


def forest(n: int, match: Matcher, tree: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the graph whose edges ``match(u, others)`` tells (a mask of others); rows
    of the same ``tree`` are linked already, and only edges between trees are returned.

    Every component is walked from its first row; a row leaves the open set once reached, so
    similar groups cost about one comparison a row."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest):
        if tree is None:
            stack, rest = [int(rest[0])], rest[1:]
        else:
            own = tree[rest] == tree[rest[0]]
            stack, rest = rest[own].tolist(), rest[~own]
        while stack and len(rest):
            u = stack.pop()
            hit = match(u, rest)
            if hit.any():
                edges += [(u, int(v)) for v in rest[hit]]
                if tree is not None:
                    hit = np.isin(tree[rest], tree[rest[hit]])
                stack += rest[hit].tolist()
                rest = rest[~hit]
    return edges


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked ids of edges (a, b), each with the smallest id it reaches over them: a star per
    component in place of its edges.  Labels spread by minima and pointer jumping."""
    ids, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[:len(a)], idx[len(a):]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        least = np.minimum(low[u], low[v])
        # the labels themselves are lowered, so whole trees move at once
        np.minimum.at(new, low[u], least)
        np.minimum.at(new, low[v], least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == low).all():
            break
        low = new
    other = np.flatnonzero(low != np.arange(len(ids)))
    return ids[other], ids[low[other]]


def _by_group(table: pa.Table, group: str):
    """(ids, rows, group's first and last row) of a task's groups, rows by id."""
    g = table[group].to_numpy()
    order = np.lexsort((table["id"].to_numpy(), g))
    table, g = table.take(pa.array(order)), g[order]
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    return table, list(zip(cut[:-1], cut[1:]))


def _edges_of(group: str, value: str, make: Callable[[list], Matcher]):
    """Forest edges (a, b) of the groups of a task; with a column root, between its trees only.  If
    ``make`` can tell the linked ``pairs`` of many groups at once (values, first rows, sizes), they become a star
    for each component of the task's links."""
    def run(table: pa.Table) -> pa.Table:
        table, parts = _by_group(table.combine_chunks(), group)
        ids, values = table["id"].to_numpy(), table[value].to_pylist()
        root = table["root"].to_numpy() if "root" in table.column_names else None
        if root is None and hasattr(make, "pairs") and parts:
            start, end = np.array(parts).T
            x, y = make.pairs(values, start, end - start)
            x, y = stars(ids[x], ids[y])
            return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})
        a, b = [], []
        for s, e in parts:
            for u, v in forest(e - s, make(values[s:e]), None if root is None else root[s:e]):
                a.append(ids[s + u])
                b.append(ids[s + v])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _roots_of(group: str, value: str, make: Callable[[list], Matcher]):
    """(group, id, root): the tree of every row of a block, named by its first row."""
    def run(table: pa.Table) -> pa.Table:
        table, parts = _by_group(table.combine_chunks(), group)
        ids, values = table["id"].to_numpy(), table[value].to_pylist()
        root = np.arange(len(ids))
        for s, e in parts:
            for u, v in forest(e - s, make(values[s:e])):      # walked from the root, so u has its root
                root[s + v] = root[s + u]
        return pa.table({group: table[group], "id": pa.array(ids), "root": pa.array(ids[root])})
    return run


def _blocks(n: Column, w: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(BLOCK_ROWS)), F.ceil(w / F.lit(BLOCK_WEIGHT)), F.lit(1).cast("long"))


def _spread(parts: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), parts).cast("int")


def meeting_rows(trees: DataFrame, group: str) -> DataFrame:
    """Rows of ``trees`` (group, id, _w, root), copied to the block pairs (_i, _j) in which they meet
    the rows of other trees of their group."""
    t = trees.groupBy(group, "root").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))
    t = t.withColumn("_large", (F.col("n") * 2 > BLOCK_ROWS) | (F.col("w") * 2 > BLOCK_WEIGHT)).withColumn("_tb", _blocks(F.col("n"), F.col("w")))
    shared = t.groupBy(group).agg(*[F.coalesce(F.sum(F.when(~F.col("_large"), F.col(c))), F.lit(0)).alias(c) for c in ("n", "w")],
                                  F.coalesce(F.sum(F.when(F.col("_large"), F.col("_tb"))), F.lit(0)).alias("_own"))
    shared = shared.select(group, F.when(F.col("n") > 0, _blocks(F.col("n"), F.col("w"))).otherwise(0).alias("_pool"), "_own")
    # large trees, at most two a block of the group, get their places one behind the other
    after = Window.partitionBy(group).orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    large = t.filter("_large").withColumn("_lo", F.coalesce(F.sum("_tb").over(after), F.lit(0))).select(group, "root", "_lo", "_tb")
    r = trees.join(shared, group).join(large, [group, "root"], "left")
    lo = F.col("_pool") + F.col("_lo")
    r = r.select(*trees.columns, (F.col("_pool") + F.col("_own")).alias("_all"), F.coalesce(lo, F.lit(0)).alias("_lo"),
                 F.coalesce(lo + F.col("_tb"), F.lit(0)).alias("_hi"),
                 F.when(F.col("_lo").isNull(), F.pmod(F.xxhash64("root", F.lit(5)), F.col("_pool"))).otherwise(lo + _spread(F.col("_tb"), 6)).cast("int").alias("_b"))
    others = F.filter(F.sequence(F.lit(0), F.col("_all").cast("int") - 1),
                      lambda o: ((o < F.col("_lo")) | (o >= F.col("_hi"))) & ((o != F.col("_b")) | (F.col("_all") == 1)))
    pair = F.explode(F.transform(others, lambda o: F.struct(F.least(F.col("_b"), o).alias("i"), F.greatest(F.col("_b"), o).alias("j"))))
    return r.withColumn("_p", pair).select(*trees.columns, F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))


def _large_groups(rows: DataFrame, group: str, payload: DataFrame | None, value: str, make: Callable[[list], Matcher]) -> DataFrame:
    """Edges (a, b) of groups of several blocks: ``rows`` (group, id, _w, blocks)."""
    rows = pin(rows)
    if payload is not None:
        payload = pin(payload.join(rows.select("id").distinct(), "id"))

    def valued(r: DataFrame) -> DataFrame:
        return r.withColumn(value, F.col("id")) if payload is None else r.join(payload, "id")

    def rooted(r: DataFrame) -> DataFrame:
        return valued(r.select(group, "id", "_b")).groupBy(group, "_b").applyInArrow(
            _roots_of(group, value, make), f"{group} long, id long, root long")
    weights = rows.select(group, "id", "_w")
    trees = pin(rooted(rows.withColumn("_b", _spread(F.col("blocks"), 7))).join(weights, [group, "id"]))
    before, salt = rows.count(), 8
    while True:
        now = trees.filter("id = root").count()
        if now > 0.8 * before:                   # hardly any trees were joined
            break
        # one row stands for a tree
        heads = trees.filter("id = root").drop("root")
        per = heads.groupBy(group).agg(F.count("*").alias("n"), F.sum("_w").alias("w")).select(group, _blocks(F.col("n"), F.col("w")).alias("blocks"))
        joined = rooted(heads.join(per, group).withColumn("_b", _spread(F.col("blocks"), salt))).select(group, F.col("id").alias("root"), F.col("root").alias("_to"))
        step = pin(trees.join(joined, [group, "root"]).select(group, "id", "_w", F.col("_to").alias("root")))
        release(trees)
        trees, before, salt = step, now, salt + 1
    meet = valued(meeting_rows(trees, group).select(group, "id", "root", "_i", "_j"))
    between = meet.groupBy(group, "_i", "_j").applyInArrow(_edges_of(group, value, make), "a long, b long")
    edges = pin(trees.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(between).distinct())
    release(rows, trees, *([] if payload is None else [payload]))
    return edges


def _links(rows: DataFrame, group: str, sizes: DataFrame, payload: DataFrame | None, value: str, make: Callable[[list], Matcher],
           per_task: int) -> DataFrame:
    """Forest edges (a, b), pinned, of all groups: ``rows`` (group, id, _w), ``sizes`` (group, n, blocks) and
    ``payload`` (id, value), without which the ids are the values."""
    total, most = sizes.agg(F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("n"))), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(1))).first()
    packs = int(total // per_task) + 1
    r = rows.join(sizes.select(group, "blocks"), group)
    small = r.filter("blocks = 1").select(group, "id", F.pmod(F.xxhash64(group), F.lit(packs)).alias("_g"))
    small = small.withColumn(value, F.col("id")) if payload is None else small.join(payload, "id")
    edges = small.groupBy("_g").applyInArrow(_edges_of(group, value, make), "a long, b long").distinct()
    if most == 1:
        return pin(edges)
    large = _large_groups(r.filter("blocks > 1"), group, payload, value, make)
    out = pin(edges.unionByName(large))
    release(large)
    return out


def hamming_matcher(parts: int, dtype: str, limit: int) -> Callable[[list], Matcher]:
    """Signatures of ``parts`` components: at most ``limit`` of them differ."""
    def make(values: list) -> Matcher:
        sig = np.frombuffer(b"".join(values), dtype).reshape(len(values), parts)
        return lambda u, rest: (sig[rest] != sig[u]).sum(axis=1) <= limit
    return make


def signature_edges(keys: DataFrame, sigs: DataFrame | None, make: Callable[[list], Matcher]) -> DataFrame:
    """Forest of the signature threshold graph over ``keys`` (key, id) and ``sigs`` (id, sig);
    without ``sigs`` the ids are the signatures.

    Buckets with the same members under several keys are compared once (recognised by count,
    smallest, largest and the xor of hashed ids).  Returns pinned (a, b)."""
    agg = (keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                                   F.bit_xor(F.xxhash64("id")).alias("x"))
               .filter("lo < hi")
               .groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")))
    buckets = pin(agg)
    # two members: the bucket's row names them; more: their key rows are fetched
    two = buckets.filter("n = 2").select("key", F.explode(F.array("lo", "hi")).alias("id"))
    more = keys.join(buckets.filter("n > 2").select("key"), "key").select("key", "id")
    sizes = buckets.select("key", "n", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).alias("blocks"))
    edges = _links(two.unionByName(more).withColumn("_w", F.lit(0).cast("long")), "key", sizes, sigs, "sig", make, PACK_ROWS)
    release(buckets)
    return edges


def verified_links(clusters: DataFrame, payload: DataFrame, make: Callable[[list], Matcher],
                   weight: Column) -> DataFrame:
    """Forest of exact links inside every cluster: ``clusters`` (id, cluster) and ``payload``
    (id, data); ``weight`` (a column of clusters) is a row's number of compared elements.
    Returns pinned (a, b)."""
    c = pin(clusters.withColumn("_w", weight.cast("long")).select("cluster", "id", "_w"))
    sizes = pin(c.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))
                 .select("cluster", "n", _blocks(F.col("n"), F.col("w")).alias("blocks")))
    avg = c.agg(F.avg("_w")).first()[0] or 1.0
    per_task = max(1, min(PACK_ROWS, int(BLOCK_WEIGHT / max(avg, 1.0))))
    links = _links(c, "cluster", sizes, payload, "data", make, per_task)
    release(c, sizes)
    return links

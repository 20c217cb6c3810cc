"""Connected components of an edge table by alternating large-star and small-star steps.

Each step rewires edges towards the smallest neighbour, so label distances shrink
geometrically: rounds grow with the logarithm of the longest chain, not with its length.
All work is group-min plus equi-join on node ids (hub nodes are combined map-side, and the
join back is one AQE can split); the edge table of each round is written to the shared
checkpoint folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.session import pin, release


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than the node moves to the node's smallest neighbour (or itself)."""
    und = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = und.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (und.filter(F.col("v") > F.col("u")).join(low, "u")
               .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, move to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _finished(e: DataFrame) -> bool:
    """The edges are stars around their smallest node: every node points to one node at most, and
    none that points is pointed at.  Counted in one job."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = (e.select(F.col("u").alias("x"), one.alias("o"), none.alias("i"))
             .unionByName(e.select(F.col("v").alias("x"), none.alias("o"), one.alias("i"))))
    per = ends.groupBy("x").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return per.agg(F.count_if((F.col("o") > 1) | ((F.col("o") > 0) & (F.col("i") > 0)))).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest reachable node.

    Self-loops keep their node in the result; null ends are ignored.  Runs until the edges are
    stars and raises if that takes more than ``max_rounds``: an unfinished labelling is never
    returned."""
    raw = pin(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
                   .filter(F.col("a").isNotNull() & F.col("b").isNotNull()))
    e = pin(raw.filter(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rounds = 0
    while not _finished(e):
        if rounds == max_rounds:
            release(raw, e)
            raise RuntimeError(f"components not finished after {max_rounds} rounds")
        step = pin(_small_star(_large_star(e)))
        release(e)
        e, rounds = step, rounds + 1
    # u > v in every edge of a finished star: v is the root
    nodes = raw.select(F.col("a").alias("node")).unionByName(raw.select(F.col("b").alias("node"))).distinct()
    out = pin(nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
                   .select("node", F.coalesce("root", "node").alias("component")))
    release(raw, e)
    return out

"""Operator 9: exact top-k search by inner product with M-trees, searched best first.

Inner products become distances by one more coordinate: with M the largest norm, the vector x
goes to (x, sqrt(M^2 - |x|^2)) and the query q to (q, 0), so the squared distance is
|q|^2 + M^2 - 2 q.x and the order by distance is the order by inner product.

The tree's top level is spread over the cluster: pivots (a bounded sample) split the vectors into
cells, each with a covering radius; a cell larger than ``CELL_ROWS`` is split by hash.  A task
builds the paged M-tree of one cell piece (metric nodes with covering radius, entries with the
distance to their parent) and searches it for a chunk of queries.  Queries first visit the cell
that is nearest to them, and with the k-th score found there only the cells whose ball may hold a
better one.  Equal vectors are one entry with their k + 1 smallest ids, which is all that ties
can ask for.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.session import pin

K = 20
SCALE = 64
CELL_ROWS = 4096
MAX_PIVOTS = 4096
QUERY_CHUNK = 4096
PAGE = 512
FANOUT = 16
FLOAT_EXACT = 2.0 ** 53     # scores below are exact in floats; larger ones are computed in integers


def _matrix(arr) -> np.ndarray:
    """Rows of a list column as float64; shorter ones are padded with zeros."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    rows = arr.to_numpy(zero_copy_only=False)
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _integers(arr, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to ``width``."""
    rows = (arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr).to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], axis=1)


class MTree:
    """M-tree over the rows of ``x`` (integers as floats) in the space of the reduction.  ``exact`` holds
    the rows as integers where floats could not hold a score; the bounds stay floats with slack."""

    def __init__(self, x: np.ndarray, ids: list, m2: float, exact: np.ndarray | None = None):
        self.x, self.ids, self.m2, self.exact = x, ids, m2, exact
        self.first = np.array([i[0] for i in ids], np.int64)
        self.aug = np.concatenate([x, np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0.0))[:, None]], axis=1)
        self.slack = 1e-5 * (np.sqrt(m2) + 1.0)
        self.root = self._node(np.arange(len(x)), 0) if len(x) else None

    def _dist(self, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 * (self.m2 - self.aug[rows] @ self.aug[center]), 0.0))

    def _node(self, rows: np.ndarray, center: int) -> dict:
        d = self._dist(rows, center)
        node = {"center": center, "radius": float(d.max())}
        if len(rows) <= PAGE:
            return node | {"rows": rows, "to_parent": d}
        # routing objects: each farthest from those before it
        seeds, near = [], np.full(len(rows), np.inf)
        at = int(d.argmax())
        for _ in range(min(FANOUT, -(-len(rows) // PAGE) + 1)):
            seeds.append(at)
            near = np.minimum(near, self._dist(rows, rows[at]))
            at = int(near.argmax())
        own = np.stack([self._dist(rows, rows[s]) for s in seeds]).argmin(axis=0)
        parts = [(int(rows[s]), rows[own == k]) for k, s in enumerate(seeds) if (own == k).any()]
        if len(parts) < 2:
            parts = [(int(p[0]), p) for p in np.array_split(rows, FANOUT) if len(p)]
        kids = [self._node(p, c) for c, p in parts]
        centers = np.array([c for c, _ in parts])
        return node | {"kids": kids, "centers": centers, "radii": np.array([k["radius"] for k in kids]), "to_parent": self._dist(centers, center)}

    def search(self, q: np.ndarray, k: int, floor: float = -np.inf, whole: np.ndarray | None = None):
        """The k best (score, id), score descending, id ascending, of those scoring ``floor`` or more; ``whole``
        is the query in integers, for a tree that holds them."""
        best_s, best_i = np.zeros(0, float if self.exact is None else np.int64), np.zeros(0, np.int64)
        if self.root is None:
            return best_s, best_i
        base = float(q @ q) + self.m2

        def bound() -> float:
            s = max(floor, best_s[-1]) if len(best_s) == k else floor
            return np.inf if s == -np.inf else np.sqrt(max(base - 2.0 * float(s), 0.0)) + self.slack
        d0 = float(np.sqrt(max(base - 2.0 * float(self.x[self.root["center"]] @ q), 0.0)))
        heap = [(max(0.0, d0 - self.root["radius"]), 0, self.root, d0)]
        n, tau = 1, bound()
        while heap:
            low, _, node, d = heapq.heappop(heap)
            if low > tau:
                break                                 # best first: nothing behind is nearer
            if "kids" in node:
                # stored parent distances rule children out before any distance to them
                open_ = np.flatnonzero(np.abs(d - node["to_parent"]) - node["radii"] <= tau)
                dist = np.sqrt(np.maximum(base - 2.0 * (self.x[node["centers"][open_]] @ q), 0.0))
                for j, dj in zip(open_, dist):
                    lj = max(0.0, float(dj) - node["radii"][j])
                    if lj <= tau:
                        heapq.heappush(heap, (lj, n, node["kids"][j], float(dj)))
                        n += 1
                continue
            rows = node["rows"]
            rows = rows[np.abs(d - node["to_parent"]) <= tau]
            s = self.x[rows] @ q if self.exact is None else self.exact[rows] @ whole
            least = max(floor, best_s[-1]) if len(best_s) == k else floor
            keep = np.flatnonzero(s >= least)
            if not len(keep):
                continue
            if len(keep) > k:                         # rows beyond the k best of a page cannot win
                keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k)[len(keep) - k]]
            ids = [self.ids[r] for r in rows[keep]]
            all_i = np.concatenate([best_i, *ids])
            all_s = np.concatenate([best_s, np.repeat(s[keep], [len(i) for i in ids])])
            order = np.lexsort((all_i, -all_s))[:k]
            best_s, best_i, tau = all_s[order], all_i[order], None
            tau = bound()
        return best_s, best_i


def _searcher(m2: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: vectors of a cell piece (v, ids); right: queries (qid, v, floor)."""
        qs, ss, vs = [], [], []
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"]), _matrix(right["v"])
            width = max(x.shape[1], q.shape[1])
            ids = [np.asarray(i, np.int64) for i in left["ids"].to_pylist()]
            order = np.argsort([i[0] for i in ids], kind="stable")
            large = m2 >= FLOAT_EXACT
            tree = MTree(_wide(x, width)[order], [ids[o] for o in order], m2, _integers(left["v"], width)[order] if large else None)
            q = _wide(q, width)
            whole = _integers(right["v"], width) if large else [None] * len(q)
            for qid, row, exact, floor in zip(right["qid"].to_pylist(), q, whole, right["floor"].to_pylist()):
                s, i = tree.search(row, k, -np.inf if floor is None else floor, exact)
                qs.append(np.full(len(s), qid))
                ss.append(s)
                vs.append(i)
        cat = lambda parts, t: pa.array(np.concatenate(parts).astype(np.int64) if parts else [], t)
        return pa.table({"qid": cat(qs, pa.int64()), "score": cat(ss, pa.int64()), "vec_id": cat(vs, pa.int64())})
    return run


def _assign(pivots: np.ndarray, m2: float):
    """(cid, v, ids) -> the same with the nearest pivot's cell and the distance to it."""
    def aug(x):
        return np.concatenate([x, np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0.0))[:, None]], axis=1)

    def run(batches):
        p = aug(pivots)
        for b in batches:
            if not b.num_rows:
                continue
            x = aug(_wide(_matrix(b.column("v")), pivots.shape[1]))
            cell, dist = [], []
            for s in range(0, len(x), 1024):
                d2 = 2.0 * (m2 - x[s:s + 1024] @ p.T)
                c = d2.argmin(axis=1)
                cell.append(c)
                dist.append(np.sqrt(np.maximum(d2[np.arange(len(c)), c], 0.0)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "v", "ids")), pa.array(np.concatenate(cell), pa.int32()),
                                              pa.array(np.concatenate(dist))], ["cid", "v", "ids", "cell", "dist"])
    return run


def _route(pivots: np.ndarray, radii: np.ndarray, pieces: np.ndarray, m2: float, first: bool):
    """(qid, v, floor, home) -> one row per cell piece to visit: first the cell whose ball is
    nearest, later all others that may hold a score of ``floor`` or more."""
    slack = 1e-5 * (np.sqrt(m2) + 1.0)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = _wide(_matrix(b.column("v")), pivots.shape[1])
            base = np.einsum("ij,ij->i", q, q) + m2
            low = np.sqrt(np.maximum(base[:, None] - 2.0 * (q @ pivots.T), 0.0)) - radii[None, :]
            if first:
                go = np.zeros(low.shape, bool)
                go[np.arange(len(q)), low.argmin(axis=1)] = True
            else:
                floor = np.array([-np.inf if f is None else f for f in b.column("floor").to_pylist()], float)
                tau = np.where(np.isinf(floor), np.inf, np.sqrt(np.maximum(base - 2.0 * np.where(np.isinf(floor), 0.0, floor), 0.0)) + slack)
                go = low <= tau[:, None]
                go[np.arange(len(q)), np.array(b.column("home").to_pylist())] = False
            qi, ci = np.nonzero(go)
            n = pieces[ci]
            at = np.repeat(np.arange(len(qi)), n)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(qi[at])
            yield pa.RecordBatch.from_arrays([b.column("qid").take(take), b.column("v").take(take), b.column("floor").take(take),
                                              pa.array(ci[at], pa.int32()), pa.array(piece, pa.int32())], ["qid", "v", "floor", "cell", "piece"])
    return run


def top_k(emb: DataFrame, query_filter, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every query's vector with
    those of all other vec_ids, components as floor(64 * x); ties to the smaller vec_id.

    ``query_filter`` is a column over vec_id.  Vectors that are null or hold null or non-finite
    components, and rows without vec_id, take no part; shorter vectors count as padded with zeros.
    Repeated (vec_id, vector) rows count once; a query never meets rows of its own vec_id.
    Fewer than ``k`` candidates give all of them; other columns are ignored.  Scores are exact; a squared norm
    that does not fit the score's type (long) raises."""
    spark = emb.sparkSession
    comp = F.col("embedding")
    ok = comp.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(comp, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = emb.filter(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"),
                                                           F.transform(comp, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    base = base.withColumn("h", F.xxhash64("v"))
    # one entry per distinct vector with its k + 1 smallest ids
    nth = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    classes = pin(base.withColumn("_n", nth).filter(F.col("_n") <= k + 1).groupBy("h", "v")
                      .agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = classes.agg(F.count("*").alias("n"), F.max(norm2).alias("m2"), F.max(F.size("v")).alias("dim")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not stats["n"]:
        return spark.createDataFrame([], empty)
    m2, dim = float(stats["m2"]), max(1, stats["dim"])
    if m2 >= 2.0 ** 63:
        raise ValueError("the scores do not fit a long")
    n_pivots = max(1, min(MAX_PIVOTS, -(-stats["n"] // CELL_ROWS)))
    pivots = _wide(_matrix(classes.orderBy(F.xxhash64("h"), "cid").limit(n_pivots).select("v").toArrow()["v"]), dim)
    cells = pin(classes.select("cid", "v", "ids").mapInArrow(_assign(pivots, m2), "cid long, v array<long>, ids array<long>, cell int, dist double"))
    radii, pieces = np.full(n_pivots, -np.inf), np.zeros(n_pivots, np.int64)
    for r in cells.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():   # one row a pivot
        radii[r["cell"]], pieces[r["cell"]] = r["r"], -(-r["n"] // CELL_ROWS)
    cells = cells.join(cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_n")), "cell")
    cells = cells.withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("_n")).cast("int"))

    asked = pin(base.filter(query_filter).select(F.col("vec_id").alias("query_id"), "h", "v").distinct()
                    .join(classes.select("h", "v", F.col("cid").alias("qid")), ["h", "v"]).select("query_id", "qid", "v"))
    queries = pin(asked.select("qid", "v").dropDuplicates(["qid"]))
    chunks = max(1, -(-queries.count() // QUERY_CHUNK))
    chunk = F.pmod(F.xxhash64("qid", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk")
    home_of = _route(pivots, radii, pieces, m2, True)
    routed = "qid long, v array<long>, floor long, cell int, piece int"
    vectors = cells.select("v", "ids", "cell", "piece", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def visit(routes: DataFrame) -> DataFrame:
        r = routes.select("qid", "v", "floor", "cell", "piece", chunk)
        return (vectors.groupBy("cell", "piece", "chunk").cogroup(r.groupBy("cell", "piece", "chunk"))
                       .applyInArrow(_searcher(m2, k + 1), "qid long, score long, vec_id long"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    q0 = queries.select("qid", "v", F.lit(None).cast("long").alias("floor"), F.lit(0).alias("home"))
    first_routes = pin(q0.mapInArrow(home_of, routed))
    near = pin(top(visit(first_routes)).select("qid", "score", "vec_id"))
    floors = near.groupBy("qid").agg(F.count("*").alias("c"), F.min("score").alias("s")).select(
        "qid", F.when(F.col("c") == k + 1, F.col("s")).alias("floor"))
    homes = first_routes.filter("piece = 0").select("qid", F.col("cell").alias("home"))
    q1 = queries.join(homes, "qid").join(floors, "qid", "left").select("qid", "v", "floor", "home")
    far = visit(q1.mapInArrow(_route(pivots, radii, pieces, m2, False), routed))
    found = pin(top(near.unionByName(far)).select("qid", "score", "vec_id"))
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = (asked.select("query_id", "qid").join(found, "qid").filter(F.col("vec_id") != F.col("query_id"))
                .withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k))
    return out.select("query_id", "rank", "vec_id", "score")

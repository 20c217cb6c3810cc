"""Embedding operators: similarity search, near-duplicate pairs and groups, 2-D reduction,
coordinates, tag normalisation (V1-V8).

Near-duplicates without all-pairs work
--------------------------------------
1. **Exact copies collapse.**  Vectors whose unit-normalised coordinates agree to 6 decimals
   (cosine > 1 - 1e-9 for any dimension in use) get one representative; members link to it
   directly.  A group of copies holding a third of all rows is one aggregate, not N^2 pairs.
2. **Pivot grid join (exact pruning).**  For unit vectors cos(u, w) >= t  <=>  |u - w| <= r,
   r = sqrt(2 - 2t).  By the triangle inequality |d(u,p) - d(w,p)| <= |u - w| for every pivot
   p, so two representatives can only be neighbours if their pivot-distance cells
   floor(d(., p_j) / r) differ by at most one for every pivot.  Each representative is
   replicated to the 3^k neighbouring cells and meets the representatives living there; the
   exact cosine is computed per (cell, chunk) block by dense matrix products of strips (numpy in
   ``applyInArrow``), and a cell with many representatives is split into bounded chunks.
   The k pivots are k representatives (a bounded k x dim literal).
3. **Components** of the threshold graph by distributed label propagation (V3), over a spanning forest of
   every block's pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.operators.components import connected_components

DEFAULT_THRESHOLD = 0.95
COPY_DECIMALS = 6
BLOCK_BYTES = 16 << 20          # vectors of one side of a block
BLOCK_ROWS = 4096               # of one side where there are few vectors
CHUNKS = 16                     # a side of all vectors is cut into no more, as far as BLOCK_BYTES allows
BLOCKS_A_TASK = 4               # blocks of the grid join in a partition
MAX_BLOCK_PARTITIONS = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def _unit_batch(v):
    import numpy as np
    import pandas as pd
    out = []
    for x in v:
        if x is None:
            out.append(None)
            continue
        a = np.asarray(x, dtype=np.float64)
        n = np.sqrt(np.dot(a, a))
        out.append(a / n if n > 0 else a)
    return pd.Series(out)


def unit(a: Column) -> Column:
    """Unit-normalised vector.  An Arrow-batched pandas UDF: as a higher-order expression the
    norm would sit inside the per-element lambda and be recomputed for every element."""
    return F.pandas_udf(_unit_batch, "array<double>")(a)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))       # null for a zero vector


def find_similar(emb: DataFrame, dataset_id: str, sample_id: str, limit: int = 20) -> DataFrame:
    """V1: top-``limit`` cosine neighbours of one sample (itself excluded); no vector => empty.

    The query vector is one row, broadcast and joined on the dataset key; ranking is a TakeOrdered top-k (no global sort).  Scores are ordered at 9 digits,
    then by sample id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in [1, 100]")
    e = emb.filter(F.col("dataset_id") == dataset_id).select("dataset_id", "sample_id", "vector")
    # at most one row per (dataset, sample): an equi-join with a one-row broadcast side
    q = e.filter(F.col("sample_id") == sample_id).select("dataset_id", F.col("vector").alias("q")).limit(1)
    scored = (e.filter(F.col("sample_id") != sample_id).join(F.broadcast(q), "dataset_id")
               .select("sample_id", cosine(F.col("vector"), F.col("q")).alias("score"))
               .filter(F.col("score").isNotNull()))
    return scored.orderBy(F.round("score", 9).desc(), "sample_id").limit(limit)


def build_index(emb: DataFrame, dataset_id: str, path: str, cells: int | None = None) -> None:
    """V1 with an index: the dataset's vectors stored by cell, a folder ``cell=n`` of ``path/vectors`` for each of
    ``cells`` pivots (some of the vectors, by default about the square root of their number, 1,024 at most).
    A vector lies in the cell of its nearest pivot; ``path/cells`` has the pivots, the largest
    distance of a member (radius) and the number of members.  Zero vectors have no direction and are left out."""
    import numpy as np

    from boxlens.session import pin, release
    e = emb.filter((F.col("dataset_id") == dataset_id) & F.exists("vector", lambda x: x != 0)).select("sample_id", "vector")
    e = pin(e.withColumn("u", unit(F.col("vector"))))
    n = cells or min(1024, max(1, math.isqrt(e.count())))
    # one pivot a distinct vector, in hash order: a bounded number of them
    pivots = [r["u"] for r in e.groupBy("u").agg(F.min("sample_id").alias("s")).orderBy(F.xxhash64("s"), "s").limit(n).collect()]
    table = np.array(pivots, float).reshape(len(pivots), -1)

    def nearest(u):
        import pandas as pd
        x = np.stack(u.to_numpy()) if len(u) else np.zeros((0, table.shape[1]))
        cos = x @ table.T
        c = cos.argmax(axis=1)
        d = np.sqrt(np.maximum(2.0 - 2.0 * cos[np.arange(len(c)), c], 0.0)) if len(c) else np.zeros(0)
        return pd.DataFrame({"cell": c.astype("int32"), "d": d})
    placed = e.withColumn("at", F.pandas_udf(nearest, "cell int, d double")("u"))
    placed.select("sample_id", "vector", "at.cell", "at.d").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = e.sparkSession.read.parquet(f"{path}/vectors")
    of = e.sparkSession.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    (stored.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).join(of, "cell")
           .write.mode("overwrite").parquet(f"{path}/cells"))
    release(e)


_SLACK = 1e-6      # of distances, for rounding


def search_index(spark, path: str, query: list[float] | None, limit: int = 20, exclude: str | None = None) -> DataFrame:
    """The ``limit`` nearest vectors (sample_id, score) of a stored index, the rows that a scan gives.

    The nearest cells that hold ``limit`` vectors give a first score; no vector of a cell is nearer than the
    distance to its pivot less its radius, so only cells that may hold a better one are read."""
    import numpy as np
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in [1, 100]")
    q = np.asarray([] if query is None else query, float)
    size = float(np.sqrt(q @ q))
    cells = spark.read.parquet(f"{path}/cells").collect() if size > 0 else []         # at most 1,024 rows
    near = sorted((max(0.0, float(np.sqrt(max(0.0, 2.0 - 2.0 * float(np.dot(c["pivot"], q)) / size))) - c["radius"]), c["cell"], c["n"]) for c in cells)

    def scored(numbers: list[int]) -> DataFrame:
        v = spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(numbers))
        if exclude is not None:
            v = v.filter(F.col("sample_id") != exclude)
        return v.select("sample_id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in q])).alias("score"))
    first, held = [], 0
    for low, cell, n in near:
        if held > limit:
            break
        first.append(cell)
        held += n
    best = scored(first).orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("s"), F.count("*").alias("n")).first() if first else None
    # beyond this distance no vector is among the best
    tau = math.sqrt(max(0.0, 2.0 - 2.0 * best["s"])) + _SLACK if best and best["n"] == limit else math.inf
    return scored([cell for low, cell, _ in near if low <= tau]).orderBy(F.round("score", 9).desc(), "sample_id").limit(limit)


def similar_with_samples(emb: DataFrame, samples: DataFrame, dataset_id: str, sample_id: str, limit: int = 20) -> DataFrame:
    """V1's neighbours with their sample's file_name and thumbnail_path, null where the sample
    (or the column) is missing; best first."""
    near = find_similar(emb, dataset_id, sample_id, limit)
    thumb = F.col("thumbnail_path") if "thumbnail_path" in samples.columns else F.lit(None).cast("string")
    s = samples.filter(F.col("dataset_id") == dataset_id).select(F.col("id").alias("sample_id"), "file_name", thumb.alias("thumbnail_path"))
    return near.join(s, "sample_id", "left").orderBy(F.round("score", 9).desc(), "sample_id")


def _prepared(emb: DataFrame, dataset_id: str) -> DataFrame:
    # a zero vector has no direction: it is a near-duplicate of nothing
    e = emb.filter((F.col("dataset_id") == dataset_id) & F.exists("vector", lambda x: x != 0)).select("sample_id", "vector")
    # copies are found by a 128-bit hash of the rounded coordinates, not by the vectors themselves
    r = F.transform("u", lambda x: F.round(x, COPY_DECIMALS) + 0.0)
    return (e.withColumn("u", unit(F.col("vector"))).withColumn("h1", F.xxhash64(r)).withColumn("h2", F.xxhash64(F.lit(1), r)))


def copy_groups(emb: DataFrame, dataset_id: str) -> DataFrame:
    """Exact-copy collapse: (sample_id, rep) with rep = smallest sample id of equal rounded coordinates.  A group
    of many copies is one row a task in the aggregate, and its key in the join is split by AQE."""
    p = _prepared(emb, dataset_id)
    reps = p.groupBy("h1", "h2").agg(F.min("sample_id").alias("rep"))
    return p.join(reps, ["h1", "h2"]).select("sample_id", "rep", "u")


def near_duplicate_pairs(emb: DataFrame, dataset_id: str, threshold: float = DEFAULT_THRESHOLD,
                         num_pivots: int = 3, block_rows: int | None = None, spanning: bool = False) -> DataFrame:
    """V2: edges of the threshold graph with copies collapsed.

    Returns (a, b, cosine) with a < b: every member -> representative link of an exact copy
    group, and every representative pair with cosine >= threshold (exact check).  Zero vectors
    take no part.  ``spanning`` gives (a, b) of fewer edges with the same components: a block yields a spanning
    forest of its pairs, so n vectors near each other give about n edges a block instead of n^2."""
    if not 0.80 <= threshold <= 0.99:
        raise ValueError("threshold must be in [0.80, 0.99]")
    from boxlens.session import pin
    cg = pin(copy_groups(emb, dataset_id))   # read by the pivots, the links and the grid
    members = cg.filter(F.col("sample_id") != F.col("rep"))
    reps = cg.filter(F.col("sample_id") == F.col("rep")).select(F.col("rep").alias("id"), "u")
    if spanning:
        links = members.select(F.least("sample_id", "rep").alias("a"), F.greatest("sample_id", "rep").alias("b"))
        return links.unionByName(_grid_pairs(reps, threshold, num_pivots, block_rows, True).select("a", "b"))
    links = (members.join(reps.select(F.col("id").alias("rep"), F.col("u").alias("ur")), "rep")
                    .select(F.least("sample_id", "rep").alias("a"), F.greatest("sample_id", "rep").alias("b"),
                            dot(F.col("u"), F.col("ur")).alias("cosine")))
    return links.unionByName(_grid_pairs(reps, threshold, num_pivots, block_rows))


_STRIP_PAIRS = 1 << 20          # pairs of a block compared at once


def _block_size(reps: DataFrame) -> int:
    """Rows of a chunk.  Every chunk is sent to each block it meets in, so chunks of a fixed size would be sent the more
    often the more vectors there are; chunks grow with the vectors, up to BLOCK_BYTES."""
    n, width = reps.agg(F.count("*"), F.coalesce(F.max(F.size("u")), F.lit(1))).first()
    return max(1, min(max(BLOCK_ROWS, -(-n // CHUNKS)), BLOCK_BYTES // (8 * max(1, width))))


def _matrix(vectors) -> np.ndarray:
    """Arrow lists of one length as the rows of a matrix."""
    vectors = vectors.combine_chunks()
    if len(vectors) and len(pc.unique(pc.list_value_length(vectors))) > 1:
        raise ValueError("vectors of unlike lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _forest(hits: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the hits (probe rows x home rows), for every probe row one home row of each tree that it reaches; ``tree``
    has the tree of every home row, and trees that a probe row joins become one."""
    qi, hi = [], []
    for i in np.flatnonzero(hits.any(axis=1)).tolist():
        h = np.flatnonzero(hits[i])
        trees, at = np.unique(tree[h], return_index=True)
        if len(trees) > 1:
            tree[np.isin(tree, trees)] = trees[0]
        qi.append(np.full(len(at), i))
        hi.append(h[at])
    return (np.concatenate(qi), np.concatenate(hi)) if qi else (np.zeros(0, int), np.zeros(0, int))


def _block_pairs(threshold: float, spanning: bool):
    """A block's rows -> its pairs with cosine >= threshold, or a spanning forest of them; held are the vectors of
    the block and the products of a strip."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        h, q = table.filter(table["is_home"]), table.filter(pc.invert(table["is_home"]))
        if not (h.num_rows and q.num_rows):
            return
        H, Q, tree = _matrix(h["u"]), _matrix(q["u"]), np.arange(h.num_rows)
        hid, qid, own = h["id"].combine_chunks(), q["id"].combine_chunks(), q["own"].combine_chunks()
        strip = max(1, _STRIP_PAIRS // len(H))
        for start in range(0, len(Q), strip):
            S = Q[start:start + strip] @ H.T
            hits = S >= threshold
            qi, hi = _forest(hits, tree) if spanning else np.nonzero(hits)
            at = pa.array(qi + start)
            a, b = qid.take(at), hid.take(pa.array(hi))
            first = pc.less(a, b)
            # inside a cell every pair meets twice, between cells once; a tree may use either meeting
            keep = pc.not_equal(a, b) if spanning else pc.or_(pc.invert(own.take(at)), first)
            out = pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(S[qi, hi])], names=["a", "b", "cosine"]).filter(keep)
            if out.num_rows:
                yield out
    return verify


def _grid_pairs(reps: DataFrame, threshold: float, num_pivots: int, block_rows: int | None, spanning: bool = False) -> DataFrame:
    """Representative pairs with cosine >= threshold (``spanning``: a spanning forest of each block's): pivot-grid
    candidate blocks, verified by dense matrix products per block (numpy inside ``applyInArrow``).

    Blocks are (home cell, home chunk, probe chunk): both sides of a cell are cut into chunks of
    about ``block_rows`` rows, so no task receives more than that of either side whatever the
    skew.  A cell probes itself and, of every pair of neighbours, only the one that comes later,
    so each block pair is computed once."""
    r = math.sqrt(2.0 - 2.0 * threshold)
    block_rows = block_rows or _block_size(reps)
    # pivots: a bounded number of representatives (k x dim values), chosen by hash order
    piv = reps.orderBy(F.xxhash64("id"), "id").limit(num_pivots).select("u").collect()
    if not piv:
        return reps.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")).limit(0)
    cells = []
    for row in piv:
        pv = F.array(*[F.lit(float(x)) for x in row["u"]])
        dist = F.sqrt(F.aggregate(F.zip_with(F.col("u"), pv, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                                  lambda acc, x: acc + x))
        cells.append(F.floor(dist / F.lit(r)).cast("int"))
    rc = reps.select("id", "u", F.array(*cells).alias("cell"))
    sizes = rc.groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("chunks"))
    offsets = [list(o) for o in itertools.product([-1, 0, 1], repeat=len(piv)) if list(o) >= [0] * len(piv)]
    off = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])
    probe = rc.select("id", "u", F.explode(F.transform(off, lambda o: F.struct(
        F.zip_with(F.col("cell"), o, lambda c, d: c + d).alias("cell"), F.forall(o, lambda d: d == 0).alias("own")))).alias("p"))
    probe = probe.select("id", "u", "p.cell", "p.own").join(sizes, "cell")   # only cells that hold representatives
    psizes = probe.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("pchunks"))
    home = (rc.join(sizes, "cell").join(psizes, "cell")
              .select("cell", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"),
                      F.explode(F.sequence(F.lit(0), F.col("pchunks") - 1)).alias("pchunk"),
                      F.lit(True).alias("is_home"), F.lit(False).alias("own"), "id", "u"))
    probe = (probe.join(psizes, "cell")
                  .select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                          F.pmod(F.xxhash64("id", F.lit(5)), F.col("pchunks")).cast("int").alias("pchunk"),
                          F.lit(False).alias("is_home"), "own", "id", "u"))
    # a task sorts and holds the blocks of its partition: the more blocks, the more partitions
    count = sizes.join(psizes, "cell").agg(F.coalesce(F.sum(F.col("chunks").cast("long") * F.col("pchunks")), F.lit(0))).first()[0]
    least = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(MAX_BLOCK_PARTITIONS, -(-count // BLOCKS_A_TASK)))
    blocks = home.unionByName(probe).repartition(parts, "cell", "chunk", "pchunk")
    return blocks.groupBy("cell", "chunk", "pchunk").applyInArrow(_block_pairs(float(threshold), spanning), "a string, b string, cosine double")


def near_duplicate_groups(emb: DataFrame, dataset_id: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """V3: connected components (size >= 2) of the threshold graph: group_id (smallest member),
    size, members (sorted), biggest first.  True components (D4)."""
    edges = near_duplicate_pairs(emb, dataset_id, threshold, spanning=True)
    comp = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    g = comp.groupBy("component").agg(F.count("*").alias("size"),
                                      F.array_sort(F.collect_list("node")).alias("members"))
    return (g.filter(F.col("size") >= 2)
             .select(F.col("component").alias("group_id"), "size", "members")
             .orderBy(F.col("size").desc(), "group_id"))


def near_duplicate_members(emb: DataFrame, dataset_id: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """V3 in rows: sample_id, group_id (smallest member), size, for every member of a group of two or more;
    no list of a group's members is built."""
    edges = near_duplicate_pairs(emb, dataset_id, threshold, spanning=True)
    comp = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    sizes = comp.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= 2)
    return comp.join(sizes, "component").select(F.col("node").alias("sample_id"), F.col("component").alias("group_id"), "size")


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """V3 totals: number of groups and of samples in them."""
    return groups.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_duplicates"))


def reduce_2d(emb: DataFrame, dataset_id: str, seed: int = 42) -> DataFrame:
    """V5 (re-aimed): 2-D coordinates by PCA(k=2) of the unit vectors (``pyspark.ml``;
    distributed, unlike the reference's single-machine UMAP: not the same projection)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = emb.filter(F.col("dataset_id") == dataset_id).select("dataset_id", "sample_id", unit(F.col("vector")).alias("u"))
    v = e.select("dataset_id", "sample_id", array_to_vector("u").alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(v)
    out = model.transform(v).select("dataset_id", "sample_id", vector_to_array("p").alias("p"))
    return out.select("dataset_id", "sample_id", F.element_at("p", 1).alias("x"), F.element_at("p", 2).alias("y"))


def coordinates(emb: DataFrame, samples: DataFrame, dataset_id: str) -> DataFrame:
    """Reduced points with the sample's file name, ordered by sample id."""
    e = emb.filter((F.col("dataset_id") == dataset_id) & F.col("x").isNotNull() & F.col("y").isNotNull())
    thumb = F.col("thumbnail_path") if "thumbnail_path" in samples.columns else F.lit(None).cast("string")
    s = samples.filter(F.col("dataset_id") == dataset_id).select(F.col("id").alias("sample_id"), "file_name", thumb.alias("thumbnail_path"))
    return e.join(s, "sample_id").select("sample_id", "x", "y", "file_name", "thumbnail_path").orderBy("sample_id")


# Controlled tag vocabulary per tagging dimension.
TAG_VOCABULARY = {
    "lighting": ["dark", "dim", "bright", "normal"],
    "clarity": ["blurry", "sharp", "noisy"],
    "setting": ["indoor", "outdoor"],
    "weather": ["sunny", "cloudy", "rainy", "foggy", "snowy", "night", "day"],
    "density": ["empty", "sparse", "moderate", "crowded"],
}
TAG_DIMENSIONS = list(TAG_VOCABULARY)


def vocabulary(spark, words: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(d, w) for d, ws in (words or TAG_VOCABULARY).items() for w in ws]
    return spark.createDataFrame(rows, "dimension string, tag string")


def normalize_tag_answers(answers: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """V7: (dataset_id, id, dimension, answer) -> (dataset_id, id, new_tags).  An answer is
    trimmed, lower-cased, stripped of trailing dots and kept only if it is a word of that
    dimension's vocabulary (``words``: dimension -> words, by default the fixed vocabulary)."""
    v = vocabulary(answers.sparkSession, words)
    norm_ans = answers.withColumn("tag", F.regexp_replace(F.lower(F.trim(F.col("answer"))), r"\.+$", ""))
    kept = norm_ans.join(v, ["dimension", "tag"], "left_semi")
    return kept.groupBy("dataset_id", "id").agg(F.array_sort(F.collect_set("tag")).alias("new_tags"))


def tag_images(images: DataFrame, answer_fn, batch_size: int = 50, words: dict[str, list[str]] | None = None) -> DataFrame:
    """V8: apply a user-supplied model to images in Arrow batches.

    ``answer_fn(pandas.DataFrame) -> pandas.DataFrame`` receives columns dataset_id, id, path
    (and content if present) and returns rows (dataset_id, id, dimension, answer); failures
    of single images are the function's to skip.  Output goes through V7."""
    schema = "dataset_id string, id string, dimension string, answer string"

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                out = answer_fn(pdf.iloc[start:start + batch_size])
                if out is not None and len(out):
                    yield out[["dataset_id", "id", "dimension", "answer"]]
    return normalize_tag_answers(images.mapInPandas(run, schema), words)


def embed_images(images: DataFrame, embed_fn, model_name: str, batch_size: int = 32) -> DataFrame:
    """V4: apply a user-supplied embedding function in batches of ``batch_size`` images.

    ``embed_fn(pandas.DataFrame) -> list[list[float] | None]`` gets columns dataset_id,
    sample_id, path, content; ``None`` marks an unreadable image, which is skipped."""
    import pandas as pd
    schema = "sample_id string, dataset_id string, model_name string, vector array<float>"

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                vecs = embed_fn(chunk)
                out = pd.DataFrame({"sample_id": chunk["sample_id"].values, "dataset_id": chunk["dataset_id"].values,
                                    "model_name": model_name, "vector": list(vecs)})
                out = out[out["vector"].notna()]
                if len(out):
                    yield out
    return images.mapInPandas(run, schema)

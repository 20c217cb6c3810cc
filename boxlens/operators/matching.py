"""Prediction-to-ground-truth box matching.

Design for scale
----------------
* **Images of up to LOCAL_BOXES boxes** are compared and matched inside tasks, after one shuffle of the boxes
  (``images``).  What follows is for the larger ones, which are told apart by a count before.
* **Pair join (J8)** is an equi-join on ``(dataset_id, sample_id, level, cell_x, cell_y)`` of a grid
  with levels of doubling cell size: a pair meets at the level of its larger box and is kept
  only in the cell holding the top-left corner of its intersection, so each overlapping pair
  appears exactly once and disjoint pairs (IoU 0, irrelevant to every rule) are rarely formed.  An image holding a
  third of all boxes is thereby split over many join keys instead of one quadratic task.
* **Argmax matching (W1 + W2)**: when a prediction's candidate is its best GT over *all* GT
  (the rule of error analysis, triage and PR matching) the sequential greedy loop equals two
  set operations: best GT per prediction (a partial aggregate, combined map-side) and the first
  claimant per GT (a window partitioned by GT).
* **Greedy "best unclaimed" matching (E12)** is inherently sequential, but only inside an image,
  and there inside a connected component of the candidate graph (pred--GT edges with IoU >= t).
  Images are packed many to a task by their pair counts and folded in one sorted pass, in which pairs
  without a rival are taken at once.  An image of more pairs than a task should hold is split into its
  components by a distributed job of logarithmically many rounds: the unit of sequential work
  is then a cluster of mutually overlapping boxes, never a huge image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.functions.geometry import effective_confidence, intersection, iou
from boxlens.operators import images
from boxlens.operators.components import connected_components
from boxlens.session import pin

GT_SOURCE = "ground_truth"
DEFAULT_CELL = 128.0

_BOX_COLS = ["dataset_id", "sample_id", "id", "category_name", "bbox_x", "bbox_y", "bbox_w",
             "bbox_h", "confidence"]


def check_thresholds(iou_threshold: float | None = None, conf_threshold: float | None = None) -> None:
    """Request bounds: IoU in [0.1, 1], confidence in [0, 1]."""
    if iou_threshold is not None and not 0.1 <= iou_threshold <= 1.0:
        raise ValueError("iou_threshold must be in [0.1, 1]")
    if conf_threshold is not None and not 0.0 <= conf_threshold <= 1.0:
        raise ValueError("conf_threshold must be in [0, 1]")


def ground_truth(ann: DataFrame, dataset_id: str, samples: DataFrame | None = None,
                 split: str | None = None) -> DataFrame:
    """E2 (GT half): ground-truth boxes of one dataset, optionally restricted to a split."""
    g = ann.filter((F.col("dataset_id") == dataset_id) & (F.col("source") == GT_SOURCE)).select(*_BOX_COLS)
    return restrict_split(g, samples, split)


def predictions(ann: DataFrame, dataset_id: str, source: str, conf_threshold: float | None = None,
                samples: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """E2 (prediction half) + F9: one run's boxes, optionally with ``coalesce(conf,1) >= t``."""
    p = ann.filter((F.col("dataset_id") == dataset_id) & (F.col("source") == source))
    if conf_threshold is not None:
        p = p.filter(effective_confidence() >= F.lit(float(conf_threshold)))
    return restrict_split(p.select(*_BOX_COLS), samples, split)


def restrict_split(boxes: DataFrame, samples: DataFrame | None, split: str | None) -> DataFrame:
    """Keep boxes whose sample has the given split (semi-join on both identity keys)."""
    if split is None:
        return boxes
    s = samples.filter(F.col("split") == split).select("dataset_id", F.col("id").alias("sample_id"))
    return boxes.join(s, ["dataset_id", "sample_id"], "left_semi")


MIN_LEVEL, MAX_LEVEL = -6, 12        # cells of cell * 2^level pixels


def _solid(boxes: DataFrame, cell: float) -> DataFrame:
    """Boxes of positive area (others can overlap nothing) with their grid level: the smallest
    cell size that is no smaller than the box, so a box covers at most 2 x 2 cells of its level."""
    side = F.greatest("bbox_w", "bbox_h") / F.lit(float(cell))
    level = F.least(F.greatest(F.ceil(F.log2(side)), F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL)).cast("int")
    return boxes.filter((F.col("bbox_w") > 0) & (F.col("bbox_h") > 0)).withColumn("_own", level)


def _placed(boxes: DataFrame, prefix: str, cell: float, places: Column) -> DataFrame:
    """Corner columns with ``prefix`` plus one row per place (turn, level) of ``places`` and cell that
    the box covers at that level."""
    b = boxes.select(
        "dataset_id", "sample_id", F.col("id").alias(f"{prefix}id"), F.col("category_name").alias(f"{prefix}cat"),
        F.col("bbox_x").alias(f"{prefix}x1"), F.col("bbox_y").alias(f"{prefix}y1"),
        (F.col("bbox_x") + F.col("bbox_w")).alias(f"{prefix}x2"),
        (F.col("bbox_y") + F.col("bbox_h")).alias(f"{prefix}y2"),
        *([effective_confidence().alias("conf")] if prefix == "p_" else []), F.explode(places).alias("_at"))
    b = b.select("*", F.col("_at.turn").alias("turn"), F.col("_at.level").alias("level")).drop("_at")
    c = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    return (b.withColumn("cx", F.explode(F.sequence(F.floor(F.col(f"{prefix}x1") / c), F.floor(F.col(f"{prefix}x2") / c))))
             .withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"{prefix}y1") / c), F.floor(F.col(f"{prefix}y2") / c)))))


HOME_PRED, HOME_GT = 0, 1      # whose own level a meeting place is on


def placed_sides(preds: DataFrame, gts: DataFrame, cell: float = DEFAULT_CELL) -> tuple[DataFrame, DataFrame]:
    """The two sides of the pair join.  Each box stands at its own level, to be met by boxes of the
    other side, and is lifted to the levels on which larger boxes of the other side stand.  A pair
    of equal levels meets on the predictions' turn only, so every pair has one level, that of its
    larger box, and two boxes of which neither is at home never meet.  A box does not stand where no box
    of the other side can be lifted to.  One small job finds the levels in use."""
    ps, gs = _solid(preds, cell), _solid(gts, cell)
    used = ps.select("_own", F.lit(HOME_PRED).alias("t")).union(gs.select("_own", F.lit(HOME_GT).alias("t"))).distinct().collect()   # at most 38 rows
    p_levels, g_levels = (sorted(r["_own"] for r in used if r["t"] == t) for t in (HOME_PRED, HOME_GT))

    def at(turn: int, level: Column) -> Column:
        return F.struct(F.lit(turn).alias("turn"), level.cast("int").alias("level"))

    def lifted(turn: int, levels: list[int], strictly: bool) -> Column:
        own = F.col("_own") + (1 if strictly else 0)
        return F.transform(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= own), lambda x: at(turn, x))

    def home(turn: int, least: list[int], strictly: bool) -> Column:
        met = F.col("_own") >= (min(least) + (1 if strictly else 0)) if least else F.lit(False)
        return F.filter(F.array(at(turn, F.col("_own"))), lambda _: met)
    p = _placed(ps, "p_", cell, F.concat(home(HOME_PRED, g_levels, False), lifted(HOME_GT, g_levels, True)))
    g = _placed(gs, "g_", cell, F.concat(home(HOME_GT, p_levels, True), lifted(HOME_PRED, p_levels, False)))
    return p, g


def candidate_pairs(preds: DataFrame, gts: DataFrame, same_class: bool = False,
                    cell: float = DEFAULT_CELL) -> DataFrame:
    """Every (prediction, GT) pair of one image with positive overlap, exactly once.

    Images of up to LOCAL_BOXES boxes are compared inside tasks (``images``), larger ones on the grid.

    Columns: dataset_id, sample_id, p_id, p_cat, conf, g_id, g_cat, iou.
    """
    large, any_large = images.large_images(preds, gts)
    small = [images.of_images(df, large, True) for df in (preds, gts)]
    pairs = images.local_pairs(*small, same_class)
    if any_large:
        pairs = pairs.unionByName(grid_pairs(*(images.of_images(df, large, False) for df in (preds, gts)), same_class, cell))
    return pairs


def grid_pairs(preds: DataFrame, gts: DataFrame, same_class: bool = False, cell: float = DEFAULT_CELL) -> DataFrame:
    """``candidate_pairs`` by an equi-join on grid cells, for images of any size.

    The grid has levels of doubling cell size.  A pair meets at the level of its larger box, so
    small boxes crowded at one spot are told apart by small cells, and a box over the whole image
    covers four cells instead of hundreds and meets each smaller box once, while those don't meet
    each other there.
    """
    p, g = placed_sides(preds, gts, cell)
    keys = ["dataset_id", "sample_id", "turn", "level", "cx", "cy"]
    c = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    pairs = p.join(g, keys)
    if same_class:
        pairs = pairs.filter(F.col("p_cat") == F.col("g_cat"))
    inter = intersection("p_", "g_")
    home = ((F.floor(F.greatest("p_x1", "g_x1") / c) == F.col("cx"))
            & (F.floor(F.greatest("p_y1", "g_y1") / c) == F.col("cy")))
    return (pairs.filter(home).withColumn("inter", inter).filter(F.col("inter") > 0)
                 .select("dataset_id", "sample_id", "p_id", "p_cat", "conf", "g_id", "g_cat",
                         iou("p_", "g_", F.col("inter")).alias("iou")))


def match_outcomes(preds: DataFrame, gts: DataFrame, iou_threshold: float, same_class: bool = False,
                   cell: float = DEFAULT_CELL, pairs: DataFrame | None = None) -> DataFrame:
    """W1 + W2 in two passes, one row per box (predictions and GT).

    W1: each prediction's best GT (IoU desc, GT id asc) -- a grouped aggregate over the pair
    table, joined to the predictions.  W2: among predictions whose best GT it is with
    IoU >= t the first by (confidence desc, prediction id) claims it -- a grouped aggregate
    per GT, joined back to the prediction (by its id) and to the GT row.

    Columns: dataset_id, sample_id, kind ('pred' | 'gt'), id, cat, conf (effective),
    confidence (stored), g_id / g_cat / iou (pred: its best GT), claimed (pred: claims its
    best GT; gt: has a claimant), m_id / m_cat / m_iou (gt: the claimant).  ``pairs`` saves the
    pair join if it has been made already.  Without it, images of up to LOCAL_BOXES boxes are matched inside tasks
    (``images``), larger ones by these joins.
    """
    if pairs is None:
        large, any_large = images.large_images(preds, gts)
        out = images.local_outcomes(*(images.of_images(df, large, True) for df in (preds, gts)), iou_threshold, same_class)
        if not any_large:
            return out
        preds, gts = (images.of_images(df, large, False) for df in (preds, gts))
        return out.unionByName(match_outcomes(preds, gts, iou_threshold, same_class, cell, grid_pairs(preds, gts, same_class, cell)))
    # the first of (-iou, g_id) per prediction; predictions without any overlap join to nothing
    best = (pairs.groupBy("dataset_id", "sample_id", F.col("p_id").alias("id"))
                 .agg(F.min(F.struct((-F.col("iou")).alias("niou"), "g_id", "g_cat")).alias("b"))
                 .select("dataset_id", "sample_id", "id", "b.g_id", "b.g_cat", (-F.col("b.niou")).alias("iou")))
    prow = (preds.select("dataset_id", "sample_id", "id", F.col("category_name").alias("cat"),
                         effective_confidence().alias("conf"), "confidence")
                 .join(best, ["dataset_id", "sample_id", "id"], "left")
                 .select("dataset_id", "sample_id", F.lit("pred").alias("kind"), "id", "cat", "conf", "confidence", "g_id", "g_cat", "iou"))
    # W2 as an aggregate, not a window: the first claimant per GT is the minimum of
    # (-confidence, prediction id) among predictions whose best GT it is with IoU >= t.
    # Partial aggregation combines map-side, so one GT chosen by a third of all predictions
    # is still one small row per task.
    elig = prow.filter(F.col("iou") >= F.lit(float(iou_threshold)))
    claims = (elig.groupBy("dataset_id", "sample_id", "g_id")
                  .agg(F.min(F.struct((-F.col("conf")).alias("nc"), F.col("id").alias("m_id"),
                                      F.col("cat").alias("m_cat"), F.col("iou").alias("m_iou"))).alias("c"))
                  .select("dataset_id", "sample_id", "g_id", "c.m_id", "c.m_cat", "c.m_iou"))
    won = claims.select("dataset_id", "sample_id", F.col("m_id").alias("id"), F.lit(True).alias("claimed"))
    pred_rows = (prow.join(won, ["dataset_id", "sample_id", "id"], "left")
                     .select("dataset_id", "sample_id", "kind", "id", "cat", "conf", "confidence", "g_id", "g_cat", "iou",
                             F.coalesce("claimed", F.lit(False)).alias("claimed"),
                             F.lit(None).cast("string").alias("m_id"), F.lit(None).cast("string").alias("m_cat"),
                             F.lit(None).cast("double").alias("m_iou")))
    gt_rows = (gts.select("dataset_id", "sample_id", F.col("id"), F.col("category_name").alias("cat"))
                  .join(claims.withColumnRenamed("g_id", "id"), ["dataset_id", "sample_id", "id"], "left")
                  .select("dataset_id", "sample_id", F.lit("gt").alias("kind"), "id", "cat",
                          F.lit(None).cast("double").alias("conf"), F.lit(None).cast("double").alias("confidence"),
                          F.lit(None).cast("string").alias("g_id"), F.lit(None).cast("string").alias("g_cat"),
                          F.lit(None).cast("double").alias("iou"), F.col("m_id").isNotNull().alias("claimed"),
                          "m_id", "m_cat", "m_iou"))
    return pred_rows.unionByName(gt_rows)


def argmax_match(preds: DataFrame, gts: DataFrame, iou_threshold: float, same_class: bool = False,
                 cell: float = DEFAULT_CELL, pairs: DataFrame | None = None) -> DataFrame:
    """Prediction rows of ``match_outcomes`` in the pair-table naming: dataset_id, sample_id,
    p_id, p_cat, conf, g_id, g_cat, iou, claimed."""
    m = match_outcomes(preds, gts, iou_threshold, same_class, cell, pairs)
    return m.filter(F.col("kind") == "pred").select(
        "dataset_id", "sample_id", F.col("id").alias("p_id"), F.col("cat").alias("p_cat"), "conf",
        "g_id", "g_cat", "iou", "claimed")


# ---------------------------------------------------------------------------------------
# Greedy best-unclaimed matching, folded per image or connected component
# ---------------------------------------------------------------------------------------

FOLD_PACK_PAIRS = 50_000     # candidate pairs packed into one fold task, and the largest image folded whole


def fold_groups(pairs: DataFrame, group_cols: list[str]) -> DataFrame:
    """``pairs``, stored, with ``grp`` and ``pack``, the task a group is folded in.

    A group is a natural group (image, or image and class) of up to FOLD_PACK_PAIRS pairs.  The pairs of larger
    ones are grouped by connected component of the candidate graph instead, which a distributed search finds.
    Both are exact: greedy choices cross neither.  Groups and nodes are named by hashes; two
    that share a hash are folded side by side, as boxes are told apart by their ids."""
    pairs = pin(pairs)      # the sizes, the component search and the fold read the same rows
    natural = F.xxhash64(*group_cols)
    sizes = pairs.groupBy(natural.alias("grp")).agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    packs = total // max(1, FOLD_PACK_PAIRS) + 1
    grouped = pairs.withColumn("grp", natural)
    if largest > FOLD_PACK_PAIRS:
        large = sizes.filter(F.col("n") > FOLD_PACK_PAIRS).select("grp")
        wide = pin(grouped.join(large, "grp", "left_semi").withColumn("_p", F.xxhash64(F.lit("p"), *group_cols, "p_id"))
                          .withColumn("_g", F.xxhash64(F.lit("g"), *group_cols, "g_id")))
        comp = connected_components(wide.select(F.col("_p").alias("src"), F.col("_g").alias("dst")))
        split = wide.drop("grp", "_g").join(comp.select(F.col("node").alias("_p"), F.col("component").alias("grp")), "_p").drop("_p")
        grouped = grouped.join(large, "grp", "left_anti").unionByName(split)
    return grouped.withColumn("pack", F.pmod(F.xxhash64("grp"), F.lit(packs)))


def _codes(table, group: str, column: str):
    """A number per row that is equal for equal (dataset, group, value of ``column``), and how often
    each occurs."""
    import numpy as np
    names = [table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("dataset_id", group, column)]
    key = names[0].astype(np.int64)
    for n in names[1:]:
        _, key = np.unique(key * (int(n.max(initial=0)) + 1) + n, return_inverse=True)
    return key, np.bincount(key)


def _fold_best_unclaimed(thresholds: list[float]):
    """Predictions in confidence order (conf desc, id) each take their best candidate with IoU >= t
    (IoU desc, GT id) that no earlier prediction took."""
    levels = sorted(thresholds)

    def run(table):
        import numpy as np
        import pyarrow as pa
        table = table.sort_by([("grp", "ascending"), ("conf", "descending"), ("p_id", "ascending"), ("iou", "descending"), ("g_id", "ascending")])
        (p, np_), (g, ng), v = _codes(table, "grp", "p_id"), _codes(table, "grp", "g_id"), table["iou"].to_numpy()
        alone = (np_[p] == 1) & (ng[g] == 1) if len(p) else np.zeros(0, bool)     # the only candidates of each other
        at = [np.flatnonzero(alone & (v >= t)) for t in levels]
        rest = np.flatnonzero(~alone)
        claimed, done, rows = [set() for _ in levels], [-1] * len(levels), [[] for _ in levels]
        for i, pi, gi, vi in zip(rest.tolist(), p[rest].tolist(), g[rest].tolist(), v[rest].tolist()):
            for k, t in enumerate(levels):
                if vi < t:
                    break
                if done[k] != pi and gi not in claimed[k]:
                    claimed[k].add(gi)
                    done[k] = pi
                    rows[k].append(i)
        take = np.concatenate([*at, *(np.array(r, np.int64) for r in rows)])
        t = np.repeat(np.array(levels * 2), [len(x) for x in (*at, *rows)])
        return table.select(["dataset_id", "p_id", "g_id", "g_cat", "iou"]).take(pa.array(take, pa.int64())).add_column(0, "t", pa.array(t, pa.float64()))
    return run


def cap_detections(preds: DataFrame, max_det: int | None) -> DataFrame:
    """Top-``max_det`` predictions per image and class (confidence desc, id): COCO's cap."""
    if max_det is None:
        return preds
    w = Window.partitionBy("dataset_id", "sample_id", "category_name").orderBy(effective_confidence().desc(), "id")
    return preds.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_det).drop("_r")


def greedy_pairs(p: DataFrame, gts: DataFrame, thresholds: list[float], same_class: bool = True,
                 cell: float = DEFAULT_CELL, pairs: DataFrame | None = None) -> DataFrame:
    """The accepted matches of E12 only: (t, dataset_id, p_id, g_id, g_cat, iou)."""
    if pairs is None:
        pairs = candidate_pairs(p, gts, same_class, cell)
    pairs = pairs.filter(F.col("iou") >= float(min(thresholds)))
    grouped = fold_groups(pairs, ["dataset_id", "sample_id", "p_cat"] if same_class else ["dataset_id", "sample_id"])
    return (grouped.select("pack", "grp", "dataset_id", "p_id", "conf", "g_id", "g_cat", "iou").groupBy("pack")
                   .applyInArrow(_fold_best_unclaimed([float(t) for t in thresholds]),
                                 "t double, dataset_id string, p_id string, g_id string, g_cat string, iou double"))


def greedy_match(preds: DataFrame, gts: DataFrame, thresholds: list[float], same_class: bool = True,
                 max_det: int | None = None, cell: float = DEFAULT_CELL) -> DataFrame:
    """Predictions (confidence desc, id asc) each take the best *still unclaimed*
    same-class GT (IoU desc, GT id asc) with IoU >= t, for every threshold in ``thresholds``.

    Returns one row per (threshold, prediction): t, dataset_id, sample_id, p_id, p_cat, conf,
    g_id / g_cat / iou (null if unmatched).  ``max_det`` keeps only the top-N predictions per
    image and class (COCO's detection cap) before matching.
    """
    p = cap_detections(preds, max_det)
    folded = greedy_pairs(p, gts, thresholds, same_class, cell)
    tarr = F.array(*[F.lit(float(t)) for t in thresholds])
    allp = p.select("dataset_id", "sample_id", F.col("id").alias("p_id"), F.col("category_name").alias("p_cat"),
                    effective_confidence().alias("conf")).withColumn("t", F.explode(tarr))
    return allp.join(folded, ["t", "dataset_id", "p_id"], "left")


def _fold_one_to_one(table):
    """Pairs in order (same class first, IoU desc, prediction id, GT id) are taken when neither
    side is taken yet."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    table = table.append_column("k", pc.cast(pc.not_equal(table["p_cat"], table["g_cat"]), pa.int8()))
    table = table.sort_by([("grp", "ascending"), ("k", "ascending"), ("iou", "descending"), ("p_id", "ascending"), ("g_id", "ascending")])
    (p, np_), (g, ng) = _codes(table, "grp", "p_id"), _codes(table, "grp", "g_id")
    alone = (np_[p] == 1) & (ng[g] == 1) if len(p) else np.zeros(0, bool)
    rest, take = np.flatnonzero(~alone), []
    ptaken, gtaken = set(), set()
    for i, pi, gi in zip(rest.tolist(), p[rest].tolist(), g[rest].tolist()):
        if pi not in ptaken and gi not in gtaken:
            ptaken.add(pi)
            gtaken.add(gi)
            take.append(i)
    cols = ["dataset_id", "sample_id", "p_id", "p_cat", "g_id", "g_cat", "iou"]
    return table.select(cols).take(pa.array(np.concatenate([np.flatnonzero(alone), np.array(take, np.int64)]), pa.int64()))


def confusion_match(preds: DataFrame, gts: DataFrame, iou_threshold: float, cell: float = DEFAULT_CELL,
                    pairs: DataFrame | None = None) -> DataFrame:
    """D6 matching for the confusion matrix: class-agnostic candidate pairs with IoU > t,
    taken greedily one-to-one in the order (same class first, IoU desc, prediction id, GT id).

    Returns the accepted pairs: dataset_id, sample_id, p_id, p_cat, g_id, g_cat, iou."""
    if pairs is None:
        pairs = candidate_pairs(preds, gts, False, cell)
    grouped = fold_groups(pairs.filter(F.col("iou") > F.lit(float(iou_threshold))), ["dataset_id", "sample_id"])
    return (grouped.select("pack", "grp", "dataset_id", "sample_id", "p_id", "p_cat", "g_id", "g_cat", "iou").groupBy("pack")
                   .applyInArrow(_fold_one_to_one, "dataset_id string, sample_id string, p_id string, p_cat string, "
                                                   "g_id string, g_cat string, iou double"))

"""Detection evaluation: PR curves, AP, mAP, confusion matrix.

Results are long-format DataFrames (one row per curve point / class / cell), never
collected.  Ties are broken deterministically (D16): confidence desc, then prediction id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators import matching as M
from boxlens.operators.cumulative import running_counts
from boxlens.session import pin

ALL = "all"
MAX_POINTS = 200


def class_names(preds: DataFrame, gts: DataFrame) -> DataFrame:
    """The sorted union of class names (set operation, distinct)."""
    return (preds.select(F.col("category_name").alias("class_name"))
                 .union(gts.select(F.col("category_name").alias("class_name"))).distinct())


def stored_sides(preds: DataFrame, gts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, stored once: the levels, the pairs, the ranks and the counts of an evaluation read them."""
    return tuple(df if hasattr(df, "_pin_path") else pin(df) for df in (preds, gts))


def shared_pairs(preds: DataFrame, gts: DataFrame, same_class: bool, cell: float = M.DEFAULT_CELL) -> DataFrame:
    """The pairs, stored once for the folds of a report: pairs with IoU >= 0.1, the least
    threshold a request may ask for (a lesser pair can neither match nor be claimed)."""
    return pin(M.candidate_pairs(preds, gts, same_class, cell).filter(F.col("iou") >= 0.1))


def pr_matches(preds: DataFrame, gts: DataFrame, iou_threshold: float, cell: float = M.DEFAULT_CELL,
               pairs: DataFrame | None = None) -> DataFrame:
    """Per prediction, ``is_tp``: its best same-class GT has IoU >= t and no earlier
    (higher-confidence) prediction of the image took it.  No confidence cut."""
    m = M.argmax_match(preds, gts, iou_threshold, same_class=True, cell=cell, pairs=pairs)
    return m.select("dataset_id", "sample_id", "p_id", F.col("p_cat").alias("class_name"), "conf",
                    F.col("claimed").cast("int").alias("is_tp"))


def _with_pooled(matches: DataFrame) -> DataFrame:
    """Every prediction once under its class and once under the pooled ``all`` curve."""
    return matches.withColumn("class_name", F.explode(F.array(F.col("class_name"), F.lit(ALL))))


def gt_counts(gts: DataFrame) -> DataFrame:
    """GT boxes per class plus the pooled total under ``all``."""
    return (gts.select(F.explode(F.array(F.col("category_name"), F.lit(ALL))).alias("class_name"))
               .groupBy("class_name").agg(F.count("*").alias("n_gt")))


def pr_points(matches: DataFrame, gts: DataFrame) -> DataFrame:
    """Full PR curve per class and pooled: one row per prediction with rank, recall,
    precision, confidence (conf desc, prediction id asc)."""
    # only what a point needs is ranked: ranked rows are shuffled and stored whole, twice the predictions
    m = _with_pooled(matches).select("class_name", "p_id", "conf", "is_tp")
    ranked = running_counts(m, ["class_name"], [F.col("conf").desc(), F.col("p_id").asc()], "is_tp")
    return (ranked.join(gt_counts(gts), "class_name", "left")
                  .select("class_name", "rank", "total", "p_id", F.col("conf").alias("confidence"), "is_tp",
                          F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.col("cum").alias("tp_cum"),
                          (F.col("cum") / F.col("n_gt")).alias("recall"),
                          (F.col("cum") / F.col("rank")).alias("precision")))


def _curve_classes(preds: DataFrame, gts: DataFrame) -> DataFrame:
    """Classes that get a curve (>= 1 GT or prediction) plus ``all`` when anything exists."""
    c = class_names(preds, gts)
    return c.union(c.limit(1).select(F.lit(ALL).alias("class_name")))


def interpolated_ap(points: DataFrame, classes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """E5: mean over the recall grid i*0.01 (i=0..100) of the max precision at recall >= grid
    value; 0 where nothing reaches it; ap 0 for curves without GT or without predictions.

    Each point lands on the highest grid index it reaches (g); a suffix max over g gives the
    interpolated precision, which holds for the grid values between consecutive g's -- a
    window over at most 101 rows per class, no join with the grid."""
    rec = F.col("recall")
    f = F.floor(rec * 100).cast("int")
    g = (F.when((f + 1 <= 100) & ((f + 1) * F.lit(0.01) <= rec), f + 1)
          .when(f * F.lit(0.01) <= rec, f).otherwise(f - 1))
    keys = keys or ["class_name"]
    pts = points.filter(F.col("n_gt") > 0).withColumn("g", F.least(g, F.lit(100)))
    per_g = pts.groupBy(*keys, "g").agg(F.max("precision").alias("p"))
    w = Window.partitionBy(*keys).orderBy(F.col("g").desc())
    sw = per_g.withColumn("suf", F.max("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    prev = F.lead("g", 1).over(w)
    contrib = sw.withColumn("span", F.col("g") - F.coalesce(prev, F.lit(-1))).select(
        *keys, (F.col("suf") * F.col("span")).alias("c"))
    ap = contrib.groupBy(*keys).agg((F.sum("c") / 101).alias("ap"))
    return classes.join(ap, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def thin(points: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """Keep positions floor(i*(n-1)/(max_points-1)) for i < max_points-1 plus the last
    (numpy ``linspace(..., dtype=int)``) when n > max_points; every point otherwise.  A
    column predicate per row: no join with the index set."""
    n = F.col("total")          # points per curve, carried by the running count
    p = points
    k = F.col("rank") - 1
    s = (n - 1) / F.lit(float(max_points - 1))
    i1 = F.ceil(k / s)

    def hit(i: Column) -> Column:
        return (i >= 0) & (i <= max_points - 2) & (F.floor(i * s) == k)
    keep = (n <= max_points) | (k == n - 1) | hit(i1 - 1) | hit(i1) | hit(i1 + 1)
    return p.filter(keep)


def pr_curves(preds: DataFrame, gts: DataFrame, iou_threshold: float,
              max_points: int = MAX_POINTS, cell: float = M.DEFAULT_CELL,
              pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """E4 + E5: (thinned curve points, ap per curve).

    Curves exist for every class with GT or predictions and for ``all``; a curve without
    predictions or without GT is the single point (recall 0, precision 1, confidence 1)."""
    preds, gts = stored_sides(preds, gts)
    matches = pr_matches(preds, gts, iou_threshold, cell, pairs)
    full = pr_points(matches, gts)
    classes = _curve_classes(preds, gts)
    ap = interpolated_ap(full, classes)
    real = thin(full.filter(F.col("n_gt") > 0), max_points).select(
        "class_name", "rank", "recall", "precision", "confidence")
    # curves with >= 1 GT and >= 1 prediction: read from the ranked points (pinned data), not
    # by recomputing the matching
    has_real = full.filter(F.col("n_gt") > 0).select("class_name").distinct()
    degenerate = (classes.join(has_real, "class_name", "left_anti")
                         .select("class_name", F.lit(1).cast("long").alias("rank"), F.lit(0.0).alias("recall"),
                                 F.lit(1.0).alias("precision"), F.lit(1.0).alias("confidence")))
    return real.unionByName(degenerate), ap


def operating_points(curve: DataFrame, conf_threshold: float) -> DataFrame:
    """Per curve the (thinned) point whose confidence is closest to the threshold; the
    earliest point (confidence desc order) wins ties."""
    key = F.struct(F.abs(F.col("confidence") - F.lit(float(conf_threshold))).alias("d"), F.col("rank").alias("r"))
    best = curve.groupBy("class_name").agg(F.min_by(F.struct("precision", "recall", "confidence"), key).alias("b"))
    return best.select("class_name", F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
                       F.col("b.confidence").alias("confidence"))


def pr_grid(curve: DataFrame) -> DataFrame:
    """Each curve on the recall grid i/100: max precision among (thinned) points with
    recall >= grid value (0 if none); ``confidence`` = confidence of the ``all`` point whose
    recall is nearest (first in curve order on ties).

    Points are <= 200 per curve, so the grid is generated next to them with ``explode``
    (at most 101 x 200 rows per curve) and reduced with grouped aggregates."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(100)))
    pts = curve.select("class_name", "recall", "precision", "confidence", "rank").withColumn("i", grid)
    env = (pts.filter(F.col("recall") >= F.col("i") / 100)
              .groupBy("class_name", "i").agg(F.max("precision").alias("precision")))
    full = curve.select("class_name").distinct().withColumn("i", grid)
    env = full.join(env, ["class_name", "i"], "left").withColumn("precision", F.coalesce("precision", F.lit(0.0)))
    near = (pts.filter(F.col("class_name") == ALL)
               .groupBy("i").agg(F.min_by("confidence", F.struct(F.abs(F.col("recall") - F.col("i") / 100),
                                                                 F.col("rank"))).alias("confidence")))
    return (env.join(near, "i", "left")
               .select("class_name", (F.col("i") / 100).alias("recall"), "precision", "confidence"))


# ---------------------------------------------------------------------------------------
# E6 mAP, E7 confusion matrix, E8 cell drill-down, E13 per-class table, E14 report
# ---------------------------------------------------------------------------------------

# COCO IoU thresholds 0.50:0.05:0.95.
COCO_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
BACKGROUND = "background"


def map_metrics(preds: DataFrame, gts: DataFrame, max_det: int | None = None,
                cell: float = M.DEFAULT_CELL, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """E6 (D5, COCO rule): greedy best-unclaimed same-class matching at every threshold,
    101-point interpolated AP per (threshold, class) over all images, classes without GT
    ignored.  Every prediction counts; ``max_det`` = 100 is COCO's cap per image and class, as an
    option.  Returns (per class: class_name, ap50, ap75, ap50_95; summary: map50, map75,
    map50_95 as means over classes with GT)."""
    # A prediction's rank in its class curve does not depend on the threshold, and the
    # interpolated precision is always attained at a true-positive row (precision only falls
    # along false positives).  So: every prediction carries the thresholds at which it is one, as bits, and one pass
    # in rank order counts them all -- no threshold x prediction table.
    preds, gts = stored_sides(preds, gts)
    p = M.cap_detections(preds, max_det)
    folded = M.greedy_pairs(p, gts, COCO_THRESHOLDS, True, cell, pairs if max_det is None else None)
    bit = F.coalesce(*[F.when(F.col("t") == t, F.lit(1 << k)) for k, t in enumerate(COCO_THRESHOLDS)])
    hits = folded.groupBy("dataset_id", "p_id").agg(F.bit_or(bit).alias("bits"))
    base = (p.select(F.col("category_name").alias("class_name"), F.col("id").alias("p_id"), "dataset_id",
                     F.coalesce("confidence", F.lit(1.0)).alias("conf"))
             .join(hits, ["dataset_id", "p_id"], "left").select("class_name", "p_id", "conf", F.coalesce("bits", F.lit(0)).alias("bits")))
    flags = [f"_f{k}" for k in range(len(COCO_THRESHOLDS))]
    base = base.select("*", *[F.getbit("bits", F.lit(k)).cast("int").alias(f) for k, f in enumerate(flags)])
    ranked = running_counts(base, ["class_name"], [F.col("conf").desc(), F.col("p_id").asc()], flags)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.getbit("bits", F.lit(k)).alias("tp"), F.col("cum")[k].alias("cum"))
                               for k, t in enumerate(COCO_THRESHOLDS)])).alias("e")
    tps = ranked.filter("bits > 0").select("class_name", "rank", each).filter("e.tp = 1")
    ng = gts.groupBy(F.col("category_name").alias("class_name")).agg(F.count("*").alias("n_gt"))
    pts = (tps.join(F.broadcast(ng), "class_name")
              .select("e.t", "class_name", "n_gt", (F.col("e.cum") / F.col("n_gt")).alias("recall"),
                      (F.col("e.cum") / F.col("rank")).alias("precision")))
    tarr = F.array(*[F.lit(t) for t in COCO_THRESHOLDS])
    keys = ng.select("class_name").withColumn("t", F.explode(tarr))
    ap = interpolated_ap(pts, keys, ["t", "class_name"])
    per_class = (ap.groupBy("class_name")
                   .agg(F.max(F.when(F.col("t") == 0.5, F.col("ap"))).alias("ap50"),
                        F.max(F.when(F.col("t") == 0.75, F.col("ap"))).alias("ap75"),
                        F.avg("ap").alias("ap50_95")))
    summary = per_class.agg(F.coalesce(F.avg("ap50"), F.lit(0.0)).alias("map50"),
                            F.coalesce(F.avg("ap75"), F.lit(0.0)).alias("map75"),
                            F.coalesce(F.avg("ap50_95"), F.lit(0.0)).alias("map50_95"))
    return per_class, summary


def confusion_pairs(preds: DataFrame, gts: DataFrame, iou_threshold: float,
                    cell: float = M.DEFAULT_CELL, pairs: DataFrame | None = None) -> DataFrame:
    """(sample_id, actual, predicted) for every matched pair, unmatched prediction
    (actual = background) and unmatched GT (predicted = background), D6 matching."""
    acc = pin(M.confusion_match(preds, gts, iou_threshold, cell, pairs))     # read three times
    matched = acc.select("dataset_id", "sample_id", F.col("g_cat").alias("actual"), F.col("p_cat").alias("predicted"))
    mp = acc.select("dataset_id", "sample_id", F.col("p_id").alias("id"))
    mg = acc.select("dataset_id", "sample_id", F.col("g_id").alias("id"))
    fp = (preds.join(mp, ["dataset_id", "sample_id", "id"], "left_anti")
               .select("dataset_id", "sample_id", F.lit(BACKGROUND).alias("actual"), F.col("category_name").alias("predicted")))
    fn = (gts.join(mg, ["dataset_id", "sample_id", "id"], "left_anti")
             .select("dataset_id", "sample_id", F.col("category_name").alias("actual"), F.lit(BACKGROUND).alias("predicted")))
    return matched.unionByName(fp).unionByName(fn)


def confusion_matrix(preds: DataFrame, gts: DataFrame, iou_threshold: float, conf_threshold: float,
                     cell: float = M.DEFAULT_CELL, pairs: DataFrame | None = None) -> DataFrame:
    """Rows actual, columns predicted, classes + background; non-zero cells in long form."""
    p = preds.filter(F.coalesce("confidence", F.lit(1.0)) >= conf_threshold)
    if pairs is not None:
        pairs = pairs.filter(F.col("conf") >= conf_threshold)
    return (confusion_pairs(p, gts, iou_threshold, cell, pairs)
            .groupBy("actual", "predicted").agg(F.count("*").alias("count")))


def confusion_cell_samples(preds: DataFrame, gts: DataFrame, actual: str, predicted: str, iou_threshold: float,
                           conf_threshold: float, compat: bool = False, cell: float = M.DEFAULT_CELL) -> DataFrame:
    """Distinct samples contributing to one matrix cell.  Default: E7's matching (D7);
    ``compat=True``: same-class best-unclaimed matching (off-diagonal cells then stay empty)."""
    p = preds.filter(F.coalesce("confidence", F.lit(1.0)) >= conf_threshold)
    if compat:
        m = M.greedy_match(p, gts, [iou_threshold], same_class=True, cell=cell)
        acc = m.filter(F.col("g_id").isNotNull())
        matched = acc.select("sample_id", F.col("g_cat").alias("actual"), F.col("p_cat").alias("predicted"))
        fp = m.filter(F.col("g_id").isNull()).select("sample_id", F.lit(BACKGROUND).alias("actual"),
                                                      F.col("p_cat").alias("predicted"))
        fn = (gts.join(acc.select("dataset_id", F.col("g_id").alias("id")), ["dataset_id", "id"], "left_anti")
                 .select("sample_id", F.col("category_name").alias("actual"), F.lit(BACKGROUND).alias("predicted")))
        cells = matched.unionByName(fp).unionByName(fn)
    else:
        cells = confusion_pairs(p, gts, iou_threshold, cell)
    return (cells.filter((F.col("actual") == actual) & (F.col("predicted") == predicted))
                 .select("sample_id").distinct())


def per_class_metrics(preds: DataFrame, gts: DataFrame, iou_threshold: float, conf_threshold: float,
                      max_det: int | None = None, cell: float = M.DEFAULT_CELL, curve: DataFrame | None = None,
                      per_class: DataFrame | None = None, max_points: int = MAX_POINTS) -> DataFrame:
    """Class x (ap50, ap75, ap50_95, precision, recall at the operating point).  Curves and
    per-class AP already built (E14) can be passed in instead of being recomputed."""
    preds, gts = stored_sides(preds, gts)
    pairs = shared_pairs(preds, gts, True, cell) if per_class is None else None
    if curve is None:
        curve, _ = pr_curves(preds, gts, iou_threshold, max_points, cell)      # matched inside tasks: less travels than the pairs and what is joined to them
    op = operating_points(curve.filter(F.col("class_name") != ALL), conf_threshold)
    if per_class is None:
        per_class, _ = map_metrics(preds, gts, max_det, cell, pairs)
    return (class_names(preds, gts).join(per_class, "class_name", "left").join(op, "class_name", "left")
            .select("class_name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in
                                    ["ap50", "ap75", "ap50_95", "precision", "recall"]]))


def evaluation_report(ann: DataFrame, dataset_id: str, source: str, iou_threshold: float = 0.5,
                      conf_threshold: float = 0.25, samples: DataFrame | None = None,
                      split: str | None = None, max_points: int = MAX_POINTS,
                      max_det: int | None = None) -> dict[str, DataFrame]:
    """Every evaluation table for one run.  One stored table of candidate pairs serves the mAP and the
    confusion matrix; the curves match the boxes inside tasks.  Building the report runs the
    shared jobs (pairs, components, ranks); the returned frames are evaluated lazily."""
    M.check_thresholds(iou_threshold, conf_threshold)
    preds, gts = stored_sides(M.predictions(ann, dataset_id, source, None, samples, split), M.ground_truth(ann, dataset_id, samples, split))
    pairs = shared_pairs(preds, gts, False)
    same = pairs.filter(F.col("p_cat") == F.col("g_cat"))
    curve, ap = pr_curves(preds, gts, iou_threshold, max_points)
    per_class, summary = map_metrics(preds, gts, max_det, pairs=same)
    return {"pr_curves": curve, "ap": ap, "ap_metrics": summary,
            "per_class": per_class_metrics(preds, gts, iou_threshold, conf_threshold, curve=curve, per_class=per_class),
            "confusion_matrix": confusion_matrix(preds, gts, iou_threshold, conf_threshold, pairs=pairs)}

"""Error analysis and triage over matched boxes.

All operators take the ``annotations`` (and where needed ``samples``) DataFrames of §1 and
return DataFrames; nothing is collected.  Matching is image-local, so every step runs inside
the (dataset_id, sample_id) partitioning established by the pair join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.operators import matching as M

ERROR_TYPES = ["tp", "hard_fp", "label_error", "false_negative"]


def error_labels(ann: DataFrame, dataset_id: str, source: str, iou_threshold: float = 0.5,
                 conf_threshold: float = 0.25, samples: DataFrame | None = None,
                 split: str | None = None, compat: bool = False,
                 cell: float = M.DEFAULT_CELL) -> DataFrame:
    """E9 per box: every kept prediction is ``tp`` / ``label_error`` / ``hard_fp``; every GT not
    claimed is ``false_negative``.  A label error claims its GT (D2).

    ``compat=True`` reproduces the reference's use of the box height in place of the
    confidence for the cut and the order (D1); by default the confidence is used.

    Columns: dataset_id, sample_id, annotation_id, error_type, category_name, confidence,
    matched_id, iou.
    """
    M.check_thresholds(iou_threshold, conf_threshold)
    preds = M.predictions(ann, dataset_id, source, None if compat else conf_threshold, samples, split)
    if compat:
        preds = (preds.filter(F.coalesce("bbox_h", F.lit(1.0)) >= conf_threshold)
                      .withColumn("real_conf", F.col("confidence"))
                      .withColumn("confidence", F.col("bbox_h")))
    gts = M.ground_truth(ann, dataset_id, samples, split)
    if compat:
        # the stored confidence is reported; the box height only drives the cut and order
        gts = gts.withColumn("real_conf", F.lit(None).cast("double"))
    m = M.match_outcomes(preds, gts, iou_threshold, cell=cell)
    if compat:
        m = m.drop("confidence").join(preds.select("dataset_id", "sample_id", "id", F.col("real_conf").alias("confidence")),
                                      ["dataset_id", "sample_id", "id"], "left")
    pred = F.col("kind") == "pred"
    etype = (F.when(pred & F.col("claimed") & (F.col("cat") == F.col("g_cat")), "tp")
              .when(pred & F.col("claimed"), "label_error")
              .when(pred, "hard_fp").when(~F.col("claimed"), "false_negative"))
    return (m.withColumn("error_type", etype).filter(F.col("error_type").isNotNull())
             .select("dataset_id", "sample_id", F.col("id").alias("annotation_id"), "error_type",
                     F.col("cat").alias("category_name"), "confidence",
                     F.when(pred & F.col("claimed"), F.col("g_id")).alias("matched_id"),
                     F.when(pred & F.col("claimed"), F.col("iou")).alias("iou")))


def error_summary(labels: DataFrame) -> DataFrame:
    """E9 totals, one row."""
    return labels.agg(
        F.count_if(F.col("error_type") == "tp").alias("true_positives"),
        F.count_if(F.col("error_type") == "hard_fp").alias("hard_false_positives"),
        F.count_if(F.col("error_type") == "label_error").alias("label_errors"),
        F.count_if(F.col("error_type") == "false_negative").alias("false_negatives"))


def error_per_class(labels: DataFrame) -> DataFrame:
    """E9 per class (prediction class; false negatives by GT class), ordered by name."""
    return (labels.groupBy(F.col("category_name").alias("class_name"))
                  .agg(F.count_if(F.col("error_type") == "tp").alias("tp"),
                       F.count_if(F.col("error_type") == "hard_fp").alias("hard_fp"),
                       F.count_if(F.col("error_type") == "label_error").alias("label_error"),
                       F.count_if(F.col("error_type") == "false_negative").alias("fn"))
                  .orderBy("class_name"))


def error_samples(labels: DataFrame, cap: int | None = None) -> DataFrame:
    """Error rows per type in sample order (predictions by confidence desc, then missed GT);
    ``cap`` keeps at most that many per type (the reference uses 50; default uncapped, D3)."""
    order = [F.col("sample_id"), F.when(F.col("error_type") == "false_negative", 1).otherwise(0),
             F.coalesce("confidence", F.lit(1.0)).desc(), F.col("annotation_id")]
    out = labels.select("error_type", "sample_id", "category_name", "confidence", "annotation_id")
    if cap is not None:
        w = Window.partitionBy("error_type").orderBy(*order)
        out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")
    return out


def first_error_per_sample(labels: DataFrame) -> DataFrame:
    """One row per (error type, sample): the first in the error list order."""
    # an aggregate (min over the order key), so a sample with a third of all boxes is
    # combined map-side instead of sorted in one task
    key = F.struct((-F.coalesce("confidence", F.lit(1.0))).alias("k"), F.col("annotation_id").alias("a"),
                   "category_name", "confidence")
    return (labels.groupBy("error_type", "sample_id").agg(F.min(key).alias("m"))
                  .select("error_type", "sample_id", "m.category_name", "m.confidence",
                          F.col("m.a").alias("annotation_id")))


def annotation_triage(ann: DataFrame, dataset_id: str, source: str, iou_threshold: float = 0.45,
                      conf_threshold: float = 0.25, overrides: DataFrame | None = None,
                      cell: float = M.DEFAULT_CELL) -> DataFrame:
    """E10 + J6: per-annotation labels for a whole dataset at once.

    Predictions: ``tp`` (claimed same class), ``label_error`` (claimed other class), ``fp``;
    matched_id / iou only when claimed.  GT: ``tp`` when claimed by any prediction (D8) with
    the claimant and its IoU, else ``fn``.  Manual overrides win: label = coalesce(override,
    auto_label), is_override.
    """
    M.check_thresholds(iou_threshold, conf_threshold)
    preds = M.predictions(ann, dataset_id, source, conf_threshold)
    gts = M.ground_truth(ann, dataset_id)
    m = M.match_outcomes(preds, gts, iou_threshold, cell=cell)
    pred = F.col("kind") == "pred"
    label = (F.when(pred & F.col("claimed") & (F.col("cat") == F.col("g_cat")), "tp")
              .when(pred & F.col("claimed"), "label_error").when(pred, "fp")
              .when(F.col("claimed"), "tp").otherwise("fn"))
    auto = m.select("dataset_id", "sample_id", F.col("id").alias("annotation_id"), label.alias("auto_label"),
                    F.when(pred & F.col("claimed"), F.col("g_id")).when(~pred, F.col("m_id")).alias("matched_id"),
                    F.when(pred & F.col("claimed"), F.col("iou")).when(~pred, F.col("m_iou")).alias("iou"))
    if overrides is None:
        return auto.select("*", F.col("auto_label").alias("label"), F.lit(False).alias("is_override"))
    ov = latest_overrides(overrides).filter(F.col("dataset_id") == dataset_id).select(
        "dataset_id", "annotation_id", F.col("label").alias("ov_label"))
    return (auto.join(ov, ["dataset_id", "annotation_id"], "left")
                .select("dataset_id", "sample_id", "annotation_id", "auto_label", "matched_id", "iou",
                        F.coalesce("ov_label", "auto_label").alias("label"),
                        F.col("ov_label").isNotNull().alias("is_override")))


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """Last write wins per (annotation_id, dataset_id), by created_at (M12 semantics); an
    aggregate (max over (created_at, label)), combined map-side, not a window."""
    cols = [c for c in overrides.columns if c not in ("annotation_id", "dataset_id")]
    latest = (overrides.groupBy("annotation_id", "dataset_id")
                       .agg(F.max(F.struct("created_at", "label", *[c for c in cols if c not in ("created_at", "label")]))
                            .alias("m")))
    return latest.select("annotation_id", "dataset_id", *[F.col(f"m.{c}").alias(c) for c in cols])


def worst_images(labels: DataFrame, limit: int | None = 50, cap: int | None = None) -> DataFrame:
    """Rank images by 0.6 * errors/max_errors + 0.4 * spread/max_spread.

    errors = hard_fp + label_error + false_negative rows of the image; spread = population
    std of the non-null error confidences (0 with fewer than two).  Maxima are scalar
    subqueries (a one-row aggregate), so no single-task global window is formed.  Sorted on
    the unrounded score, then sample id; outputs rounded to 4 digits (D23).  ``cap`` mimics the
    reference's 50-per-type input lists (D3); default uncapped.
    """
    if limit is not None and not 1 <= limit <= 200:
        raise ValueError("limit must be in [1, 200]")
    errs = labels.filter(F.col("error_type") != "tp")
    if cap is not None:
        errs = error_samples(errs, cap)
    per = (errs.groupBy("sample_id")
               .agg(F.count("*").alias("error_count"),
                    F.count("confidence").alias("_n"),
                    F.stddev_pop("confidence").alias("_sd"))
               .withColumn("spread", F.when(F.col("_n") >= 2, F.col("_sd")).otherwise(F.lit(0.0))))
    # one row per image with errors, read three times (two maxima and the ranking): pin it
    from boxlens.session import pin
    per = pin(per)
    max_err = per.select(F.max("error_count")).scalar()
    max_spread = per.select(F.max("spread")).scalar()
    max_spread = F.when(F.coalesce(max_spread, F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(max_spread)
    scored = per.withColumn("_score", 0.6 * (F.col("error_count") / max_err) + 0.4 * (F.col("spread") / max_spread))
    # ties are compared at 9 digits so the order does not depend on summation order
    out = scored.orderBy(F.round("_score", 9).desc(), "sample_id")
    if limit is not None:
        out = out.limit(limit)
    return out.select("sample_id", "error_count", F.round("spread", 4).alias("confidence_spread"),
                      F.round("_score", 4).alias("score"))


def run_class_counts(ann: DataFrame, dataset_id: str, source: str, limit: int = 50) -> DataFrame:
    """Per class GT vs one run, GT desc (class name breaks ties), top ``limit``."""
    return (ann.filter(F.col("dataset_id") == dataset_id)
               .groupBy("category_name")
               .agg(F.count_if(F.col("source") == M.GT_SOURCE).alias("gt_count"),
                    F.count_if(F.col("source") == source).alias("pred_count"))
               .orderBy(F.col("gt_count").desc(), "category_name").limit(limit))


# Confidence buckets of the evidence histogram, lower bounds and labels.
CONF_BUCKETS = [(0.9, "0.9-1.0"), (0.7, "0.7-0.9"), (0.5, "0.5-0.7"), (0.3, "0.3-0.5"), (None, "0.0-0.3")]


def confidence_histogram(labels: DataFrame) -> DataFrame:
    """Per error type the count per confidence bucket; null confidences skipped, empty
    buckets absent."""
    c = F.col("confidence")
    b = None
    for lo, name in CONF_BUCKETS:
        if lo is None:
            b = b.otherwise(F.lit(name))
        else:
            b = F.when(c >= lo, F.lit(name)) if b is None else b.when(c >= lo, F.lit(name))
    return (labels.filter(c.isNotNull()).groupBy("error_type", b.alias("confidence_range"))
                  .agg(F.count("*").alias("count")).orderBy("error_type", "confidence_range"))


def tag_correlation(labels: DataFrame, samples: DataFrame, dataset_id: str, top: int = 10) -> DataFrame:
    """Per error type, tag counts over the *distinct* samples with that error type, top 10
    by count (tag name breaks ties)."""
    s = samples.filter(F.col("dataset_id") == dataset_id).select(F.col("id").alias("sample_id"), "tags")
    d = labels.select("error_type", "sample_id").distinct()
    t = d.join(s, "sample_id").select("error_type", F.explode("tags").alias("tag"))
    c = t.groupBy("error_type", "tag").agg(F.count("*").alias("count"))
    w = Window.partitionBy("error_type").orderBy(F.col("count").desc(), "tag")
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).drop("_r")


def error_evidence(ann: DataFrame, samples: DataFrame, dataset_id: str, source: str,
                   iou_threshold: float = 0.45, conf_threshold: float = 0.25, top_tags: int = 10) -> dict[str, DataFrame]:
    """The evidence tables handed to a report writer (summary, A7, A8, A9); ``top_tags`` per
    error type, ten as in the report by default."""
    labels = error_labels(ann, dataset_id, source, iou_threshold, conf_threshold)
    return {"summary": error_summary(labels), "per_class": run_class_counts(ann, dataset_id, source),
            "confidence": confidence_histogram(labels), "tags": tag_correlation(labels, samples, dataset_id, top_tags)}

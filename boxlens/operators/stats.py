"""Dataset statistics.

Each statistic is one aggregation pass; counts with conditions use ``count_if`` so GT and
prediction counts come from a single scan with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.operators.matching import GT_SOURCE, restrict_split


def class_distribution(ann: DataFrame, dataset_id: str, samples: DataFrame | None = None,
                       split: str | None = None) -> DataFrame:
    """A1: per category the GT count and the prediction count (all runs), GT desc."""
    a = restrict_split(ann.filter(F.col("dataset_id") == dataset_id), samples, split)
    return (a.groupBy("category_name")
             .agg(F.count_if(F.col("source") == GT_SOURCE).alias("gt_count"),
                  F.count_if(F.col("source") != GT_SOURCE).alias("pred_count"))
             .orderBy(F.col("gt_count").desc(), "category_name"))


def split_breakdown(samples: DataFrame, dataset_id: str) -> DataFrame:
    """A2: samples per split, null as 'unassigned', count desc (never split-filtered)."""
    return (samples.filter(F.col("dataset_id") == dataset_id)
                   .groupBy(F.coalesce("split", F.lit("unassigned")).alias("split_name"))
                   .agg(F.count("*").alias("count"))
                   .orderBy(F.col("count").desc(), "split_name"))


def summary_stats(samples: DataFrame, ann: DataFrame, dataset_id: str, split: str | None = None) -> DataFrame:
    """A3: total images, GT boxes, prediction boxes, distinct categories (one row).

    Two single-pass aggregates (samples, annotations); the one-row results are combined
    as scalar subqueries, never by a join."""
    s = samples.filter(F.col("dataset_id") == dataset_id)
    if split is not None:
        s = s.filter(F.col("split") == split)
    a = restrict_split(ann.filter(F.col("dataset_id") == dataset_id), samples, split)
    agg = a.agg(F.count_if(F.col("source") == GT_SOURCE).alias("gt_annotations"),
                F.count_if(F.col("source") != GT_SOURCE).alias("pred_annotations"),
                F.count_distinct("category_name").alias("total_categories"))
    return agg.select(s.select(F.count("*")).scalar().alias("total_images"), "gt_annotations",
                      "pred_annotations", "total_categories")


def facets(samples: DataFrame, ann: DataFrame, dataset_id: str) -> DataFrame:
    """A4: (facet, name, count) for categories, splits (not null), tags (unnested), sources."""
    a = ann.filter(F.col("dataset_id") == dataset_id)
    s = samples.filter(F.col("dataset_id") == dataset_id)
    cats = a.groupBy(F.col("category_name").alias("name")).agg(F.count("*").alias("count")).select(F.lit("category").alias("facet"), "name", "count")
    srcs = a.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("count")).select(F.lit("source").alias("facet"), "name", "count")
    splits = (s.filter(F.col("split").isNotNull()).groupBy(F.col("split").alias("name"))
               .agg(F.count("*").alias("count")).select(F.lit("split").alias("facet"), "name", "count"))
    tags = (s.select(F.explode("tags").alias("name")).groupBy("name")
             .agg(F.count("*").alias("count")).select(F.lit("tag").alias("facet"), "name", "count"))
    return cats.unionByName(splits).unionByName(tags).unionByName(srcs).orderBy("facet", "name")


def embedding_status(embeddings: DataFrame, dataset_id: str) -> DataFrame:
    """A5: vector count, model name, reduced count, has_embeddings, has_reduction."""
    e = embeddings.filter(F.col("dataset_id") == dataset_id)
    return (e.agg(F.count("*").alias("embedding_count"), F.max("model_name").alias("model_name"),
                  F.count("x").alias("reduced_count"))
             .select("*", (F.col("embedding_count") > 0).alias("has_embeddings"),
                     (F.col("reduced_count") > 0).alias("has_reduction")))


def row_normalize(matrix: DataFrame) -> DataFrame:
    """Each confusion cell divided by its row (actual class) total, 0 for empty rows.

    The row totals are a grouped aggregate joined back on the class (at most classes+1 rows
    per side), not a window over an unpartitioned frame."""
    tot = matrix.groupBy("actual").agg(F.sum("count").alias("_row"))
    return (matrix.join(tot, "actual")
                  .select("actual", "predicted", "count",
                          F.when(F.col("_row") > 0, F.col("count") / F.col("_row")).otherwise(0.0).alias("share")))


def error_shares(summary: DataFrame) -> DataFrame:
    """Each error type as a percentage of all classified boxes (one row in, four out)."""
    cols = ["true_positives", "hard_false_positives", "label_errors", "false_negatives"]
    total = sum(F.col(c) for c in cols)
    stacked = summary.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("error_type"), F.col(c).alias("count"),
                 F.when(total > 0, F.col(c) * 100.0 / total).otherwise(0.0).alias("percent"))
        for c in cols])).alias("r"))
    return stacked.select("r.*")

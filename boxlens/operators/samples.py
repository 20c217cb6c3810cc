"""Sample discovery: filters (F1-F16), sort and page (T1-T3), counting (A6), grouping (A10).

The filter "IR" is the DataFrame itself: each argument adds a Column predicate or a
semi-join, and Catalyst pushes equality/range predicates into the parquet scan (partition
pruning on ``dataset_id``) and prunes every column not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest literal id list accepted (bigger selections are DataFrames).
MAX_ID_LIST = 5000
# Sortable sample columns (anything else sorts by id).
SORTABLE_COLUMNS = ["id", "file_name", "width", "height", "split"]
# Triage tag prefix and the obsolete triage tags the grid no longer highlights.
TRIAGE_PREFIX = "triage:"
OBSOLETE_TRIAGE_TAGS = ["triage:tp", "triage:fp", "triage:fn", "triage:mistake"]
# The four sample-level triage tags that may be set.
TRIAGE_TAGS = ["triage:tp", "triage:fp", "triage:fn", "triage:mistake"]


def like_pattern(search: str) -> str:
    """F4 pattern: trimmed text inside ``%...%``; ``%`` and ``_`` stay wildcards; a backslash
    is literal (doubled, since Spark's LIKE treats it as the escape character, D14)."""
    return "%" + search.strip().replace("\\", "\\\\") + "%"


def split_list(c: Column) -> Column:
    """Comma-separated text -> list of trimmed, non-empty items (tags / id parameters)."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def list_datasets(datasets: DataFrame) -> DataFrame:
    """Datasets newest first (id breaks ties)."""
    return datasets.orderBy(F.col("created_at").desc_nulls_last(), "id")


def filter_samples(samples: DataFrame, dataset_id: str, *, annotations: DataFrame | None = None,
                   split: str | None = None, category: str | None = None, search: str | None = None,
                   tags: list[str] | None = None, sample_ids: DataFrame | list[str] | None = None,
                   min_width: int | None = None, min_height: int | None = None,
                   compat_empty_ids: bool = False) -> DataFrame:
    """F1-F7 (+F16): AND of all given conditions.

    * category (F3): samples with >= 1 annotation of that category in any source
      (``left_semi``, so no DISTINCT is needed afterwards).
    * sample_ids (F6): a list (``isin``) or a DataFrame with an ``id`` column (semi-join,
      for selections of any size).  ``None`` is no filter and ``[]`` selects no rows (D21);
      ``compat_empty_ids=True`` ignores an empty list.
    """
    conds: list[Column] = [F.col("dataset_id") == dataset_id]
    if split is not None:
        conds.append(F.col("split") == split)
    if search is not None and search.strip():
        conds.append(F.col("file_name").ilike(like_pattern(search)))
    for t in tags or []:
        conds.append(F.array_contains(F.col("tags"), t))
    if min_width is not None:
        conds.append(F.col("width") >= min_width)
    if min_height is not None:
        conds.append(F.col("height") >= min_height)
    ids_df = None
    if isinstance(sample_ids, list):
        if len(sample_ids) > MAX_ID_LIST:
            raise ValueError(f"at most {MAX_ID_LIST} sample ids per literal list; pass a DataFrame selection")
        if sample_ids:
            conds.append(F.col("id").isin(sample_ids))
        elif not compat_empty_ids:
            conds.append(F.lit(False))
    elif sample_ids is not None:
        ids_df = sample_ids
    out = samples.filter(reduce(lambda a, b: a & b, conds))
    if category is not None:
        a = (annotations.filter((F.col("dataset_id") == dataset_id) & (F.col("category_name") == category))
                        .select(F.col("sample_id").alias("id")))
        out = out.join(a, "id", "left_semi")
    if ids_df is not None:
        out = out.join(ids_df.select("id"), "id", "left_semi")
    return out


def sort_samples(df: DataFrame, sort_by: str | None = "id", sort_dir: str | None = "asc") -> DataFrame:
    """Allow-listed column, nulls last both ways (D13), id as tie-breaker."""
    if sort_by not in SORTABLE_COLUMNS:
        return df.orderBy(F.col("id").asc())
    c = F.col(sort_by)
    c = c.desc_nulls_last() if sort_dir == "desc" else c.asc_nulls_last()
    return df.orderBy(c, F.col("id").asc())


def _order(sort_by: str | None, sort_dir: str | None) -> list[Column]:
    c = F.col(sort_by if sort_by in SORTABLE_COLUMNS else "id")
    if sort_by not in SORTABLE_COLUMNS:
        return [c.asc()]
    return [c.desc_nulls_last() if sort_dir == "desc" else c.asc_nulls_last(), F.col("id").asc()]


def store_order(df: DataFrame, path: str, sort_by: str | None = "id", sort_dir: str | None = "asc", partitions: int | None = None) -> None:
    """T2 for deep pages: store ``df`` in ranges of its order (T1) with the number of rows of each.

    A range is a folder ``part=n`` of ``path/rows``; the counts are a small table beside it.  ``partitions``
    (the session's shuffle partitions by default) bounds a range to about its share of the rows."""
    order = _order(sort_by, sort_dir)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ranges.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    stored.groupBy("part").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def seek_page(spark: SparkSession, path: str, offset: int = 0, limit: int = 50, sort_by: str | None = "id",
              sort_dir: str | None = "asc") -> DataFrame:
    """A page of an order stored by ``store_order`` (of the same sort): only the ranges that the page lies in are
    read and sorted, however many rows come before."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be in [1, 200] and offset >= 0")
    counts = sorted((r["part"], r["n"]) for r in spark.read.parquet(f"{path}/counts").collect())     # a row a range
    before, first, parts = 0, 0, []
    for part, n in counts:
        if before < offset + limit and before + n > offset:
            first = before if not parts else first
            parts.append(part)
        before += n
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(parts)).drop("part")
    return rows.orderBy(*_order(sort_by, sort_dir)).offset(max(0, offset - first)).limit(limit)


def page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page after a total order (limit 1-200)."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be in [1, 200] and offset >= 0")
    return df.offset(offset).limit(limit)


def count_matching(df: DataFrame) -> DataFrame:
    """Total number of matching samples (one row)."""
    return df.agg(F.count("*").alias("total"))


def source_filter(annotations: DataFrame, sources: list[str] | None) -> DataFrame:
    """F8: rows of the given sources (ground truth, runs); all without a selection."""
    return annotations.filter(F.col("source").isin(sources)) if sources else annotations


def annotations_by_sample(annotations: DataFrame, dataset_id: str, sample_ids: DataFrame | None = None,
                          sources: list[str] | None = None) -> DataFrame:
    """A10 (+F8), long format: the annotations of the selected samples ordered by (sample_id,
    id).  The sort is a range-partitioned global sort, so one image with a third of all boxes
    is still spread over many tasks."""
    a = source_filter(annotations.filter(F.col("dataset_id") == dataset_id), sources)
    if sample_ids is not None:
        a = a.join(sample_ids.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    return a.orderBy("sample_id", "id")


def group_annotations(annotations: DataFrame, dataset_id: str, sample_ids: DataFrame,
                      sources: list[str] | None = None) -> DataFrame:
    """A10 nested: annotations per sample as a sorted list of structs, for a *page* of samples
    (the selection is required: a list per sample is only bounded for a bounded selection)."""
    a = source_filter(annotations.filter(F.col("dataset_id") == dataset_id), sources)
    a = a.join(sample_ids.select(F.col("id").alias("sample_id")), "sample_id", "left_semi")
    return (a.groupBy("sample_id")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "id", "dataset_id", "category_name", "source", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area", "is_crowd",
                 "confidence"))).alias("annotations")))


def highlight(tags: Column) -> Column:
    """sample carries a visible ``triage:*`` tag (obsolete tags ignored)."""
    obsolete = F.array(*[F.lit(t) for t in OBSOLETE_TRIAGE_TAGS])
    return F.coalesce(F.exists(F.array_except(tags, obsolete), lambda t: t.startswith(TRIAGE_PREFIX)), F.lit(False))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """F12 lasso: even-odd ray test over the polygon's literal edges, boundary included;
    fewer than 3 vertices selects nothing.  Callers add the bounding-box pre-filter
    (``lasso_filter``) so parquet min/max statistics can skip row groups."""
    n = len(polygon)
    if n < 3:
        return F.lit(False)
    inside = F.lit(False)
    on_edge = F.lit(False)
    for i in range(n):
        xi, yi = polygon[i]
        xj, yj = polygon[i - 1]
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (
            x < F.lit(xj - xi) * (y - F.lit(yi)) / F.lit((yj - yi) if yj != yi else 1.0) + F.lit(xi))
        inside = F.when(crosses, ~inside).otherwise(inside)
        cross = (F.lit(xj - xi) * (y - F.lit(yi))) - (F.lit(yj - yi) * (x - F.lit(xi)))
        within = ((x >= min(xi, xj)) & (x <= max(xi, xj)) & (y >= min(yi, yj)) & (y <= max(yi, yj)))
        on_edge = on_edge | ((F.abs(cross) <= F.lit(1e-12)) & within)
    return inside | on_edge


def lasso_filter(points: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """F10 + F12: reduced points (x, y not null) inside the polygon."""
    pts = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if len(polygon) < 3:
        return pts.limit(0)
    xs = [p[0] for p in polygon]
    ys = [p[1] for p in polygon]
    pts = pts.filter(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    return pts.filter(in_polygon(F.col("x"), F.col("y"), polygon))


def combine_selection(lasso_ids: list[str] | None, discovery_ids: list[str] | None) -> list[str] | None:
    """a lasso selection overrides the discovery selection."""
    return lasso_ids if lasso_ids is not None else discovery_ids


VIEW_SCHEMA = "search string, category string, split string, tags array<string>, sortBy string, sortDir string"


def apply_saved_view(samples: DataFrame, annotations: DataFrame, views: DataFrame, dataset_id: str) -> DataFrame:
    """F14 for every saved view at once: (view_id, sample id) of the samples each view selects.

    The view JSON is parsed with ``from_json``; views meet the samples of their dataset in an
    equi-join on dataset_id with the conditions behind it, the category condition becomes a
    semi-join on (view, sample) pairs."""
    v = (views.filter(F.col("dataset_id") == dataset_id)
              .select("dataset_id", F.col("id").alias("view_id"), F.from_json("filters", VIEW_SCHEMA).alias("f")))
    s = samples.filter(F.col("dataset_id") == dataset_id)
    term = F.trim(F.col("f.search"))
    cond = ((F.col("f.split").isNull() | (F.col("split") == F.col("f.split")))
            & (term.isNull() | (term == "") |
               F.ilike(F.col("file_name"), F.concat(F.lit("%"), F.regexp_replace(term, r"\\", r"\\\\"), F.lit("%"))))
            & F.coalesce(F.forall(F.col("f.tags"), lambda t: F.coalesce(F.array_contains(F.col("tags"), t), F.lit(False))),
                         F.lit(True)))
    s, vv = s.alias("s"), v.withColumnRenamed("dataset_id", "v_dataset")
    hit = s.join(vv, (F.col("dataset_id") == F.col("v_dataset")) & cond).select("view_id", "id", F.col("f.category").alias("cat"))
    a = (annotations.filter(F.col("dataset_id") == dataset_id)
                    .select(F.col("sample_id").alias("id"), F.col("category_name").alias("cat")).distinct())
    with_cat = hit.filter(F.col("cat").isNotNull()).join(a, ["id", "cat"], "left_semi")
    return hit.filter(F.col("cat").isNull()).unionByName(with_cat).select("view_id", "id")


def saved_view_order(samples: DataFrame, annotations: DataFrame, views: DataFrame, dataset_id: str) -> DataFrame:
    """F14 with the views' sort: (view_id, id, pos), pos from 1 in the order of the view's sortBy and
    sortDir (T1's rules: unknown columns sort by id ascending, nulls last, id breaks ties).

    Positions come from the distributed running count, so a view that selects every sample is
    not one task."""
    from boxlens.operators.cumulative import running_counts
    v = (views.filter(F.col("dataset_id") == dataset_id)
              .select(F.col("id").alias("view_id"), F.from_json("filters", VIEW_SCHEMA).alias("f"))
              .select("view_id", F.col("f.sortBy").alias("by"), (F.col("f.sortDir") == "desc").alias("desc")))
    cols = samples.filter(F.col("dataset_id") == dataset_id).select("id", *[c for c in SORTABLE_COLUMNS if c != "id"])
    hit = apply_saved_view(samples, annotations, views, dataset_id).join(cols, "id").join(v, "view_id")
    known = F.col("by").isin(SORTABLE_COLUMNS)
    down = F.coalesce(known & F.col("desc"), F.lit(False))
    number = F.when(F.col("by") == "width", F.col("width")).when(F.col("by") == "height", F.col("height")).cast("double")
    text = F.when(F.col("by") == "file_name", F.col("file_name")).when(F.col("by") == "split", F.col("split")).when(F.col("by") == "id", F.col("id"))
    # one pair of order columns per direction: the other direction's are null throughout a view
    hit = hit.select("view_id", "id", F.lit(0).alias("_z"), F.when(~down, number).alias("n_up"), F.when(down, number).alias("n_down"),
                     F.when(~down, text).alias("t_up"), F.when(down, text).alias("t_down"))
    order = [F.col("n_up").asc_nulls_last(), F.col("n_down").desc_nulls_last(), F.col("t_up").asc_nulls_last(),
             F.col("t_down").desc_nulls_last(), F.col("id").asc()]
    return running_counts(hit, ["view_id"], order, "_z").select("view_id", "id", F.col("rank").alias("pos"))

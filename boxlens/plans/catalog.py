"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Every query reads the driver's tables (through ``boxlens.fixtures``) so its work grows with
the scale factor; doubles are rounded to 9 digits and arrays rendered sorted so that the
two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.fixtures import DATASET, RUN_A, derived, duck_with
from boxlens.operators import errors as E
from boxlens.plans.sqlkit import error_label_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(c: str):
    return F.round(F.col(c), 9).alias(c)


def W(*ctes: str) -> str:
    return duck_with(*ctes)


# ---------------------------------------------------------------------------------------
# E9 error analysis and what is derived from it
# ---------------------------------------------------------------------------------------

def _labels(spark, sf_dir, iou=0.5, conf=0.25):
    d = derived(spark, sf_dir)
    return E.error_labels(d.annotations, DATASET, RUN_A, iou, conf)


@query("E9_error_summary", W(*error_label_ctes()) + """
SELECT COUNT(*) FILTER (WHERE error_type='tp') true_positives,
       COUNT(*) FILTER (WHERE error_type='hard_fp') hard_false_positives,
       COUNT(*) FILTER (WHERE error_type='label_error') label_errors,
       COUNT(*) FILTER (WHERE error_type='false_negative') false_negatives FROM labels""")
def e9_summary(spark, sf_dir):
    return E.error_summary(_labels(spark, sf_dir))


@query("E9_error_per_class", W(*error_label_ctes()) + """
SELECT category_name class_name,
       COUNT(*) FILTER (WHERE error_type='tp') tp, COUNT(*) FILTER (WHERE error_type='hard_fp') hard_fp,
       COUNT(*) FILTER (WHERE error_type='label_error') label_error,
       COUNT(*) FILTER (WHERE error_type='false_negative') fn
FROM labels GROUP BY category_name ORDER BY class_name""")
def e9_per_class(spark, sf_dir):
    return E.error_per_class(_labels(spark, sf_dir))


@query("E9_error_labels", W(*error_label_ctes()) + """
SELECT sample_id, annotation_id, error_type, category_name, ROUND(confidence, 9) confidence, matched_id,
       ROUND(iou, 9) iou FROM labels""")
def e9_labels(spark, sf_dir):
    lab = _labels(spark, sf_dir)
    return lab.select("sample_id", "annotation_id", "error_type", "category_name", r9("confidence"),
                      "matched_id", r9("iou"))


def _d(spark, sf_dir):
    return derived(spark, sf_dir)


def tags_str(c: str = "tags"):
    return F.array_join(F.array_sort(F.col(c)), "|").alias(c)


TAGS_SQL = "array_to_string(list_sort(tags), '|') tags"

# ---------------------------------------------------------------------------------------
# E9 derived: W6, T7, E10, E11, A7, A8, A9, A12
# ---------------------------------------------------------------------------------------
from boxlens.operators import stats as S  # noqa: E402
from boxlens.operators import samples as SM  # noqa: E402
from boxlens.operators import mutate as MU  # noqa: E402
from boxlens.plans.sqlkit import argmax_ctes  # noqa: E402

_ORDER_SQL = ("sample_id, CASE WHEN error_type='false_negative' THEN 1 ELSE 0 END, "
              "COALESCE(confidence, 1.0) DESC, annotation_id")


@query("W6_error_samples_top50", W(*error_label_ctes()) + f"""
SELECT error_type, sample_id, category_name, ROUND(confidence, 9) confidence, annotation_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY {_ORDER_SQL}) r FROM labels) WHERE r <= 50""")
def w6(spark, sf_dir):
    return E.error_samples(_labels(spark, sf_dir), cap=50).select(
        "error_type", "sample_id", "category_name", r9("confidence"), "annotation_id")


@query("T7_first_error_per_sample", W(*error_label_ctes()) + """
SELECT error_type, sample_id, category_name, ROUND(confidence, 9) confidence, annotation_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY error_type, sample_id ORDER BY COALESCE(confidence,1.0) DESC, annotation_id) r
  FROM labels) WHERE r = 1""")
def t7(spark, sf_dir):
    return E.first_error_per_sample(_labels(spark, sf_dir)).select(
        "error_type", "sample_id", "category_name", r9("confidence"), "annotation_id")


def _triage_sql(with_overrides: bool) -> str:
    base = W(*argmax_ctes("run_a", 0.45, 0.25)) + """,
auto AS (
  SELECT P.sample_id, P.id annotation_id,
         CASE WHEN c.p_id IS NULL THEN 'fp' WHEN c.p_cat = c.g_cat THEN 'tp' ELSE 'label_error' END auto_label,
         c.g_id matched_id, c.iou FROM P LEFT JOIN claim c ON c.p_id = P.id
  UNION ALL
  SELECT G.sample_id, G.id, CASE WHEN c.p_id IS NULL THEN 'fn' ELSE 'tp' END, c.p_id, c.iou
  FROM G LEFT JOIN claim c ON c.g_id = G.id),
ov AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY annotation_id, dataset_id
                                                   ORDER BY created_at DESC, label DESC) r FROM overrides) WHERE r = 1)
"""
    if not with_overrides:
        return base + "SELECT sample_id, annotation_id, auto_label, matched_id, ROUND(iou, 9) iou, auto_label label, false is_override FROM auto"
    return base + """SELECT a.sample_id, a.annotation_id, a.auto_label, a.matched_id, ROUND(a.iou, 9) iou,
       COALESCE(ov.label, a.auto_label) label, ov.label IS NOT NULL is_override
FROM auto a LEFT JOIN ov ON ov.annotation_id = a.annotation_id"""


@query("E10_annotation_triage", _triage_sql(True))
def e10(spark, sf_dir):
    d = _d(spark, sf_dir)
    t = E.annotation_triage(d.annotations, DATASET, RUN_A, 0.45, 0.25, overrides=d.overrides)
    return t.select("sample_id", "annotation_id", "auto_label", "matched_id", r9("iou"), "label", "is_override")


@query("F11_triage_label_filter", _triage_sql(True).replace(
    "FROM auto a LEFT JOIN ov ON ov.annotation_id = a.annotation_id",
    "FROM auto a LEFT JOIN ov ON ov.annotation_id = a.annotation_id WHERE COALESCE(ov.label, a.auto_label) = 'label_error'"))
def f11(spark, sf_dir):
    return e10(spark, sf_dir).filter(F.col("label") == "label_error")


@query("E11_worst_images", W(*error_label_ctes()) + """,
per AS (SELECT sample_id, COUNT(*) error_count, COUNT(confidence) n, STDDEV_POP(confidence) sd
        FROM labels WHERE error_type <> 'tp' GROUP BY sample_id),
sp AS (SELECT *, CASE WHEN n >= 2 THEN sd ELSE 0.0 END spread FROM per),
mx AS (SELECT MAX(error_count) me, CASE WHEN COALESCE(MAX(spread), 0.0) = 0.0 THEN 1.0 ELSE MAX(spread) END ms FROM sp)
SELECT sample_id, error_count, ROUND(spread, 4) confidence_spread, ROUND(score, 4) score FROM (
  SELECT sp.*, 0.6 * (error_count / me) + 0.4 * (spread / ms) score FROM sp, mx)
ORDER BY ROUND(score, 9) DESC, sample_id LIMIT 50""")
def e11(spark, sf_dir):
    return E.worst_images(_labels(spark, sf_dir), limit=50)


@query("A7_run_class_counts", W() + """
SELECT category_name, COUNT(*) FILTER (WHERE source='ground_truth') gt_count,
       COUNT(*) FILTER (WHERE source='run_a') pred_count
FROM annotations WHERE dataset_id='ds1' GROUP BY category_name ORDER BY gt_count DESC, category_name LIMIT 50""")
def a7(spark, sf_dir):
    return E.run_class_counts(_d(spark, sf_dir).annotations, DATASET, RUN_A)


@query("A8_confidence_histogram", W(*error_label_ctes()) + """
SELECT error_type, CASE WHEN confidence >= 0.9 THEN '0.9-1.0' WHEN confidence >= 0.7 THEN '0.7-0.9'
                        WHEN confidence >= 0.5 THEN '0.5-0.7' WHEN confidence >= 0.3 THEN '0.3-0.5'
                        ELSE '0.0-0.3' END confidence_range, COUNT(*) count
FROM labels WHERE confidence IS NOT NULL GROUP BY ALL""")
def a8(spark, sf_dir):
    return E.confidence_histogram(_labels(spark, sf_dir))


@query("A9_tag_correlation", W(*error_label_ctes()) + """,
t AS (SELECT d.error_type, UNNEST(s.tags) tag FROM (SELECT DISTINCT error_type, sample_id FROM labels) d
      JOIN samples s ON s.id = d.sample_id),
c AS (SELECT error_type, tag, COUNT(*) count FROM t GROUP BY ALL)
SELECT error_type, tag, count FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY count DESC, tag) r FROM c) WHERE r <= 10""")
def a9(spark, sf_dir):
    d = _d(spark, sf_dir)
    return E.tag_correlation(_labels(spark, sf_dir), d.samples, DATASET)


@query("A12_error_shares", W(*error_label_ctes()) + """,
s AS (SELECT COUNT(*) FILTER (WHERE error_type='tp') true_positives,
             COUNT(*) FILTER (WHERE error_type='hard_fp') hard_false_positives,
             COUNT(*) FILTER (WHERE error_type='label_error') label_errors,
             COUNT(*) FILTER (WHERE error_type='false_negative') false_negatives FROM labels),
u AS (SELECT 'true_positives' error_type, true_positives count, * FROM s
      UNION ALL SELECT 'hard_false_positives', hard_false_positives, * FROM s
      UNION ALL SELECT 'label_errors', label_errors, * FROM s
      UNION ALL SELECT 'false_negatives', false_negatives, * FROM s)
SELECT error_type, count, ROUND(CASE WHEN (true_positives+hard_false_positives+label_errors+false_negatives) > 0
    THEN count * 100.0 / (true_positives+hard_false_positives+label_errors+false_negatives) ELSE 0 END, 9) percent FROM u""")
def a12(spark, sf_dir):
    return S.error_shares(E.error_summary(_labels(spark, sf_dir))).select("error_type", "count", r9("percent"))


# ---------------------------------------------------------------------------------------
# Statistics A1-A6, A10
# ---------------------------------------------------------------------------------------

@query("A1_class_distribution", W() + """
SELECT category_name, COUNT(*) FILTER (WHERE source='ground_truth') gt_count,
       COUNT(*) FILTER (WHERE source<>'ground_truth') pred_count
FROM annotations WHERE dataset_id='ds1' GROUP BY category_name""")
def a1(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.class_distribution(d.annotations, DATASET)


@query("A1_class_distribution_split", W() + """
SELECT a.category_name, COUNT(*) FILTER (WHERE a.source='ground_truth') gt_count,
       COUNT(*) FILTER (WHERE a.source<>'ground_truth') pred_count
FROM annotations a JOIN samples s ON a.sample_id = s.id AND a.dataset_id = s.dataset_id
WHERE a.dataset_id='ds1' AND s.split='train' GROUP BY a.category_name""")
def a1s(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.class_distribution(d.annotations, DATASET, d.samples, "train")


@query("A2_split_breakdown", W() + """
SELECT COALESCE(split, 'unassigned') split_name, COUNT(*) count FROM samples WHERE dataset_id='ds1' GROUP BY 1""")
def a2(spark, sf_dir):
    return S.split_breakdown(_d(spark, sf_dir).samples, DATASET)


@query("A3_summary_stats", W() + """
SELECT (SELECT COUNT(*) FROM samples WHERE dataset_id='ds1') total_images,
       (SELECT COUNT(*) FROM annotations WHERE dataset_id='ds1' AND source='ground_truth') gt_annotations,
       (SELECT COUNT(*) FROM annotations WHERE dataset_id='ds1' AND source<>'ground_truth') pred_annotations,
       (SELECT COUNT(DISTINCT category_name) FROM annotations WHERE dataset_id='ds1') total_categories""")
def a3(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.summary_stats(d.samples, d.annotations, DATASET)


@query("A3_summary_stats_split", W() + """
SELECT (SELECT COUNT(*) FROM samples WHERE dataset_id='ds1' AND split='val') total_images,
       (SELECT COUNT(*) FROM annotations a JOIN samples s ON a.sample_id=s.id AND a.dataset_id=s.dataset_id
        WHERE a.dataset_id='ds1' AND a.source='ground_truth' AND s.split='val') gt_annotations,
       (SELECT COUNT(*) FROM annotations a JOIN samples s ON a.sample_id=s.id AND a.dataset_id=s.dataset_id
        WHERE a.dataset_id='ds1' AND a.source<>'ground_truth' AND s.split='val') pred_annotations,
       (SELECT COUNT(DISTINCT a.category_name) FROM annotations a JOIN samples s ON a.sample_id=s.id
        AND a.dataset_id=s.dataset_id WHERE a.dataset_id='ds1' AND s.split='val') total_categories""")
def a3s(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.summary_stats(d.samples, d.annotations, DATASET, "val")


@query("A4_facets", W() + """
SELECT 'category' facet, category_name name, COUNT(*) count FROM annotations WHERE dataset_id='ds1' GROUP BY 2
UNION ALL SELECT 'split', split, COUNT(*) FROM samples WHERE dataset_id='ds1' AND split IS NOT NULL GROUP BY 2
UNION ALL SELECT 'tag', tag, COUNT(*) FROM (SELECT UNNEST(tags) tag FROM samples WHERE dataset_id='ds1' AND tags IS NOT NULL) GROUP BY 2
UNION ALL SELECT 'source', source, COUNT(*) FROM annotations WHERE dataset_id='ds1' GROUP BY 2""")
def a4(spark, sf_dir):
    d = _d(spark, sf_dir)
    return S.facets(d.samples, d.annotations, DATASET)


@query("A5_embedding_status", W() + """
SELECT COUNT(*) embedding_count, MAX(model_name) model_name, COUNT(x) reduced_count,
       COUNT(*) > 0 has_embeddings, COUNT(x) > 0 has_reduction FROM emb_xy WHERE dataset_id='ds1'""")
def a5(spark, sf_dir):
    return S.embedding_status(_d(spark, sf_dir).embeddings, DATASET)


_ANN_OUT = ["sample_id", "id", "category_name", "source", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area", "confidence"]


def _ann_out(df):
    return df.select(*[r9(c) if c in ("area", "confidence") or c.startswith("bbox") else c for c in _ANN_OUT])


_ANN_SQL = ", ".join(f"ROUND({c}, 9) {c}" if c in ("area", "confidence") or c.startswith("bbox") else c for c in _ANN_OUT)


@query("A10_group_annotations", W() + f"""
SELECT {_ANN_SQL} FROM annotations WHERE dataset_id='ds1' AND source IN ('ground_truth', 'run_b')""")
def a10(spark, sf_dir):
    return _ann_out(SM.annotations_by_sample(_d(spark, sf_dir).annotations, DATASET, sources=["ground_truth", "run_b"]))


# ---------------------------------------------------------------------------------------
# Filters F1-F16, sort/page T1-T3
# ---------------------------------------------------------------------------------------

_SAMPLE_COLS_SQL = f"id, file_name, width, height, split, {TAGS_SQL}"


def _sample_out(df):
    return df.select("id", "file_name", "width", "height", "split", tags_str())


@query("F7_filter_samples", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples s WHERE dataset_id='ds1' AND split='train' AND file_name ILIKE '%img_1%'
  AND list_contains(tags, '1-URGENT')
  AND EXISTS (SELECT 1 FROM annotations a WHERE a.sample_id = s.id AND a.dataset_id = s.dataset_id AND a.category_name='A')""")
def f7(spark, sf_dir):
    d = _d(spark, sf_dir)
    return _sample_out(SM.filter_samples(d.samples, DATASET, annotations=d.annotations, split="train",
                                         category="A", search=" img_1 ", tags=["1-URGENT"]))


@query("F3_category_filter", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples s WHERE dataset_id='ds1'
  AND EXISTS (SELECT 1 FROM annotations a WHERE s.id = a.sample_id AND a.dataset_id = s.dataset_id AND a.category_name='N')""")
def f3(spark, sf_dir):
    d = _d(spark, sf_dir)
    return _sample_out(SM.filter_samples(d.samples, DATASET, annotations=d.annotations, category="N"))


@query("F4_search_wildcards", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples WHERE dataset_id='ds1' AND file_name ILIKE '%IMG_1_3%'""")
def f4(spark, sf_dir):
    return _sample_out(SM.filter_samples(_d(spark, sf_dir).samples, DATASET, search="  IMG_1_3 "))


@query("F5_tags_all", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples WHERE dataset_id='ds1' AND list_contains(tags, 'triage:fp')
  AND list_contains(tags, '2-HIGH')""")
def f5(spark, sf_dir):
    return _sample_out(SM.filter_samples(_d(spark, sf_dir).samples, DATASET, tags=["triage:fp", "2-HIGH"]))


@query("F6_sample_id_set", W(*error_label_ctes()) + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples WHERE dataset_id='ds1'
  AND id IN (SELECT sample_id FROM labels WHERE error_type='label_error')""")
def f6(spark, sf_dir):
    d = _d(spark, sf_dir)
    ids = _labels(spark, sf_dir).filter(F.col("error_type") == "label_error").select(F.col("sample_id").alias("id"))
    return _sample_out(SM.filter_samples(d.samples, DATASET, sample_ids=ids))


@query("F16_min_size", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples WHERE dataset_id='ds1' AND width >= 1280 AND height >= 960 AND split = 'val'""")
def f16(spark, sf_dir):
    return _sample_out(SM.filter_samples(_d(spark, sf_dir).samples, DATASET, split="val", min_width=1280, min_height=960))


@query("F8_source_filter", W() + f"""
SELECT {_ANN_SQL} FROM annotations WHERE dataset_id='ds1' AND source IN ('ground_truth', 'run_b')""")
def f8(spark, sf_dir):
    a = _d(spark, sf_dir).annotations.filter(F.col("dataset_id") == DATASET)
    return _ann_out(SM.source_filter(a, ["ground_truth", "run_b"]))


@query("F9_confidence_threshold", W() + f"""
SELECT {_ANN_SQL} FROM annotations WHERE dataset_id='ds1' AND source = 'run_a' AND COALESCE(confidence, 1.0) >= 0.6""")
def f9(spark, sf_dir):
    p = MT.predictions(_d(spark, sf_dir).annotations.withColumn("_a", F.col("area")), DATASET, RUN_A, conf_threshold=0.6)
    return p.select("sample_id", "id", "category_name", F.lit(RUN_A).alias("source"), *[r9(c) for c in _ANN_OUT[4:8]],
                    F.round(F.col("bbox_w") * F.col("bbox_h"), 9).alias("area"), r9("confidence"))


@query("F13_highlight", W() + """
SELECT id, COALESCE(list_bool_or(list_transform(
         list_filter(tags, lambda t: t NOT IN ('triage:tp','triage:fp','triage:fn','triage:mistake')),
         lambda t: starts_with(t, 'triage:'))), false) highlighted
FROM (SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN list_append(COALESCE(tags, []), 'triage:annotated')
                      ELSE tags END tags FROM samples)""")
def f13(spark, sf_dir):
    s = _d(spark, sf_dir).samples
    s = s.withColumn("tags", F.when(F.col("id").cast("long") % 7 == 0,
                                    F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit("triage:annotated")))
                              .otherwise(F.col("tags")))
    return s.select("id", SM.highlight(F.col("tags")).alias("highlighted"))


_POLY = [(-0.5, -0.5), (0.6, -0.4), (0.7, 0.5), (0.0, 0.9), (-0.6, 0.3)]


def _poly_sql(poly) -> str:
    xs = [p[0] for p in poly]
    ys = [p[1] for p in poly]
    parts, edge = [], []
    for i in range(len(poly)):
        xi, yi = poly[i]
        xj, yj = poly[i - 1]
        den = (yj - yi) if yj != yi else 1.0
        parts.append(f"CASE WHEN (({yi} > y) <> ({yj} > y)) AND (x < {xj - xi} * (y - {yi}) / {den} + {xi}) THEN 1 ELSE 0 END")
        edge.append(f"(ABS(({xj - xi} * (y - {yi})) - ({yj - yi} * (x - {xi}))) <= 1e-12 AND x >= {min(xi, xj)} AND "
                    f"x <= {max(xi, xj)} AND y >= {min(yi, yj)} AND y <= {max(yi, yj)})")
    return (f"x IS NOT NULL AND y IS NOT NULL AND x BETWEEN {min(xs)} AND {max(xs)} AND y BETWEEN {min(ys)} AND {max(ys)} "
            f"AND ((({' + '.join(parts)}) % 2 = 1) OR {' OR '.join(edge)})")


@query("F12_lasso", W() + f"SELECT sample_id FROM emb_xy WHERE dataset_id='ds1' AND {_poly_sql(_POLY)}")
def f12(spark, sf_dir):
    e = _d(spark, sf_dir).embeddings.filter(F.col("dataset_id") == DATASET)
    return SM.lasso_filter(e, _POLY).select("sample_id")


@query("F15_combined_selection", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples WHERE dataset_id='ds1' AND split='train'
  AND id IN (SELECT sample_id FROM emb_xy WHERE {_poly_sql(_POLY)})""")
def f15(spark, sf_dir):
    d = _d(spark, sf_dir)
    lasso = SM.lasso_filter(d.embeddings.filter(F.col("dataset_id") == DATASET), _POLY).select(F.col("sample_id").alias("id"))
    sel = SM.combine_selection(lasso, None)
    return _sample_out(SM.filter_samples(d.samples, DATASET, split="train", sample_ids=sel))


@query("F14_apply_saved_views", W() + """,
v AS (SELECT id view_id, json_extract_string(filters, '$.search') search, json_extract_string(filters, '$.category') category,
             json_extract_string(filters, '$.split') split, CAST(json_extract(filters, '$.tags') AS VARCHAR[]) tags FROM views)
SELECT v.view_id, s.id FROM samples s, v
WHERE s.dataset_id='ds1' AND (v.split IS NULL OR s.split = v.split)
  AND (v.search IS NULL OR trim(v.search) = '' OR s.file_name ILIKE '%' || trim(v.search) || '%')
  AND COALESCE(list_bool_and(list_transform(v.tags, lambda t: COALESCE(list_contains(s.tags, t), false))), true)
  AND (v.category IS NULL OR EXISTS (SELECT 1 FROM annotations a WHERE a.sample_id = s.id AND a.category_name = v.category))""")
def f14(spark, sf_dir):
    d = _d(spark, sf_dir)
    return SM.apply_saved_view(d.samples, d.annotations, d.views, DATASET)


@query("T1_sort_samples", W() + """
SELECT id, width, split, ROW_NUMBER() OVER (ORDER BY split DESC NULLS LAST, id) pos FROM samples WHERE dataset_id='ds1'""")
def t1(spark, sf_dir):
    s = SM.sort_samples(_d(spark, sf_dir).samples.filter(F.col("dataset_id") == DATASET), "split", "desc")
    # materialise the order as a position column so the comparison is order-aware
    # positions of the total order, by the distributed running count (no single-task window)
    from boxlens.operators.cumulative import running_counts
    r = running_counts(s.select("id", "width", "split", F.lit(0).alias("_z")), [],
                       [F.col("split").desc_nulls_last(), F.col("id").asc()], "_z")
    return r.select("id", "width", "split", F.col("rank").alias("pos"))


@query("T2_page", W() + f"""
SELECT {_SAMPLE_COLS_SQL} FROM samples WHERE dataset_id='ds1' ORDER BY width DESC NULLS LAST, id LIMIT 200 OFFSET 400""")
def t2(spark, sf_dir):
    s = SM.sort_samples(_d(spark, sf_dir).samples.filter(F.col("dataset_id") == DATASET), "width", "desc")
    return _sample_out(SM.page(s, 400, 200))


@query("T2_count_matching", W() + """SELECT COUNT(*) total FROM samples WHERE dataset_id='ds1' AND split='val'""")
def t2c(spark, sf_dir):
    return SM.count_matching(SM.filter_samples(_d(spark, sf_dir).samples, DATASET, split="val"))


# ---------------------------------------------------------------------------------------
# Mutations M3-M18 (selections are derived from the data, so work grows with it)
# ---------------------------------------------------------------------------------------

def _sel(spark, sf_dir, etype):
    return (_labels(spark, sf_dir).filter(F.col("error_type") == etype)
            .select(F.lit(DATASET).alias("dataset_id"), F.col("sample_id").alias("id")))


def _sel_sql(etype):
    return f"(SELECT sample_id FROM labels WHERE error_type = '{etype}')"


def _tag_query(name, etype, spark_fn, sql_expr):
    sql = W(*error_label_ctes()) + f"""
SELECT id, CASE WHEN id IN {_sel_sql(etype)} THEN array_to_string(list_sort({sql_expr}), '|')
                ELSE array_to_string(list_sort(tags), '|') END tags FROM samples"""

    def fn(spark, sf_dir):
        d = _d(spark, sf_dir)
        return spark_fn(d.samples, _sel(spark, sf_dir, etype)).select("id", tags_str())
    query(name, sql)(fn)


_tag_query("M8_add_tag", "label_error", lambda s, sel: MU.add_tag(s, sel, "review"),
           "list_distinct(list_append(COALESCE(tags, []), 'review'))")
_tag_query("M9_remove_tag", "false_negative", lambda s, sel: MU.remove_tag(s, sel, "1-URGENT"),
           "list_filter(COALESCE(tags, []), lambda t: t <> '1-URGENT')")
_tag_query("M10_set_triage_tag", "tp", lambda s, sel: MU.set_triage_tag(s, sel, "triage:tp"),
           "list_distinct(list_append(list_filter(COALESCE(tags, []), lambda t: NOT starts_with(t, 'triage:')), 'triage:tp'))")
_tag_query("M11_clear_triage_tag", "hard_fp", lambda s, sel: MU.clear_triage_tag(s, sel),
           "list_filter(COALESCE(tags, []), lambda t: NOT starts_with(t, 'triage:'))")


@query("M14_merge_tags", W() + """,
gen AS (SELECT sample_id, list_distinct(list(DISTINCT 'cls:' || lower(category_name))) new_tags
        FROM annotations WHERE source = 'ground_truth' GROUP BY sample_id)
SELECT s.id, array_to_string(list_sort(CASE WHEN g.new_tags IS NULL THEN s.tags
                                           ELSE list_distinct(list_concat(COALESCE(s.tags, []), g.new_tags)) END), '|') tags
FROM samples s LEFT JOIN gen g ON g.sample_id = s.id""")
def m14(spark, sf_dir):
    d = _d(spark, sf_dir)
    gen = (d.annotations.filter(F.col("source") == "ground_truth")
           .groupBy("dataset_id", F.col("sample_id").alias("id"))
           .agg(F.collect_set(F.concat(F.lit("cls:"), F.lower("category_name"))).alias("new_tags")))
    return MU.merge_tags(d.samples, gen).select("id", tags_str())


def _new_overrides_spark(spark, sf_dir):
    d = _d(spark, sf_dir)
    t = E.annotation_triage(d.annotations, DATASET, RUN_A, 0.45, 0.25)
    return (t.filter(F.col("auto_label") == "label_error")
             .select("annotation_id", "dataset_id", "sample_id", F.lit("mistake").alias("label"),
                     F.lit("2024-02-01 00:00:00").cast("timestamp").alias("created_at")))


_NEW_OV_SQL = _triage_sql(False).split("SELECT sample_id, annotation_id, auto_label, matched_id")[0] + """,
newov AS (SELECT annotation_id, 'ds1' dataset_id, sample_id, 'mistake' label, true is_override,
                 TIMESTAMP '2024-02-01 00:00:00' created_at FROM auto WHERE auto_label = 'label_error'),
merged AS (SELECT * FROM overrides WHERE annotation_id NOT IN (SELECT annotation_id FROM newov)
           UNION ALL SELECT * FROM newov)
"""


@query("M12_set_triage_override", _NEW_OV_SQL + """
SELECT label, COUNT(*) n, COUNT(DISTINCT sample_id) samples FROM merged GROUP BY label""")
def m12(spark, sf_dir):
    d = _d(spark, sf_dir)
    ov, _ = MU.set_triage_override(d.overrides, d.samples, _new_overrides_spark(spark, sf_dir))
    return ov.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"))


@query("M12_annotated_tags", _NEW_OV_SQL + """
SELECT id, CASE WHEN id IN (SELECT sample_id FROM newov)
    THEN array_to_string(list_sort(list_distinct(list_append(list_filter(COALESCE(tags, []),
         lambda t: NOT starts_with(t, 'triage:ann')), 'triage:annotated'))), '|')
    ELSE array_to_string(list_sort(tags), '|') END tags FROM samples""")
def m12t(spark, sf_dir):
    d = _d(spark, sf_dir)
    _, s = MU.set_triage_override(d.overrides, d.samples, _new_overrides_spark(spark, sf_dir))
    return s.select("id", tags_str())


@query("M13_remove_triage_override", W() + """,
s2 AS (SELECT id, CASE WHEN id IN (SELECT sample_id FROM overrides)
                       THEN list_append(COALESCE(tags, []), 'triage:annotated') ELSE tags END tags FROM samples),
removed AS (SELECT annotation_id FROM overrides WHERE label = 'fn'),
rest AS (SELECT * FROM overrides WHERE annotation_id NOT IN (SELECT annotation_id FROM removed)),
emptied AS (SELECT DISTINCT sample_id FROM overrides WHERE annotation_id IN (SELECT annotation_id FROM removed)
            AND sample_id NOT IN (SELECT sample_id FROM rest))
SELECT id, CASE WHEN id IN (SELECT sample_id FROM emptied)
    THEN array_to_string(list_sort(list_filter(COALESCE(tags, []), lambda t: NOT starts_with(t, 'triage:ann'))), '|')
    ELSE array_to_string(list_sort(tags), '|') END tags FROM s2""")
def m13(spark, sf_dir):
    d = _d(spark, sf_dir)
    touched = d.overrides.select("dataset_id", F.col("sample_id").alias("id"))
    s2 = MU._retag(d.samples, touched, F.array_append(MU._tags(), F.lit("triage:annotated")))
    removed = d.overrides.filter(F.col("label") == "fn").select("annotation_id", "dataset_id")
    _, s3 = MU.remove_triage_override(d.overrides, s2, removed)
    return s3.select("id", tags_str())


_EDIT_SQL = W() + """,
upd AS (SELECT * FROM edits WHERE op = 'update'), del AS (SELECT id FROM edits WHERE op = 'delete'),
edited AS (
  SELECT a.dataset_id, a.id, a.sample_id,
         CASE WHEN u.id IS NOT NULL AND a.source='ground_truth' THEN COALESCE(u.category_name, a.category_name) ELSE a.category_name END category_name,
         CASE WHEN u.id IS NOT NULL AND a.source='ground_truth' THEN COALESCE(u.bbox_x, a.bbox_x) ELSE a.bbox_x END bbox_x,
         CASE WHEN u.id IS NOT NULL AND a.source='ground_truth' THEN COALESCE(u.bbox_y, a.bbox_y) ELSE a.bbox_y END bbox_y,
         CASE WHEN u.id IS NOT NULL AND a.source='ground_truth' THEN COALESCE(u.bbox_w, a.bbox_w) ELSE a.bbox_w END bbox_w,
         CASE WHEN u.id IS NOT NULL AND a.source='ground_truth' THEN COALESCE(u.bbox_h, a.bbox_h) ELSE a.bbox_h END bbox_h,
         CASE WHEN u.id IS NOT NULL AND a.source='ground_truth' THEN COALESCE(u.bbox_w, a.bbox_w) * COALESCE(u.bbox_h, a.bbox_h) ELSE a.area END area,
         a.is_crowd, a.source, a.confidence
  FROM annotations a LEFT JOIN upd u ON u.id = a.id AND u.dataset_id = a.dataset_id
  WHERE NOT (a.id IN (SELECT id FROM del) AND a.source = 'ground_truth')
  UNION ALL
  SELECT dataset_id, id, sample_id, category_name, bbox_x, bbox_y, bbox_w, bbox_h, bbox_w*bbox_h, false, 'ground_truth', NULL
  FROM edits WHERE op = 'create')
"""


@query("M6_apply_annotation_edits", _EDIT_SQL + """
SELECT id, sample_id, category_name, bbox_x, bbox_y, bbox_w, bbox_h, area FROM edited WHERE source = 'ground_truth'""")
def m6(spark, sf_dir):
    d = _d(spark, sf_dir)
    a, _ = MU.apply_annotation_edits(d.annotations, d.edits)
    return a.filter(F.col("source") == "ground_truth").select(
        "id", "sample_id", "category_name", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area")


@query("M7_refresh_counts", _EDIT_SQL + """
SELECT dataset_id, COUNT(*) annotation_count, COUNT(DISTINCT category_name) category_count FROM edited GROUP BY dataset_id""")
def m7(spark, sf_dir):
    d = _d(spark, sf_dir)
    a, _ = MU.apply_annotation_edits(d.annotations, d.edits)
    return MU.refresh_counts(a)


@query("M6_rejected_edits", W() + """,
e2 AS (SELECT 'update' op, id, dataset_id FROM annotations WHERE source = 'run_b' AND category_name = 'R')
SELECT op, id FROM e2 WHERE id IN (SELECT id FROM annotations WHERE source <> 'ground_truth')""")
def m6r(spark, sf_dir):
    d = _d(spark, sf_dir)
    e2 = (d.annotations.filter((F.col("source") == "run_b") & (F.col("category_name") == "R"))
          .select(F.lit("update").alias("op"), "id", "dataset_id", "sample_id", "category_name",
                  "bbox_x", "bbox_y", "bbox_w", "bbox_h"))
    _, rej = MU.apply_annotation_edits(d.annotations, e2)
    return rej.select("op", "id")


@query("M3_merge_categories", W() + """,
incoming AS (SELECT 'ds1' dataset_id, category_name name, CAST(DENSE_RANK() OVER (ORDER BY category_name DESC) + 1 AS INTEGER) category_id
             FROM (SELECT DISTINCT category_name FROM annotations WHERE source = 'run_a'))
SELECT dataset_id, name, category_id FROM categories
UNION ALL SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.dataset_id = i.dataset_id AND c.category_id = i.category_id)""")
def m3(spark, sf_dir):
    from pyspark.sql import Window
    d = _d(spark, sf_dir)
    inc = (d.annotations.filter(F.col("source") == "run_a").select(F.col("category_name").alias("name")).distinct()
           .select(F.lit(DATASET).alias("dataset_id"), "name",
                   (F.dense_rank().over(Window.orderBy(F.col("name").desc())) + 1).cast("int").alias("category_id")))
    return MU.merge_categories(d.categories, inc)


@query("M4_replace_run", W() + """,
newrows AS (SELECT dataset_id, 'n' || id id, sample_id, category_name, bbox_x, bbox_y, bbox_w, bbox_h, area, is_crowd,
                   'run_b' source, confidence FROM annotations WHERE source = 'run_a' AND confidence >= 0.5),
res AS (SELECT * FROM annotations WHERE NOT (dataset_id = 'ds1' AND source = 'run_b') UNION ALL SELECT * FROM newrows)
SELECT {ann} FROM res""".format(ann=_ANN_SQL))
def m4(spark, sf_dir):
    a = _d(spark, sf_dir).annotations
    new = (a.filter((F.col("source") == "run_a") & (F.col("confidence") >= 0.5))
           .withColumn("id", F.concat(F.lit("n"), F.col("id"))).withColumn("source", F.lit("run_b")))
    return _ann_out(MU.replace_run(a, new, DATASET, "run_b"))


@query("M4_prediction_count", W() + """
SELECT dataset_id, COUNT(*) FILTER (WHERE source <> 'ground_truth') prediction_count FROM annotations GROUP BY dataset_id""")
def m4c(spark, sf_dir):
    return MU.prediction_count(_d(spark, sf_dir).annotations)


@query("M5_delete_dataset", W() + """,
a2 AS (SELECT * FROM annotations UNION ALL SELECT 'ds2' dataset_id, id, sample_id, category_name, bbox_x, bbox_y,
       bbox_w, bbox_h, area, is_crowd, source, confidence FROM annotations WHERE source = 'run_b'),
s2 AS (SELECT id, dataset_id FROM samples UNION ALL SELECT id, 'ds2' FROM samples WHERE split = 'val'),
o2 AS (SELECT dataset_id, annotation_id FROM overrides UNION ALL SELECT 'ds2', annotation_id FROM overrides WHERE label = 'fp')
SELECT 'annotations' tbl, dataset_id, id FROM a2 WHERE dataset_id <> 'ds1'
UNION ALL SELECT 'samples', dataset_id, id FROM s2 WHERE dataset_id <> 'ds1'
UNION ALL SELECT 'annotation_triage', dataset_id, annotation_id FROM o2 WHERE dataset_id <> 'ds1'""")
def m5(spark, sf_dir):
    d = _d(spark, sf_dir)
    tables = {
        "annotations": d.annotations.unionByName(d.annotations.filter(F.col("source") == "run_b").withColumn("dataset_id", F.lit("ds2"))),
        "samples": d.samples.unionByName(d.samples.filter(F.col("split") == "val").withColumn("dataset_id", F.lit("ds2"))),
        "annotation_triage": d.overrides.unionByName(d.overrides.filter(F.col("label") == "fp").withColumn("dataset_id", F.lit("ds2"))),
    }
    out = MU.delete_dataset(tables, DATASET)
    parts = [df.select(F.lit(k).alias("tbl"), "dataset_id", F.col("annotation_id" if k == "annotation_triage" else "id").alias("id"))
             for k, df in out.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


@query("M15_backfill_image_dir", W() + """
SELECT id, COALESCE(NULLIF(CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'own/' || split END, ''), '/data/ds1') image_dir
FROM samples""")
def m15(spark, sf_dir):
    d = _d(spark, sf_dir)
    m = F.col("id").cast("long") % 3
    s = d.samples.withColumn("image_dir", F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit(""))
                             .otherwise(F.concat(F.lit("own/"), F.col("split"))))
    ds = spark.createDataFrame([(DATASET, "/data/ds1")], "id string, image_dir string")
    return MU.backfill_image_dir(s, ds).select("id", "image_dir")


@query("M16_views_by_priority", W() + """,
pv AS (SELECT 'pv_' || p id, 'ds1' dataset_id, p name,
              TIMESTAMP '2024-03-01 00:00:00' + CAST(SUBSTR(p, 1, 1) AS INTEGER) * INTERVAL 1 HOUR created_at
       FROM (SELECT DISTINCT UNNEST(tags) p FROM samples WHERE tags IS NOT NULL) WHERE p NOT LIKE 'triage:%'),
allv AS (SELECT id, dataset_id, name, created_at FROM views UNION ALL SELECT * FROM pv)
SELECT id, name, ROW_NUMBER() OVER (ORDER BY created_at DESC, id) pos FROM allv WHERE id <> 'v1'""")
def m16(spark, sf_dir):
    from pyspark.sql import Window
    d = _d(spark, sf_dir)
    p = (d.samples.select(F.explode("tags").alias("p")).distinct().filter(~F.col("p").startswith("triage:")))
    pv = p.select(F.concat(F.lit("pv_"), "p").alias("id"), F.lit(DATASET).alias("dataset_id"), F.col("p").alias("name"),
                  F.to_json(F.struct(F.array("p").alias("tags"))).alias("filters"),
                  (F.lit("2024-03-01 00:00:00").cast("timestamp")
                   + F.make_interval(hours=F.substring("p", 1, 1).cast("int"))).alias("created_at"))
    pv = pv.withColumn("updated_at", F.col("created_at"))
    v = MU.save_view(d.views, pv)
    v = MU.delete_view(v, spark.createDataFrame([("v1",)], "id string"))
    lst = MU.list_views(v, DATASET)
    return lst.select("id", "name", F.row_number().over(Window.orderBy(F.col("created_at").desc(), "id")).cast("long").alias("pos"))


@query("M17_replace_embeddings", W() + """
SELECT sample_id, array_to_string(list_transform(vector, lambda x: CAST(CAST(round(x * 0.5 * 1e6) AS BIGINT) AS VARCHAR)), ',') vector FROM emb""")
def m17(spark, sf_dir):
    e = _d(spark, sf_dir).embeddings
    new = e.withColumn("vector", F.transform("vector", lambda x: x * 0.5))
    r = MU.replace_embeddings(e, new, DATASET)
    # whole vectors as text, components in millionths
    return r.select("sample_id", F.array_join(F.transform("vector", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("vector"))


@query("M18_write_coordinates", W() + """
SELECT sample_id, ROUND(CASE WHEN CAST(sample_id AS BIGINT) % 2 = 0 THEN vector[3] ELSE vector[1] END, 9) x,
       ROUND(CASE WHEN CAST(sample_id AS BIGINT) % 2 = 0 THEN vector[4] ELSE vector[2] END, 9) y FROM emb""")
def m18(spark, sf_dir):
    e = _d(spark, sf_dir).embeddings
    coords = e.filter(F.col("sample_id").cast("long") % 2 == 0).select(
        "dataset_id", "sample_id", F.element_at("vector", 3).alias("x"), F.element_at("vector", 4).alias("y"))
    return MU.write_coordinates(e, coords).select("sample_id", r9("x"), r9("y"))


# ---------------------------------------------------------------------------------------
# PR curves: E3, E4 (W3, W4), E5, W5, E15
# ---------------------------------------------------------------------------------------
from boxlens.operators import evaluate as EV  # noqa: E402
from boxlens.operators import matching as MT  # noqa: E402


def _pg(spark, sf_dir):
    d = _d(spark, sf_dir)
    return MT.predictions(d.annotations, DATASET, RUN_A), MT.ground_truth(d.annotations, DATASET)


_PR_CTES = argmax_ctes("run_a", 0.5, None, same_class=True) + [
    """m AS (SELECT P.sample_id, P.id p_id, P.category_name class_name, COALESCE(P.confidence, 1.0) conf,
                 CASE WHEN c.p_id IS NOT NULL THEN 1 ELSE 0 END is_tp FROM P LEFT JOIN claim c ON c.p_id = P.id)""",
    "mm AS (SELECT p_id, class_name, conf, is_tp FROM m UNION ALL SELECT p_id, 'all', conf, is_tp FROM m)",
    """ng AS (SELECT category_name class_name, COUNT(*) n_gt FROM G GROUP BY 1 UNION ALL SELECT 'all', COUNT(*) FROM G)""",
    """cls AS (SELECT DISTINCT category_name class_name FROM (SELECT category_name FROM P UNION ALL SELECT category_name FROM G)
              UNION ALL SELECT 'all' WHERE EXISTS (SELECT 1 FROM P UNION ALL SELECT 1 FROM G))""",
    """pts AS (SELECT mm.class_name, mm.p_id, mm.conf confidence, ng.n_gt,
                   ROW_NUMBER() OVER w rank,
                   SUM(is_tp) OVER (PARTITION BY mm.class_name ORDER BY conf DESC, p_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) tp_cum
            FROM mm JOIN ng ON ng.class_name = mm.class_name WINDOW w AS (PARTITION BY mm.class_name ORDER BY conf DESC, p_id))""",
    "prc AS (SELECT *, tp_cum / n_gt AS recall, tp_cum / rank AS precision FROM pts)",
    """apc AS (SELECT c.class_name, COALESCE((SELECT SUM(COALESCE(mp, 0.0)) / 101 FROM (
                 SELECT g.i, (SELECT MAX(p.precision) FROM prc p WHERE p.class_name = c.class_name
                                                     AND p.recall >= g.i * CAST(0.01 AS DOUBLE)) mp
                 FROM range(101) g(i))), 0.0) ap FROM cls c)""",
    "cnt AS (SELECT class_name, MAX(rank) n FROM prc GROUP BY class_name)",
    """keep AS (SELECT class_name, CAST(CASE WHEN i = 199 THEN n - 1 ELSE FLOOR(i * ((n - 1) / 199.0)) END AS BIGINT) + 1 rank
              FROM cnt, range(200) t(i) WHERE n > 200
              UNION SELECT class_name, rank FROM prc WHERE class_name IN (SELECT class_name FROM cnt WHERE n <= 200))""",
    """curve AS (SELECT p.class_name, p.rank, p.recall, p.precision, p.confidence FROM prc p
                SEMI JOIN keep k ON k.class_name = p.class_name AND k.rank = p.rank
                UNION ALL SELECT class_name, 1, 0.0, 1.0, 1.0 FROM cls WHERE class_name NOT IN (SELECT class_name FROM prc))""",
]


@query("E3_pr_matches", W(*_PR_CTES) + "SELECT sample_id, p_id, class_name, ROUND(conf, 9) conf, is_tp FROM m")
def e3(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    return EV.pr_matches(p, g, 0.5).select("sample_id", "p_id", "class_name", r9("conf"), "is_tp")


@query("E4_pr_curve", W(*_PR_CTES) + """
SELECT class_name, rank, ROUND(recall, 9) recall, ROUND(precision, 9) AS precision, ROUND(confidence, 9) confidence FROM curve""")
def e4(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    curve, _ = EV.pr_curves(p, g, 0.5)
    return curve.select("class_name", "rank", r9("recall"), r9("precision"), r9("confidence"))


@query("W3_cumulative_pr", W(*_PR_CTES) + """
SELECT class_name, rank, p_id, CAST(tp_cum AS BIGINT) tp_cum, ROUND(recall, 9) recall, ROUND(precision, 9) AS precision FROM prc""")
def w3(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    pts = EV.pr_points(EV.pr_matches(p, g, 0.5), g)
    return pts.select("class_name", "rank", "p_id", "tp_cum", r9("recall"), r9("precision"))


@query("E5_interpolated_ap", W(*_PR_CTES) + "SELECT class_name, ROUND(ap, 9) ap FROM apc")
def e5(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    _, ap = EV.pr_curves(p, g, 0.5)
    return ap.select("class_name", r9("ap"))


@query("W5_operating_points", W(*_PR_CTES) + """
SELECT class_name, ROUND(arg_min(precision, (ABS(confidence - 0.25), rank)), 9) AS precision,
       ROUND(arg_min(recall, (ABS(confidence - 0.25), rank)), 9) recall,
       ROUND(arg_min(confidence, (ABS(confidence - 0.25), rank)), 9) confidence FROM curve GROUP BY class_name""")
def w5(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    curve, _ = EV.pr_curves(p, g, 0.5)
    return EV.operating_points(curve, 0.25).select("class_name", r9("precision"), r9("recall"), r9("confidence"))


@query("E15_pr_grid", W(*_PR_CTES) + """,
gi AS (SELECT i, i / 100 r FROM range(101) t(i)),
env AS (SELECT c.class_name, gi.i, gi.r, COALESCE((SELECT MAX(precision) FROM curve p WHERE p.class_name = c.class_name
                                                   AND p.recall >= gi.r), 0.0) AS precision
        FROM (SELECT DISTINCT class_name FROM curve) c, gi),
nr AS (SELECT gi.i, arg_min(a.confidence, (ABS(a.recall - gi.r), a.rank)) confidence
       FROM gi, (SELECT * FROM curve WHERE class_name = 'all') a GROUP BY gi.i)
SELECT env.class_name, ROUND(env.r, 9) recall, ROUND(env.precision, 9) AS precision, ROUND(nr.confidence, 9) confidence
FROM env LEFT JOIN nr ON nr.i = env.i""")
def e15(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    curve, _ = EV.pr_curves(p, g, 0.5)
    return EV.pr_grid(curve).select("class_name", r9("recall"), r9("precision"), r9("confidence"))


# ---------------------------------------------------------------------------------------
# Greedy fold family: E12, E7, A11, E8, E6, E13
# ---------------------------------------------------------------------------------------

_FOLD_LAMBDA = """lambda acc, x: CASE WHEN list_filter(x.c, lambda y: y.iou >= x.t AND NOT list_contains(list_transform(acc, lambda m: m.g_id), y.g_id))[1] IS NULL
        THEN acc ELSE list_append(acc, {'p_id': x.p_id, 'g_id': list_filter(x.c, lambda y: y.iou >= x.t AND NOT list_contains(list_transform(acc, lambda m: m.g_id), y.g_id))[1].g_id}) END"""


def _greedy_ctes(conf, thresholds, max_det=None):
    cut = f" AND COALESCE(confidence, 1.0) >= {conf}" if conf is not None else ""
    topn = "" if max_det is None else f""" QUALIFY ROW_NUMBER() OVER (PARTITION BY sample_id, category_name
                                                        ORDER BY COALESCE(confidence, 1.0) DESC, id) <= {max_det}"""
    from boxlens.plans.sqlkit import iou_sql
    tl = ", ".join(str(t) for t in thresholds)
    return [
        f"P AS (SELECT * FROM annotations WHERE dataset_id='ds1' AND source='run_a'{cut}{topn})",
        "G AS (SELECT * FROM annotations WHERE dataset_id='ds1' AND source='ground_truth')",
        f"""gpairs AS (SELECT p.sample_id, p.category_name p_cat, p.id p_id, COALESCE(p.confidence, 1.0) conf, g.id g_id,
                   {iou_sql('p', 'g')} iou FROM P p JOIN G g ON p.sample_id = g.sample_id AND p.category_name = g.category_name)""",
        f"ths AS (SELECT UNNEST([{tl}]) t)",
        """gpp AS (SELECT t, sample_id, p_cat, p_id, conf, list({'g_id': g_id, 'iou': iou} ORDER BY iou DESC, g_id) c
                 FROM gpairs, ths WHERE iou >= t GROUP BY ALL)""",
        """ggrp AS (SELECT t, sample_id, p_cat, list({'p_id': p_id, 'c': c, 't': t} ORDER BY conf DESC, p_id) ps FROM gpp GROUP BY ALL)""",
        f"""gacc AS (SELECT t, UNNEST(list_reduce(ps, {_FOLD_LAMBDA}, []::STRUCT(p_id VARCHAR, g_id VARCHAR)[]), recursive := true)
                 FROM ggrp)""",
        """gm AS (SELECT ths.t, P.sample_id, P.id p_id, P.category_name p_cat, COALESCE(P.confidence, 1.0) conf, a.g_id
               FROM P CROSS JOIN ths LEFT JOIN gacc a ON a.p_id = P.id AND a.t = ths.t)""",
    ]


@query("E12_greedy_match", W(*_greedy_ctes(0.25, [0.5])) + "SELECT sample_id, p_id, g_id FROM gm")
def e12(spark, sf_dir):
    d = _d(spark, sf_dir)
    p = MT.predictions(d.annotations, DATASET, RUN_A, 0.25)
    g = MT.ground_truth(d.annotations, DATASET)
    return MT.greedy_match(p, g, [0.5]).select("sample_id", "p_id", "g_id")


_PAIR_FOLD = """lambda acc, x: CASE WHEN list_bool_or(list_transform(acc, lambda m: m.p_id = x.p_id OR m.g_id = x.g_id))
                                THEN acc ELSE list_append(acc, x) END"""


def _confusion_ctes(conf=0.25, iou=0.5):
    from boxlens.plans.sqlkit import iou_sql
    return [
        f"P AS (SELECT * FROM annotations WHERE dataset_id='ds1' AND source='run_a' AND COALESCE(confidence, 1.0) >= {conf})",
        "G AS (SELECT * FROM annotations WHERE dataset_id='ds1' AND source='ground_truth')",
        f"""cpairs AS (SELECT * FROM (SELECT p.sample_id, p.id p_id, p.category_name p_cat, g.id g_id, g.category_name g_cat,
                      {iou_sql('p', 'g')} iou FROM P p JOIN G g ON p.sample_id = g.sample_id) WHERE iou > {iou})""",
        """cgrp AS (SELECT sample_id, list({'p_id': p_id, 'g_id': g_id, 'p_cat': p_cat, 'g_cat': g_cat}
                   ORDER BY CASE WHEN p_cat = g_cat THEN 0 ELSE 1 END, iou DESC, p_id, g_id) ps FROM cpairs GROUP BY sample_id)""",
        f"""cacc AS (SELECT sample_id, UNNEST(list_reduce(ps, {_PAIR_FOLD},
                 []::STRUCT(p_id VARCHAR, g_id VARCHAR, p_cat VARCHAR, g_cat VARCHAR)[]), recursive := true) FROM cgrp)""",
        """cells AS (SELECT sample_id, g_cat actual, p_cat predicted FROM cacc
                  UNION ALL SELECT sample_id, 'background', category_name FROM P WHERE id NOT IN (SELECT p_id FROM cacc)
                  UNION ALL SELECT sample_id, category_name, 'background' FROM G WHERE id NOT IN (SELECT g_id FROM cacc))""",
        "cm AS (SELECT actual, predicted, COUNT(*) count FROM cells GROUP BY ALL)",
    ]


def _pg_conf(spark, sf_dir):
    d = _d(spark, sf_dir)
    return MT.predictions(d.annotations, DATASET, RUN_A), MT.ground_truth(d.annotations, DATASET)


@query("E7_confusion_matrix", W(*_confusion_ctes()) + "SELECT actual, predicted, count FROM cm")
def e7(spark, sf_dir):
    p, g = _pg_conf(spark, sf_dir)
    return EV.confusion_matrix(p, g, 0.5, 0.25)


@query("A11_row_normalize", W(*_confusion_ctes()) + """
SELECT actual, predicted, count, ROUND(CASE WHEN SUM(count) OVER (PARTITION BY actual) > 0
       THEN count / SUM(count) OVER (PARTITION BY actual) ELSE 0 END, 9) share FROM cm""")
def a11(spark, sf_dir):
    p, g = _pg_conf(spark, sf_dir)
    return S.row_normalize(EV.confusion_matrix(p, g, 0.5, 0.25)).select("actual", "predicted", "count", r9("share"))


@query("E8_confusion_cell_samples", W(*_confusion_ctes()) + "SELECT DISTINCT sample_id FROM cells WHERE actual = 'R' AND predicted = 'N'")
def e8(spark, sf_dir):
    p, g = _pg_conf(spark, sf_dir)
    return EV.confusion_cell_samples(p, g, "R", "N", 0.5, 0.25)


@query("E8_cell_samples_background", W(*_confusion_ctes()) + "SELECT DISTINCT sample_id FROM cells WHERE actual = 'background' AND predicted = 'A'")
def e8b(spark, sf_dir):
    p, g = _pg_conf(spark, sf_dir)
    return EV.confusion_cell_samples(p, g, "background", "A", 0.5, 0.25)


@query("E8_cell_samples_compat", W(*_greedy_ctes(0.25, [0.5])) + """
SELECT DISTINCT sample_id FROM gm WHERE g_id IS NOT NULL AND p_cat = 'A'""")
def e8c(spark, sf_dir):
    p, g = _pg_conf(spark, sf_dir)
    return EV.confusion_cell_samples(p, g, "A", "A", 0.5, 0.25, compat=True)


_COCO = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
_MAP_CTES = _greedy_ctes(None, _COCO) + [
    "mng AS (SELECT category_name class_name, COUNT(*) n_gt FROM G GROUP BY 1)",
    """mpts AS (SELECT gm.t, gm.p_cat class_name, mng.n_gt,
                    SUM(CASE WHEN g_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY gm.t, gm.p_cat ORDER BY conf DESC, p_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / mng.n_gt AS recall,
                    SUM(CASE WHEN g_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY gm.t, gm.p_cat ORDER BY conf DESC, p_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                      / ROW_NUMBER() OVER (PARTITION BY gm.t, gm.p_cat ORDER BY conf DESC, p_id) AS precision
             FROM gm JOIN mng ON mng.class_name = gm.p_cat)""",
    """mgrid AS (SELECT ths.t, mng.class_name, r.i FROM ths, mng, range(101) r(i))""",
    """mip AS (SELECT g.t, g.class_name, g.i, (SELECT MAX(p.precision) FROM mpts p WHERE p.t = g.t AND p.class_name = g.class_name
                                                AND p.recall >= g.i * CAST(0.01 AS DOUBLE)) mp FROM mgrid g)""",
    "map AS (SELECT t, class_name, SUM(COALESCE(mp, 0.0)) / 101 ap FROM mip GROUP BY t, class_name)",
    """mpc AS (SELECT class_name, MAX(CASE WHEN t = 0.5 THEN ap END) ap50, MAX(CASE WHEN t = 0.75 THEN ap END) ap75,
                   AVG(ap) ap50_95 FROM map GROUP BY class_name)""",
]


@query("E6_map_per_class", W(*_MAP_CTES) + """
SELECT class_name, ROUND(ap50, 9) ap50, ROUND(ap75, 9) ap75, ROUND(ap50_95, 9) ap50_95 FROM mpc""")
def e6(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    per_class, _ = EV.map_metrics(p, g)
    return per_class.select("class_name", r9("ap50"), r9("ap75"), r9("ap50_95"))


@query("E6_map_summary", W(*_MAP_CTES) + """
SELECT ROUND(COALESCE(AVG(ap50), 0), 9) map50, ROUND(COALESCE(AVG(ap75), 0), 9) map75,
       ROUND(COALESCE(AVG(ap50_95), 0), 9) map50_95 FROM mpc""")
def e6s(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    _, summary = EV.map_metrics(p, g)
    return summary.select(r9("map50"), r9("map75"), r9("map50_95"))


def _map_ctes_renamed():
    out = []
    for c in _MAP_CTES:
        if c.startswith("G AS"):
            continue
        c = c.replace("P AS (SELECT", "PM AS (SELECT", 1) if c.startswith("P AS") else c
        c = c.replace("FROM P p JOIN G g", "FROM PM p JOIN G g").replace("FROM P CROSS JOIN ths", "FROM PM P CROSS JOIN ths")
        out.append(c)
    return out


@query("E13_per_class_metrics", W(*(_PR_CTES + _map_ctes_renamed())) + """,
op AS (SELECT class_name, arg_min(precision, (ABS(confidence - 0.25), rank)) AS precision,
              arg_min(recall, (ABS(confidence - 0.25), rank)) AS recall FROM curve WHERE class_name <> 'all' GROUP BY class_name)
SELECT c.class_name, ROUND(COALESCE(mpc.ap50, 0), 9) ap50, ROUND(COALESCE(mpc.ap75, 0), 9) ap75,
       ROUND(COALESCE(mpc.ap50_95, 0), 9) ap50_95, ROUND(COALESCE(op.precision, 0), 9) AS precision,
       ROUND(COALESCE(op.recall, 0), 9) AS recall
FROM cls c LEFT JOIN mpc ON mpc.class_name = c.class_name LEFT JOIN op ON op.class_name = c.class_name
WHERE c.class_name <> 'all'""")
def e13(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    return EV.per_class_metrics(p, g, 0.5, 0.25).select(
        "class_name", r9("ap50"), r9("ap75"), r9("ap50_95"), r9("precision"), r9("recall"))


# ---------------------------------------------------------------------------------------
# Vectors: V1, V2, V3, V6, V7, F10
# ---------------------------------------------------------------------------------------
from boxlens.operators import vectors as V  # noqa: E402

_COS_SQL = """list_reduce(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2]), lambda x, y: x + y)
   / (sqrt(list_reduce(list_transform(a.vector, lambda x: x * x), lambda x, y: x + y))
      * sqrt(list_reduce(list_transform(b.vector, lambda x: x * x), lambda x, y: x + y)))"""


@query("V1_find_similar", W() + f"""
SELECT sample_id, score FROM (
  SELECT b.sample_id, ROUND({_COS_SQL}, 9) score FROM emb a, emb b WHERE a.sample_id = '10' AND b.sample_id <> '10')
ORDER BY score DESC, sample_id LIMIT 20""")
def v1(spark, sf_dir):
    r = V.find_similar(_d(spark, sf_dir).embeddings, DATASET, "10", 20)
    return r.select("sample_id", F.round("score", 9).alias("score"))


_DUP_CTES = [
    """un AS (SELECT sample_id, list_transform(vector, lambda x: x / sqrt(list_reduce(list_transform(vector, lambda y: y * y),
                                                                             lambda p, q: p + q))) u FROM emb)""",
    "ky AS (SELECT sample_id, u, list_transform(u, lambda x: ROUND(x, 6)) k FROM un)",
    "rp AS (SELECT k, MIN(sample_id) rep FROM ky GROUP BY k)",
    "cg AS (SELECT ky.sample_id, rp.rep, ky.u FROM ky JOIN rp ON rp.k = ky.k)",
    """dots AS (SELECT x.sample_id a, y.sample_id b,
                   list_reduce(list_transform(list_zip(x.u, y.u), lambda z: z[1] * z[2]), lambda p, q: p + q) cosine
            FROM cg x JOIN cg y ON x.sample_id < y.sample_id
            WHERE (x.sample_id = x.rep AND y.sample_id = y.rep) OR (x.rep = y.sample_id AND x.sample_id <> x.rep)
                  OR (y.rep = x.sample_id AND y.sample_id <> y.rep))""",
    """edges AS (SELECT a, b, cosine FROM dots WHERE cosine >= 0.95 OR a IN (SELECT sample_id FROM cg WHERE rep = b)
                 OR b IN (SELECT sample_id FROM cg WHERE rep = a))""",
]


@query("V2_near_duplicate_pairs", W(*_DUP_CTES) + "SELECT a, b, ROUND(cosine, 6) cosine FROM edges")
def v2(spark, sf_dir):
    e = V.near_duplicate_pairs(_d(spark, sf_dir).embeddings, DATASET, 0.95)
    return e.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("V3_near_duplicate_groups", "WITH RECURSIVE " + W(*_DUP_CTES)[5:] + """,
und AS (SELECT a x, b y FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT x, x FROM und UNION SELECT r.node, u.y FROM reach r JOIN und u ON u.x = r.other),
comp AS (SELECT node, MIN(other) component FROM reach GROUP BY node)
SELECT component group_id, COUNT(*) size, string_agg(node, '|' ORDER BY node) members FROM comp GROUP BY component""")
def v3(spark, sf_dir):
    g = V.near_duplicate_groups(_d(spark, sf_dir).embeddings, DATASET, 0.95)
    return g.select("group_id", "size", F.array_join("members", "|").alias("members"))


@query("V3_group_members", "WITH RECURSIVE " + W(*_DUP_CTES)[5:] + """,
und AS (SELECT a x, b y FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT x, x FROM und UNION SELECT r.node, u.y FROM reach r JOIN und u ON u.x = r.other),
comp AS (SELECT node, MIN(other) component FROM reach GROUP BY node)
SELECT node sample_id, component group_id, COUNT(*) OVER (PARTITION BY component) size FROM comp""")
def v3m(spark, sf_dir):
    return V.near_duplicate_members(_d(spark, sf_dir).embeddings, DATASET, 0.95)


@query("V3_duplicate_totals", "WITH RECURSIVE " + W(*_DUP_CTES)[5:] + """,
und AS (SELECT a x, b y FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (SELECT x, x FROM und UNION SELECT r.node, u.y FROM reach r JOIN und u ON u.x = r.other),
comp AS (SELECT node, MIN(other) component FROM reach GROUP BY node),
grp AS (SELECT component, COUNT(*) size FROM comp GROUP BY component HAVING COUNT(*) >= 2)
SELECT COUNT(*) total_groups, CAST(COALESCE(SUM(size), 0) AS BIGINT) total_duplicates FROM grp""")
def v3t(spark, sf_dir):
    return V.duplicate_totals(V.near_duplicate_groups(_d(spark, sf_dir).embeddings, DATASET, 0.95))


@query("V6_coordinates", W() + """
SELECT e.sample_id, ROUND(e.x, 9) x, ROUND(e.y, 9) y, s.file_name FROM emb_xy e JOIN samples s ON s.id = e.sample_id""")
def v6(spark, sf_dir):
    d = _d(spark, sf_dir)
    return V.coordinates(d.embeddings, d.samples, DATASET).select("sample_id", r9("x"), r9("y"), "file_name")


# V7: the answers are text columns of the given tables (an order's priority and status, its
# lines' return flags); words outside the vocabulary of their dimension are dropped.
V7_WORDS = {"priority": ["1-urgent", "2-high", "3-medium"], "flag": ["a", "r"], "status": ["f", "o"]}

_V7_SQL = """
WITH voc AS (SELECT * FROM (VALUES """ + ", ".join(f"('{d}', '{w}')" for d, ws in V7_WORDS.items() for w in ws) + """) v(dimension, tag)),
ans AS (SELECT CAST(o_orderkey AS VARCHAR) id, 'priority' dimension, ' ' || o_orderpriority || '..' answer FROM orders
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus || '.' FROM orders
        UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'flag', l_returnflag FROM lineitem),
nrm AS (SELECT id, dimension, regexp_replace(lower(trim(answer)), '\\.+$', '') tag FROM ans)
SELECT id, array_to_string(list_sort(list_distinct(list(tag))), '|') new_tags FROM nrm SEMI JOIN voc USING (dimension, tag) GROUP BY id"""


@query("V7_normalize_tag_answers", _V7_SQL)
def v7(spark, sf_dir):
    d = _d(spark, sf_dir)
    o, li = d.table("orders"), d.table("lineitem")
    key = lambda c: [F.lit(DATASET).alias("dataset_id"), F.col(c).cast("string").alias("id")]
    ans = (o.select(*key("o_orderkey"), F.lit("priority").alias("dimension"), F.concat(F.lit(" "), "o_orderpriority", F.lit("..")).alias("answer"))
            .unionByName(o.select(*key("o_orderkey"), F.lit("status").alias("dimension"), F.concat("o_orderstatus", F.lit(".")).alias("answer")))
            .unionByName(li.select(*key("l_orderkey"), F.lit("flag").alias("dimension"), F.col("l_returnflag").alias("answer"))))
    return V.normalize_tag_answers(ans, V7_WORDS).select("id", F.array_join("new_tags", "|").alias("new_tags"))


@query("V8_tag_images", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings),
c AS (SELECT label, i, avg(x) m FROM (SELECT label, unnest(v) x, generate_subscripts(v, 1) i FROM e) GROUP BY label, i),
t AS (SELECT vec_id, unnest(v) x, generate_subscripts(v, 1) i FROM e),
s AS (SELECT t.vec_id, c.label, sum(t.x * c.m) - sum(c.m * c.m) / 2 score FROM t JOIN c ON c.i = t.i GROUP BY t.vec_id, c.label)
SELECT CAST(vec_id AS VARCHAR) id, 'label ' || arg_max(label, (round(score, 9), -label)) new_tags FROM s GROUP BY vec_id""")
def v8(spark, sf_dir):
    """Batch tagging with a model learned from the table: the nearest class centroid of a vector."""
    e = _d(spark, sf_dir).table("embeddings")
    rows = (e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
             .groupBy("label", "i").agg(F.avg("x").alias("m"))
             .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect())   # one row a class
    labels, centroids = [r["label"] for r in rows], [[x["m"] for x in r["c"]] for r in rows]

    def nearest_class(pdf):
        import numpy as np
        import pandas as pd
        c = np.array(centroids)
        v = np.stack([np.asarray(x, np.float64) for x in pdf["vector"]])
        score = np.round(v @ c.T - (c * c).sum(axis=1) / 2, 9)
        return pd.DataFrame({"dataset_id": pdf["dataset_id"], "id": pdf["id"], "dimension": "label",
                             "answer": [f"Label {labels[k]}." for k in score.argmax(axis=1)]})
    images = e.select(F.lit(DATASET).alias("dataset_id"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    out = V.tag_images(images, nearest_class, words={"label": [f"label {x}" for x in labels]})
    return out.select("id", F.array_join("new_tags", "|").alias("new_tags"))


@query("J5_similar_with_samples", W() + f"""
SELECT n.sample_id, n.score, s.file_name FROM (
  SELECT b.sample_id, ROUND({_COS_SQL}, 9) score FROM emb a, emb b WHERE a.sample_id = '10' AND b.sample_id <> '10'
  ORDER BY score DESC, b.sample_id LIMIT 20) n LEFT JOIN samples s ON s.id = n.sample_id""")
def j5(spark, sf_dir):
    d = _d(spark, sf_dir)
    r = V.similar_with_samples(d.embeddings, d.samples, DATASET, "10", 20)
    return r.select("sample_id", F.round("score", 9).alias("score"), "file_name")


# ---------------------------------------------------------------------------------------
# G1-G4 display geometry, A10 nested, F14 order, E16 evidence, list_datasets
# ---------------------------------------------------------------------------------------
from boxlens.functions import geometry as GEO  # noqa: E402


def _on_display(spark, sf_dir):
    d = _d(spark, sf_dir)
    s = d.samples.select(F.col("id").alias("sample_id"), "width", "height")
    return (d.annotations.join(s, "sample_id").withColumn("display_w", F.lit(800.0)).withColumn("display_h", F.lit(600.0)))


def _box9(df):
    return df.select("id", *[r9(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")])


@query("G1_scale_boxes", W() + """
SELECT a.id, ROUND(bbox_x * (800.0 / s.width), 9) bbox_x, ROUND(bbox_y * (600.0 / s.height), 9) bbox_y,
       ROUND(bbox_w * (800.0 / s.width), 9) bbox_w, ROUND(bbox_h * (600.0 / s.height), 9) bbox_h
FROM (SELECT * REPLACE (CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height) FROM samples) s JOIN annotations a ON a.sample_id = s.id""".replace("800.0", "CAST(800 AS DOUBLE)").replace("600.0", "CAST(600 AS DOUBLE)"))
def g1(spark, sf_dir):
    return _box9(GEO.scale_boxes(_on_display(spark, sf_dir)))


@query("G2_unscale_boxes", W() + """
SELECT a.id, ROUND(bbox_x * (s.width / CAST(800 AS DOUBLE)), 9) bbox_x, ROUND(bbox_y * (s.height / CAST(600 AS DOUBLE)), 9) bbox_y,
       ROUND(bbox_w * (s.width / CAST(800 AS DOUBLE)), 9) bbox_w, ROUND(bbox_h * (s.height / CAST(600 AS DOUBLE)), 9) bbox_h
FROM samples s JOIN annotations a ON a.sample_id = s.id""")
def g2(spark, sf_dir):
    return _box9(GEO.unscale_boxes(_on_display(spark, sf_dir)))


@query("G3_normalize_boxes", W() + """
SELECT id, ROUND(bbox_x, 9) bbox_x, ROUND(bbox_y, 9) bbox_y, ROUND(bbox_w, 9) bbox_w, ROUND(bbox_h, 9) bbox_h FROM annotations""")
def g3(spark, sf_dir):
    """Every second box is drawn from its right edge, every third from its bottom edge."""
    a = _d(spark, sf_dir).annotations
    flip_x, flip_y = F.crc32(F.col("id").cast("binary")) % 2 == 0, F.crc32(F.col("id").cast("binary")) % 3 == 0
    drawn = (a.withColumn("bbox_x", F.when(flip_x, F.col("bbox_x") + F.col("bbox_w")).otherwise(F.col("bbox_x")))
              .withColumn("bbox_w", F.when(flip_x, -F.col("bbox_w")).otherwise(F.col("bbox_w")))
              .withColumn("bbox_y", F.when(flip_y, F.col("bbox_y") + F.col("bbox_h")).otherwise(F.col("bbox_y")))
              .withColumn("bbox_h", F.when(flip_y, -F.col("bbox_h")).otherwise(F.col("bbox_h"))))
    return _box9(GEO.normalize_boxes(drawn))


@query("G4_next_triage_label", W() + """
SELECT annotation_id, CASE label WHEN 'tp' THEN 'fp' WHEN 'fp' THEN 'fn' WHEN 'fn' THEN 'mistake' ELSE 'tp' END next_label FROM overrides""")
def g4(spark, sf_dir):
    return _d(spark, sf_dir).overrides.select("annotation_id", GEO.next_triage_label(F.col("label")).alias("next_label"))


@query("A10_nested_page", W() + """
SELECT sample_id, COUNT(*) n, string_agg(id || ':' || dataset_id || ':' || category_name || ':' || CAST(CAST(area AS BIGINT) AS VARCHAR) || ':' ||
       CAST(is_crowd AS VARCHAR), '|' ORDER BY id) boxes
FROM annotations WHERE sample_id IN (SELECT id FROM samples WHERE dataset_id = 'ds1' ORDER BY width DESC NULLS LAST, id LIMIT 200 OFFSET 400)
  AND source IN ('ground_truth', 'run_b') GROUP BY sample_id""")
def a10n(spark, sf_dir):
    d = _d(spark, sf_dir)
    ids = SM.page(SM.sort_samples(d.samples.filter(F.col("dataset_id") == DATASET), "width", "desc"), 400, 200).select("id")
    g = SM.group_annotations(d.annotations, DATASET, ids, ["ground_truth", "run_b"])
    box = lambda x: F.concat_ws(":", x["id"], x["dataset_id"], x["category_name"], x["area"].cast("long").cast("string"), x["is_crowd"].cast("string"))
    return g.select("sample_id", F.size("annotations").cast("long").alias("n"), F.array_join(F.transform("annotations", box), "|").alias("boxes"))


@query("F14_saved_view_order", ORACLE["F14_apply_saved_views"].replace("SELECT v.view_id, s.id FROM samples s, v", """
SELECT view_id, id, ROW_NUMBER() OVER (PARTITION BY view_id ORDER BY
    CASE WHEN NOT d THEN n END NULLS LAST, CASE WHEN d THEN n END DESC NULLS LAST,
    CASE WHEN NOT d THEN t END NULLS LAST, CASE WHEN d THEN t END DESC NULLS LAST, id) pos
FROM (SELECT v.view_id, s.id, COALESCE(v.sort_dir = 'desc', false) d,
             CASE v.sort_by WHEN 'width' THEN s.width WHEN 'height' THEN s.height END n,
             CASE v.sort_by WHEN 'file_name' THEN s.file_name WHEN 'split' THEN s.split END t FROM samples s, v""").replace(
    "'$.tags') AS VARCHAR[]) tags FROM views)",
    "'$.tags') AS VARCHAR[]) tags, json_extract_string(filters, '$.sortBy') sort_by, json_extract_string(filters, '$.sortDir') sort_dir FROM views)") + ")")
def f14o(spark, sf_dir):
    d = _d(spark, sf_dir)
    return SM.saved_view_order(d.samples, d.annotations, d.views, DATASET)


@query("E16_error_evidence_summary", W(*error_label_ctes("run_a", 0.45, 0.25)) + """
SELECT COUNT(*) FILTER (WHERE error_type='tp') true_positives, COUNT(*) FILTER (WHERE error_type='hard_fp') hard_false_positives,
       COUNT(*) FILTER (WHERE error_type='label_error') label_errors, COUNT(*) FILTER (WHERE error_type='false_negative') false_negatives FROM labels""")
def e16(spark, sf_dir):
    d = _d(spark, sf_dir)
    return E.error_evidence(d.annotations, d.samples, DATASET, RUN_A)["summary"]


# ---------------------------------------------------------------------------------------
# E1 / J8 pair join, E2 class list, T6 per-class order, V5 reduction
# ---------------------------------------------------------------------------------------

@query("E1_iou_pairs", W(*argmax_ctes("run_a", 0.5, None)) + """
SELECT sample_id, p_id, g_id, ROUND(iou, 9) iou FROM pairs WHERE iou > 0""")
def e1(spark, sf_dir):
    d = _d(spark, sf_dir)
    p = MT.predictions(d.annotations, DATASET, RUN_A)
    g = MT.ground_truth(d.annotations, DATASET)
    return MT.candidate_pairs(p, g).select("sample_id", "p_id", "g_id", r9("iou"))


@query("E1_iou_pairs_wide", W(*argmax_ctes("run_a", 0.5, None)) + """
SELECT sample_id, p_id, g_id, ROUND(iou, 9) iou FROM pairs WHERE iou > 0""")
def e1w(spark, sf_dir):
    """The same boxes 64 times as large (to 4,700 x 4,600 pixels, over many grid cells); a power of
    two, so every IoU stays the same to the last bit."""
    a = _d(spark, sf_dir).annotations
    big = a.select(*[F.col(c) * F.lit(64.0) if c.startswith("bbox_") else F.col(c) for c in a.columns])
    big = big.toDF(*a.columns)
    p = MT.predictions(big, DATASET, RUN_A)
    g = MT.ground_truth(big, DATASET)
    return MT.candidate_pairs(p, g).select("sample_id", "p_id", "g_id", r9("iou"))


@query("E2_class_names", W() + """
SELECT DISTINCT category_name class_name FROM annotations WHERE dataset_id = 'ds1' AND source IN ('ground_truth', 'run_a')""")
def e2(spark, sf_dir):
    d = _d(spark, sf_dir)
    return EV.class_names(MT.predictions(d.annotations, DATASET, RUN_A), MT.ground_truth(d.annotations, DATASET))


@query("T6_per_class_order", W(*(_PR_CTES + _map_ctes_renamed())) + """
SELECT c.class_name, ROW_NUMBER() OVER (ORDER BY ROUND(COALESCE(mpc.ap50, 0), 9) DESC, c.class_name) pos
FROM cls c LEFT JOIN mpc ON mpc.class_name = c.class_name WHERE c.class_name <> 'all'""")
def t6(spark, sf_dir):
    from pyspark.sql import Window
    pcm = e13(spark, sf_dir)
    # one row per class: a small table, ordered for display
    return pcm.select("class_name", F.row_number().over(Window.orderBy(F.col("ap50").desc(), "class_name")).cast("long").alias("pos"))


@query("V5_reduce_2d")
def v5(spark, sf_dir):
    """PCA(k=2) of the unit vectors; not the reference's projection, so rows-only."""
    return V.reduce_2d(_d(spark, sf_dir).embeddings, DATASET).select("sample_id", "x", "y")


# the queries of files, ingestion and reports register themselves
from boxlens.plans import roundtrip  # noqa: E402, F401

"""Registered queries against their DuckDB oracle on sf0.001 (the driver repeats this at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from boxlens.plans import catalog
from conftest import SF

FAST = ["E9_error_summary", "E9_error_per_class", "E10_annotation_triage", "E11_worst_images", "E4_pr_curve",
        "E5_interpolated_ap", "E7_confusion_matrix", "E12_greedy_match", "E6_map_per_class", "A4_facets", "F7_filter_samples",
        "F14_apply_saved_views", "M6_apply_annotation_edits", "M12_annotated_tags", "V3_near_duplicate_groups",
        "V7_normalize_tag_answers", "V8_tag_images", "E1_iou_pairs_wide", "F14_saved_view_order", "T2_page",
        "S3_coco_annotations", "S4_coco_predictions", "T2_seek_page", "V1_index_search", "M6_rejected_edits", "M2_ingest_splits"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["orders", "lineitem", "embeddings", "documents"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


ROWS_ONLY = {"V5_reduce_2d"}   # PCA is not the reference's projection; checked in test_vectors


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    srows, snames = df.collect(), df.columns
    cur = con.execute(entry.oracle_sql()[name])
    drows, dnames = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(snames) == sorted(dnames)
    assert _rows(snames, srows) == _rows(dnames, drows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp": "TIMESTAMP"}


QUICK_SCHEMA = ("A", "F", "G", "J", "M", "T2", "V1", "V6", "V7", "V8", "E9", "E10", "E1_", "E2_", "E16")


def test_schemas_match_oracle_types(spark, con):
    """Column names and types of the registered queries equal those of their oracles
    (a quick subset by default; every query with BOXLENS_FULL=1)."""
    for t in ["customer", "supplier", "part", "region", "nation", "events", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    bad = []
    full = bool(os.environ.get("BOXLENS_FULL"))
    for name, sql in catalog.ORACLE.items():
        if not full and not name.startswith(QUICK_SCHEMA):
            continue
        st = dict(catalog.QUERIES[name](spark, SF).dtypes)
        rel = con.sql(sql)
        dt = dict(zip(rel.columns, [str(x) for x in rel.types]))
        if set(st) != set(dt) or any(SPARK_TO_DUCK.get(st[c], st[c]) != dt[c] for c in st):
            bad.append((name, st, dt))
    assert not bad, bad[:3]

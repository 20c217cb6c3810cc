"""Plan-level guards: no Cartesian products, partition pruning and column pruning on stored
tables, and the skew-safe shapes of the core operators."""

import pytest

from boxlens.fixtures import derived
from boxlens.plans import catalog as C
from conftest import SF

HEAVY = ["E9_error_labels", "E10_annotation_triage", "E12_greedy_match", "E7_confusion_matrix", "E3_pr_matches",
         "A1_class_distribution", "A4_facets", "F7_filter_samples", "M6_apply_annotation_edits", "V2_near_duplicate_pairs",
         "E1_iou_pairs", "F14_apply_saved_views"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    derived(spark, SF).materialize(str(tmp_path_factory.mktemp("tables")))
    yield
    from boxlens import fixtures
    fixtures._STORED.pop(SF, None)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_cartesian_product(spark, stored, name):
    plan = _plan(C.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pair_join_prunes_partitions_and_columns(spark, stored):
    plan = C.QUERIES["E9_error_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan and "(source" in plan
    # the box scans never read metadata / area / is_crowd
    for scan in [l for l in plan.split("\n") if "FileScan parquet" in l and "annotations" in l]:
        assert "metadata" not in scan and "is_crowd" not in scan


def test_top_k_per_type_is_limited_before_the_shuffle(spark, stored):
    plan = _plan(C.QUERIES["W6_error_samples_top50"](spark, SF))
    assert "WindowGroupLimit" in plan


def test_flagship_has_no_window(spark, stored):
    """E9 matching is aggregates and equi-joins only: no window can hold a hot GT or image."""
    plan = _plan(C.QUERIES["E9_error_summary"](spark, SF))
    assert "Window" not in plan
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan

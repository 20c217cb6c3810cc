"""Images matched inside tasks against the joins on grid cells: the same rows, whatever is null or repeated."""

import random

import pytest

from boxlens.operators import images as I
from boxlens.operators import matching as M

COLS = ("dataset_id string, sample_id string, id string, category_name string, bbox_x double, bbox_y double, bbox_w double, bbox_h double, "
        "confidence double")


def _boxes(rnd, kind, n):
    some = lambda v, p=0.04: None if rnd.random() < p else v
    return [(some(rnd.choice(["d", "e"])), some(rnd.choice("abcdef")), some(f"{kind}{rnd.randint(0, n // 2)}"), some(rnd.choice(["x", "y", "é"])),
             some(float(rnd.randint(0, 60))), float(rnd.randint(0, 60)), some(float(rnd.randint(-1, 30))), float(rnd.randint(0, 30)),
             some(rnd.randint(0, 5) / 5)) for _ in range(n)]


@pytest.fixture()
def sides(spark):
    rnd = random.Random(3)
    return [spark.createDataFrame(_boxes(rnd, k, 300), COLS) for k in "pg"]


def _rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("same_class", [False, True])
def test_images_in_tasks_equal_the_joins(spark, sides, monkeypatch, same_class):
    outcome = ["dataset_id", "sample_id", "kind", "id", "cat", "conf", "confidence", "g_id", "g_cat", "iou", "claimed", "m_id", "m_cat", "m_iou"]
    pair = ["dataset_id", "sample_id", "p_id", "p_cat", "conf", "g_id", "g_cat", "iou"]
    got = []
    for limit in (0, 40 if same_class else 2048):                # all images by joins; the larger ones, or none
        monkeypatch.setattr(I, "LOCAL_BOXES", limit)
        got.append((_rows(M.match_outcomes(*sides, 0.3, same_class, 16.0), *outcome), _rows(M.candidate_pairs(*sides, same_class, 16.0), *pair)))
    assert got[0] == got[1]
    assert len(got[0][0]) == 600 and len(got[0][1]) > 200


def test_images_cut_by_batches_and_pieces(spark, sides, monkeypatch):
    want = _rows(M.match_outcomes(*sides, 0.3), "id", "conf", "g_id", "claimed", "m_id")
    monkeypatch.setattr(I, "_PAIRS", 7)
    runs = [t for k in (1, 50) for t in [_small(spark, sides, monkeypatch, k)]]
    assert runs == [want, want]


def _small(spark, sides, monkeypatch, rows):
    import pyarrow as pa
    monkeypatch.setattr(I, "_ROWS", rows)
    table = I._sides(*sides).orderBy("_h").toArrow()
    out = pa.Table.from_batches(list(I._by_image(I._outcomes_of(0.3, False))(iter(table.to_batches(max_chunksize=11)))))
    return _rows(spark.createDataFrame(out), "id", "conf", "g_id", "claimed", "m_id")


def test_boxes_are_shuffled_once(spark, sides):
    """No grid places, and no joins of pairs with their boxes, while images are small."""
    plan = M.match_outcomes(*sides, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Generate" not in plan

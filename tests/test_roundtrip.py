import json
import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from boxlens.plans import roundtrip as R
from boxlens.sources import coco

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents_and_arrays_of_many_files(spark, monkeypatch):
    queries = entry.queries()
    names = ["S3_coco_annotations", "S4_unmapped", "M1_ingest_dataset", "M2_ingested_samples"]
    whole = {n: _rows(queries[n](spark, SF)) for n in names}
    monkeypatch.setattr(R, "FILE_ITEMS", 300)
    files = {}
    monkeypatch.setattr(R, "store_files", lambda rows, *order, f=R.store_files: files.setdefault(len(files), f(rows, *order)))
    for n in names:
        assert _rows(queries[n](spark, SF)) == whole[n], n
        # no file, and so no task, holds much more than FILE_ITEMS lines of a section
        at = list(files.values())[-1]
        assert at.count() > 3 and at.agg(F.max("lines")).first()[0] < 3 * 300, n


def test_items_of_an_array_are_not_broadcast(spark, tmp):
    os.makedirs(tmp, exist_ok=True)
    with open(f"{tmp}/a.json", "w") as f:
        f.write('[{"image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "score": 0.5}, {"image_id": 2, "category_id": 9, "bbox": [0, 0, 1, 1], "score": 0.5}]')
    # categories whose size the planner takes for large
    cats = spark.range(2).select(F.lit("d").alias("dataset_id"), F.col("id").cast("int").alias("category_id"), F.col("id").cast("string").alias("name")).repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20b")
    try:
        found, skipped = coco.read_coco_predictions(spark, f"{tmp}/a.json", cats, "d", "run")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "SortMergeJoin" not in plan and "BuildLeft" not in plan
        assert [r.category_name for r in found.collect()] == ["1"] and skipped.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_files_are_written_by_many_tasks(spark, tmp):
    rows = spark.range(400).select(F.concat(F.lit(f"{tmp}/a/f"), F.col("id"), F.lit(".txt")).alias("path"),
                                   F.when(F.col("id") % 2 == 0, F.lit("x")).alias("line"), F.lit(0).alias("ord"))
    done = R.store_files(rows, "ord")
    assert done.count() == 400 and done.agg(F.sum("lines")).first()[0] == 200 and len(os.listdir(f"{tmp}/a")) == 400
    # a part file a task: small files are not taken together in one
    assert len([f for f in os.listdir(done._pin_path.removeprefix("file:")) if f.endswith(".parquet")]) > 1


def test_boxes_are_not_dealt_by_their_category(spark, tmp, monkeypatch):
    plans = []
    monkeypatch.setattr(R, "store_files", lambda rows, *order: plans.append(rows._jdf.queryExecution().executedPlan().toString()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # no size is small enough: only what is asked for travels
    try:
        R.coco_documents(R._d(spark, SF), f"{tmp}/a")
        R.prediction_arrays(R._d(spark, SF), f"{tmp}/b")
        one = spark.range(1)
        items = one.selectExpr("'1' id", "'1' image_id", "id category_id", "array(1D, 2D, 3D, 4D) bbox", "1D area", "0L iscrowd")
        cats = one.selectExpr("cast(id as int) category_id", "'a' name")
        read = coco.read_coco_annotations(items, "d", cats)
        assert [r.category_name for r in read.collect()] == ["a"]
        plans.append(read._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 3
    for p in plans:
        assert "BroadcastHashJoin" in p and not re.search(r"hashpartitioning\((category_name|category_id|_cid)#", p)


def test_files_of_many_items_get_tasks_of_their_own(spark, tmp, monkeypatch):
    monkeypatch.setattr(R, "FILE_ITEMS", 100)
    done = []
    monkeypatch.setattr(R, "pin", lambda df, f=R.pin: done.append(df) or f(df))
    R.prediction_arrays(R._d(spark, SF), f"{tmp}/b")
    written = done[-1]
    plan = written._jdf.queryExecution().executedPlan().toString()
    files = len(os.listdir(f"{tmp}/b"))
    assert files > 20 and written.rdd.getNumPartitions() >= 2 * files
    # the commas and the writing share one shuffle of the lines and one sort
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.split("Union")[0].count("Sort [") == 1, plan
    # items of one order key and of keys whose text order is another one still make a valid array
    items = spark.createDataFrame([(f"{tmp}/c.json", k, (k,)) for k in (9, 10, 10, None)], "path string, k int, item struct<v int>")
    paths = items.select("path").distinct()
    rows = R._mark_lines(paths, 0, "[").unionByName(R._array_lines(items, 1, "k")).unionByName(R._mark_lines(paths, 2, "]"))
    R._store_arrays(rows, paths)
    with open(f"{tmp}/c.json") as f:
        assert sorted(x.get("v", 0) for x in json.load(f)) == [0, 9, 10, 10]


def test_boxes_and_images_are_dealt_to_tasks_by_their_number(spark, tmp, monkeypatch):
    from boxlens import fixtures
    whole = _rows(R._d(spark, SF).gt)
    monkeypatch.setattr(fixtures, "BOX_ROWS", 300)
    d = R._d(spark, SF)
    # 6000 rows of lineitem; the session has 4 shuffle partitions
    assert d.base.rdd.getNumPartitions() == 20 and _rows(d.gt) == whole
    plans = []
    monkeypatch.setattr(R, "pin", lambda df, f=R.pin: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    R.coco_documents(d, f"{tmp}/a")
    boxes = [p for p in plans if "SortMergeJoin" in p]
    # no side of boxes and images is broadcast, however small it seems
    assert len(boxes) == 1 and boxes[0].count("hashpartitioning(sample_id") == 2, plans
    assert len(re.findall(r"hashpartitioning\(sample_id#\d+, 20\)", boxes[0])) == 2, boxes[0]

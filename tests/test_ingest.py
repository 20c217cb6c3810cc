from pyspark.sql import functions as F

from boxlens.operators import mutate as MU
from boxlens.plans.ingest import Hooks, NotFound, complete, ingest_dataset, ingest_splits, require_source, write_ingested
from boxlens.sources import coco
from cocofix import predictions, small_doc, write


def test_ingest_counts_and_hooks(spark, tmp):
    p = write(f"{tmp}/small.json", small_doc())
    calls = []

    def start(**kw):
        calls.append(("start", kw["dataset_id"]))

    def boom(**kw):
        raise RuntimeError("hook failure")

    def done(**kw):
        calls.append(("complete", kw["counts"]["image_count"]))

    def mark(df):
        return df.withColumn("tags", F.array(F.lit("ingested")))

    def broken(df):
        return df.select("id")          # drops columns: rejected, ingestion continues

    hooks = Hooks(on_start=[start, boom], per_sample=[mark, broken], on_complete=[done])
    ing = ingest_dataset(spark, p, "d1", hooks=hooks)
    row = ing.dataset.first()
    assert (row.name, row.image_count, row.annotation_count, row.category_count) == ("small", 10, 17, 3)
    assert [r[0] for r in ing.hook_results] == ["start", "boom", "mark", "broken"]
    assert isinstance(ing.hook_results[1][1], RuntimeError) and isinstance(ing.hook_results[3][1], Exception)
    assert ing.samples.filter(F.array_contains("tags", "ingested")).count() == 10
    complete(ing, hooks)
    assert calls == [("start", "d1"), ("complete", 10)]
    write_ingested(ing, f"{tmp}/store")
    write_ingested(ing, f"{tmp}/store")          # again: nothing doubles
    assert spark.read.parquet(f"{tmp}/store/annotations").filter("dataset_id = 'd1'").count() == 17
    assert spark.read.parquet(f"{tmp}/store/datasets").count() == 1


def test_ingest_streamed_sections_same_result(spark, tmp):
    p = write(f"{tmp}/small.json", small_doc())
    a = ingest_dataset(spark, p, "d1")
    b = ingest_dataset(spark, p, "d1", reader="stream")
    for x, y in ((a.samples, b.samples), (a.annotations, b.annotations), (a.categories, b.categories)):
        assert sorted(x.collect()) == sorted(y.collect())
    ra, rb = a.dataset.first(), b.dataset.first()
    assert (ra.image_count, ra.annotation_count, ra.category_count) == (rb.image_count, rb.annotation_count, rb.category_count)


def test_ingest_splits_sum_counts(spark, tmp):
    a = write(f"{tmp}/train.json", small_doc())
    b = write(f"{tmp}/val.json", small_doc())
    ing = ingest_splits(spark, [("train", a, "/img/train"), ("val", b, "/img/val")], "d2", "two")
    r = ing.dataset.first()
    assert (r.image_count, r.annotation_count, r.category_count) == (20, 34, 3)
    assert ing.categories.count() == 3
    assert ing.samples.select("id").distinct().count() == 20


def test_replace_run_is_idempotent(spark, tmp):
    doc = coco.read_coco(spark, write(f"{tmp}/small.json", small_doc()))
    cats = coco.read_coco_categories(doc, "d1")
    gt = coco.read_coco_annotations(doc, "d1", cats)
    preds, _ = coco.read_coco_predictions(spark, write(f"{tmp}/run.json", predictions()), cats, "d1", "run")
    once = MU.replace_run(gt, preds, "d1", "run")
    twice = MU.replace_run(once, preds, "d1", "run")
    assert twice.filter("source = 'run'").count() == 8
    assert twice.filter("source = 'ground_truth'").count() == 17
    assert MU.prediction_count(twice).first().prediction_count == 8


def test_require_source(spark, tmp):
    doc = coco.read_coco(spark, write(f"{tmp}/small.json", small_doc()))
    gt = coco.read_coco_annotations(doc, "d1", coco.read_coco_categories(doc, "d1"))
    require_source(gt, "d1")
    for args in (("nope",), ("d1", "missing_run")):
        try:
            require_source(gt, *args)
            raise AssertionError("expected NotFound")
        except NotFound:
            pass


def test_tag_mutations_and_views(spark):
    s = spark.createDataFrame([("a", "d", None), ("b", "d", ["x", "triage:fp"]), ("c", "d", ["y"])],
                              "id string, dataset_id string, tags array<string>")
    sel = spark.createDataFrame([("a", "d"), ("b", "d")], "id string, dataset_id string")
    out = {r.id: sorted(r.tags or []) for r in MU.add_tag(s, sel, "x").collect()}
    assert out == {"a": ["x"], "b": ["triage:fp", "x"], "c": ["y"]}
    out = {r.id: sorted(r.tags) for r in MU.set_triage_tag(s, sel, "triage:tp").collect() if r.id != "c"}
    assert out == {"a": ["triage:tp"], "b": ["triage:tp", "x"]}
    try:
        MU.set_triage_tag(s, sel, "triage:bogus")
        raise AssertionError
    except ValueError:
        pass


def test_import_predictions_end_to_end(spark, tmp):
    from boxlens.plans.ingest import import_predictions
    doc = coco.read_coco(spark, write(f"{tmp}/small.json", small_doc()))
    cats = coco.read_coco_categories(doc, "d1")
    gt = coco.read_coco_annotations(doc, "d1", cats).drop("metadata").withColumn("metadata", F.lit(None).cast("string"))
    samples = coco.read_coco_samples(doc, "d1")
    path = write(f"{tmp}/model_v1.json", predictions())
    imp = import_predictions(spark, gt, cats, samples, "d1", path)
    assert imp.inserted.first().inserted == 8
    assert imp.skipped.first().files == 1
    again = import_predictions(spark, imp.annotations, cats, samples, "d1", path)
    assert again.annotations.filter("source = 'model_v1'").count() == 8
    assert again.annotations.filter("source = 'ground_truth'").count() == 17
    assert again.prediction_count.first().prediction_count == 8


def test_require_source_by_dataset_row(spark, tmp):
    doc = coco.read_coco(spark, write(f"{tmp}/small.json", small_doc()))
    gt = coco.read_coco_annotations(doc, "d1", coco.read_coco_categories(doc, "d1"))
    datasets = spark.createDataFrame([("d1",), ("empty",)], "id string")
    require_source(gt, "empty", datasets=datasets)
    try:
        require_source(gt, "gone", datasets=datasets)
        raise AssertionError("expected NotFound")
    except NotFound:
        pass


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, id string, sample_id string, category_name string, bbox_x double, bbox_y double, "
                                       "bbox_w double, bbox_h double, area double, is_crowd boolean, source string, confidence double")


def _box(i, source="ground_truth", ds="d1"):
    return (ds, i, "s1", "bolt", 1.0, 1.0, 2.0, 3.0, 6.0, False, source, None)


def test_stored_delete_and_replace(spark, tmp):
    path = f"{tmp}/annotations"
    MU.write_table(_boxes(spark, [_box("g1"), _box("p1", "run a'b"), _box("p2", "run2"), _box("g2", ds="d2")]), path, ["dataset_id", "source"])
    new = _boxes(spark, [_box("p9", "run2")])
    MU.store_run(new, path, "d1", "run2")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["g1", "g2", "p1", "p9"]
    MU.store_run(new, path, "d1", "run a'b")                 # an import without rows: the old run is gone
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["g1", "g2", "p9"]
    spark.createDataFrame([("d1",), ("d2",)], "id string").write.parquet(f"{tmp}/datasets")
    MU.delete_dataset_stored(spark, tmp, "d1", ["annotations", "datasets", "samples"])
    assert [r.id for r in spark.read.parquet(path).collect()] == ["g2"]
    assert [r.id for r in spark.read.parquet(f"{tmp}/datasets").collect()] == ["d2"]


def test_edits_last_one_wins_and_unknown_ids(spark):
    ann = _boxes(spark, [_box("a"), _box("b"), _box("c"), _box("p", "run")])
    rows = [(1, "update", "a", None, "nut", None), (2, "update", "a", None, None, 9.0), (3, "update", "a", None, "gauge", None),
            (4, "delete", "b", None, None, None), (5, "update", "zz", None, "nut", None), (6, "delete", "p", None, None, None),
            (7, "create", "n", "s2", "nut", 4.0), (8, "update", "n", None, "bolt", None), (9, "create", "m", "s2", "nut", 4.0), (10, "delete", "m", None, None, None),
            (11, "delete", "c", None, None, None), (12, "create", "c", "s3", "nut", 5.0), (13, "create", "a", "s9", None, None)]
    edits = spark.createDataFrame([(s, op, i, "d1", sid, cat, None, None, w, 2.0 if w else None) for s, op, i, sid, cat, w in rows],
                                  "seq int, op string, id string, dataset_id string, sample_id string, category_name string, bbox_x double, "
                                  "bbox_y double, bbox_w double, bbox_h double")
    out, rej = MU.apply_annotation_edits(ann, edits)
    got = {r.id: (r.sample_id, r.category_name, r.bbox_w, r.bbox_h, r.area, r.source) for r in out.collect()}
    assert got == {"a": ("s1", "gauge", 9.0, 2.0, 18.0, "ground_truth"), "p": ("s1", "bolt", 2.0, 3.0, 6.0, "run"),
                   "n": ("s2", "bolt", 4.0, 2.0, 8.0, "ground_truth"), "c": ("s3", "nut", 5.0, 2.0, 10.0, "ground_truth")}
    assert out.count() == 4
    assert sorted(r.seq for r in rej.collect()) == [5, 6, 13]


def test_override_last_write_in_a_batch(spark):
    from datetime import datetime
    samples = spark.createDataFrame([("s1", "d1", ["x"])], "id string, dataset_id string, tags array<string>")
    schema = "annotation_id string, dataset_id string, sample_id string, label string, is_override boolean, created_at timestamp"
    old = spark.createDataFrame([("a", "d1", "s1", "tp", True, datetime(2030, 1, 1))], schema)
    new = spark.createDataFrame([("a", "d1", "s1", lab, True, datetime(2024, 1, d)) for lab, d in (("fn", 1), ("mistake", 3), ("fp", 2), ("bogus", 9))], schema)
    out, tagged = MU.set_triage_override(old, samples, new)
    assert [(r.annotation_id, r.label) for r in out.collect()] == [("a", "mistake")]
    assert tagged.first().tags == ["x", "triage:annotated"]

"""Registered queries of sources, ingestion and reports: files are written from the given tables by
tasks, read back by the operator, and its rows compared with SQL over the tables.

The writers only lay out rows in the formats that the operators expect; ``store_files`` writes any
number of files of any size, a line at a time, so nothing is gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlens.fixtures import DATASET, RUN_A
from boxlens.operators import errors as E
from boxlens.operators import evaluate as EV
from boxlens.operators import mutate as MU
from boxlens.operators import samples as SM
from boxlens.operators import vectors as V
from boxlens.plans import ingest
from boxlens.plans.catalog import ORACLE, W, _d, query, r9
from boxlens.plans.sqlkit import error_label_ctes
from boxlens.session import pin, shared_path
from boxlens.sources import coco, detection

# ---------------------------------------------------------------------------------------
# Writing files by tasks
# ---------------------------------------------------------------------------------------


def _target(path: str):
    from pyarrow import fs as pafs
    return pafs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else (path if "://" in path else "file://" + path))


_DONE = 4096               # written files told in one batch


def _write_lines(batches):
    """(path, line), lines of a path one behind the other -> (path, lines) of the written files."""
    done: list[tuple[str, int]] = []

    def written():
        b = pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "lines": pa.array([k for _, k in done], pa.int64())})
        done.clear()
        return b
    path, out, n = None, None, 0
    filesystem, made = None, set()          # one file system and one look at a folder for all files of a task
    for b in batches:
        for p, line in zip(b.column("path").to_pylist(), b.column("line").to_pylist()):
            if p != path:
                if out is not None:
                    out.close()
                    done.append((path, n))
                    if len(done) >= _DONE:
                        yield written()
                folder, name = p.rsplit("/", 1)
                if folder not in made:
                    filesystem, inner = _target(folder)
                    filesystem.create_dir(inner, recursive=True)
                    made = {folder}
                local = filesystem.type_name == "local"        # a plain file costs half of a stream, and there may be millions
                path, out, n = p, open(f"{inner}/{name}", "wb") if local else filesystem.open_output_stream(f"{inner}/{name}"), 0
            if line is not None:
                out.write(line.encode() + b"\n")
                n += 1
    if out is not None:
        out.close()
        done.append((path, n))
        yield written()


def _dealt(rows: DataFrame, files: int = 0) -> DataFrame:
    """``rows`` dealt out by path.  The number of tasks is fixed: many files of few bytes must not be taken together;
    of large files, ``files`` in number, a task gets a few, however many there are."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * files)
    out = rows.repartition(tasks, "path")
    out._tasks = tasks
    return out


def store_files(rows: DataFrame, *order: str) -> DataFrame:
    """Write ``rows`` (path, line and the columns that order a file's lines; a null line writes nothing) as text
    files, each by one task; returns (path, lines).  A task that is run again writes its files again.  Rows that
    ``_dealt`` has dealt out stay where they are."""
    spread = rows if hasattr(rows, "_tasks") else _dealt(rows)
    return pin(spread.sortWithinPartitions("path", *order).select("path", "line").mapInArrow(_write_lines, "path string, lines long"))


def _store_arrays(rows: DataFrame, paths: DataFrame) -> None:
    """Write JSON documents (path, part, ord, line) into the files of ``paths``: a line of the part of the line before
    it is preceded by a comma.  The lines are dealt and sorted once, for the commas and the writing."""
    dealt = _dealt(rows, paths.count())
    again = F.lag("part").over(Window.partitionBy("path").orderBy("part", "ord")) == F.col("part")
    lines = dealt.withColumn("line", F.when(again, F.concat(F.lit(","), "line")).otherwise(F.col("line")))
    lines._tasks = dealt._tasks
    store_files(lines, "part", "ord")


def _array_lines(items: DataFrame, at: int, order: str) -> DataFrame:
    """Lines (path, part, ord, line) of a JSON array's items: (path, order, item)."""
    return items.select("path", F.lit(at).alias("part"), F.col(order).cast("string").alias("ord"), F.to_json("item").alias("line"))


def _mark_lines(paths: DataFrame, at: int, text: str) -> DataFrame:
    return paths.select("path", F.lit(at).alias("part"), F.lit("").alias("ord"), F.lit(text).alias("line"))


FILE_ITEMS = 200_000        # items of a written document or array; more rows make more files


def _file_number(rows: DataFrame, key: str):
    """Number of the file that a row stands in, by its ``key``: files of about FILE_ITEMS rows."""
    return F.pmod(F.xxhash64(key), F.lit(-(-rows.count() // FILE_ITEMS) or 1))


def _numbered(stem, number, ext: str):
    """``stem.ext`` for file 0, ``stem_<number>.ext`` for the others."""
    return F.concat(stem, F.when(number == 0, F.lit(ext)).otherwise(F.concat(F.lit("_"), F.lpad(number.cast("string"), 6, "0"), F.lit(ext))))


def _named(categories: DataFrame) -> DataFrame:
    """The few categories, sent to the boxes: joined by a shuffle, all boxes of a category would meet in one task."""
    return F.broadcast(categories.withColumnRenamed("name", "category_name"))


def _split():
    return F.coalesce("split", F.lit("test"))


_SPLIT_SQL = "COALESCE(split, 'test')"


def coco_documents(d, root: str) -> list[str]:
    """The samples, ground truth and categories as COCO documents in a folder per split, ``root/<split>/data.json`` with
    the categories and, of many rows, ``data_<n>.json`` beside it; some boxes lack their bbox, some name no category.
    Returns the folders."""
    folder = F.concat(F.lit(f"{root}/"), _split())
    item = F.struct(F.col("id").cast("long").alias("id"), "file_name", "width", "height")
    images = d.samples.select(_numbered(F.concat(folder, F.lit("/data")), _file_number(d.samples, "id"), ".json").alias("path"), folder.alias("folder"),
                              F.col("id").alias("sid"), item.alias("item"))
    folders = pin(images.select("folder").distinct())
    categories = pin(d.categories)
    cats = categories.select(F.lit(1).alias("k"), "category_id", F.struct(F.col("category_id").alias("id"), "name", F.lit("flags").alias("supercategory")).alias("item"))
    first = folders.select(F.concat("folder", F.lit("/data.json")).alias("path"), F.lit(1).alias("k"))
    cats = first.join(F.broadcast(cats), "k").drop("k")             # the first document of a split lists the few categories
    box = F.when(F.col("p") % 97 != 0, F.array("x", "y", "w", "h"))
    # boxes are dealt to as many tasks as they need, and images never broadcast: both grow with the input
    tasks = max(d.tasks, d.spark.sparkContext.defaultParallelism)
    of = images.select("folder", F.col("sid").alias("sample_id")).repartition(tasks, "sample_id").hint("merge")
    # stored once, for the number of files, their names and their lines
    boxes = pin(d.gt.repartition(tasks, "sample_id").join(of, "sample_id")
                 .select("folder", F.col("id").alias("sid"), "category_name", "s", "sample_id", box.alias("bbox"), (F.col("w") * F.col("h")).alias("area"),
                         (F.col("n") % 2).alias("iscrowd")))
    gt = boxes.join(_named(categories), "category_name").select(
        "folder", "sid", _numbered(F.concat("folder", F.lit("/data")), _file_number(boxes, "sid"), ".json").alias("path"), F.struct(
            F.col("sid").alias("id"), F.col("sample_id").cast("long").alias("image_id"), F.when(F.col("s") % 89 != 0, F.col("category_id")).alias("category_id"),
            "bbox", "area", "iscrowd").alias("item"))
    # every file that holds an item, and the first of each folder
    paths = pin(images.select("path").union(gt.select("path")).union(first.select("path")).distinct())
    rows = _mark_lines(paths, 0, '{"info": {"images": []}, "categories": [')
    for part in (_array_lines(cats, 1, "category_id"), _mark_lines(paths, 2, '], "images": ['), _array_lines(images, 3, "sid"),
                 _mark_lines(paths, 4, '], "annotations": ['), _array_lines(gt, 5, "sid"), _mark_lines(paths, 6, "]}")):
        rows = rows.unionByName(part)
    _store_arrays(rows, paths)
    return sorted(r["folder"] for r in folders.collect())          # one folder a split


def prediction_arrays(d, root: str) -> str:
    """Run A as COCO result arrays in a folder, three or, of many rows, a multiple; some detections of an unknown category."""
    item = F.struct(F.col("sample_id").cast("long").alias("image_id"), F.when(F.col("p") % 50 == 0, 99).otherwise(F.col("category_id")).alias("category_id"),
                    F.array("x", "y", "w", "h").alias("bbox"), F.col("conf").alias("score"))
    stem = F.concat(F.lit(f"{root}/part"), (F.col("o") % 3).cast("string"))
    items = (d.pr.join(_named(d.categories), "category_name")
                 .select(_numbered(stem, _file_number(d.pr, "id"), ".json").alias("path"), "id", item.alias("item")))
    paths = pin(items.select("path").distinct())
    rows = _mark_lines(paths, 0, "[").unionByName(_array_lines(items, 1, "id")).unionByName(_mark_lines(paths, 2, "]"))
    _store_arrays(rows, paths)
    return root


def detection_folder(d, root: str, faults: bool = True) -> str:
    """Run B as a file per image, boxes relative to the image.  With ``faults`` class names of one category are left
    out, some files can't be read and some name no image of the table."""
    s = d.samples.select(F.col("id").alias("sample_id"), "file_name", "width", "height")
    cats = _named(d.categories)
    names = d.categories.filter(F.col("category_id") != 1) if faults else d.categories
    names = names.agg(F.map_from_entries(F.collect_list(F.struct(F.col("category_id").cast("string"), "name"))).alias("categories"))   # the few categories
    nth = F.row_number().over(Window.partitionBy("o").orderBy("id"))
    boxes = (d.pr.filter("k = 1").withColumn("conf", F.lit(0.95) - nth * F.lit(0.01) if not faults else F.col("conf"))
                 .join(cats, "category_name").join(s, "sample_id"))
    box = F.struct(F.struct(*[(F.col(c) / F.col(m)).alias(c) for c, m in zip("xywh", ("width", "height") * 2)]).alias("bbox"),
                   F.col("conf").alias("confidence"), F.col("category_id").alias("class_id"))
    docs = boxes.groupBy("sample_id", "file_name", "width", "o").agg(F.array_sort(F.collect_list(box)).alias("annotations"))   # the boxes of one image
    name = F.when(F.lit(faults) & (F.col("o") % 97 == 1), F.concat(F.lit("nope_"), "file_name")).otherwise(F.col("file_name"))
    doc = F.to_json(F.struct(name.alias("filename"), "categories", F.struct(
        F.concat(F.lit("cam"), F.col("width").cast("string")).alias("annotations_source"), F.lit("2024-05-01T10:00:00").alias("created_at")).alias("info"), "annotations"))
    line = F.when(F.lit(faults) & (F.col("o") % 101 == 1), F.lit("{not json")).otherwise(doc)
    rows = docs.withColumn("k", F.lit(1)).join(names.withColumn("k", F.lit(1)), "k").select(
        F.concat(F.lit(f"{root}/"), "sample_id", F.lit(".json")).alias("path"), line.alias("line"), F.lit(0).alias("ord"))
    store_files(rows, "ord")
    return root


# ---------------------------------------------------------------------------------------
# COCO documents and prediction arrays
# ---------------------------------------------------------------------------------------

def _documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return coco.read_coco_ranges(spark, coco_documents(_d(spark, sf_dir), shared_path(spark, "coco")), 1 << 20)


@query("S1_coco_categories", W() + f"""
SELECT 'ds1' dataset_id, category_id, name, 'flags' supercategory FROM categories, (SELECT DISTINCT {_SPLIT_SQL} s FROM samples)""")
def s1(spark, sf_dir):
    return coco.read_coco_categories(_documents(spark, sf_dir)["categories"], DATASET)


@query("S2_coco_samples", W() + """
SELECT 'all_' || id id, dataset_id, file_name, width, height, 'all' split FROM samples""")
def s2(spark, sf_dir):
    s = coco.read_coco_samples(_documents(spark, sf_dir)["images"], DATASET, "all")
    return s.select("id", "dataset_id", "file_name", "width", "height", "split")


_COCO_GT = """SELECT id, sample_id, CASE WHEN s % 89 <> 0 THEN category_name ELSE 'unknown' END category_name,
       CASE WHEN p % 97 <> 0 THEN x ELSE 0 END bbox_x, CASE WHEN p % 97 <> 0 THEN y ELSE 0 END bbox_y,
       CASE WHEN p % 97 <> 0 THEN w ELSE 0 END bbox_w, CASE WHEN p % 97 <> 0 THEN h ELSE 0 END bbox_h,
       w * h area, n % 2 = 1 is_crowd FROM gt"""
_BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]


@query("S3_coco_annotations", W() + _COCO_GT)
def s3(spark, sf_dir):
    parts = _documents(spark, sf_dir)
    cats = coco.read_coco_categories(parts["categories"]).distinct()
    return coco.read_coco_annotations(parts["annotations"], DATASET, cats).select("id", "sample_id", "category_name", *_BOX, "area", "is_crowd")


def _predictions(spark, sf_dir):
    d = _d(spark, sf_dir)
    return coco.read_coco_predictions(spark, prediction_arrays(d, shared_path(spark, "results")), d.categories, DATASET, "results")


@query("S4_coco_predictions", W() + """
SELECT sample_id, category_name, x bbox_x, y bbox_y, w bbox_w, h bbox_h, w * h area, ROUND(conf, 9) confidence FROM pr WHERE p % 50 <> 0""")
def s4(spark, sf_dir):
    return _predictions(spark, sf_dir)[0].select("sample_id", "category_name", *_BOX, "area", r9("confidence"))


@query("S4_prediction_ids", W() + "SELECT COUNT(*) n, COUNT(*) ids FROM pr WHERE p % 50 <> 0")
def s4_ids(spark, sf_dir):
    return _predictions(spark, sf_dir)[0].agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("S4_unmapped", W() + "SELECT sample_id image_id, CAST(99 AS BIGINT) category_id, ROUND(conf, 9) score FROM pr WHERE p % 50 = 0")
def s4_unmapped(spark, sf_dir):
    return _predictions(spark, sf_dir)[1].select("image_id", "category_id", r9("score"))


# ---------------------------------------------------------------------------------------
# Folders of files, run names, splits, stored tables
# ---------------------------------------------------------------------------------------

@query("S5_detection_files", W() + """
SELECT sample_id, CASE WHEN c.category_id = 1 THEN 'class_1' ELSE category_name END category_name, ROUND(x / width * width, 6) bbox_x,
       ROUND(y / height * height, 6) bbox_y, ROUND(w / width * width, 6) bbox_w, ROUND(h / height * height, 6) bbox_h, ROUND(conf, 9) confidence
FROM pr JOIN samples m ON m.id = sample_id JOIN categories c ON c.name = category_name WHERE k = 1 AND o % 97 <> 1 AND o % 101 <> 1""")
def s5(spark, sf_dir):
    d = _d(spark, sf_dir)
    out, _ = detection.read_detection_dir(spark, detection_folder(d, shared_path(spark, "files")), d.samples, DATASET, "files")
    return out.select("sample_id", "category_name", *[F.round(c, 6).alias(c) for c in _BOX], r9("confidence"))


@query("S5_skipped_files", W() + """,
f AS (SELECT DISTINCT o FROM pr WHERE k = 1)
SELECT 'unreadable' reason, COUNT(*) files FROM f WHERE o % 101 = 1 HAVING COUNT(*) > 0
UNION ALL SELECT 'no_matching_sample', COUNT(*) FROM f WHERE o % 97 = 1 AND o % 101 <> 1 HAVING COUNT(*) > 0""")
def s5_skips(spark, sf_dir):
    d = _d(spark, sf_dir)
    return detection.read_detection_dir(spark, detection_folder(d, shared_path(spark, "files")), d.samples, DATASET, "files")[1]


@query("S6_run_name", W() + """
SELECT 'cam' || arg_min(width, sample_id || '.json') || '_2024-05-01' run_name FROM pr JOIN samples m ON m.id = sample_id WHERE k = 1""")
def s6(spark, sf_dir):
    root = detection_folder(_d(spark, sf_dir), shared_path(spark, "files"), faults=False)
    return detection.derive_run_name(detection.read_detection_files(spark, root))


def _split_tree(spark, sf_dir) -> str:
    """A folder per split with its document and an (empty) image file for each of its samples."""
    d, root = _d(spark, sf_dir), shared_path(spark, "tree")
    coco_documents(d, root)
    images = d.samples.select(F.concat(F.lit(f"{root}/"), _split(), F.lit("/"), "file_name").alias("path"), F.lit(None).cast("string").alias("line"), F.lit(0).alias("ord"))
    store_files(images, "ord")
    return root


@query("S7_discover_splits", W() + f"""
SELECT {_SPLIT_SQL} AS name, '/' || {_SPLIT_SQL} || '/data.json' annotation_path, '/' || {_SPLIT_SQL} image_dir, COUNT(*) image_count
FROM samples GROUP BY ALL""")
def s7(spark, sf_dir):
    root = _split_tree(spark, sf_dir)
    inside = lambda c: F.substring_index(c, root.rstrip("/").split("/")[-1], -1).alias(c)
    return detection.discover_splits(spark, root).select("name", inside("annotation_path"), inside("image_dir"), "image_count")


@query("S8_stored_tables", W() + """
SELECT source, id, sample_id, category_name FROM annotations WHERE source IN ('ground_truth', 'run_b')
UNION ALL SELECT 'samples', id, split, file_name FROM samples
UNION ALL SELECT 'categories', CAST(category_id AS VARCHAR), name, NULL FROM categories""")
def s8(spark, sf_dir):
    d, root = _d(spark, sf_dir), shared_path(spark, "stored")
    MU.write_table(d.annotations, f"{root}/annotations", ["dataset_id", "source"])
    MU.write_table(d.samples, f"{root}/samples", ["dataset_id"])
    MU.write_table(d.categories, f"{root}/categories", ["dataset_id"])
    t = detection.read_tables(spark, root)
    mine = {n: t[n].filter(F.col("dataset_id") == DATASET) for n in t}
    return (mine["annotations"].filter(F.col("source").isin("ground_truth", "run_b")).select("source", "id", "sample_id", "category_name")
            .union(mine["samples"].select(F.lit("samples"), "id", "split", "file_name"))
            .union(mine["categories"].select(F.lit("categories"), F.col("category_id").cast("string"), "name", F.lit(None).cast("string"))))


# ---------------------------------------------------------------------------------------
# Streaming import
# ---------------------------------------------------------------------------------------

_S9 = """R AS (SELECT * REPLACE (CAST(0.95 AS DOUBLE) - row_number() OVER (PARTITION BY o ORDER BY id) * CAST(0.01 AS DOUBLE) AS conf) FROM pr WHERE k = 1)"""
_S9_LABELS = [c.replace("FROM annotations", "FROM annotations_s9") for c in error_label_ctes("live", 0.5, 0.25)]


@query("S9_stream_import", W(_S9, """annotations_s9 AS (
SELECT * FROM annotations WHERE source = 'ground_truth' AND sample_id IN (SELECT sample_id FROM R)
UNION ALL SELECT 'ds1', id, sample_id, category_name, x / width * width, y / height * height, w / width * width, h / height * height, 0, false, 'live', conf
FROM R JOIN (SELECT id mid, width, height FROM samples) m ON m.mid = sample_id)""", *_S9_LABELS) + """
SELECT 'box' kind, sample_id, category_name, NULL error_type, ROUND(confidence, 9) confidence, ROUND(bbox_x + bbox_h, 6) AS value
FROM annotations_s9 WHERE source = 'live'
UNION ALL SELECT 'label', sample_id, category_name, error_type, ROUND(confidence, 9), ROUND(iou, 6) FROM labels""")
def s9(spark, sf_dir):
    from boxlens.streaming import ingest as stream
    d, root = _d(spark, sf_dir), shared_path(spark, "live")
    folder = detection_folder(d, shared_path(spark, "inbox"), faults=False)
    d.annotations.filter("source = 'ground_truth'").withColumn("metadata", F.lit(None).cast("string")).write.parquet(f"{root}/ground_truth")
    # a state partition holds some thousand images
    parts = int(max(8, d.samples.count() // 5_000))
    q = stream.start_ingest_stream(spark, folder, root, d.samples, DATASET, "live", shared_path(spark, "stream"), trigger_once=True, state_partitions=parts)
    q.awaitTermination()
    boxes, labels = (stream.current(spark, root, t, DATASET, "live") for t in ("annotations", "error_labels"))
    return (boxes.select(F.lit("box").alias("kind"), "sample_id", "category_name", F.lit(None).cast("string").alias("error_type"), r9("confidence"),
                         F.round(F.col("bbox_x") + F.col("bbox_h"), 6).alias("value"))
                 .unionByName(labels.select(F.lit("label").alias("kind"), "sample_id", "category_name", "error_type", r9("confidence"),
                                            F.round("iou", 6).alias("value"))))


# ---------------------------------------------------------------------------------------
# Stored orders and vector indexes
# ---------------------------------------------------------------------------------------

@query("T2_seek_page", W() + """
SELECT id, file_name, width, height, split, ROW_NUMBER() OVER (ORDER BY width DESC NULLS LAST, id) pos
FROM samples WHERE dataset_id = 'ds1' QUALIFY pos > 1200 AND pos <= 1400""")
def t2_seek(spark, sf_dir):
    path = shared_path(spark, "order")
    SM.store_order(_d(spark, sf_dir).samples.filter(F.col("dataset_id") == DATASET), path, "width", "desc")
    page = SM.seek_page(spark, path, 1200, 200, "width", "desc")
    # the places inside the page: one window over its rows, 200 at most
    at = F.row_number().over(Window.orderBy(F.col("width").desc_nulls_last(), "id")) + 1200
    return page.select("id", "file_name", "width", "height", "split", at.cast("long").alias("pos"))


@query("V1_index_search", ORACLE["V1_find_similar"])
def v1_index(spark, sf_dir):
    e, path = _d(spark, sf_dir).embeddings, shared_path(spark, "index")
    V.build_index(e, DATASET, path)
    q = e.filter("sample_id = '10'").select("vector").first()
    return V.search_index(spark, path, q["vector"], 20, "10").select("sample_id", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------------------------------
# ingestion
# ---------------------------------------------------------------------------------------

def _one_document(spark, sf_dir, hooks=None):
    folders = coco_documents(_d(spark, sf_dir), shared_path(spark, "coco"))
    return ingest.ingest_dataset(spark, next(f for f in folders if f.endswith("/train")), "new", name="n", split="train", hooks=hooks)


@query("M1_ingest_dataset", W() + """,
g AS (SELECT gt.* FROM gt JOIN samples m ON m.id = sample_id WHERE m.split = 'train')
SELECT 'new' id, 'n' AS name, 'coco' format, CAST((SELECT COUNT(*) FROM samples WHERE split = 'train') AS INTEGER) image_count,
       CAST((SELECT COUNT(*) FROM g) AS INTEGER) annotation_count, CAST((SELECT COUNT(*) FROM categories) AS INTEGER) category_count""")
def m1(spark, sf_dir):
    return _one_document(spark, sf_dir).dataset.select("id", "name", "format", "image_count", "annotation_count", "category_count")


@query("M1_ingest_annotations", W() + f"""
SELECT 'train_' || a.id id, 'train_' || sample_id sample_id, category_name, bbox_x, bbox_y, bbox_w, bbox_h, area, is_crowd
FROM ({_COCO_GT}) a JOIN samples m ON m.id = sample_id WHERE m.split = 'train'""")
def m1_annotations(spark, sf_dir):
    return _one_document(spark, sf_dir).annotations.select("id", "sample_id", "category_name", *_BOX, "area", "is_crowd")


@query("M2_ingest_splits", W() + """
SELECT 'new' id, 'n' AS name, CAST((SELECT COUNT(*) FROM samples) AS INTEGER) image_count,
       CAST((SELECT COUNT(*) FROM gt) AS INTEGER) annotation_count, CAST((SELECT COUNT(*) FROM categories) AS INTEGER) category_count""")
def m2(spark, sf_dir):
    splits = [(f.split("/")[-1], f, f) for f in coco_documents(_d(spark, sf_dir), shared_path(spark, "coco"))]
    return ingest.ingest_splits(spark, splits, "new", "n").dataset.select("id", "name", "image_count", "annotation_count", "category_count")


@query("M2_ingested_samples", W() + f"""
SELECT {_SPLIT_SQL} || '_' || id id, file_name, {_SPLIT_SQL} split FROM samples""")
def m2_samples(spark, sf_dir):
    splits = [(f.split("/")[-1], f, f) for f in coco_documents(_d(spark, sf_dir), shared_path(spark, "coco"))]
    return ingest.ingest_splits(spark, splits, "new", "n").samples.select("id", "file_name", "split")


def large_tag(samples: DataFrame) -> DataFrame:
    """A per-sample hook: wide images are tagged."""
    return samples.withColumn("tags", F.when(F.col("width") >= 1280, F.array_append("tags", F.lit("large"))).otherwise(F.col("tags")))


def drops_columns(samples: DataFrame) -> DataFrame:
    """A faulty hook, to be skipped."""
    return samples.drop("file_name")


@query("U1_ingest_hooks", W() + """
SELECT 'train_' || id id, file_name, CASE WHEN width >= 1280 THEN 'large' ELSE '' END tags FROM samples WHERE split = 'train'""")
def u1(spark, sf_dir):
    s = _one_document(spark, sf_dir, ingest.Hooks(per_sample=[drops_columns, large_tag])).samples
    return s.select("id", "file_name", F.array_join("tags", "|").alias("tags"))


@query("U2_hook_isolation", W() + """
SELECT * FROM (VALUES ('broken_start', 'ZeroDivisionError', 1), ('drops_columns', 'ValueError', 2), ('large_tag', 'ok', 3)) t(hook, outcome, pos)
UNION ALL SELECT 'counted', CAST(COUNT(*) AS VARCHAR), 4 FROM samples WHERE split = 'train'""")
def u2(spark, sf_dir):
    def broken_start(**_):
        return 1 / 0

    def counted(counts, **_):
        return counts["image_count"]
    hooks = ingest.Hooks([broken_start], [drops_columns, large_tag], [counted])
    ing = _one_document(spark, sf_dir, hooks)
    results = ing.hook_results + ingest.complete(ing, hooks)
    rows = [(n, type(x).__name__ if isinstance(x, Exception) else str(x), k) for k, (n, x) in enumerate(results, 1)]
    return spark.createDataFrame(rows, "hook string, outcome string, pos int")


@query("E17_existence_checks", W() + """
SELECT 'ds1' dataset_id, source, true known FROM (SELECT DISTINCT source FROM annotations)
UNION ALL SELECT 'ds1', 'no such run', false UNION ALL SELECT 'no such set', NULL, false""")
def e17(spark, sf_dir):
    a = _d(spark, sf_dir).annotations
    asked = [(DATASET, r["source"]) for r in a.select("source").distinct().collect()] + [(DATASET, "no such run"), ("no such set", None)]   # the few runs

    def known(ds, source):
        try:
            ingest.require_source(a, ds, source)
        except ingest.NotFound:
            return False
        return True
    return spark.createDataFrame([(ds, s, known(ds, s)) for ds, s in asked], "dataset_id string, source string, known boolean")


# ---------------------------------------------------------------------------------------
# E14 report, E16 evidence, V4 embedding
# ---------------------------------------------------------------------------------------

def _long(df: DataFrame, name: str, keys: list[str], values: list[str]) -> DataFrame:
    """A report table as rows (tbl, k1, k2, metric, value)."""
    k = [F.col(c).cast("string") for c in keys] + [F.lit(None).cast("string")] * (2 - len(keys))
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.round(F.col(v).cast("double"), 9).alias("value")) for v in values])).alias("c")
    return df.select(F.lit(name).alias("tbl"), k[0].alias("k1"), k[1].alias("k2"), cells).select("tbl", "k1", "k2", "c.metric", "c.value")


def _long_sql(of: str, name: str, keys: list[str], values: list[str]) -> str:
    k = [f"CAST({c} AS VARCHAR)" for c in keys] + ["CAST(NULL AS VARCHAR)"] * (2 - len(keys))
    return " UNION ALL ".join(f"SELECT '{name}' tbl, {k[0]} k1, {k[1]} k2, '{v}' metric, ROUND(CAST({v} AS DOUBLE), 9) AS value FROM ({ORACLE[of]})" for v in values)


_REPORT = [("pr_curves", "E4_pr_curve", ["class_name", "rank"], ["recall", "precision", "confidence"]),
           ("ap", "E5_interpolated_ap", ["class_name"], ["ap"]), ("ap_metrics", "E6_map_summary", [], ["map50", "map75", "map50_95"]),
           ("per_class", "E13_per_class_metrics", ["class_name"], ["ap50", "ap75", "ap50_95", "precision", "recall"]),
           ("confusion_matrix", "E7_confusion_matrix", ["actual", "predicted"], ["count"])]


@query("E14_evaluation_report", " UNION ALL ".join(_long_sql(of, n, k, v) for n, of, k, v in _REPORT))
def e14(spark, sf_dir):
    tables = EV.evaluation_report(_d(spark, sf_dir).annotations, DATASET, RUN_A, 0.5, 0.25)
    out = None
    for n, _, k, v in _REPORT:
        t = _long(tables[n], n, k, v)
        out = t if out is None else out.unionByName(t)
    return out


def _evidence(spark, sf_dir, table):
    d = _d(spark, sf_dir)
    return E.error_evidence(d.annotations, d.samples, DATASET, RUN_A, 0.5, 0.25)[table]


query("E16_evidence_per_class", ORACLE["A7_run_class_counts"])(lambda spark, sf_dir: _evidence(spark, sf_dir, "per_class"))
query("E16_evidence_confidence", ORACLE["A8_confidence_histogram"])(lambda spark, sf_dir: _evidence(spark, sf_dir, "confidence"))
query("E16_evidence_tags", ORACLE["A9_tag_correlation"])(lambda spark, sf_dir: _evidence(spark, sf_dir, "tags"))


def byte_counts(images):
    """An embedding function for V4: size and counts of some bytes; unreadable content has none."""
    return [None if c is None else [float(len(c)), float(c.count(b"<")), float(c.count(b" ")), float(c.count(b"e"))] for c in images["content"]]


@query("V4_embed_images", """
SELECT CAST(page_id AS VARCHAR) sample_id, 'ds1' dataset_id, 'bytes' model_name, strlen(html) || ',' || (length(html) - length(replace(html, '<', ''))) || ',' ||
       (length(html) - length(replace(html, ' ', ''))) || ',' || (length(html) - length(replace(html, 'e', ''))) vector FROM pages WHERE html IS NOT NULL""")
def v4(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("string").alias("sample_id"), F.lit(DATASET).alias("dataset_id"), F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    e = V.embed_images(images, byte_counts, "bytes")
    return e.withColumn("vector", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ","))

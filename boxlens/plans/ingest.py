"""Dataset ingestion (M1, M2), plugin hooks (U1, U2) and request checks."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.operators.mutate import write_table
from boxlens.session import pin, release, table_exists
from boxlens.sources import coco

log = logging.getLogger(__name__)


# ---- U1 / U2: hooks ----------------------------------------------------------------------

@dataclass
class Hooks:
    """Ingest hooks.  ``on_start(dataset_id=..., name=...)`` and
    ``on_complete(dataset_id=..., counts=...)`` are driver callbacks; ``per_sample`` hooks are
    ``DataFrame -> DataFrame`` transforms applied to the samples (``df.transform``).

    U2: a hook that fails is logged and skipped; results are kept in registration order.
    A per-sample hook is validated while the plan is *built* (analysis errors, and a schema
    that lost a sample column); runtime errors inside it surface when the job runs."""
    on_start: list[Callable] = field(default_factory=list)
    per_sample: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    on_complete: list[Callable] = field(default_factory=list)

    def fire(self, kind: str, **kwargs) -> list[tuple[str, object]]:
        results = []
        for fn in getattr(self, kind):
            name = getattr(fn, "__name__", repr(fn))
            try:
                results.append((name, fn(**kwargs)))
            except Exception as exc:  # noqa: BLE001 - isolation is the contract
                log.warning("hook %s failed: %s", name, exc)
                results.append((name, exc))
        return results

    def transform_samples(self, samples: DataFrame) -> tuple[DataFrame, list[tuple[str, object]]]:
        results = []
        for fn in self.per_sample:
            name = getattr(fn, "__name__", repr(fn))
            try:
                out = samples.transform(fn)
                missing = [c for c in samples.columns if c not in out.columns]
                if missing:
                    raise ValueError(f"hook dropped columns {missing}")
                out.schema  # noqa: B018 - forces analysis of the new plan
                samples = out
                results.append((name, "ok"))
            except Exception as exc:  # noqa: BLE001
                log.warning("per-sample hook %s failed: %s", name, exc)
                results.append((name, exc))
        return samples, results


# ---- M1 / M2 -----------------------------------------------------------------------------

@dataclass
class Ingested:
    dataset: DataFrame
    samples: DataFrame
    annotations: DataFrame
    categories: DataFrame
    hook_results: list = field(default_factory=list)


def ingest_dataset(spark: SparkSession, annotation_path: str, dataset_id: str, *, image_dir: str = "",
                   name: str | None = None, split: str | None = None, hooks: Hooks | None = None,
                   reader: str = "ranges") -> Ingested:
    """M1: one COCO document, or a folder of documents that make up one, -> dataset row, samples, annotations,
    categories.

    The document is read by byte ranges, many tasks to a file (``coco.read_coco_ranges``).  The reader
    "stream" reads each section in one task with bounded memory (for filesystems without random
    access; no folders), "document" parses the whole document as one row.  The dataset name defaults to the file stem; counts are
    image / GT / category counts of the file (D10).  Nothing is written here:
    ``write_ingested`` appends the partitions."""
    hooks = hooks or Hooks()
    name = name or os.path.splitext(os.path.basename(annotation_path))[0]
    results = hooks.fire("on_start", dataset_id=dataset_id, name=name)
    # the document is parsed once; every table and count reads the stored sections
    if reader == "ranges":
        src = coco.read_coco_ranges(spark, annotation_path)
    elif reader == "stream":
        parts = coco.read_coco_streaming(spark, [annotation_path])
        src = {k: pin(parts[k]) for k in ("categories", "images", "annotations")}
    else:
        doc = pin(coco.read_coco(spark, annotation_path))
        src = {k: doc for k in ("categories", "images", "annotations")}
    cats = coco.read_coco_categories(src["categories"], dataset_id)
    samples = coco.read_coco_samples(src["images"], dataset_id, split, image_dir)
    samples, r2 = hooks.transform_samples(samples)
    anns = coco.read_coco_annotations(src["annotations"], dataset_id, cats, split)
    # counts of the file as scalar subqueries over the three sections (no join of tables)
    counts = spark.range(1).select(
        coco.read_coco_samples(src["images"], dataset_id).select(F.count("*")).scalar().alias("image_count"),
        anns.select(F.count("*")).scalar().alias("annotation_count"),
        cats.select(F.count("*")).scalar().alias("category_count"))
    dataset = counts.select(F.lit(dataset_id).alias("id"), F.lit(name).alias("name"), F.lit("coco").alias("format"),
                            F.lit(annotation_path).alias("source_path"), F.lit(image_dir).alias("image_dir"),
                            F.col("image_count").cast("int"), F.col("annotation_count").cast("int"),
                            F.col("category_count").cast("int"), F.lit(0).alias("prediction_count"),
                            F.current_timestamp().alias("created_at"), F.lit(None).cast("string").alias("metadata"))
    categories = cats.select("dataset_id", "category_id", "name", "supercategory")
    results += r2
    return Ingested(dataset, samples, anns, categories, results)


def complete(ing: Ingested, hooks: Hooks | None = None) -> list:
    """Fire the completion hooks with the counts (a one-row action)."""
    hooks = hooks or Hooks()
    row = ing.dataset.select("image_count", "annotation_count", "category_count").first()
    return hooks.fire("on_complete", dataset_id=ing.dataset.first()["id"], counts=row.asDict() if row else {})


def ingest_splits(spark: SparkSession, splits: list[tuple[str, str, str]], dataset_id: str, name: str) -> Ingested:
    """M2: several (split, annotation_path, image_dir) under one dataset: image and annotation
    counts add up, category_count is the largest; categories merged without duplicates (M3)."""
    parts = [ingest_dataset(spark, p, dataset_id, image_dir=d, name=name, split=s) for s, p, d in splits]
    samples, anns, cats, ds = parts[0].samples, parts[0].annotations, parts[0].categories, parts[0].dataset
    for p in parts[1:]:
        samples = samples.unionByName(p.samples)
        anns = anns.unionByName(p.annotations)
        cats = cats.unionByName(p.categories.join(cats.select("dataset_id", "category_id"),
                                                  ["dataset_id", "category_id"], "left_anti"))
        ds = ds.unionByName(p.dataset)
    dataset = (ds.groupBy("id").agg(F.first("name").alias("name"), F.first("format").alias("format"),
                                    F.first("source_path").alias("source_path"), F.first("image_dir").alias("image_dir"),
                                    F.sum("image_count").cast("int").alias("image_count"),
                                    F.sum("annotation_count").cast("int").alias("annotation_count"),
                                    F.max("category_count").cast("int").alias("category_count"),
                                    F.lit(0).alias("prediction_count"), F.max("created_at").alias("created_at"),
                                    F.first("metadata").alias("metadata")))
    return Ingested(dataset, samples, anns, cats.dropDuplicates(["dataset_id", "category_id"]))


def write_ingested(ing: Ingested, root: str) -> None:
    """Store the dataset: its partitions of samples (dataset_id), annotations (dataset_id, source:
    the ground truth) and categories are replaced, so writing it again changes nothing; prediction runs
    stay.  The one row of ``datasets`` replaces an older one of its id."""
    write_table(ing.samples, f"{root}/samples", ["dataset_id"])
    write_table(ing.annotations, f"{root}/annotations", ["dataset_id", "source"])
    write_table(ing.categories, f"{root}/categories", ["dataset_id"])
    spark, path = ing.dataset.sparkSession, f"{root}/datasets"
    rows = ing.dataset
    if table_exists(spark, path):
        rows = rows.unionByName(spark.read.parquet(path).join(rows.select("id"), "id", "left_anti"))
    rows = pin(rows)
    rows.write.mode("overwrite").parquet(path)
    release(rows)


# ---- E17 ---------------------------------------------------------------------------------

class NotFound(LookupError):
    pass


def require_source(ann: DataFrame, dataset_id: str, source: str | None = None, datasets: DataFrame | None = None) -> None:
    """Unknown dataset or a source with no rows is an error (existence via ``limit(1)``).

    With the ``datasets`` table a dataset is known by its row there, annotations or not; without
    it, by its annotations."""
    q = ann.filter(F.col("dataset_id") == dataset_id)
    known = q if datasets is None else datasets.filter(F.col("id") == dataset_id)
    if known.limit(1).count() == 0:
        raise NotFound(f"dataset {dataset_id!r} not found")
    if source is not None and q.filter(F.col("source") == source).limit(1).count() == 0:
        raise NotFound(f"no annotations with source {source!r} in dataset {dataset_id!r}")


# ---- M4 end to end -----------------------------------------------------------------------

@dataclass
class Imported:
    annotations: DataFrame     # the whole table after the import
    inserted: DataFrame        # one row: inserted
    skipped: DataFrame         # per-reason skip counts
    prediction_count: DataFrame


def import_predictions(spark: SparkSession, annotations: DataFrame, categories: DataFrame, samples: DataFrame,
                       dataset_id: str, path: str, fmt: str = "coco", run_name: str | None = None,
                       split: str | None = None, datasets: DataFrame | None = None) -> Imported:
    """M4 with its sources: read a COCO result array (S4) or a folder of per-image files (S5),
    replace that run in the dataset (GT and other runs untouched) and report inserted /
    skipped rows and the new prediction count.  The run name defaults to S6.  Ids are
    content hashes, so importing the same file twice gives the same rows."""
    from boxlens.operators import mutate
    from boxlens.sources import detection
    require_source(annotations, dataset_id, datasets=datasets)
    if fmt == "coco":
        name = run_name or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        rows, bad = coco.read_coco_predictions(spark, path, categories, dataset_id, name, split)
        skipped = bad.agg(F.count("*").alias("files")).select(F.lit("unmapped_category").alias("reason"), "files")
    else:
        name = run_name or detection.derive_run_name(detection.read_detection_files(spark, path)).first().run_name
        rows, skipped = detection.read_detection_dir(spark, path, samples, dataset_id, name)
    rows = rows.select(*[c for c in annotations.columns])
    out = mutate.replace_run(annotations, rows, dataset_id, name)
    return Imported(out, rows.agg(F.count("*").alias("inserted")), skipped,
                    mutate.prediction_count(out.filter(F.col("dataset_id") == dataset_id)))

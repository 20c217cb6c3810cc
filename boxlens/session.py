"""Session helpers: a tuned SparkSession for local runs and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import logging
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PINNED: set[str] = set()
_LOCAL_DIRS: dict[str, str] = {}   # application id -> scratch folder of a local session without the setting

# Defaults that matter at any scale: AQE re-plans joins and coalesces/splits partitions at
# runtime (skew join handling included); the UI server stays off.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "boxlens", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session.  On a cluster pass ``master=None`` and let the
    launcher decide; locally ``local[N]`` with shuffle partitions ~ cores."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("BOXLENS_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    A local session without the setting (tests, trials) gets a fresh scratch folder; off a
    local master the setting is required, because executors would each write to their own
    disk otherwise.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder shared by driver and executors (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="boxlens-ckpt-", dir="/tmp")
        d = _LOCAL_DIRS[app]
    return d


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new, unused path under the shared checkpoint folder; removed by ``release`` or when
    the driver's Python ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not _PINNED:
        atexit.register(release_all, spark)
    _PINNED.add(path)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table under the shared checkpoint folder and return a
    frame reading it back.

    One write job; the rows are then fixed (e.g. row ids computed before the write are read
    back unchanged), survive executor loss, and the lineage of iterative jobs is cut.
    ``release`` removes the table as soon as nothing reads it any more; whatever a returned,
    lazily evaluated result still needs goes when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, "pin")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pin_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A stored table (or folder) is at ``path``."""
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp)


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames returned by ``pin`` (others are ignored)."""
    for f in frames:
        path = getattr(f, "_pin_path", None)
        if path in _PINNED:
            _PINNED.discard(path)
            _delete(f.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table still pinned: call it when all results have been consumed."""
    for path in sorted(_PINNED):
        try:
            _delete(spark, path)
        except Exception as e:  # noqa: BLE001 - the session may already be stopped at exit
            logging.getLogger(__name__).debug("pin %s not removed: %s", path, e)
            continue
        _PINNED.discard(path)


@contextlib.contextmanager
def pin_scope(spark: SparkSession):
    """``with pin_scope(spark): result = query(...); result.write...`` leaves no pinned table
    of the block behind."""
    before = set(_PINNED)
    try:
        yield
    finally:
        for path in sorted(_PINNED - before):
            _PINNED.discard(path)
            _delete(spark, path)

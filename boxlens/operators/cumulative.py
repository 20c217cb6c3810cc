"""Distributed running counts (W3) without a single-task window.

A window ``ORDER BY conf DESC`` with no (or a skewed) partition key runs in one task.  Here
the rows are range-partitioned on (keys, order) -- Spark samples the bounds, so even a key
holding a third of all rows is split over many partitions -- and sorted there.  Each task numbers
its rows in passing, so they are shuffled once; per-(partition, key) totals
(at most #partitions + #keys rows) give prefix offsets that are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlens.session import pin


def _local_counts(keys: list[str], flags: list[str]):
    """Sorted rows of a partition -> the same with _lr and, per flag, _lc<n>: the position in the key's rows so far
    and the flag's running sum.  Held are a batch and the last row's counts."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        last, held = None, np.zeros(len(flags) + 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                code = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = tuple(b.column(k)[0].as_py() for k in keys)
            new[0] = first != last
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))      # -1: the key of the batch before
            counts = []
            for n, f in enumerate([None, *flags]):
                one = np.ones(b.num_rows, np.int64) if f is None else b.column(f).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(one)])
                counts.append(before[1:] - np.where(start < 0, -held[n], before[np.maximum(start, 0)]))
            last, held = tuple(b.column(k)[-1].as_py() for k in keys), np.array([c[-1] for c in counts])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in counts)], names=[*b.schema.names, "_lr", *(f"_lc{n}" for n in range(len(flags)))])
    return run


def running_counts(df: DataFrame, keys: list[str], order: list[Column], flag: str | list[str],
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based position within the key in ``order``), ``cum`` (running sum of
    the 0/1 column ``flag`` up to and including the row) and ``total`` (rows of the key).  Several flags give an array
    ``cum``."""
    spark = df.sparkSession
    flags = [flag] if isinstance(flag, str) else list(flag)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    spread = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id())
    local = [f"_lc{i}" for i in range(len(flags))]
    schema = T.StructType([*spread.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_lr", *local))])
    r = pin(spread.mapInArrow(_local_counts(keys, flags), schema))
    tot = r.groupBy("_pid", *keys).agg(F.max("_lr").alias("_c"), *[F.max(c).alias(f"_t{i}") for i, c in enumerate(local)])
    ow = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *keys, F.coalesce(F.sum("_c").over(ow), F.lit(0)).alias("_oc"),
                     *[F.coalesce(F.sum(f"_t{i}").over(ow), F.lit(0)).alias(f"_ot{i}") for i in range(len(flags))],
                     F.sum("_c").over(Window.partitionBy(*keys)).cast("long").alias("total"))
    # ``off`` has one row per non-empty (partition, key), #partitions + #keys at most
    cums = [(F.col(c) + F.col(f"_ot{i}")).cast("long") for i, c in enumerate(local)]
    return (r.join(F.broadcast(off), ["_pid", *keys])
             .withColumn("rank", (F.col("_lr") + F.col("_oc")).cast("long"))
             .withColumn("cum", cums[0] if isinstance(flag, str) else F.array(*cums))
             .drop("_pid", "_lr", "_oc", *local, *[f"_ot{i}" for i in range(len(flags))]))

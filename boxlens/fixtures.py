"""Detection tables derived from the driver's TPC-H-like parquet files.

The driver data has no boxes, so ground truth and predictions are computed from
``lineitem`` keys with integer arithmetic that Spark and DuckDB evaluate alike.  Every
table exists twice: as a Spark DataFrame (``Derived``) and as DuckDB SQL (``duck_with``),
so each registered query can be checked against an independent engine.

Tables (all in dataset ``ds1``):
  samples      one row per order (image)
  annotations  ground truth, run ``run_a`` (all predictions), run ``run_b`` (k=1 copies)
  categories   distinct return flags, ranked
  embeddings   64-d vectors plus planted scaled copies (near-duplicate groups)
  overrides    manual triage labels on every 11th annotation
  edits        update / delete / create on every 13th ground-truth box
  views        three saved filter sets
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET = "ds1"
GT = "ground_truth"
RUN_A = "run_a"
RUN_B = "run_b"

# Triage labels used to fill the overrides fixture, in cycle order.
OVERRIDE_LABELS = ["tp", "fp", "fn", "mistake"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BOX_ROWS = 250_000         # rows of lineitem or orders that one task makes boxes or images of; more rows make more tasks

# sf_dir -> folder holding the materialised detection tables (see ``materialize``)
_STORED: dict[str, str] = {}

# table -> partition columns when stored
STORED_TABLES = {"samples": ["dataset_id"], "annotations": ["dataset_id", "source"], "categories": ["dataset_id"],
                 "embeddings": ["dataset_id"], "overrides": ["dataset_id"], "edits": ["dataset_id"]}


@dataclass
class Derived:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return _read(self.spark, self.sf_dir, name)

    def __getattribute__(self, name):
        # once materialised, detection tables are read from their partitioned parquet copy
        if name in STORED_TABLES:
            stored = _STORED.get(object.__getattribute__(self, "sf_dir"))
            if stored:
                return object.__getattribute__(self, "spark").read.parquet(f"{stored}/{name}")
        return object.__getattribute__(self, name)

    def materialize(self, path: str) -> dict[str, int]:
        """Ingest: write every detection table as parquet partitioned like production
        (annotations by dataset_id and source) and serve later reads from there."""
        counts = {}
        for name, parts in STORED_TABLES.items():
            df = object.__getattribute__(self, name)
            df.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{name}")
        _STORED[self.sf_dir] = path
        for name in STORED_TABLES:
            counts[name] = getattr(self, name).count()
        return counts

    # -- boxes ---------------------------------------------------------------------------
    @cached_property
    def tasks(self) -> int:
        """Tasks to deal boxes or images to, so many that none holds much more than BOX_ROWS.  (The counts are read from
        the files' footers.)"""
        return -(-max(self.table(t).count() for t in ("lineitem", "orders")) // BOX_ROWS)

    @cached_property
    def base(self) -> DataFrame:
        li = self.table("lineitem")
        if self.tasks > 1:
            # the minima of strings are taken of sorted rows: partitions cut by their (compressed) bytes, or of a fixed
            # number, sort more rows a task the larger the table is
            tasks = max(self.tasks, self.spark.sparkContext.defaultParallelism)
            li = li.repartition(tasks, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        return (li.groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"),
                           F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
                  .agg(F.min("l_linestatus").alias("st"), F.min("l_returnflag").alias("rf")))

    @cached_property
    def gt(self) -> DataFrame:
        o, p, s, n = (F.col(c) for c in "opsn")
        return (self.base.filter(F.col("st") == "F").select(
            "o", "p", "s", "n",
            F.concat(F.lit("g_"), o.cast("string"), F.lit("_"), p.cast("string"), F.lit("_"),
                     s.cast("string"), F.lit("_"), n.cast("string")).alias("id"),
            o.cast("string").alias("sample_id"),
            F.col("rf").alias("category_name"),
            (p % 40).cast("double").alias("x"), (s % 40).cast("double").alias("y"),
            (20 + p % 11).cast("double").alias("w"), (20 + s % 13).cast("double").alias("h")))

    @cached_property
    def pr(self) -> DataFrame:
        o, p, s, n, k = (F.col(c) for c in "opsnk")
        keep = (((F.col("st") == "F") & (s % 10 < 8) & ((k == 0) | (p % 3 == 0)))
                | ((F.col("st") == "O") & (k == 0) & (s % 5 == 0)))
        # k = 0, 1: a generator doubles each row in place (no join, no shuffle)
        return (self.base.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter(keep).select(
            "o", "p", "s", "n", "k",
            F.concat(F.lit("p"), k.cast("string"), F.lit("_"), o.cast("string"), F.lit("_"),
                     p.cast("string"), F.lit("_"), s.cast("string"), F.lit("_"),
                     n.cast("string")).alias("id"),
            o.cast("string").alias("sample_id"),
            F.when(p % 7 == 0, F.lit("N")).otherwise(F.col("rf")).alias("category_name"),
            (p % 40 + (s + k * 3) % 5).cast("double").alias("x"),
            (s % 40 + (p + k) % 4).cast("double").alias("y"),
            (20 + p % 11).cast("double").alias("w"), (20 + s % 13).cast("double").alias("h"),
            (((p * 7 + s * 13 + n * 31 + k * 17) % 100).cast("double") / 100).alias("conf")))

    @cached_property
    def annotations(self) -> DataFrame:
        def shape(df, source, conf, id_col=F.col("id")):
            return df.select(
                F.lit(DATASET).alias("dataset_id"), id_col.alias("id"), "sample_id", "category_name",
                F.col("x").alias("bbox_x"), F.col("y").alias("bbox_y"),
                F.col("w").alias("bbox_w"), F.col("h").alias("bbox_h"),
                (F.col("w") * F.col("h")).alias("area"), F.lit(False).alias("is_crowd"),
                F.lit(source).alias("source"), conf.alias("confidence"))
        return (shape(self.gt, GT, F.lit(None).cast("double"))
                .unionByName(shape(self.pr, RUN_A, F.col("conf")))
                .unionByName(shape(self.pr.filter(F.col("k") == 1), RUN_B, F.col("conf"),
                                   F.concat(F.lit("b"), F.col("id")))))

    # -- samples -------------------------------------------------------------------------
    @cached_property
    def samples(self) -> DataFrame:
        ok = F.col("o_orderkey")
        prio = F.col("o_orderpriority")
        tags = (F.when(ok % 23 == 0, F.lit(None).cast("array<string>"))
                 .when(ok % 17 == 0, F.array(prio, F.lit("triage:fp")))
                 .otherwise(F.array(prio)))
        return self.table("orders").select(
            ok.cast("string").alias("id"), F.lit(DATASET).alias("dataset_id"),
            F.concat(F.lit("img_"), ok.cast("string"), F.lit(".jpg")).alias("file_name"),
            (640 + 320 * (ok % 5)).cast("int").alias("width"),
            (480 + 240 * (ok % 4)).cast("int").alias("height"),
            F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val")
             .alias("split"),
            tags.alias("tags"))

    @cached_property
    def categories(self) -> DataFrame:
        # distinct flags first (tiny after the aggregate), then rank: the window sees <= a
        # handful of rows
        from pyspark.sql import Window
        d = self.base.select(F.col("rf").alias("name")).distinct()
        return d.select(F.lit(DATASET).alias("dataset_id"), "name",
                        F.dense_rank().over(Window.orderBy("name")).cast("int").alias("category_id"))

    # -- vectors -------------------------------------------------------------------------
    @cached_property
    def embeddings(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        twice = F.transform("v", lambda x: x * 2)

        def shape(df, id_col, vec):
            return df.select(id_col.cast("string").alias("sample_id"), F.lit(DATASET).alias("dataset_id"),
                             F.lit("m64").alias("model_name"), vec.alias("vector"))
        out = (shape(e, F.col("vec_id"), F.col("v"))
               .unionByName(shape(e.filter(F.col("vec_id") % 10 == 0) .unionByName(e.filter(F.col("vec_id") % 10 == 5)),
                                  F.col("vec_id") + 100000, twice))
               .unionByName(shape(e.filter(F.col("vec_id") % 10 == 0), F.col("vec_id") + 200000, twice)))
        return out.select("*", F.element_at("vector", 1).alias("x"), F.element_at("vector", 2).alias("y"))

    # -- triage overrides and edits ------------------------------------------------------
    @cached_property
    def overrides(self) -> DataFrame:
        labels = F.array(*[F.lit(x) for x in OVERRIDE_LABELS])
        g = self.gt.select("o", "p", "s", "n", F.lit(0).alias("k"), "id", "sample_id")
        p = self.pr.select("o", "p", "s", "n", "k", "id", "sample_id")
        both = g.unionByName(p)
        return (both.filter((F.col("p") + F.col("s") + F.col("n") + F.col("k")) % 11 == 0)
                    .select(F.col("id").alias("annotation_id"), F.lit(DATASET).alias("dataset_id"),
                            "sample_id",
                            F.element_at(labels, (F.col("o") % 4 + 1).cast("int")).alias("label"),
                            F.lit(True).alias("is_override"),
                            (F.lit("2024-01-01 00:00:00").cast("timestamp")
                             + F.make_interval(mins=(F.col("n")).cast("int"))).alias("created_at")))

    @cached_property
    def edits(self) -> DataFrame:
        g = self.gt.filter((F.col("p") + F.col("s") + F.col("n")) % 13 == 0)
        op = F.element_at(F.array(F.lit("update"), F.lit("delete"), F.lit("create")),
                          (F.col("o") % 3 + 1).cast("int"))
        return g.select(
            op.alias("op"),
            F.when(op == "create", F.concat(F.lit("c_"), F.col("id"))).otherwise(F.col("id")).alias("id"),
            F.lit(DATASET).alias("dataset_id"), "sample_id",
            F.when(op == "delete", F.lit(None)).otherwise(F.col("category_name")).alias("category_name"),
            F.when(op == "delete", F.lit(None)).otherwise(F.col("x") + 1).alias("bbox_x"),
            F.when(op == "delete", F.lit(None)).otherwise(F.col("y") + 2).alias("bbox_y"),
            F.when(op == "delete", F.lit(None)).otherwise(F.col("w") + 3).alias("bbox_w"),
            F.when(op == "delete", F.lit(None)).otherwise(F.col("h")).alias("bbox_h"))

    @cached_property
    def views(self) -> DataFrame:
        rows = [(f"v{i}", DATASET, name, js, ts) for i, (name, js, ts) in enumerate(VIEW_LITERALS)]
        return self.spark.createDataFrame(
            rows, "id string, dataset_id string, name string, filters string, created_at string"
        ).withColumn("created_at", F.col("created_at").cast("timestamp")) \
         .withColumn("updated_at", F.col("created_at"))


# Three saved filter sets in the JSON shape {search, category, split, tags, sortBy, sortDir}.
VIEW_LITERALS = [
    ("urgent train", '{"search":"img_1","category":"A","split":"train","tags":["1-URGENT"],"sortBy":"width","sortDir":"desc"}', "2024-01-01 10:00:00"),
    ("flagged", '{"search":null,"category":null,"split":null,"tags":["triage:fp"],"sortBy":"file_name","sortDir":"asc"}', "2024-01-02 10:00:00"),
    ("val N", '{"search":"5","category":"N","split":"val","tags":[],"sortBy":"height","sortDir":"asc"}', "2024-01-03 10:00:00"),
]


def derived(spark: SparkSession, sf_dir: str) -> Derived:
    return Derived(spark, sf_dir)


# --------------------------------------------------------------------------------------
# The same tables as DuckDB SQL (oracle side).
# --------------------------------------------------------------------------------------

_DUCK_CTES = {
    "base": """SELECT l_orderkey o, l_partkey p, l_suppkey s, l_linenumber n,
                 MIN(l_linestatus) st, MIN(l_returnflag) rf
          FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber""",
    "gt": """SELECT o, p, s, n, CONCAT('g_',o,'_',p,'_',s,'_',n) id, CAST(o AS VARCHAR) sample_id, rf category_name,
               CAST(p%40 AS DOUBLE) x, CAST(s%40 AS DOUBLE) y,
               CAST(20+p%11 AS DOUBLE) w, CAST(20+s%13 AS DOUBLE) h
        FROM base WHERE st='F'""",
    "pr": """SELECT o, p, s, n, k, CONCAT('p',k,'_',o,'_',p,'_',s,'_',n) id, CAST(o AS VARCHAR) sample_id,
               CASE WHEN p%7=0 THEN 'N' ELSE rf END category_name,
               CAST(p%40+(s+k*3)%5 AS DOUBLE) x, CAST(s%40+(p+k)%4 AS DOUBLE) y,
               CAST(20+p%11 AS DOUBLE) w, CAST(20+s%13 AS DOUBLE) h,
               CAST((p*7+s*13+n*31+k*17)%100 AS DOUBLE)/100 conf
        FROM base CROSS JOIN (SELECT 0 k UNION ALL SELECT 1 k) kk
        WHERE (st='F' AND s%10<8 AND (k=0 OR p%3=0)) OR (st='O' AND k=0 AND s%5=0)""",
    "annotations": """SELECT 'ds1' dataset_id, id, sample_id, category_name, x bbox_x, y bbox_y, w bbox_w, h bbox_h,
                 w*h area, false is_crowd, 'ground_truth' source, CAST(NULL AS DOUBLE) confidence FROM gt
          UNION ALL SELECT 'ds1', id, sample_id, category_name, x, y, w, h, w*h, false, 'run_a', conf FROM pr
          UNION ALL SELECT 'ds1', CONCAT('b', id), sample_id, category_name, x, y, w, h, w*h, false, 'run_b', conf
                    FROM pr WHERE k=1""",
    "samples": """SELECT CAST(o_orderkey AS VARCHAR) id, 'ds1' dataset_id,
                 CONCAT('img_', o_orderkey, '.jpg') file_name,
                 CAST(640+320*(o_orderkey%5) AS INTEGER) width, CAST(480+240*(o_orderkey%4) AS INTEGER) height,
                 CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' END split,
                 CASE WHEN o_orderkey%23=0 THEN NULL
                      WHEN o_orderkey%17=0 THEN [o_orderpriority, 'triage:fp']
                      ELSE [o_orderpriority] END tags
          FROM orders""",
    "categories": """SELECT 'ds1' dataset_id, name, CAST(DENSE_RANK() OVER (ORDER BY name) AS INTEGER) category_id
          FROM (SELECT DISTINCT rf name FROM base)""",
    "emb": """SELECT CAST(vec_id AS VARCHAR) sample_id, 'ds1' dataset_id, 'm64' model_name,
                 CAST(embedding AS DOUBLE[]) vector FROM embeddings
          UNION ALL SELECT CAST(vec_id+100000 AS VARCHAR), 'ds1', 'm64',
                 list_transform(CAST(embedding AS DOUBLE[]), lambda x: x*2) FROM embeddings WHERE vec_id%10 IN (0, 5)
          UNION ALL SELECT CAST(vec_id+200000 AS VARCHAR), 'ds1', 'm64',
                 list_transform(CAST(embedding AS DOUBLE[]), lambda x: x*2) FROM embeddings WHERE vec_id%10 = 0""",
    "emb_xy": """SELECT *, vector[1] x, vector[2] y FROM emb""",
    "overrides": """SELECT id annotation_id, 'ds1' dataset_id, sample_id,
                 (['tp','fp','fn','mistake'])[o%4+1] label, true is_override,
                 TIMESTAMP '2024-01-01 00:00:00' + n * INTERVAL 1 MINUTE created_at
          FROM (SELECT o, p, s, n, 0 k, id, sample_id FROM gt UNION ALL SELECT o, p, s, n, k, id, sample_id FROM pr)
          WHERE (p+s+n+k)%11 = 0""",
    "edits": """SELECT op, CASE WHEN op='create' THEN CONCAT('c_', id) ELSE id END id, 'ds1' dataset_id, sample_id,
                 CASE WHEN op='delete' THEN NULL ELSE category_name END category_name,
                 CASE WHEN op='delete' THEN NULL ELSE x+1 END bbox_x,
                 CASE WHEN op='delete' THEN NULL ELSE y+2 END bbox_y,
                 CASE WHEN op='delete' THEN NULL ELSE w+3 END bbox_w,
                 CASE WHEN op='delete' THEN NULL ELSE h END bbox_h
          FROM (SELECT *, (['update','delete','create'])[o%3+1] op FROM gt WHERE (p+s+n)%13 = 0)""",
}


def duck_with(*extra: str) -> str:
    """``WITH`` clause defining every derived table, plus optional extra CTE bodies
    given as ``"name AS (...)"`` strings.  Unused CTEs cost nothing in DuckDB."""
    parts = [f"{k} AS ({v})" for k, v in _DUCK_CTES.items()]
    views = " UNION ALL ".join(
        f"SELECT 'v{i}' id, 'ds1' dataset_id, '{n}' name, '{j}' filters, TIMESTAMP '{t}' created_at"
        for i, (n, j, t) in enumerate(VIEW_LITERALS))
    parts.append(f"views AS ({views})")
    parts.extend(extra)
    return "WITH " + ",\n".join(parts) + "\n"

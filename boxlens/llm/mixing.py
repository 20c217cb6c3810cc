"""Operator 4: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Plan (DataFrame functions only):

1. Word counts and sources: a thin table (doc_id, hash of the text, source, words).  Targets share
   the total by weight, stopping at three times a source's size.
2. A source's documents fall into blocks by hash.  Every block is taken once per whole pass over
   the source; the rest of the target takes blocks in a hashed order up to the block that
   crosses it, of which single documents are taken.
3. The taken blocks are the source's quota.  A binary tree deals all quotas to the output
   shards: at each node a uniformly drawn half of the node's block tokens goes left, which is a
   draw from the multivariate hypergeometric distribution of the quotas below it.
4. Each shard's quota of a source is filled with the next blocks of the source's own hashed
   permutation, so shards hold disjoint blocks, and a shard is shuffled by a hash of its rows.

Windows run over sources, blocks or the documents of one block per source, never over a
source's documents; all draws are hashes of ids with a seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlens.session import pin

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DOCS_PER_BLOCK = 64
MAX_BLOCKS = 4096            # blocks of one source; larger sources have larger blocks
WORDS_PER_SHARD = 8_000_000
FILL_PASSES = 4              # window passes of one round of filling
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size, ...) plus target (double).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes.  A target stops at ``repeats`` times its source's size and the excess is shared by
    weight among the others until none is above: the level at which the shares of the
    unstopped sources use up the total.  One row per source passes through one window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w.cast("double")).withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - before) / from_here
    s = s.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    # levels fall once they fit; the first that fits is the largest of them
    s = s.withColumn("_level", F.coalesce(F.max(fits).over(whole), F.lit(math.inf)))
    return s.withColumn("target", F.least("_cap", F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_level")


def _join(a: DataFrame, b: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """Join on source (null equals null) and ``cols``; the left side's columns stay."""
    b = b.select(*[F.col(c).alias(f"_r_{c}") for c in ("source", *cols)], *[c for c in b.columns if c not in ("source", *cols)])
    cond = a["source"].eqNullSafe(b["_r_source"])
    for c in cols:
        cond = cond & (a[c] == b[f"_r_{c}"])
    return a.join(b, cond, how).drop(*[f"_r_{c}" for c in ("source", *cols)])


def _block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("th")), F.col("n_blocks"))


def plan(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, words_per_shard: int = WORDS_PER_SHARD) -> dict:
    """The mixture of ``docs`` (doc_id, text, source) as tables:

    thin (a row per document: doc_id, th, source, size, source_size, target, n_blocks, block),
    sources, units (a row per taken copy of a block: source, block, copy, partial, shard),
    chosen (documents taken from partial units: source, doc_id, th)."""
    thin0 = pin(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                            F.xxhash64(F.col("text").cast("string")).alias("th"), word_count(F.col("text").cast("string")).alias("size")))
    sizes = thin0.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sizes, weights)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = pin(sources.withColumn("passes", passes)
                         .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
                         .withColumn("n_blocks", F.least(F.ceil(F.col("n_docs") / DOCS_PER_BLOCK), F.lit(MAX_BLOCKS)).cast("long"))
                         .drop("n_docs"))
    thin = _join(thin0, sources.select("source", "source_size", "target", "n_blocks"), how="inner").withColumn("block", _block_of(seed))

    # blocks in the source's hashed order with running sizes
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    run = F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = _join(thin.groupBy("source", "block").agg(F.sum("size").alias("block_size")).withColumn("run", run),
                   sources.select("source", "passes", "rest"))
    blocks = pin(blocks.withColumn("whole", (F.col("run") <= F.col("rest")) & (F.col("rest") > 0)))
    by_source = Window.partitionBy("source")
    chosen = fill(thin.select("source", "block", "doc_id", "th", "size"), blocks.filter(~F.col("whole") & (F.col("rest") > 0)), seed)

    # one row per taken copy of a block
    copies = F.col("passes") + F.col("whole").cast("int")
    partial = _join(blocks, chosen.select("source", "block").distinct(), "block", how="left_semi")
    taken = (blocks.filter(copies > 0).select("source", "block", F.explode(F.sequence(F.lit(1), copies)).alias("copy"), F.lit(False).alias("partial"))
                   .unionByName(partial.select("source", "block", (F.col("passes") + 1).alias("copy"), F.lit(True).alias("partial"))))
    units = pin(taken.withColumn("place", F.row_number().over(
        by_source.orderBy(F.xxhash64(F.lit(seed + 3), "source", "block", "copy"), "block", "copy"))))
    total = thin0.agg(F.sum("size")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1.0, total / words_per_shard))))
    shards = split_quotas(units.groupBy("source").agg(F.count("*").alias("quota")), depth, seed)
    # a shard's quota of a source takes the next places of the source's permutation
    offsets = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (shards.withColumn("_lo", F.coalesce(F.sum("quota").over(offsets), F.lit(0)))
                    .select("source", "shard", F.explode(F.sequence(F.col("_lo") + 1, F.col("_lo") + F.col("quota"))).alias("place")))
    units = pin(_join(units, ranges, "place").drop("place"))
    return {"thin": thin, "sources": sources, "units": units, "chosen": chosen, "depth": depth}


def fill(docs: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """Documents (source, block, doc_id, th) that fill what whole blocks leave of each target.

    ``blocks`` (source, block, block_size, run, rest) are those that are not taken whole, in the source's
    order.  Documents that exceed the room left are passed over.  A round takes the first blocks whose fitting
    documents could fill the room and their documents in hashed order as long as they fit, in a few
    passes; rounds go on, over all blocks, until no document fits.  Each round's windows hold about
    the room's words; rows equal in source, doc_id and text of an earlier round's choice stay out."""
    # what the whole blocks leave: the first block of the others begins at their end
    room = pin(blocks.groupBy("source").agg(F.max(F.col("rest") - F.col("run") + F.col("block_size")).alias("room")).filter("room > 0"))
    places = blocks.select("source", "block", "run")
    by_source = Window.partitionBy("source")
    before = by_source.orderBy("run", "block").rowsBetween(Window.unboundedPreceding, -1)
    place = by_source.orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "th"), "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    chosen = None
    while True:
        d = _join(_join(docs.filter("size > 0"), room), places, "block").filter(F.col("size") <= F.col("room"))
        if chosen is not None:
            c = chosen.select(F.col("source").alias("_cs"), F.col("doc_id").alias("_cd"), F.col("th").alias("_ct"))
            d = d.join(c, d["source"].eqNullSafe(c["_cs"]) & d["doc_id"].eqNullSafe(c["_cd"]) & d["th"].eqNullSafe(c["_ct"]), "left_anti")
        fitting = d.groupBy("source", "block", "run", "room").agg(F.sum("size").alias("_fit"))
        fitting = fitting.withColumn("_before", F.coalesce(F.sum("_fit").over(before), F.lit(0))).filter(F.col("_before") < F.col("room"))
        d = _join(d, fitting.select("source", "block"), "block").withColumn("took", F.lit(False))
        for _ in range(FILL_PASSES):
            d = d.withColumn("_left", F.col("room") - F.sum(F.when(F.col("took"), F.col("size")).otherwise(0)).over(by_source))
            fits = ~F.col("took") & (F.col("size") <= F.col("_left"))
            d = d.withColumn("_run", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(place))
            d = d.withColumn("took", F.col("took") | (fits & (F.col("_run") <= F.col("_left"))))
        now = pin(d.filter("took").select("source", "block", "doc_id", "th", "size", "room"))
        if now.limit(1).count() == 0:
            return now.select("source", "block", "doc_id", "th") if chosen is None else chosen
        now_docs = now.select("source", "block", "doc_id", "th")
        chosen = now_docs if chosen is None else pin(chosen.unionByName(now_docs))
        room = pin(now.groupBy("source", "room").agg(F.sum("size").alias("_s")).select("source", (F.col("room") - F.col("_s")).alias("room")).filter("room > 0"))


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``quotas`` (source, quota) dealt to 2^depth shards: (source, shard, quota).

    Every quota is a pile of tokens.  A node sends a uniformly drawn half of its tokens (the
    larger half if odd) left, so its children's piles follow the multivariate hypergeometric
    distribution and every shard ends within one token of the others at its level."""
    t = quotas.select("source", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("token"), F.lit(0).alias("shard"))
    for level in range(depth):
        drawn = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 100 + level), "source", "token", "shard"), "source", "token")
        n = F.count("*").over(Window.partitionBy("shard"))
        right = (F.row_number().over(drawn) * 2 > n + 1).cast("int")
        t = t.withColumn("shard", F.col("shard") * 2 + right)
    return t.groupBy("source", "shard").agg(F.count("*").alias("quota"))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row per taken copy, plus copy (from 1), shard
    and shuffle_key, dealt out by shard and locally sorted by the key.

    Null text has no words (size 0); zero-size rows come along with whole blocks.  A null source
    is a source of its own, last in order.  Rows equal in doc_id, source and text are drawn alike in whole
    blocks; of a crossing block as many of them are taken as fit.  Columns of docs named copy,
    shard or shuffle_key are replaced."""
    p = plan(docs, seed, weights, words_per_shard)
    base = docs.drop("copy", "shard", "shuffle_key")
    keyed = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"), "doc_id",
                        F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    keyed = _join(keyed, p["sources"].select("source", "n_blocks")).withColumn("block", _block_of(seed))
    units = p["units"]
    whole = _join(keyed, units.filter("NOT partial").select("source", "block", "copy", "shard"), "block")
    # documents of crossing blocks: a row may be chosen as often as it is listed
    listed = p["chosen"].groupBy("source", "block", "doc_id", "th").agg(F.count("*").alias("n"))
    some = _join(keyed, units.filter("partial").select("source", "block", "copy", "shard"), "block")
    l = listed.select(F.col("source").alias("_ls"), F.col("doc_id").alias("_ld"), F.col("th").alias("_lt"), "n")
    some = some.join(l, some["source"].eqNullSafe(l["_ls"]) & some["doc_id"].eqNullSafe(l["_ld"]) & some["th"].eqNullSafe(l["_lt"]))
    nth = F.row_number().over(Window.partitionBy("source", "doc_id", "th").orderBy("copy"))
    some = some.withColumn("_nth", nth).filter("_nth <= n").drop("_ls", "_ld", "_lt", "n", "_nth")
    rows = whole.unionByName(some).withColumn("shuffle_key", F.xxhash64(F.lit(seed + 5), "doc_id", "th", "copy"))
    out = rows.select("_row.*", "copy", "shard", "shuffle_key")
    # a task a shard: partitions are named, not hashed
    return out.repartitionById(2 ** p["depth"], F.col("shard").cast("int")).sortWithinPartitions("shard", "shuffle_key")


def taken_words(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (size times the copies
    the mixture holds), source."""
    p = plan(docs, seed)
    per_block = p["units"].groupBy("source", "block").agg(F.sum((~F.col("partial")).cast("int")).alias("copies"))
    t = _join(p["thin"], per_block, "block", how="left")
    listed = (p["chosen"].groupBy("source", "doc_id", "th").agg(F.count("*").alias("n"))
                         .select(F.col("source").alias("_ls"), F.col("doc_id").alias("_ld"), F.col("th").alias("_lt"), "n"))
    t = t.join(listed, t["source"].eqNullSafe(listed["_ls"]) & t["doc_id"].eqNullSafe(listed["_ld"]) & t["th"].eqNullSafe(listed["_lt"]), "left")
    # of rows equal in everything, as many as are listed
    nth = F.row_number().over(Window.partitionBy("source", "doc_id", "th").orderBy("size"))
    extra = F.when(F.col("n").isNotNull() & (nth <= F.col("n")), 1).otherwise(0)
    return t.select("doc_id", "size", "source_size", "target",
                    (F.col("size") * (F.coalesce("copies", F.lit(0)) + extra)).cast("long").alias("taken"), "source")

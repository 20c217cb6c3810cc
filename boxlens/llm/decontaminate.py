"""Operator 3: benchmark decontamination with suffix arrays of the training text.

Every task builds word-level suffix arrays of its shards (slices of some megabytes of whole
documents), finds every test suffix in them by binary search, and merges the occurrences of
successive suffixes into longest verbatim matches with their places.  A shard is one narrow
pass over its documents: nothing is shuffled, and the suffix arrays never leave the task.

The test set travels to the tasks in blocks of bounded size (``BLOCK_BYTES`` of text); a
larger test set takes one pass per block, whose findings are then combined per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm import textvec

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20        # text of one block of test items sent to the tasks

_TABLE = textvec.byte_table("alnum")


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``seq`` (ids from 0) in the order of their first ``depth`` ids at least.

    Packs as many ids as fit into one sort key, then refines only the groups that still tie,
    by the ranks found so far, so each round triples the sorted depth."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(seq.max()).bit_length())
    k = min(depth, 63 // bits)
    key = np.zeros(n, np.int64)
    for t in range(k):
        key <<= bits
        if t < n:
            key[:n - t] |= seq[t:]
    sa = np.argsort(key, kind="stable")
    sk = key[sa]
    first = np.concatenate([[True], sk[1:] != sk[:-1]])
    rank = np.empty(n + 2 * depth, np.int64)
    rank[n:] = -1                                   # beyond the end sorts first
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    done = k
    shift = n.bit_length()
    pack = 2 if 3 * shift <= 63 else 1              # further ranks that fit behind the own one
    while done < depth:
        tie = ~first | np.concatenate([~first[1:], [False]])
        slots = np.flatnonzero(tie)
        if not len(slots):
            break
        at = sa[slots]
        key = rank[at]
        for t in range(1, pack + 1):
            key = (key << shift) | (rank[np.minimum(at + t * done, n + depth)] + 1)
        order = np.argsort(key, kind="stable")
        sk = key[order]
        sa[slots] = at[order]
        new = np.concatenate([[True], sk[1:] != sk[:-1]])
        first[slots] = new
        rank[sa[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        done *= 1 + pack
    return sa


def _bound(seq, sa, q, length, upper: bool) -> np.ndarray:
    """For each row of ``q``: the number of suffixes whose first ``length`` ids sort before it
    (with ``upper``: not after it)."""
    lo = np.zeros(len(q), np.int64)
    hi = np.full(len(q), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        at = sa[mid]
        sign = np.zeros(len(open_), np.int8)        # of suffix - query at the first difference
        for t in range(q.shape[1]):
            live = (sign == 0) & (length[open_] > t)
            if not live.any():
                break
            a = np.where(at + t < len(seq), seq[np.minimum(at + t, len(seq) - 1)], -1)
            sign = np.where(live, np.sign(a - q[open_, t]), sign).astype(np.int8)
        right = sign < 0 if not upper else sign <= 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def test_suffixes(item_ids, texts: pa.Array) -> dict:
    """The windows at which test suffixes begin: word hashes (rows of WINDOW, padded), length,
    item number and place; items of fewer words are one window."""
    data, off = textvec.buffers(texts)
    rows, length, item, place = [], [], [], []
    for i, j in textvec.slices(off):
        m, s, e, woff = textvec.words(data, off[i:j + 1], _TABLE)
        h = textvec.hash_words(m, s, e)
        for t in range(j - i):
            w = h[woff[t]:woff[t + 1]]
            if len(w) >= WINDOW:
                v = np.lib.stride_tricks.sliding_window_view(w, WINDOW)
            elif len(w):
                v = np.concatenate([w, np.zeros(WINDOW - len(w), np.uint64)])[None]
            else:
                continue
            rows.append(v)
            length.append(np.full(len(v), min(len(w), WINDOW)))
            item.append(np.full(len(v), i + t))
            place.append(np.arange(len(v)))
    if not rows:
        return {"q": np.zeros((0, WINDOW), np.uint64), "length": np.zeros(0, np.int64), "item": np.zeros(0, np.int64),
                "place": np.zeros(0, np.int64), "ids": list(item_ids)}
    return {"q": np.concatenate(rows), "length": np.concatenate(length), "item": np.concatenate(item),
            "place": np.concatenate(place), "ids": list(item_ids)}


def shard_matches(h: np.ndarray, woff: np.ndarray, tests: dict):
    """Longest verbatim matches in one shard: arrays (doc, item, doc_start, item_start, n_words)."""
    none = [np.zeros(0, np.int64)] * 5
    vocab, inv = np.unique(h, return_inverse=True)
    if not len(vocab) or not len(tests["q"]):
        return none
    # ids from 1; every document ends with id 0, which no test word has
    n_docs = len(woff) - 1
    seq = np.zeros(len(h) + n_docs, np.int64)
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(woff))
    seq[np.arange(len(h)) + doc_of_word] = inv + 1
    at = np.minimum(np.searchsorted(vocab, tests["q"]), len(vocab) - 1)
    inside = np.arange(WINDOW)[None, :] < tests["length"][:, None]
    known = (vocab[at] == tests["q"]) | ~inside
    live = np.flatnonzero(known.all(axis=1))         # a suffix with an unknown word occurs nowhere
    if not len(live):
        return none
    q, length = at[live] + 1, tests["length"][live]
    sa = suffix_array(seq, WINDOW)
    lo = _bound(seq, sa, q, length, False)
    hi = _bound(seq, sa, q, length, True)
    n = hi - lo
    w = np.repeat(np.arange(len(live)), n)
    pos = sa[np.repeat(lo, n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
    start = woff[:-1] + np.arange(n_docs)            # first place of each document in seq
    doc = np.searchsorted(start, pos, side="right") - 1
    item, place = tests["item"][live][w], tests["place"][live][w]
    # successive suffixes found at successive places are one longer match
    order = np.lexsort((pos, pos - place, item))
    doc, item, place, pos, ln = doc[order], item[order], place[order], pos[order], length[w][order]
    if not len(pos):
        return none
    head = np.ones(len(pos), bool)
    head[1:] = ((item[1:] != item[:-1]) | (pos[1:] != pos[:-1] + 1) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(head)
    run = np.diff(np.concatenate([at, [len(pos)]]))
    return [doc[at], item[at], pos[at] - start[doc[at]], place[at], run - 1 + ln[at]]


def _scan(tests_bc, item_type: pa.DataType):
    def scan(batches):
        tests = tests_bc.value
        ids = pa.array(tests["ids"], item_type)
        for b in batches:
            data, off = textvec.buffers(b.column("text"))
            for i, j in textvec.slices(off, SHARD_BYTES):
                hs, counts = [], [np.zeros(1, np.int64)]
                for u, v in textvec.slices(off[i:j + 1]):     # hashed in smaller slices
                    m, s, e, woff = textvec.words(data, off[i + u:i + v + 1], _TABLE)
                    hs.append(textvec.hash_words(m, s, e))
                    counts.append(np.diff(woff))
                woff = np.cumsum(np.concatenate(counts))
                doc, item, start, istart, n = shard_matches(np.concatenate(hs), woff, tests)
                by = np.lexsort((istart, item, start, doc))
                doc, item, start, istart, n = doc[by], item[by], start[by], istart[by], n[by]
                offs = np.searchsorted(doc, np.arange(j - i + 1))
                st = pa.StructArray.from_arrays(
                    [ids.take(pa.array(item, pa.int64())),
                     pa.array(start, pa.int32()), pa.array(istart, pa.int32()), pa.array(n, pa.int32())],
                    ["item", "doc_start", "item_start", "n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(np.diff(woff), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offs, pa.int32()), st)], ["doc_id", "th", "n_words", "matches"])
    return scan


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of its text), n_words and matches, the longest
    verbatim matches with test items as (item, doc_start, item_start, n_words), words from 0.

    A match is at least ten words long, or a whole item of fewer.  Null and wordless texts have
    no words and no matches; a null item_id leaves ``item`` null; other columns are ignored.  doc_id
    and item_id may be of any type."""
    spark = docs.sparkSession
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                      F.xxhash64(F.col("text").cast("string")).alias("th"))
    bench = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (bench, "item_id")))
    match = f"array<struct<item:{item_kind},doc_start:int,item_start:int,n_words:int>>"
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = None
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        tests = test_suffixes(part["item_id"].to_pylist(), part["text"].combine_chunks())
        one = src.mapInArrow(_scan(spark.sparkContext.broadcast(tests), part.schema.field("item_id").type),
                             f"doc_id {doc_kind}, th long, n_words long, matches {match}")
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        # every row was seen once per block; equal rows are told apart by their number
        found = (found.groupBy("doc_id", "th", "n_words")
                      .agg(F.count("*").alias("c"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
                      .withColumn("_i", F.explode(F.sequence(F.lit(1), (F.col("c") / F.lit(blocks)).cast("int"))))
                      .select("doc_id", "th", "n_words", "matches"))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``verbatim_matches`` plus, per document: n_hit (words inside any match), n_items (distinct
    item_ids matched), items_sha256 (of those ids, sorted as strings, comma-joined), longest
    (words of the longest match, 0 if none) and contaminated (n_hit > 0)."""
    m = verbatim_matches(docs, benchmark, block_bytes)
    spans = F.array_sort(F.transform("matches", lambda x: F.struct(
        x["doc_start"].alias("s"), (x["doc_start"] + x["n_words"]).alias("e"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["e"], x["e"]).alias("e"),
                              (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n")),
        lambda a: a["n"])
    items = F.array_sort(F.array_distinct(F.transform(
        F.filter("matches", lambda x: x["item"].isNotNull()), lambda x: x["item"].cast("string"))))
    return m.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["n_words"])), F.lit(0)).alias("longest"), "th", "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match; columns unchanged.  Texts equal to a contaminated
    one are contaminated too, so rows go by the hash of their text."""
    bad = contamination(docs, benchmark).filter("contaminated").select("th", "doc_id").distinct()
    key = F.xxhash64(docs["text"].cast("string")) == bad["th"]
    return docs.join(bad, key & docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")

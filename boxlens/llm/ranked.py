"""Operator 11: ranked lexical search by the NRA algorithm (no random access).

Documents stay where they are: a task cuts its documents into shards of some megabytes of text
and inverts each shard in memory, for the terms of the queries only.  A term's postings are
sorted by impact, the integer share tf and length give a document, so a posting adds
weight * impact to a score.  Every query then reads its terms' lists from the top, block by block:

* a document's lower bound is the sum of what has been read of it;
* its upper bound adds, for each list in which it has not been seen, the value at that list's
  position (nothing below is larger; zero once the list has ended);
* a document whose upper bound is below the k-th best lower bound, or below the k-th score
  already found in earlier shards of the task, is out, and so are documents never seen once the sum of
  the positions' values is below it;
* reading goes on until the documents left have bounds that meet, so members, ties and final
  scores are exact, and no posting is ever looked up out of order.

A task keeps the best k of each query over its shards; the best k of all tasks are the result.
Postings are never shuffled.  Weights and lengths need counts over all documents first (one
narrow pass): documents, words, and documents per query term.

Queries travel to the tasks in blocks of bounded size (``BLOCK_TERMS`` terms), one pass per
block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlens.llm import textvec

K = 10
SHARD_BYTES = 16 << 20
BLOCK_TERMS = 1_000_000      # (query, term) pairs of one block of queries sent to the tasks
READ = 64                    # postings read of every list in the first step; steps double

_TABLE = textvec.byte_table("alnum")


def _term_hashes(data: np.ndarray, off: np.ndarray):
    m, s, e, woff = textvec.words(data, off, _TABLE)
    return textvec.hash_words(m, s, e), woff


def _item_terms(batches):
    """(item, text) -> item, term: the distinct term hashes of every text."""
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        for i, j in textvec.slices(off):
            h, woff = _term_hashes(data, off[i:j + 1])
            terms = [np.unique(h[woff[t]:woff[t + 1]]) for t in range(j - i)]
            take = pa.array(np.repeat(np.arange(i, j), [len(t) for t in terms]))
            yield pa.RecordBatch.from_arrays([b.column("item").take(take), pa.array(np.concatenate(terms).view(np.int64))], ["item", "term"])


def query_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS):
    """The queries in blocks: (item ids, terms, offsets of each item's terms).  ``items`` has item_id
    and text; all rows of one item_id are one query."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select(F.col("item_id").alias("item"), F.col("text").cast("string").alias("text"))
    terms = rows.mapInArrow(_item_terms, f"item {kind}, term long").distinct()
    total = terms.count()
    blocks = max(1, -(-total // block_terms))
    for k in range(blocks):
        part = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        t = part.sort("item", "term").toArrow()
        if not t.num_rows:
            continue
        item = t["item"].combine_chunks()
        ids = item.dictionary_encode(null_encoding="encode")
        number = ids.indices.to_numpy()
        yield (ids.dictionary.to_pylist(), t["term"].to_numpy().view(np.uint64),
               np.searchsorted(number, np.arange(len(ids.dictionary) + 1)))


def _counts(terms_bc):
    """(text) -> (term, n) of a task: documents holding each query term, and under the numbers -1 and -2
    the documents with a term and the terms of all documents."""
    def run(batches):
        vocab = terms_bc.value
        df, docs, words = np.zeros(len(vocab), np.int64), 0, 0
        for b in batches:
            data, off = textvec.buffers(b.column("text"))
            for i, j in textvec.slices(off):
                h, woff = _term_hashes(data, off[i:j + 1])
                doc, term, _ = _postings(h, woff, vocab)
                df += np.bincount(term, minlength=len(vocab))
                docs += int((np.diff(woff) > 0).sum())
                words += len(h)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [docs, words]]))], ["term", "n"])
    return run


def _postings(h: np.ndarray, woff: np.ndarray, vocab: np.ndarray):
    """(document, term number, tf) of the words that are in the sorted ``vocab``, by document."""
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    known = np.flatnonzero(vocab[at] == h)
    doc = np.searchsorted(woff, known, side="right") - 1
    both, tf = np.unique(doc * len(vocab) + at[known], return_counts=True)
    return both // len(vocab), both % len(vocab), tf


class Shard:
    """Impact-sorted postings of some documents for the terms of a block of queries."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def nra(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int, ids: np.ndarray):
        """(documents, scores) of the ``k`` best, by score descending and ``ids`` ascending, of scores
        above 0 and not below ``floor``; the lists are read in order only."""
        live = (self.start[terms + 1] > self.start[terms]) & (weight > 0)
        terms, weight = terms[live], weight[live]
        lo, hi = self.start[terms], self.start[terms + 1]
        at, step = lo.copy(), READ
        low = np.zeros(self.n_docs, np.int64)
        out = np.zeros(self.n_docs, bool)            # ruled out
        left = np.zeros(0, np.int64)                 # documents read of and not ruled out
        while True:
            new = [left]
            for t in range(len(terms)):
                end = min(at[t] + step, hi[t])
                d = self.doc[at[t]:end]
                low[d] += weight[t] * self.impact[at[t]:end]
                new.append(d[~out[d]])
                at[t] = end
            step *= 2                                # so what is read again below stays in proportion
            left = np.unique(np.concatenate(new))
            # nothing further down a list is worth more than its last posting read
            head = np.where(at < hi, weight * self.impact[at - 1], 0)
            more = np.zeros(self.n_docs, np.int64)   # heads of the lists a document was seen in
            for t in np.flatnonzero(head):
                more[self.doc[lo[t]:at[t]]] += head[t]
            up = low[left] + int(head.sum()) - more[left]
            bar = floor
            if len(left) >= k:
                bar = max(bar, int(np.partition(low[left], len(left) - k)[len(left) - k]))
            keep = up >= max(bar, 1)
            out[left[~keep]] = True
            left, up = left[keep], up[keep]
            # unseen documents cannot enter, and every document left is resolved (at the lists' ends at last)
            if int(head.sum()) < max(bar, 1) and (low[left] == up).all():
                break
        order = np.lexsort((ids[left], -low[left]))[:k]
        return left[order], low[left[order]]


def lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A document's m: 100 for average length, from 10 up, 90 a further average length."""
    return 10 + (90 * n.astype(np.int64) * docs) // max(words, 1)


def _search(block_bc, k: int, kind: pa.DataType):
    def run(batches):
        vocab, weight, item_terms, item_off, docs, words = block_bc.value
        best: list[list] = [[] for _ in range(len(item_off) - 1)]
        for ids, data, off in _shards(batches):
            hs, counts = [], [np.zeros(1, np.int64)]
            for u, v in textvec.slices(off):             # hashed in smaller slices
                h, woff = _term_hashes(data, off[u:v + 1])
                hs.append(h)
                counts.append(np.diff(woff))
            woff = np.cumsum(np.concatenate(counts))
            doc, term, tf = _postings(np.concatenate(hs), woff, vocab)
            m = lengths(np.diff(woff), docs, words)
            shard = Shard(doc, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]), len(ids), len(vocab))
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            for q in range(len(best)):
                terms = item_terms[item_off[q]:item_off[q + 1]]
                floor = best[q][-1][0] if len(best[q]) == k else 1
                found, score = shard.nra(terms, weight[terms], k, floor, rank)
                if len(found):
                    named = zip(score.tolist(), ids.take(pa.array(found)).to_pylist())
                    best[q] = sorted(best[q] + list(named), key=_by_rank)[:k]
        rows = [(q, d, s) for q, top in enumerate(best) for s, d in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind),
                                          pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])
    return run


def _by_rank(row):
    score, doc_id = row
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def _shards(batches):
    """(ids, data, offsets) of successive documents of at most ``SHARD_BYTES``, one document at least."""
    ids, texts, size = [], [], 0
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
        for i, j in textvec.slices(off, SHARD_BYTES):
            n = int(off[j] - off[i])
            if texts and size + n > SHARD_BYTES:
                yield (pa.concat_arrays(ids), *textvec.buffers(pa.concat_arrays(texts)))
                ids, texts, size = [], [], 0
            ids.append(b.column("doc_id").slice(i, j - i))
            texts.append(text.slice(i, j - i))
            size += n
    if texts:
        yield (pa.concat_arrays(ids), *textvec.buffers(pa.concat_arrays(texts)))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest score above 0 for every item.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  With N documents that
    hold a term, L terms in all, n terms of the document, df documents of a term and tf occurrences:
    weight = floor(1000 ln((2N + 2) / (2df + 1))), m = 10 + 90nN div L, and the score is the sum over the
    item's terms, once each, of weight * (10^9 tf div (1000 tf + 8m)).  Equal scores go by ascending
    doc_id, null ids last; ids may be of any type that has an order.

    All rows of one item_id are one item; items without a term, or whose terms no document holds, give
    no rows.  Null and wordless texts have no terms.  Repeated rows of ``docs`` are documents of their own;
    fewer than ``k`` documents give all; other columns are ignored."""
    spark = docs.sparkSession
    field = docs.schema["doc_id"].dataType
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    item_type = items.schema["item_id"].dataType
    found = None
    for item_ids, terms, offsets in query_blocks(items, block_terms):
        vocab, numbers = np.unique(terms, return_inverse=True)
        counted = (src.select("text").mapInArrow(_counts(spark.sparkContext.broadcast(vocab)), "term long, n long")
                      .groupBy("term").agg(F.sum("n").alias("n")).toArrow())       # a row a query term at most
        n = dict(zip(counted["term"].to_pylist(), counted["n"].to_pylist()))
        n_docs, n_words = n.get(-1, 0), n.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(vocab))], np.int64)
        block = spark.sparkContext.broadcast((vocab, weight, numbers, offsets, n_docs, n_words))
        names = spark.createDataFrame(list(enumerate(item_ids)), f"item long, item_id {item_type.simpleString()}")
        one = src.mapInArrow(_search(block, k, kind), f"item long, doc_id {field.simpleString()}, score long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        one = one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        one = one.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {field.simpleString()}, score long")
    return found

"""Operator 10: MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A document's signature is 64 components of 16 bits (MinHash over its distinct five-word
shingles).  Pairs of Jaccard similarity 0.85 differ in a component with probability 0.15, so
more than 22 of 64 differ with probability about 3e-5: 22 is the distance threshold.  The
signature is cut into 16 chunks of 4 components, and errors are allowed per chunk by the
pigeonhole rule: 7 chunks may hold one error, 9 none.  A pair that exceeds its allowance in
every chunk differs in at least 7*2 + 9*1 = 23 components, so **every** pair within 22 shares
one of the 9 + 7*4 = 37 keys (whole chunks, and chunks with one component left out).

Documents with the same word sequence are one class from the start, so thousands of copies are
one row; buckets and clusters are compared as in ``simjoin`` without emitting pairs, links are
confirmed on full shingle sets, and groups are connected components of the confirmed links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm import simjoin, textvec
from boxlens.operators.components import connected_components
from boxlens.session import pin, release

SHINGLE = 5
COMPONENTS = 64
CHUNKS, WIDTH = 16, 4
LOOSE = 7                 # chunks in which one error is allowed
MAX_DIFF = 22             # 2 * LOOSE + (CHUNKS - LOOSE) - 1
MIN_PERCENT = 85          # Jaccard similarity in percent, inclusive

_gen = np.random.default_rng(20240917)
_XOR = _gen.integers(0, 2**63, COMPONENTS, dtype=np.uint64) * np.uint64(2)
_MUL = _gen.integers(0, 2**63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_TABLE = textvec.byte_table("nonspace")


def minhash(sh: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """(texts, 64) uint16 signatures; texts without shingles get zeros."""
    n = len(soff) - 1
    sig = np.zeros((n, COMPONENTS), np.uint16)
    full = np.flatnonzero(np.diff(soff) > 0)
    if len(full):
        at = soff[full]
        for k in range(COMPONENTS):
            v = (sh ^ _XOR[k]) * _MUL[k]
            v ^= v >> np.uint64(32)
            low = np.minimum.reduceat(v, at)
            sig[full, k] = (textvec.mix64(low) >> np.uint64(48)).astype(np.uint16)
    return sig


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _profile(batches):
    """(doc_id, text, th) -> doc_id, th, h1, h2 (hash of the word sequence), n_shingles, sig."""
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        ids = b.column("doc_id")
        for i, j in textvec.slices(off):
            m, s, e, woff = textvec.words(data, off[i:j + 1], _TABLE)
            h = textvec.hash_words(m, s, e)
            h1, h2 = textvec.sequence_hash(h, woff)
            sh, soff = textvec.shingles(h, woff, SHINGLE)
            n = np.array([_distinct(sh[soff[t]:soff[t + 1]]) for t in range(j - i)], np.int64)
            sig = minhash(sh, soff)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), b.column("th").slice(i, j - i), _signed(h1), _signed(h2), pa.array(n),
                 pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "th", "h1", "h2", "n_shingles", "sig"])


def _distinct(x: np.ndarray) -> int:
    if len(x) < 2:
        return len(x)
    x = np.sort(x)
    return int(np.count_nonzero(x[1:] != x[:-1])) + 1


def _sets(batches):
    """(id, text) -> id, data: the sorted distinct shingle hashes as bytes."""
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        ids = b.column("id")
        for i, j in textvec.slices(off):
            m, s, e, woff = textvec.words(data, off[i:j + 1], _TABLE)
            sh, soff = textvec.shingles(textvec.hash_words(m, s, e), woff, SHINGLE)
            out = [np.unique(sh[soff[t]:soff[t + 1]]).tobytes() for t in range(j - i)]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(out, pa.binary())], ["id", "data"])


def jaccard_matcher(percent: int):
    """Exact Jaccard test on sets given as bytes of sorted distinct 64-bit hashes."""
    def make(values: list):
        sets = [np.frombuffer(v, np.uint64) for v in values]
        size = np.array([len(x) for x in sets], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        _, idx = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(int(idx.max()) + 1 if len(idx) else 1, bool)

        def match(u: int, rest: np.ndarray) -> np.ndarray:
            big, small = np.maximum(size[rest], size[u]), np.minimum(size[rest], size[u])
            hit = 100 * small >= percent * big       # sizes alone rule the others out
            near = rest[hit]
            if len(near):
                own = idx[off[u]:off[u + 1]]
                mark[own] = True
                if len(near) * 4 > len(sets):
                    both = np.add.reduceat(mark[idx], off[:-1], dtype=np.int64)[near]
                else:
                    both = np.array([np.count_nonzero(mark[idx[off[v]:off[v + 1]]]) for v in near], np.int64)
                mark[own] = False
                hit[hit] = 100 * both >= percent * (size[near] + size[u] - both)
            return hit
        return match
    return make


def signature_keys(classes: DataFrame) -> DataFrame:
    """The 37 multi-index keys (key, id) of every class signature."""
    w = 2 * WIDTH
    keys = []
    for c in range(CHUNKS):
        chunk = F.substring("sig", c * w + 1, w)
        if c >= LOOSE:
            keys.append(F.xxhash64(F.lit(c), chunk))
        else:
            for skip in range(WIDTH):
                left = F.substring("sig", c * w + 1, 2 * skip)
                right = F.substring("sig", c * w + 1 + 2 * skip + 2, w - 2 * skip - 2)
                keys.append(F.xxhash64(F.lit(c), F.lit(skip), left, right))
    return classes.select(F.explode(F.array(*keys)).alias("key"), "id")


def near_duplicates(docs: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of distinct
    five-word shingles (a text of one to four words has its whole sequence as one); percent is
    85 or more.  component_id is the smallest doc_id reachable over links, kept marks it.

    Null or wordless text: empty set, linked with nothing, kept.  Rows with the same doc_id
    count as one document for ``kept``; a null doc_id never is a component's smallest unless
    the whole component has none (then null, and kept).  doc_id may be of any type that has
    an order; other columns are ignored."""
    return near_duplicate_rows(docs, percent).drop("th")


def near_duplicate_rows(docs: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """``near_duplicates`` plus th, the hash of the row's text, which tells rows of one doc_id apart."""
    if percent < MIN_PERCENT:
        raise ValueError("the signature threshold is set for a similarity of 0.85 or more")
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                      F.xxhash64(F.col("text").cast("string")).alias("th"))
    prof = pin(src.mapInArrow(_profile, f"doc_id {kind}, th long, h1 long, h2 long, n_shingles long, sig binary"))
    # a class is one word sequence; its text is read from the row with the smallest doc_id
    classes = pin(prof.filter("n_shingles > 0").groupBy("h1", "h2")
                      .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("r"),
                           F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
                      .select("h1", "h2", F.col("r.doc_id").alias("first_doc"), F.col("r.th").alias("th"), "n", "sig",
                              F.monotonically_increasing_id().alias("id")))
    edges = simjoin.signature_edges(signature_keys(classes), classes.select("id", "sig"),
                                    simjoin.hamming_matcher(COMPONENTS, "<u2", MAX_DIFF))
    clusters = connected_components(edges, "a", "b")
    members = pin(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
                          .join(classes.select("id", "n", "first_doc", "th"), "id"))
    m = members.select("id", "first_doc", F.col("th").alias("mth"))
    # members grow with the corpus: one plan at every size, no broadcast while they are few
    texts = src.join(m.hint("merge"), (F.col("th") == F.col("mth")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("id", "text")
    links = simjoin.verified_links(members.select("id", "cluster", "n"), texts.mapInArrow(_sets, "id long, data binary"),
                                   jaccard_matcher(percent), F.col("n"))
    groups = connected_components(links, "a", "b")
    low = (groups.join(classes.select(F.col("id").alias("node"), "first_doc"), "node")
                 .groupBy("component").agg(F.min("first_doc").alias("low")))
    linked = (groups.join(low, "component").join(classes.select(F.col("id").alias("node"), "h1", "h2"), "node")
                    .select("h1", "h2", "low"))
    label = pin(classes.join(linked, ["h1", "h2"], "left")
                       .select("h1", "h2", F.coalesce("low", "first_doc").alias("component")))
    release(edges, members, links, classes)
    out = (prof.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), "h2")
               .join(label, ["h1", "h2"], "left")
               .select("doc_id", "th", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th")

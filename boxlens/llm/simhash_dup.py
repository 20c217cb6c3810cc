"""Operator 13: SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A fingerprint is the majority vote of the XXH64 hashes of a text's three-word shingles.  It is
cut into three segments of at most 23 bits.  The Golay code of length 23 is perfect: every
segment is within three bits of one codeword, and if it is three bits away, five more codewords
are four bits away.  The indices of all codewords within four bits (one or six of them) are the
segment's fuzzy hashes.  Two segments that differ in two bits at most share one: the codeword
within three bits of the segment half-way is within four of both.

Pigeonhole over two errors and three segments: some segment has no error and the one behind it
(in a cycle) one at most.  So the keys are (segment, fuzzy hash of the next segment) for the
three segments, at most 18 a fingerprint, of 33 bits or more; every pair within the distance shares one.
Fingerprints under one key are compared, and groups are the connected components of the links.

Equal fingerprints are one class from the start, so copies cost one row; a bucket yields a
spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlens.llm import simjoin, textvec
from boxlens.operators.components import connected_components
from boxlens.session import pin, release

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))      # (first bit, bits) of the segments
_STEP = 1 << 16                               # shingles hashed at a time
_GENERATOR = 0xAE3                            # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def syndromes(v: np.ndarray) -> np.ndarray:
    """Remainder of every 23-bit word divided by the generator polynomial (11 bits)."""
    v = v.astype(np.int64)
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (_GENERATOR << (bit - 11)), v)
    return v


def _error_table() -> np.ndarray:
    """(2048, 6): the error patterns of at most four bits of every syndrome, the first repeated
    where there is one only."""
    patterns = np.array([sum(1 << b for b in c) for k in range(5) for c in itertools.combinations(range(23), k)], np.int64)
    s = syndromes(patterns)
    order = np.argsort(s, kind="stable")
    first = np.searchsorted(s[order], np.arange(2049))
    n = np.diff(first)
    place = first[:-1, None] + np.minimum(np.arange(6), n[:, None] - 1)
    return patterns[order][place]


_ERRORS = _error_table()


def fuzzy_hashes(v: np.ndarray) -> np.ndarray:
    """(words, 6): index (12 bits) of every codeword within four bits of the 23-bit words."""
    return (v[:, None] ^ _ERRORS[syndromes(v)]) >> 11


def multi_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the fingerprint) of uint64 fingerprints."""
    parts = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    keys, owner = [], []
    for i, whole in enumerate(parts):
        fuzzy = fuzzy_hashes(parts[(i + 1) % 3])
        # one codeword, or six: the table repeats the one
        new = np.ones(fuzzy.shape, bool)
        new[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :1]
        keys.append((np.int64(i) << 40 | whole[:, None] << 12 | fuzzy)[new])
        owner.append(np.broadcast_to(np.arange(len(fp))[:, None], fuzzy.shape)[new])
    return np.concatenate(keys), np.concatenate(owner)


def _normalised(data: np.ndarray, off: np.ndarray):
    """(bytes, starts, ends, word offsets): the lower-cased words of consecutive texts with one
    space behind each."""
    m = _LOWER[data[off[0]:off[-1]]]
    rel = off - off[0]
    solid = ~_SPACE[m]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    full = rel[:-1][rel[:-1] < rel[1:]]
    begin[full] = solid[full]
    first = np.flatnonzero(begin)
    woff = np.searchsorted(first, rel)
    if not len(first):
        return b"", first, first, woff
    before = np.cumsum(solid) - solid             # solid bytes in front of each byte
    starts = before[first] + np.arange(len(first))
    ends = np.concatenate([starts[1:] - 1, [int(solid.sum()) + len(first) - 1]])
    out = np.full(int(ends[-1]) + 1, 0x20, np.uint8)
    word = np.cumsum(begin)[solid] - 1
    out[before[solid] + word] = m[solid]
    return out.tobytes(), starts, ends, woff


def shingle_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray):
    """XXH64 of the bytes ``joined[starts[i]:ends[i]]``, some thousand at a time."""
    digest = xxhash.xxh64_digest
    for a in range(0, len(starts), _STEP):
        both = zip(starts[a:a + _STEP].tolist(), ends[a:a + _STEP].tolist())
        yield a, np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in both]), ">u8")


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of consecutive texts."""
    joined, starts, ends, woff = _normalised(data, off)
    n = np.diff(woff)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    w = woff[text] + np.arange(len(text)) - soff[text]
    last = w + np.minimum(n[text], SHINGLE) - 1
    votes = np.zeros((len(n), 64), np.int64)
    for a, h in shingle_hashes(joined, starts[w], ends[last]):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)          # highest bit first
        own = text[a:a + len(h)]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        votes[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint_rows(batches):
    """(doc_id, text) -> doc_id, fp"""
    for b in batches:
        data, off = textvec.buffers(b.column("text"))
        for i, j in textvec.slices(off):
            fp = fingerprints(data, off[i:j + 1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _key_rows(batches):
    """(id) -> key, id: a row per multi-index key of a fingerprint."""
    for b in batches:
        fp = b.column("id").to_numpy()
        keys, owner = multi_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[owner])], ["key", "id"])


def bits_matcher(limit: int):
    """Fingerprints of which at most ``limit`` bits differ."""
    def make(values: list):
        fp = np.array(values, np.int64).view(np.uint64)
        return lambda u, rest: np.bitwise_count(fp[rest] ^ fp[u]) <= limit
    return make


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in two bits at most; component_id is the
    smallest doc_id reachable over links, the document's own if there is none.  doc_id may be of
    any type that has an order.

    Null, empty and wordless texts have fingerprint zero and are linked like any other.  A null
    doc_id never is a component's smallest unless the whole component has none (then null).
    Repeated rows are rows of their own; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = pin(src.mapInArrow(_fingerprint_rows, f"doc_id {kind}, fp long"))
    classes = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    keys = classes.select(F.col("fp").alias("id")).mapInArrow(_key_rows, "key long, id long")
    edges = simjoin.signature_edges(keys, None, bits_matcher(MAX_BITS))
    comp = connected_components(edges, "a", "b")
    label = comp.join(classes.withColumnRenamed("fp", "node"), "node")
    low = label.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = pin(comp.join(low, "component").select(F.col("node").alias("fp"), "component_id"))
    # one row per fingerprint; rows of a frequent fingerprint are split by AQE's skew join
    of = pin(classes.join(linked.withColumnRenamed("component_id", "linked"), "fp", "left")
                    .select("fp", F.coalesce("linked", "low").alias("component_id")))
    release(classes, edges, linked)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")

"""Operator 13 against plain votes and all pairs of fingerprints."""

import itertools
import random
import re

import numpy as np
import xxhash

from boxlens.llm import simhash_dup, simjoin
from boxlens.llm.simhash_dup import simhash_groups

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fp(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    """(doc_id, fingerprint, component) by all pairs."""
    fps = [plain_fp(t) for _, t in docs]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    low = {}
    for (d, _), f in zip(docs, fps):
        r = find(f)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, f"{f:016x}", low.get(find(f))) for (d, _), f in zip(docs, fps)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_golay_code():
    """2048 syndromes: all words of three errors at most are told apart, and words within two bits
    share a fuzzy hash while a word has one or six."""
    e = simhash_dup._ERRORS
    weight = np.bitwise_count(e)
    assert (weight[:, 0] <= 3).all() and (weight <= 4).all()
    assert (simhash_dup.syndromes(e.ravel()).reshape(e.shape) == np.arange(2048)[:, None]).all()
    rnd = random.Random(1)
    words = np.array([rnd.getrandbits(23) for _ in range(400)] + [0, (1 << 23) - 1])
    own = simhash_dup.fuzzy_hashes(words)
    assert {len(set(x)) for x in own.tolist()} <= {1, 6}
    for i, j in itertools.combinations_with_replacement(range(23), 2):
        other = simhash_dup.fuzzy_hashes(words ^ (1 << i) ^ ((1 << j) if j != i else 0))
        assert (own[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_every_pair_within_two_bits_shares_a_key():
    rnd = random.Random(2)
    fp = np.array([rnd.getrandbits(64) for _ in range(30)], np.uint64)
    keys, owner = simhash_dup.multi_keys(fp)
    mine = [set(keys[owner == k].tolist()) for k in range(len(fp))]
    assert max(map(len, mine)) <= 18
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        flip = np.uint64(1 << i) | np.uint64(1 << j)
        keys, owner = simhash_dup.multi_keys(fp ^ flip)
        assert all(mine[k] & set(keys[owner == k].tolist()) for k in range(len(fp)))


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = simhash_groups(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    exp = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(out) == exp
    assert any(d != c for d, _, c in exp)


def test_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(simhash_groups(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_cases_blocks_and_chains(spark, monkeypatch):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(300)]
    docs = [(10, None), (11, ""), (12, " \n\t"), (13, "One"), (14, "one"), (15, "one two"), (16, "one\x00 two"), (17, "one two "),
            (18, "é" * 300_000), (18, "é" * 300_000), (None, "solo words without an id"), (None, "copied words without an id"), (19, "copied  words without\nan ID"),
            (20, "a b c " * 50_000)]
    for i in range(200):                               # a family whose fingerprints crowd a few buckets
        w = list(base)
        w[rnd.randrange(300)] = f"x{i}"
        docs.append((100 + i, " ".join(w)))
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 7)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, fp string, component_id int")
    assert got(simhash_groups(df)) == brute(docs)
    assert simhash_groups(df.limit(0)).collect() == []


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("d2", "same text here"), ("d10", "Same text here"), ("d3", "another one")], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash_groups(df).collect()} == {"d2": "d10", "d10": "d10", "d3": "d3"}


def test_planted_fingerprints(spark):
    """Links by bit distance alone: random fingerprints with planted neighbours one to three bits away."""
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    fps += [f ^ sum(1 << b for b in rnd.sample(range(64), 1 + k % 3)) for k, f in enumerate(fps)]
    ids = np.array(fps, np.uint64).view(np.int64).tolist()
    keys = spark.createDataFrame([(i,) for i in ids], "id long").mapInArrow(simhash_dup._key_rows, "key long, id long")
    edges = simjoin.signature_edges(keys, None, simhash_dup.bits_matcher(2))
    found = {frozenset((r["a"], r["b"])) for r in edges.collect()}
    assert found == {frozenset((ids[a], ids[b])) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2}

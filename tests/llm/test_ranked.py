"""Operator 11 against scores of all documents, and NRA's own promises on one shard."""

import math
import random
import re
from collections import Counter

import numpy as np

from boxlens.llm import ranked
from boxlens.llm.ranked import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in wanted.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tables(spark, monkeypatch):
    for sf, shard in (("sf0.001", 40_000), ("sf0.01", 400_000)):
        monkeypatch.setattr(ranked, "SHARD_BYTES", shard)
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        items = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
        out = ranked_search(docs.repartition(5), items, block_terms=300)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]
        exp = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
        assert got(out) == exp and len(exp) >= 10 * items.count() - 5


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "..., !"), (4, "alpha beta"), (5, "ALPHA beta"), (5, "alpha beta"), (None, "alpha beta"), (None, "alpha beta"),
            (6, "alpha " * 100_000), (7, "naïve café Ünïcode"), (8, "gamma"), (9, "delta_epsilon [zeta]")] + [(100 + i, "the same copied text") for i in range(40)]
    items = [(1, "Alpha gamma"), (2, None), (3, ""), (4, "nowhere"), (5, "CAFÉ café épsilon"), (6, "copied"), (7, "beta"), (7, "zeta delta beta"), (None, "epsilon"), (8, "the same copied text alpha")]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, score int, rank string")
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, doc_id int")
    exp = brute(docs, items)
    assert got(ranked_search(d, i)) == exp
    assert {x[0] for x in exp} == {1, 5, 6, 7, None, 8} and len({(x[0], x[1]) for x in exp}) == len(exp)
    assert got(ranked_search(d, i, k=3)) == brute(docs, items, 3)
    assert ranked_search(d.limit(0), i).collect() == [] == ranked_search(d, i.limit(0)).collect()


def test_ids_that_are_no_numbers(spark):
    docs = [("d2", "one two"), ("d10", "one two"), ("é", "two"), ("a", "three")]
    items = [("i", "two one"), ("j", "three")]
    d, i = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert [(x[0], x[1], x[2]) for x in got(ranked_search(d, i))] == [("i", 1, "d10"), ("i", 2, "d2"), ("i", 3, "é"), ("j", 1, "a")]


def test_nra_resolves_members_ties_and_scores():
    """Against all scores, with many ties, and without reading the lists to their ends."""
    rnd = np.random.default_rng(1)
    unread = 0
    for case in range(60):
        n_docs, n_terms = int(rnd.integers(1, 3000)), int(rnd.integers(1, 12))
        doc, term, impact = [], [], []
        for t in range(n_terms):
            d = rnd.permutation(n_docs)[:int(rnd.integers(0, n_docs + 1))]
            doc.append(d)
            term.append(np.full(len(d), t))
            impact.append(rnd.integers(1, 5 if case % 2 else 10**6, len(d)))
        doc, term, impact = np.concatenate(doc), np.concatenate(term), np.concatenate(impact)
        weight = rnd.integers(0, 50, n_terms)
        if case % 3 == 0 and n_docs > 100:               # a few documents far ahead
            for t in range(n_terms):
                doc, term, impact = np.append(doc, n_docs + np.arange(12)), np.append(term, np.full(12, t)), np.append(impact, 10**8 + rnd.integers(0, 2, 12))
            n_docs += 12
        ids = rnd.permutation(n_docs)
        shard = ranked.Shard(doc, term, impact, n_docs, n_terms)
        floor = int(rnd.integers(1, 100))
        reads = CountingArray(shard.doc)
        shard.doc = reads
        found, score = shard.nra(np.arange(n_terms), weight, 10, floor, ids)
        total = np.bincount(doc, weight[term] * impact, minlength=n_docs).astype(np.int64)
        exp = sorted((-total[d], ids[d], d) for d in range(n_docs) if total[d] >= floor)[:10]
        assert list(zip((-score).tolist(), ids[found].tolist(), found.tolist())) == exp
        unread += len(doc) - reads.furthest()
    assert unread > 0


class CountingArray:
    """A posting list that notes how far each slice of it was read."""

    def __init__(self, a):
        self.a, self.read = a, np.zeros(len(a), bool)

    def __getitem__(self, key):
        self.read[key] = True
        return self.a[key]

    def furthest(self):
        return int(self.read.sum())

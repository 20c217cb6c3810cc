"""Operator 10 against brute force on whole sets."""

import re

import pytest

from boxlens.llm import near_dup
from boxlens.llm.near_dup import near_duplicates

SPACE = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([("short", *w)])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows, percent=85):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    index = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        for j in {j for x in s for j in index[x] if j > i}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i), d) if s else d) for i, (d, s) in enumerate(sets)), key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    out = near_duplicates(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = out.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


def test_hub_chain_blocks_and_edge_cases(spark, monkeypatch):
    import random
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows = [(100, " ".join(base))]
    for i in range(40):                      # copies of a hub with own edits: linked through the hub only
        c = list(base)
        c[rnd.randrange(120)] = f"x{i}"
        if i % 2:
            c[rnd.randrange(120)] = f"y{i}"
        rows.append((200 + i, " ".join(c)))
    chain = list(base[::-1])
    for i in range(6):
        chain = [*chain[4:], *[f"c{i}_{k}" for k in range(4)]]
        rows.append((300 + i, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one\ntwo"), (6, "a b c d e"), (7, "A  B C d e x"),
             (8, "a b c d e"), (8, "a b c d e"), (9, "naïve " * 50), (10, "NAïVE " * 60), (11, "x" * 300_000)]
    from boxlens.llm import simjoin
    monkeypatch.setattr(simjoin, "BLOCK_ROWS", 7)
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_extra_columns_empty_and_null_ids(spark):
    schema = "id long, th string, doc_id long, text string, component_id string, h1 int"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a", None, "p q r s t u", "z", 1), (2, "b", 7, "p q r s t u", "z", 1), (3, "c", None, "solo text", "z", 1)]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("7", "7", True), ("None", "7", False), ("None", "None", True)]
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], schema), percent=50)


def test_pigeonhole_allowance():
    assert 2 * near_dup.LOOSE + (near_dup.CHUNKS - near_dup.LOOSE) == near_dup.MAX_DIFF + 1
    assert near_dup.CHUNKS * near_dup.WIDTH == near_dup.COMPONENTS

"""Operator 4: targets against the stated rule, nearness, repeats, tree, reruns, edge cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boxlens.llm.mixing import mix, source_targets, split_quotas, taken_words

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes):
    """Share by weight, stop at three times, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 2000, "c": 500, "d": 0, None: 3}, {"x": 5}, {"x": 0}, {"b": 1, "a": 1, "c": 10**9},
    {f"s{i}": (i * 7919) % 1000 for i in range(40)}, {"\U0001F600": 4, "￿": 90, "z": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    exp = targets(sizes)
    assert got.keys() == exp.keys()
    for s in exp:
        assert got[s] == pytest.approx(exp[s], rel=1e-9, abs=1e-9)


def check(rows, docs):
    """Contract of the digest rows against the documents."""
    size = Counter()
    for d, s, t in docs:
        size[s] += len(WORD.findall(t or ""))
    exp = targets(size)
    taken, biggest = Counter(), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(exp[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - exp[s]) <= max(2, biggest[s]), s
    return taken


def test_whole_table_and_mix_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = taken_words(docs).collect()
    check(rows, [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()])
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in taken_words(docs).collect())
    m = mix(docs, words_per_shard=2000)
    assert m.columns == [*docs.columns, "copy", "shard", "shuffle_key"]
    got = m.select("doc_id", "text", "shard", "copy").collect()
    by_doc, shard_words = Counter(), Counter()
    for r in got:
        by_doc[r["doc_id"]] += len(WORD.findall(r["text"]))
        shard_words[r["shard"]] += 1
    assert dict(by_doc) == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    assert len(shard_words) > 16
    held = m.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(held) == len({r["p"] for r in held}) == len(shard_words)          # a task a shard


def test_small_blocks_hit_targets(spark, monkeypatch):
    from boxlens.llm import mixing
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", 3)
    docs = [(i, f"s{i % 4}" if i % 9 else None, "w " * (1 + (i * 31) % 17)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = taken_words(df).collect()
    check(rows, docs)
    m = mix(df, words_per_shard=100).groupBy("doc_id").count().collect()
    size = {d: len(t.split()) for d, _, t in docs}
    assert {r["doc_id"]: r["count"] * size[r["doc_id"]] for r in m} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_room_is_filled_from_later_blocks(spark, monkeypatch):
    """Long documents that don't fit are passed over, and blocks behind them fill the room to the word."""
    from boxlens.llm import mixing
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", 2)
    # 'a' is capped by nothing and gets 5/8 of all words, part of it in whole passes; every other document is long
    docs = [(i, "a", "w " * (900 if i % 2 else 1 + i % 5)) for i in range(60)] + [(100 + i, "b", "x " * 40) for i in range(1000)]
    docs += [(5000 + i, "c", "y " * (7000 if i < 3 else 3)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = taken_words(df).collect()
    check(rows, docs)
    for s in "abc":
        mine = [r for r in rows if r["source"] == s]
        passes = int(mine[0]["target"] // mine[0]["source_size"])
        smallest = min(r["size"] for r in mine if r["taken"] <= passes * r["size"])      # of those that could still be taken
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < smallest + 1
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in taken_words(df).collect()}


def test_edge_cases(spark):
    docs = [(1, "a", None), (2, "a", ""), (3, "b", " \t\n"), (None, "b", "x y"), (4, None, "p q r"), (5, None, None),
            (6, "c", "same text"), (6, "c", "same text"), (7, "c", "é" * 100_000 + " z"), (8, "", "empty name")]
    df = spark.createDataFrame([(d, s, t, "k", 9, 9, 9) for d, s, t in docs],
                               "doc_id long, source string, text string, th string, shard int, block int, size int")
    rows = taken_words(df).collect()
    check(rows, docs)
    assert mix(df).columns == ["doc_id", "source", "text", "th", "block", "size", "copy", "shard", "shuffle_key"]
    assert sum(len(WORD.findall(r["text"] or "")) for r in mix(df).collect()) == sum(r["taken"] for r in rows)
    assert taken_words(df.limit(0)).collect() == [] and mix(df.limit(0)).collect() == []


def test_splitting_tree_is_exact_and_near_hypergeometric(spark):
    q = {"a": 200, "b": 56, "c": 1, None: 15}
    df = spark.createDataFrame(list(q.items()), "source string, quota long")
    shard, source, seen = Counter(), Counter(), defaultdict(list)
    for seed in range(6):
        rows = split_quotas(df, 3, seed).collect()
        per = Counter()
        for r in rows:
            per[r["shard"]] += r["quota"]
            source[(seed, r["source"])] += r["quota"]
            if r["source"] == "a":
                seen[seed].append(r["quota"])
        assert set(per.values()) == {34}
    assert all(source[(seed, s)] == q[s] for seed in range(6) for s in q)
    flat = [x for v in seen.values() for x in v]
    mean = sum(flat) / len(flat)
    assert mean == 25 and 1 < sum((x - mean) ** 2 for x in flat) / len(flat) < 16   # 34 * 200/272 = 25, variance 5.8

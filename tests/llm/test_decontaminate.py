"""Operator 3 against brute force: windows, short items, blocks, edge cases."""

import hashlib
import re

from boxlens.llm.decontaminate import contamination, decontaminate, verbatim_matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    wins = []
    for item, t in bench:
        w = words(t)
        if len(w) >= 10:
            wins += [(item, tuple(w[i:i + 10])) for i in range(len(w) - 9)]
        elif w:
            wins.append((item, tuple(w)))
    by = {}
    for item, w in wins:
        by.setdefault(w, set()).add(item)
    sizes = {len(w) for w in by}
    out = []
    for d, t in docs:
        w = words(t)
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = by.get(tuple(w[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    items |= own
        ids = sorted(str(x) for x in items if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def got(df):
    assert df.columns[:6] == COLS
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    exp = brute(rows, items)
    assert any(r[5] for r in exp)
    assert got(contamination(docs, bench)) == exp
    assert got(contamination(docs, bench, block_bytes=2000)) == exp      # several blocks of the test set


def test_edge_cases(spark):
    phrase = " ".join(f"w{i}" for i in range(14))
    bench = [(1, phrase), (2, "Short ITEM"), (3, None), (4, ""), (5, "!!"), (None, "no id item here"), (2, "other short item"),
             (10, phrase), (6, "r r r r r r r r r r")]
    docs = [(1, None), (2, ""), (3, "x " * 30), (4, f"a {phrase.upper()} b {phrase[:-4]}"), (5, "a short, item - and a short\nitem"),
            (6, "no id, item HERE"), (None, phrase), (7, phrase), (7, phrase), (8, "short"), (9, "r " * 25), (11, "é" * 200_000 + " short item")]
    d = spark.createDataFrame([(x, t, "k", 1) for x, t in docs], "doc_id long, text string, th string, n_words int")
    b = spark.createDataFrame([(x, t, "k") for x, t in bench], "item_id long, text string, doc_id string")
    assert got(contamination(d, b)) == brute(docs, bench)
    assert got(contamination(d, b, block_bytes=30)) == brute(docs, bench)
    clean = decontaminate(d, b)
    assert clean.columns == d.columns
    bad = {r[0] for r in brute(docs, bench) if r[5]}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(x) for x, _ in docs if x not in bad)
    assert got(contamination(d.limit(0), b)) == []
    assert all(r[2] == 0 for r in got(contamination(d, b.limit(0))))


def test_matches_are_longest_and_located(spark):
    phrase = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"pre fix {phrase} end w3 w4 w5")], "doc_id long, text string")
    b = spark.createDataFrame([(7, f"zz {phrase}")], "item_id long, text string")
    m = verbatim_matches(d, b).first()["matches"]
    assert [tuple(x) for x in m] == [(7, 2, 1, 20)]

"""Operator 12 against a plain cut of the token list, and its exact round trip."""

import hashlib
import re

from pyspark.sql import functions as F

from boxlens.llm import fim


def plain(doc_id, text):
    t = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    r = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((r[0] % (len(w) + 1), r[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90:
        return (doc_id, len(w), "plain", t, None, None)
    if r[3] % 100 < 20:
        return (doc_id, len(w), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m))
    return (doc_id, len(w), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def check(df, docs):
    out = fim.transform(df).select("doc_id", "n", "form", "output", "prefix_chars", "middle_chars",
                                   fim.restore(F.col("output"), F.col("form")).alias("back"))
    rows = [tuple(r) for r in out.collect()]
    assert sorted((r[:6] for r in rows), key=repr) == sorted((plain(*d) for d in docs), key=repr)
    assert sorted((r[0], r[6]) for r in rows if r[0] is not None) == sorted((d, t or "") for d, t in docs if d is not None)
    return rows


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    d = fim.digests(docs).collect()
    texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["restored_sha256"] for r in d} == texts


def test_edge_cases(spark):
    odd = ["", None, "x", " ", "\n", "a<P>b", "<S>", "ends with <", "<P", "P><S", "<M", "a b\r\nc", "$1 \\1 \\ $", "\U0001f600a\U0001f600 b", "é ß ñ", "a\x00b",
           "(?s)[^x]{3}+", "word " * 60_000, "é" * 100_000, "x" * 300_000, "a b\n" * 40_000]
    docs = [(i, t) for i, t in enumerate(t for t in odd for _ in range(6))]
    docs += [(None, "no id"), (None, "no id"), (7, "the same id"), (7, "the same id"), (-5, "negative")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, h string, a int")
    assert {r[2] for r in check(df, docs)} == {"plain", "psm", "spm"}
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "h", "a", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert fim.transform(df.limit(0)).collect() == []


def test_clashing_columns_and_other_ids(spark):
    df = spark.createDataFrame([("d1", "one two, three four", 5, "old", "z")], "doc_id string, text string, n int, form string, `b.c` string")
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "b.c", "n", "form", "output", "prefix_chars", "middle_chars"]
    r = out.first()
    assert (r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == plain("d1", "one two, three four")


def test_one_narrow_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fim.digests(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan

"""Operator 1: held-out accuracy, the language models against plain dictionaries, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np

from boxlens.llm import langid, textvec
from boxlens.llm.langid import identify

COLS = ["doc_id", "held_out", "lang_pred", "score"]


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert not any(r["rejected"] for r in rows if r["lang_pred"] == lang[r["doc_id"]])


def test_prediction_ignores_lang_source_and_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = {r["doc_id"]: r["lang_pred"] for r in identify(docs).collect()}
    from pyspark.sql import functions as F
    mod = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    other = docs.withColumn("lang", F.when(mod != 1, F.col("lang"))).drop("source")
    assert {r["doc_id"]: r["lang_pred"] for r in identify(other).collect()} == base


def grams(text, o):
    chars = []
    for c in text:
        if c.isalpha():
            chars.append(c.lower())
        elif chars and chars[-1] != " ":
            chars.append(" ")
    s = [" "] * 4 + chars
    return [tuple(s[i - o + 1:i + 1]) for i in range(4, len(s))]


def kneser_ney(texts):
    """Plain dictionaries: prob(gram) for one language."""
    count = {5: Counter(g for t in texts for g in grams(t, 5))}
    for o in range(4, 0, -1):
        count[o] = Counter(g[1:] for g in count[o + 1])
    total, kinds = {}, {}
    for o in range(1, 6):
        total[o], kinds[o] = Counter(), Counter()
        for g, n in count[o].items():
            total[o][g[:-1]] += n
            kinds[o][g[:-1]] += 1

    def prob(g):
        o, ctx = len(g), g[:-1]
        t = total[o][ctx]
        if o == 1:
            return max(count[1][g] - 0.75, 0) / t + 0.75 * kinds[1][ctx] / t / 4096
        if not t:
            return prob(g[1:])
        return max(count[o][g] - 0.75, 0) / t + 0.75 * kinds[o][ctx] / t * prob(g[1:])
    return prob


def test_model_equals_plain_kneser_ney(spark):
    train = {"xx": ["Hello world, hello there!", "the world ends here"], "yy": ["ça va très bien", "élan vital, très vital"]}
    df = spark.createDataFrame([(k, t) for k, v in train.items() for t in v], "lang string, text string")
    model = langid.fit(df)
    assert model["langs"] == ["xx", "yy"]
    import pyarrow as pa
    probe = ["hello très world", "zq", "the élan", ""]
    data, off = textvec.buffers(pa.array(probe))
    key, koff, letters = langid.keys_of(data, off)
    got = langid.log_probs(model, key)
    for i, name in enumerate(model["langs"]):
        prob = kneser_ney(train[name])
        exp = [math.log(prob(g)) for t in probe for g in grams(t, 5)]
        assert np.allclose(got[:, i], exp, atol=1e-4)
    assert letters.tolist() == [14, 2, 7, 0]


def test_edge_cases(spark):
    en = "the quick brown fox jumps over the lazy dog and runs away from it again"
    de = "der schnelle braune fuchs springt über den faulen hund und läuft dann wieder weg"
    rows = [(i, (en if i % 2 else de) + " " + " ".join([(en if i % 2 else de).split()[i % 9]] * 3), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !? 456", "en"), (None, "the dog", None), (103, "der hund", None), (103, "der hund", None),
             (104, "ж" * 300, None), (105, "the dog " * 60_000, "en"), (106, "a\udc00b".encode("utf-8", "replace").decode(), None)]
    df = spark.createDataFrame([(d, t, lang, "x", 1) for d, t, lang in rows], "doc_id long, text string, lang string, th string, score int")
    out = identify(df)
    assert out.columns[:4] == COLS
    got = out.collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 and by[d]["rejected"] for d in (100, 101, 102))
    assert by[103]["lang_pred"] == "de" and by[None]["lang_pred"] == "en" and by[105]["lang_pred"] == "en"
    assert by[104]["rejected"] and by[104]["lang_pred"] in ("en", "de")
    assert not any(by[d]["rejected"] for d in range(80))
    assert identify(df.limit(0)).collect() == []
    unlabelled = identify(df.withColumn("lang", df["lang"].substr(0, 0)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_blocks_of_the_model_score_like_the_whole(spark):
    """However small a block, no n-gram and no language is lost."""
    rows = [(i, "the quick brown fox number " + "abcdefghij"[i % 10] * 3, "en") for i in range(60)]
    rows += [(i, "der schnelle braune fuchs", "de") for i in range(60, 120)]
    rows += [(i, "rzadki język mały", "pl") for i in range(120, 132)] + [(120, "rzadki język mały", "pl"), (200, "", "pl")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, cut = (sorted(identify(df, n).collect(), key=lambda r: (r["doc_id"], r["th"])) for n in (10_000, 20))
    assert len(whole) == len(cut) == len(rows)
    for a, b in zip(whole, cut):
        assert (a["lang_pred"], a["rejected"], a["held_out"]) == (b["lang_pred"], b["rejected"], b["held_out"])
        assert a["cross_entropy"] is b["cross_entropy"] or math.isclose(a["cross_entropy"], b["cross_entropy"], rel_tol=1e-5)
    assert {r["lang_pred"] for r in cut if 120 <= r["doc_id"] < 132} == {"pl"}


def test_unlearned_text_is_rejected_whatever_stray_letters_were_learned(spark):
    """Texts of an unlearned language in Latin script and random letters, beside clean ones."""
    import random
    rnd = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    # every language has seen a thousand letters once
    stray = "".join(c for c in map(chr, range(0x370, 0x1000)) if c.isalpha())[:1000]
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    first = [d for d in range(1_000_000, 1_000_100) if zlib.crc32(str(d).encode()) % 3 == 0]
    extra = [(d, " ".join(stray), lang) for d, lang in zip(first, langs)]
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem "
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
    bad = [(2_000_000, polish * 6, None), (2_000_001, finnish * 6, None)]
    bad += [(2_000_002 + i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(150)), None)
            for i in range(4)]
    df = docs.unionByName(spark.createDataFrame(extra + bad, "doc_id long, text string, lang string"))
    rows = {r["doc_id"]: r for r in identify(df).collect()}
    assert [d for d, *_ in bad if not rows[d]["rejected"]] == []
    assert [d for d, r in rows.items() if r["rejected"] and d < 1_000_000] == []


def test_scoring_holds_little_beside_its_batch():
    import tracemalloc

    import pyarrow as pa
    text = "the quick brown fox jumps over the lazy dog " * 40
    key, koff, _ = langid.keys_of(*textvec.buffers(pa.array([text])))
    class sent:
        value = langid.build_model(["a"], np.zeros(len(key), np.int64), key, np.ones(len(key), np.int64))
    n = 1500                        # 2.6 MB of text
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "lang": ["a"] * n, "th": list(range(n)), "text": [text] * n})
    for run in (langid._score(sent, 0, int(langid._MASK[2])), langid._count):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 48 << 20, (run, peak)

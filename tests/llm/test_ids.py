"""Every operator on documents takes ids that are no numbers, and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from boxlens.llm import queries
from boxlens.llm.decontaminate import contamination, decontaminate
from boxlens.llm.langid import identify
from boxlens.llm.mixing import mix, taken_words
from boxlens.llm.near_dup import near_duplicates
from boxlens.llm.quality import quality_scores
from boxlens.llm.secrets import scan

TEXT = "the quick brown fox jumps over the lazy dog and runs through the green field to the old house"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", TEXT + (f" token: abcdefgh{i:04d}XYZ" if i % 3 else ""), "en" if i % 2 else "de", f"s{i % 2}", "x", 1, 2, 3) for i in range(12)]
    rows += [(None, TEXT, None, None, "x", 1, 2, 3), ("d1", None, "en", "s1", "x", 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, th string, size int, h1 int, _row int")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def test_text_ids(spark, docs):
    every = ids(docs)
    bench = spark.createDataFrame([("q1", "jumps over the lazy dog and runs through the green field"), (None, "not in any text")], "item_id string, text string")
    c = contamination(docs, bench)
    assert ids(c) == every and {r["n_items"] for r in c.collect() if r["n_words"]} == {1}
    assert {x["item"] for r in c.collect() for x in r["matches"]} == {"q1"}
    assert ids(decontaminate(docs, bench)) == ["d1"]
    near = near_duplicates(docs)
    assert ids(near) == every and {r["component_id"] for r in near.collect() if r["n_shingles"]} == {"d0"}
    labels = docs.select("doc_id", (F.crc32("doc_id") % 2).cast("int").alias("quality")).filter("doc_id is not null")
    for out in (identify(docs), quality_scores(docs, labels), scan(docs), taken_words(docs)):
        assert ids(out) == every
    assert set(ids(mix(docs))) <= set(every)
    assert "op3_decontamination" in queries.QUERIES

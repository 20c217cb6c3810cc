"""Byte-range reading of JSON documents against json.loads and the whole-document reader."""

import json
import random

import pytest
from cocofix import predictions, small_doc, write

from boxlens.sources import coco, jsonranges
from boxlens.sources.jsonranges import read_items


def odd_text(rnd):
    return "".join(rnd.choice(['"', "\\", "[", "]", "{", "}", ",", ":", "é", "😀", " ", "\n", "images", "\\\\", "a"]) for _ in range(rnd.randrange(12)))


def odd_doc(seed):
    rnd = random.Random(seed)
    item = lambda i: {"id": i, odd_text(rnd): odd_text(rnd), "deep": [[{"x": odd_text(rnd)}], {}], "n": rnd.random()}
    doc = {"info": {"images": [{"id": "not one"}], "t": odd_text(rnd)}, odd_text(rnd) + "k": [item(-1)], "images": [item(i) for i in range(12)],
           "licenses": [{"id": 0}], "empty": [], "categories": [], "annotations": [item(100 + i) for i in range(15)], "version": "1]}", "list": [[{"id": 7}]]}
    return doc


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["section"], []).append(json.loads(r["item"]))
    return {k: sorted(v, key=lambda x: x["id"]) for k, v in out.items()}


@pytest.mark.parametrize("seed,ascii_,indent,width", [(1, True, None, 37), (2, False, 1, 64), (3, True, 2, 301), (4, False, None, 10**6), (5, True, None, 11)])
def test_ranges_of_any_width_give_the_items(spark, tmp, seed, ascii_, indent, width):
    doc = odd_doc(seed)
    path = f"{tmp}/doc{seed}.json"
    with open(path, "w") as f:
        json.dump(doc, f, ensure_ascii=ascii_, indent=indent)
    df = read_items(spark, path, ["images", "annotations", "categories", "absent"], width)
    assert got(df) == {"images": doc["images"], "annotations": doc["annotations"]}
    assert all(r["item"].startswith("{") and r["path"] == path for r in df.collect())


def test_escapes_across_borders(spark, tmp):
    """Runs of backslashes in front of quotes, cut at every byte."""
    items = [{"id": i, "t": "\\" * i + '"' + "]}" * (i % 3)} for i in range(9)]
    path = write(f"{tmp}/a.json", items)
    for width in (1, 2, 3, 5, 8, 1000):
        assert got(read_items(spark, path, None, width)) == {None: items}


def test_one_document_is_read_by_many_tasks_like_the_whole(spark, tmp):
    doc = small_doc()
    doc["images"] += [{"id": f"s{i}", "file_name": f"x \"{i}\".jpg", "width": i, "height": None} for i in range(400)] + [{"id": 5.5, "file_name": None}]
    path = write(f"{tmp}/doc.json", doc)
    whole = coco.read_coco(spark, path)
    parts = coco.read_coco_ranges(spark, path, 512)
    raw = read_items(spark, path, ["images"], 512)
    assert raw.rdd.getNumPartitions() > 20
    key = lambda df: sorted(map(repr, df.collect()))
    cats = coco.read_coco_categories(whole, "d")
    assert key(coco.read_coco_categories(parts["categories"], "d")) == key(cats)
    assert key(coco.read_coco_samples(parts["images"], "d", "train")) == key(coco.read_coco_samples(whole, "d", "train"))
    assert key(coco.read_coco_annotations(parts["annotations"], "d", cats)) == key(coco.read_coco_annotations(whole, "d", cats))


def test_folders_empty_files_and_faults(spark, tmp):
    a, b = write(f"{tmp}/in/a.json", predictions()), write(f"{tmp}/in/b.json", [])
    write(f"{tmp}/in/.hidden.json", [{"id": 1}])
    open(f"{tmp}/in/c.json", "w").close()
    rows = read_items(spark, f"{tmp}/in", None, 100).collect()
    assert sorted(json.dumps(json.loads(r["item"])) for r in rows) == sorted(json.dumps(x) for x in predictions())
    assert {r["path"] for r in rows} == {a}
    assert read_items(spark, [b], None).collect() == [] == read_items(spark, f"{tmp}/in/c.json").collect()
    with pytest.raises(FileNotFoundError):
        read_items(spark, f"{tmp}/none.json")
    with open(f"{tmp}/cut.json", "w") as f:
        f.write('[{"id": 1}, {"id": 2, "t": "')
    with pytest.raises(Exception, match="truncated JSON"):
        read_items(spark, f"{tmp}/cut.json", None, 9).collect()


def test_a_range_holds_no_more_than_itself(spark, tmp, monkeypatch):
    """A long item is read beyond its range, by the task that owns its beginning only."""
    long = {"id": 1, "t": "x" * 300_000}
    path = write(f"{tmp}/long.json", [{"id": 0}, long, {"id": 2}])
    assert got(read_items(spark, path, None, 1000)) == {None: [{"id": 0}, long, {"id": 2}]}
    assert jsonranges.RANGE_BYTES == 32 << 20

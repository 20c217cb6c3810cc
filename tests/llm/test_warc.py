"""Operator 2: round trips, byte ranges at every size, damage, equal payloads, edge cases."""

import hashlib
import io

from pyspark.sql import functions as F

from boxlens.llm import warc
from boxlens.llm.warc import archive_files, read_archives, records_in, round_trip, write_archives


def expect(rows):
    size = {}
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            size[b] = max(size.get(b, p), p)
    out = []
    for p, h in rows:
        b = (h or "").encode()
        first = size.get(b)
        ref = first if first is not None and first != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("archive", "place").collect()), key=repr)


def test_edge_cases(spark):
    big = "x é " * 400
    rows = [(1, None), (2, ""), (3, "<p>short</p>"), (4, "<p>short</p>"), (5, big), (9, big), (7, big), (None, big), (11, big + "!"),
            (12, "y" * 999), (13, "y" * 999), (14, "z" * 1000), (15, "z" * 1000), (15, "z" * 1000), (None, "lone"), (-3, "q" * 3_000_000)]
    df = spark.createDataFrame([(p, h, None if i % 3 else "http://a.b/\r\nX: y é", "k") for i, (p, h) in enumerate(rows)],
                               "page_id long, html string, url string, sha1 string")
    out = round_trip(df.repartition(3), range_bytes=700)
    assert out.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got(out) == expect(rows)
    assert round_trip(df.limit(0)).collect() == []


def test_files_on_disk_are_read_the_same_at_any_split(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = f"file://{tmp_path}/w"
    n = write_archives(pages.repartition(2), folder).agg(F.sum("records")).first()[0]
    files = archive_files(spark, folder)
    assert n == pages.count() and files.count() == 2
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    for size in (997, 20_000, 1 << 30):
        rows = read_archives(files, size).collect()
        assert sorted(r["page_id"] for r in rows) == sorted(html)
        assert all(r["payload"] == html[r["page_id"]] for r in rows if r["record_type"] == "response")


def test_ranges_own_every_record_once_despite_false_magic():
    recs = [warc.record(i, f"http://x/{i}", bytes([31, 139, 8, 0]) * (i * 37 % 90) + b"WARC/1.0" * (i % 4), None, "0", 0) for i in range(40)]
    recs.insert(7, b"\x1f\x8b\x08 not a member")
    recs.insert(20, b"\x1f\x8b\x08\x00garbage WARC/1.1")
    import gzip
    recs.insert(30, gzip.compress(b"no record"))
    data = b"".join(recs)
    whole = [(p, h["warc-record-id"]) for p, h, _ in records_in(io.BytesIO(data), len(data), 0, len(data))]
    assert len(whole) == 40
    for step in (1, 13, 200, 5000):
        parts = [(p, h["warc-record-id"]) for s in range(0, len(data), step)
                 for p, h, _ in records_in(io.BytesIO(data), len(data), s, min(len(data), s + step))]
        assert parts == whole
    cut = data[:-9]                          # a member cut off at the end is no record
    assert len(list(records_in(io.BytesIO(cut), len(cut), 0, len(cut)))) == 39


def test_magic_across_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    recs = [warc.record(i, None, b"p" * (i * 50), None, "0", 0) for i in range(12)]
    data = b"noise" * 30 + b"".join(recs)
    assert [p for _, _, p in records_in(io.BytesIO(data), len(data), 0, len(data))] == [b"p" * (i * 50) for i in range(12)]

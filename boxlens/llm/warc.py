"""Operator 2: WARC archives, written and read back by splitting them.

Writing: every task writes one archive of gzip members, one record each, to a path of its own
under the target folder; only the paths of successful attempts reach the manifest, so a lost
executor or a repeated attempt leaves at most an unlisted file.  Equal payloads of at least
``MIN_REVISIT`` bytes are written once (the response of the largest page id) and revisited by
the others.

Reading: archives are cut into byte ranges.  A task looks for gzip magic from the start of its
range, accepts a candidate only if its first bytes decode to a WARC header, and owns the records
that start inside its range, reading past the end to finish the last one.  Records of any size
pass through in chunks; ranges are independent of the record layout.

Files are opened through ``pyarrow.fs`` by URI, so the folder may be local, HDFS or an object
store; it must be shared by driver and executors.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.session import pin, shared_path

MIN_REVISIT = 1000
RANGE_BYTES = 8 << 20
CHUNK = 256 << 10
LEVEL = 1
MAX_HEADER = 64 << 10
_MAGIC = b"\x1f\x8b\x08"


def _open(uri: str):
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


# ------------------------------------------------------------------ writing

def record(page_id, uri: str | None, payload: bytes, refers_to, sha1: str, size: int) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit (refers_to given) has no payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
            b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + " ".join((uri or "").split()).encode("utf-8", "replace"),
            b"Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{sha1}".encode(), f"X-Payload-Length: {size}".encode()]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}".encode())
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n") + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()


def _writer(folder: str):
    def write(batches):
        uri = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        system, path = _open(uri)
        out, size, n = None, 0, 0
        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "html", "refers_to", "sha1", "size")]
            for row in zip(*cols):
                page_id, url, html, ref, sha1, length = (x.as_py() for x in row)
                data = record(page_id, url, html or b"", ref, sha1, length)
                if out is None:
                    out = system.open_output_stream(path, compression=None)   # members are compressed one by one
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "length", "records"])
    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) under ``folder``; returns the pinned manifest (path,
    length, records).  Payload is the html in UTF-8, empty for null."""
    spark = pages.sparkSession
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(folder)
    system = hp.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hp)
    folder = system.makeQualified(hp).toString()     # a path without scheme is one of the cluster's default store
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    # the largest page id of every payload that occurs more than once; payloads are not moved for it
    firsts = (p.filter(F.col("size") >= MIN_REVISIT).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
               .filter("n > 1").select(F.col("sha1").alias("_h"), F.col("size").alias("_z"), "first"))
    firsts = pin(firsts)
    # repeated payloads grow with the corpus: one plan at every size, no broadcast while they are few
    rows = p.join(firsts.hint("merge"), (F.col("sha1") == F.col("_h")) & (F.col("size") == F.col("_z")), "left")
    ref = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", F.when(ref.isNull(), F.col("html")).alias("html"), ref.alias("refers_to"), "sha1", "size")
    return pin(rows.mapInArrow(_writer(folder), "path string, length long, records long"))


# ------------------------------------------------------------------ reading

class _Source:
    """Bytes of a file from a place onwards, read in chunks and kept only as far as needed."""

    def __init__(self, file, start: int, length: int):
        self.file, self.base, self.length, self.buf = file, start, length, bytearray()
        file.seek(start)

    def fill(self, upto: int) -> bool:
        """Bytes up to place ``upto`` are in the buffer, unless the file ends before."""
        while self.base + len(self.buf) < upto:
            got = self.file.read(CHUNK)
            if not got:
                return False
            self.buf += got
        return True

    def drop(self, upto: int) -> None:
        cut = min(len(self.buf), upto - self.base)
        if cut > 0:
            del self.buf[:cut]
            self.base += cut


def _member(src: _Source, at: int):
    """The member at place ``at``: (header dict, payload, place behind it), None if there is no
    valid WARC record (bad deflate data, checksum or header)."""
    z, place, head, body, body_size, want = zlib.decompressobj(31), at, b"", [], 0, None
    try:
        while not z.eof:
            if not src.fill(place + 1):
                return None
            chunk = bytes(src.buf[place - src.base:place - src.base + CHUNK])
            out = z.decompress(chunk)
            place += len(chunk) - len(z.unused_data)
            if want is None:
                head += out
                if not b"WARC/1.".startswith(head[:7]) and head[:7] != b"WARC/1.":
                    return None
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    if len(head) > MAX_HEADER:
                        return None
                    continue
                fields = dict(line.partition(b":")[::2] for line in head[:end].split(b"\r\n")[1:])
                fields = {k.strip().lower().decode("latin-1"): v.strip() for k, v in fields.items()}
                if not fields.get("content-length", b"").isdigit():
                    return None
                want = int(fields["content-length"])
                out = head[end + 4:]
            body.append(out)
            body_size += len(out)
    except zlib.error:
        return None
    if want is None or body_size < want:
        return None
    return fields, b"".join(body)[:want], place


def records_in(file, length: int, start: int, end: int):
    """(place, header, payload) of the records of an archive that start in [start, end)."""
    src = _Source(file, start, length)
    at = start
    while at < end:
        src.drop(at)
        more = src.fill(at + CHUNK)
        i = src.buf.find(_MAGIC)
        if i < 0:
            if not more:
                return
            at += len(src.buf) - len(_MAGIC) + 1     # magic may lie across the end of what was read
            continue
        at = src.base + i
        if at >= end:
            return
        got = _member(src, at)
        if got is None:
            at += 1                                  # magic by chance inside compressed data
            continue
        yield at, got[0], got[1]
        at = got[2]


def _urn(value: bytes | None):
    text = (value or b"").decode("latin-1")
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _reader(batches):
    for b in batches:
        for path, length, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "length", "start", "end"))):
            system, local = _open(path)
            rows, held = [], 0
            with system.open_input_file(local) as f:
                for place, h, payload in records_in(f, length, start, end):
                    rows.append((path, place, _urn(h.get("warc-record-id")), h.get("warc-type", b"").decode("latin-1"),
                                 _urn(h.get("warc-refers-to")), int(h.get("x-payload-length") or len(payload)),
                                 h.get("warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:"),
                                 h.get("warc-target-uri", b"").decode("utf-8", "replace"), payload))
                    held += len(payload)
                    if held > 4 * CHUNK or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


_SCHEMA = pa.schema([("path", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("declared", pa.int64()), ("declared_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of ``files`` (path, length): path, place, page_id, record_type,
    refers_to, declared and declared_digest (payload size and SHA-1 in the header), url, payload.

    Bytes that belong to no valid record are passed over; an empty file has no records."""
    ranges = files.filter("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    n = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 1
    ddl = ("path string, place long, page_id long, record_type string, refers_to long, declared long, declared_digest string, "
           "url string, payload binary")
    return ranges.repartition(max(1, min(int(n), 100_000))).mapInArrow(_reader, ddl)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the archives in a folder, listed by Spark (contents are not read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def round_trip(pages: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes ``pages`` to archives and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, archive, place, a row per row of pages.

    Of records with equal payloads of at least 1000 bytes the one of the largest page_id is the
    response and the others revisit it (rows that repeat that page_id are responses too); rows
    without page_id revisit where any equal payload has an id.  payload_bytes and payload_digest
    are those of the full payload: computed from the bytes read for responses, declared by the
    header for revisits.  Null html is an empty payload; other columns are ignored."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    back = read_archives(write_archives(pages, folder).select("path", "length"), range_bytes)
    is_revisit = F.col("record_type") == "revisit"
    return back.select(
        "page_id", F.when(is_revisit, F.col("declared")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(is_revisit, F.col("declared_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type", "refers_to", F.col("path").alias("archive"), "place")

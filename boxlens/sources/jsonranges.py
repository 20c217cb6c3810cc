"""Large JSON documents read by many tasks: byte ranges of one file, each owning the array items
that begin in it.

Whether a bracket counts depends on everything before it (strings, nesting), so the file is scanned
in narrow passes over ranges:

1. every range tells what it does to the state: whether its quotes flip "inside a string", and
   by how much its brackets change the depth, for either state at its start.  Composing these few
   numbers per range gives the state at the start of each;
2. every range names the top-level section that is open at its end, if one begins in it;
3. every range cuts out the items that begin in it (the last one is read to its end beyond
   the range) as JSON text, which Spark parses with an explicit schema.

Bytes are scanned with numpy; a task holds one range and one item.  What the driver sees is one
row per range (``RANGE_BYTES``).
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
_KEY_BYTES = 1 << 16         # a section's key and the blanks around it are looked for in so many bytes
_EMIT_BYTES = 4 << 20
_BRACKETS = np.zeros(256, np.int8)
_BRACKETS[[ord("["), ord("{")]] = 1
_BRACKETS[[ord("]"), ord("}")]] = -1
_STATE = "path string, size long, start long, stop long"


def open_file(path: str):
    """Random-access file of a path or URI of any filesystem pyarrow knows."""
    from pyarrow import fs as pafs
    uri = "file:///" + path[5:].lstrip("/") if path.startswith("file:") else (path if "://" in path else "file://" + path)
    filesystem, inner = pafs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(inner)


def _read(f, start: int, stop: int) -> np.ndarray:
    f.seek(start)
    return np.frombuffer(f.read(stop - start), np.uint8)


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the quotes that no backslash escapes, and of all brackets."""
    quotes = np.flatnonzero(data == 34)
    slash = data == 92
    if slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))      # last byte that is none
        before = np.where(quotes > 0, quotes - 1 - last[quotes - 1], 0)
        quotes = quotes[before % 2 == 0]
    return quotes, np.flatnonzero(_BRACKETS[data])


def _outside(quotes: np.ndarray, brackets: np.ndarray, in_string: bool) -> np.ndarray:
    """The brackets outside strings."""
    return brackets[(np.searchsorted(quotes, brackets) + in_string) % 2 == 0]


def _back(f, start: int) -> int:
    """The first byte of the run of backslashes that ends at ``start``."""
    step = 64
    while start:
        data = _read(f, max(0, start - step), start)
        other = np.flatnonzero(data != 92)
        if len(other):
            return start - (len(data) - 1 - int(other[-1]))
        if len(data) == start:
            return 0
        step *= 4
    return 0


def _range_marks(f, start: int, stop: int):
    """(data, quotes, brackets) of a range; an escape that begins in front of it is respected."""
    lead = start - _back(f, start)
    data = _read(f, start - lead, stop)
    quotes, brackets = _marks(data)
    return data[lead:], quotes[quotes >= lead] - lead, brackets[brackets >= lead] - lead


def _effects(batches):
    """(path, size, start, stop) -> the same with flips and the depth change outside and inside a string."""
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            with open_file(r["path"]) as f:
                data, quotes, brackets = _range_marks(f, r["start"], r["stop"])
            r["flips"] = len(quotes) % 2
            r["out"], r["in"] = (int(_BRACKETS[data[_outside(quotes, brackets, s)]].sum(dtype=np.int64)) for s in (False, True))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*b.schema, ("flips", pa.int32()), ("out", pa.int64()), ("in", pa.int64())]))


def _depths(data, quotes, brackets, in_string: bool, depth: int):
    """(places, change, depth behind) of the brackets that count."""
    at = _outside(quotes, brackets, in_string)
    change = _BRACKETS[data[at]].astype(np.int64)
    return at, change, depth + np.cumsum(change)


def _section_at(f, place: int) -> str | None:
    """Key of the array that opens at ``place`` of the file, None if it is an object or has no key."""
    lo = max(0, place - _KEY_BYTES)
    data = _read(f, lo, place + 1)
    if data[-1] != ord("["):
        return None
    m = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\[\Z', data.tobytes(), re.S)
    return None if m is None else json.loads(b'"' + m[1] + b'"')


def _open_sections(batches):
    """Ranges with their state -> path, start, opened (a section begins in the range), section (the last one)."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            with open_file(r["path"]) as f:
                data, quotes, brackets = _range_marks(f, r["start"], r["stop"])
                at, change, behind = _depths(data, quotes, brackets, r["in_string"], r["depth"])
                top = at[(change == 1) & (behind == 2)]
                rows.append({"path": r["path"], "start": r["start"], "opened": bool(len(top)),
                             "section": _section_at(f, r["start"] + int(top[-1])) if len(top) else None})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("start", pa.int64()), ("opened", pa.bool_()), ("section", pa.string())]))


def _item_end(f, start: int, size: int) -> bytes:
    """The whole item that begins at ``start``, read in growing pieces."""
    step = 1 << 16
    while True:
        data = _read(f, start, min(size, start + step))
        quotes, brackets = _marks(data)
        at, _, behind = _depths(data, quotes, brackets, False, 0)
        end = np.flatnonzero(behind == 0)
        if len(end):
            return data[:at[end[0]] + 1].tobytes()
        if start + step >= size:
            raise ValueError("truncated JSON")
        step *= 4


def _items(sections: list[str] | None):
    """Ranges with state and open section -> (path, section, item) of the objects that begin in them.

    With ``sections`` these are the items of top-level arrays of these names; without, those of a
    document that is an array itself."""
    level = 3 if sections else 2
    schema = pa.schema([("path", pa.string()), ("section", pa.string()), ("item", pa.string())])

    def batch(path, names, items):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(items), pa.string()), pa.array(names, pa.string()),
                                           pa.array(items, pa.binary()).cast(pa.string())], schema=schema)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                with open_file(r["path"]) as f:
                    data, quotes, brackets = _range_marks(f, r["start"], r["stop"])
                    at, change, behind = _depths(data, quotes, brackets, r["in_string"], r["depth"])
                    opened = (change == 1) & (data[at] == ord("{")) & (behind == level)
                    starts, ends = at[opened], at[(change == -1) & (behind == level - 1)]
                    names = np.full(len(starts), None, object)
                    if sections:
                        top = at[(change == 1) & (behind == 2)]
                        keys = [r["section"], *(_section_at(f, r["start"] + int(p)) for p in top)]
                        names = np.array(keys, object)[np.searchsorted(top, starts)]
                        mine = np.array([n in sections for n in names], bool)
                        starts, names = starts[mine], names[mine]
                    until = np.searchsorted(ends, starts)
                    held, whole = 0, data.tobytes()
                    out, of = [], []
                    for s, k, name in zip(starts.tolist(), until.tolist(), names):
                        item = whole[s:int(ends[k]) + 1] if k < len(ends) else _item_end(f, r["start"] + s, r["size"])
                        out.append(item)
                        of.append(name)
                        held += len(item)
                        if held >= _EMIT_BYTES:
                            yield batch(r["path"], of, out)
                            out, of, held = [], [], 0
                    if out:
                        yield batch(r["path"], of, out)
    return run


def _files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of the named files, and of the files of named folders (hidden ones not)."""
    from pyarrow import fs as pafs
    out = []
    for p in paths:
        filesystem, inner = pafs.FileSystem.from_uri("file:///" + p[5:].lstrip("/") if p.startswith("file:") else (p if "://" in p else "file://" + p))
        info = filesystem.get_file_info(inner)
        prefix = p.rstrip("/")[: len(p.rstrip("/")) - len(inner.rstrip("/"))] if p.rstrip("/").endswith(inner.rstrip("/")) else ""
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(p)
        if info.type == pafs.FileType.Directory:
            found = filesystem.get_file_info(pafs.FileSelector(inner))
            out += sorted((prefix + i.path, int(i.size)) for i in found if i.type == pafs.FileType.File and i.base_name[0] not in "._")
        else:
            out.append((p, int(info.size)))
    return out


def read_items(spark: SparkSession, paths: str | list[str], sections: list[str] | None = None,
               range_bytes: int | None = None) -> DataFrame:
    """(path, section, item): the objects of the named top-level arrays as JSON text, or of documents
    that are arrays themselves (section null).  Files are UTF-8; empty files have no items; a document that
    ends inside an item raises.  Two small jobs find the state of every range, the items are read lazily."""
    width = range_bytes or RANGE_BYTES
    ranges = [(p, n, a, min(n, a + width)) for p, n in _files([paths] if isinstance(paths, str) else list(paths)) for a in range(0, n, width)]
    if not ranges:
        return spark.createDataFrame([], "path string, section string, item string")

    def spread(rows: list, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).repartitionByRange(max(1, min(len(rows), 4096)), "path", "start")
    effects = spread(ranges, _STATE).mapInArrow(_effects, f"{_STATE}, flips int, out long, in long").collect()     # one row a range
    states, current = [], None
    for e in sorted(effects, key=lambda e: (e["path"], e["start"])):
        if e["path"] != current:
            current, inside, depth = e["path"], False, 0
        states.append((e["path"], e["size"], e["start"], e["stop"], inside, depth))
        depth += e["in"] if inside else e["out"]
        inside ^= bool(e["flips"])
    full = f"{_STATE}, in_string boolean, depth int"
    named = {(s[0], s[2]): None for s in states}
    if sections:
        opened = spread(states, full).mapInArrow(_open_sections, "path string, start long, opened boolean, section string").collect()
        current = None
        for o in sorted(opened, key=lambda o: (o["path"], o["start"])):
            if o["path"] != current:
                current, section = o["path"], None
            named[(o["path"], o["start"])] = section
            section = o["section"] if o["opened"] else section
    rows = [(*s, named[(s[0], s[2])]) for s in states]
    return spread(rows, f"{full}, section string").mapInArrow(_items(sections), "path string, section string, item string")


def read_section(items: DataFrame, section: str, schema) -> DataFrame:
    """Flat rows of one section of ``read_items``, parsed with ``schema``."""
    return items.filter(F.col("section") == section).select(F.from_json("item", schema).alias("i")).select("i.*")

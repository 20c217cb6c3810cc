"""Boxes matched image by image inside tasks: what ``matching`` does by joins, for images of bounded size.

The boxes of both sides are shuffled once, by a hash of their image, and sorted by it.  A task reads its images one
behind the other, some thousand boxes at a time, and compares the boxes of an image with each other in
numpy.  Nothing but the result leaves the task: no grid places, no pairs for an aggregate, no rows joined back.
Images of more than LOCAL_BOXES boxes are told apart by a count before, and stay with the joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlens.functions.geometry import effective_confidence
from boxlens.session import pin

LOCAL_BOXES = 2048          # boxes of an image that is matched inside a task
_ROWS = 1 << 15             # boxes of whole images compared at a time
_PAIRS = 1 << 20            # pairs of boxes compared at a time
PRED, TRUTH = 0, 1


def _image() -> Column:
    """Images by hash; boxes of no image match nothing and are dealt out by their own id."""
    return F.when(F.col("dataset_id").isNull() | F.col("sample_id").isNull(), F.xxhash64(F.lit(1), "id")).otherwise(F.xxhash64("dataset_id", "sample_id"))


def large_images(preds: DataFrame, gts: DataFrame) -> tuple[DataFrame, bool]:
    """(image hashes of more than LOCAL_BOXES boxes, whether there are any), stored by one job."""
    h = preds.select(_image().alias("_h")).unionByName(gts.select(_image().alias("_h")))
    large = pin(h.groupBy("_h").agg(F.count("*").alias("n")).filter(F.col("n") > LOCAL_BOXES).select("_h"))
    return large, not large.isEmpty()


def of_images(boxes: DataFrame, large: DataFrame, small: bool) -> DataFrame:
    """The boxes of the images that are matched inside tasks, or of the others."""
    return boxes.withColumn("_h", _image()).join(large, "_h", "left_anti" if small else "left_semi").drop("_h")


def _sides(preds: DataFrame, gts: DataFrame) -> DataFrame:
    def side(df: DataFrame, kind: int, conf: Column, confidence: Column) -> DataFrame:
        return df.select(_image().alias("_h"), F.lit(kind).cast("byte").alias("kind"), "dataset_id", "sample_id", "id", F.col("category_name").alias("cat"),
                         *[F.col(f"bbox_{c}").cast("double").alias(c) for c in "xywh"], conf.alias("conf"), confidence.alias("confidence"))
    none = F.lit(None).cast("double")
    return side(preds, PRED, effective_confidence().cast("double"), F.col("confidence").cast("double")).unionByName(side(gts, TRUTH, none, none))


def _by_image(run):
    """``run`` over tables of whole images, of sorted batches."""
    def over(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < _ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table["_h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))         # the last image may go on
            if cut:
                yield from run(table.slice(0, cut)).to_batches()
            held, n = table.slice(cut).to_batches(), len(h) - cut
        if n:
            yield from run(pa.Table.from_batches(held).combine_chunks()).to_batches()
    return over


def _ranks(column) -> np.ndarray:
    """A number per value that orders as the values do; null comes first, as -1."""
    codes = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, -1, rank[at]) if len(rank) else np.full(len(at), -1, np.int64)


def _numbers(table, c: str) -> np.ndarray:
    return table[c].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)


def _known(table, *columns: str) -> np.ndarray:
    out = np.ones(table.num_rows, bool)
    for c in columns:
        out &= table[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    return out


class _Boxes:
    """The boxes of some images: number of the image (-1: none), kind and order of ids and categories."""

    def __init__(self, table):
        self.kind = table["kind"].to_numpy()
        known = _known(table, "dataset_id", "sample_id")
        ds, sample = _ranks(table["dataset_id"]), _ranks(table["sample_id"])
        self.image = np.where(known, np.unique(ds * (int(sample.max(initial=0)) + 1) + sample, return_inverse=True)[1], -1)
        self.id, self.cat = _ranks(table["id"]), _ranks(table["cat"])
        self.named = self.image * (int(self.id.max(initial=0)) + 2) + self.id + 1       # the same for boxes of one image and id
        x, y, w, h = (_numbers(table, c) for c in "xywh")
        self.x1, self.y1, self.x2, self.y2 = x, y, x + w, y + h
        self.solid = known & _known(table, *"xywh") & (w > 0) & (h > 0)

    def pairs(self, same_class: bool):
        """(prediction, ground truth, IoU) of all pairs of one image that overlap, by row."""
        p, g = (np.flatnonzero(self.solid & (self.kind == k)) for k in (PRED, TRUTH))
        p, g = p[np.argsort(self.image[p], kind="stable")], g[np.argsort(self.image[g], kind="stable")]
        start = np.searchsorted(self.image[g], self.image[p])
        n = np.searchsorted(self.image[g], self.image[p], side="right") - start
        total = np.cumsum(n)
        out, i = [], 0
        while i < len(p):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PAIRS, side="right")))
            k = n[i:j]
            a = np.repeat(p[i:j], k)
            b = g[np.repeat(start[i:j] - (np.cumsum(k) - k), k) + np.arange(len(a))]
            if same_class:
                same = (self.cat[a] == self.cat[b]) & (self.cat[a] >= 0)
                a, b = a[same], b[same]
            iw = np.maximum(0.0, np.minimum(self.x2[a], self.x2[b]) - np.maximum(self.x1[a], self.x1[b]))
            ih = np.maximum(0.0, np.minimum(self.y2[a], self.y2[b]) - np.maximum(self.y1[a], self.y1[b]))
            inter = iw * ih
            hit = inter > 0
            a, b, inter = a[hit], b[hit], inter[hit]
            union = self._area(a) + self._area(b) - inter
            out.append((a, b, np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)))
            i = j
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def _area(self, k):
        return (self.x2[k] - self.x1[k]) * (self.y2[k] - self.y1[k])


def _firsts(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Of every group, the row that is first in ``order``."""
    at = np.lexsort((*order[::-1], group))
    return at[np.concatenate([[True], group[at][1:] != group[at][:-1]])] if len(at) else at


def _lookup(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Place of every ``of`` in the sorted ``keys``, -1 if it isn't there."""
    at = np.searchsorted(keys, of)
    return np.where((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == of), at, -1) if len(keys) else np.full(len(of), -1)


def _taken(column, at: np.ndarray):
    """Values of rows, null where the row is -1."""
    return column.take(pa.array(at, mask=at < 0))


def _pairs_of(same_class: bool):
    def run(table):
        a, b, iou = _Boxes(table).pairs(same_class)
        p, g = (table.select(["dataset_id", "sample_id", "id", "cat", "conf"]).take(pa.array(k)) for k in (a, b))
        return pa.table([p["dataset_id"], p["sample_id"], p["id"], p["cat"], p["conf"], g["id"], g["cat"], pa.array(iou)],
                        names=["dataset_id", "sample_id", "p_id", "p_cat", "conf", "g_id", "g_cat", "iou"])
    return run


def _outcomes_of(iou_threshold: float, same_class: bool):
    def run(table):
        x = _Boxes(table)
        a, b, v = x.pairs(same_class)
        a, b, v = (k[x.id[a] >= 0] for k in (a, b, v))         # a box without id is nobody's
        # best ground truth by id of the prediction, as several boxes may have one
        first = _firsts(x.named[a], -v, x.id[b], x.cat[b])
        keys, best, iou = x.named[a][first], b[first], v[first]
        pred = (x.kind == PRED) & (x.image >= 0) & (x.id >= 0)
        at = np.where(pred, _lookup(keys, x.named), -1)
        truth = np.where(at >= 0, best[np.maximum(at, 0)], -1) if len(best) else at
        value = np.where(at >= 0, iou[np.maximum(at, 0)], np.nan) if len(best) else np.full(len(at), np.nan)
        # the first claimant of a ground truth, by its id
        e = np.flatnonzero((at >= 0) & (value >= iou_threshold))
        conf = _numbers(table, "conf")
        won = e[_firsts(x.named[truth[e]], -conf[e], x.id[e], x.cat[e], value[e])]
        claims = np.where((x.kind == PRED) & pred, np.isin(x.named, x.named[won]), False)
        c = _lookup(x.named[truth[won]], x.named)
        m = np.where((x.kind == TRUTH) & (x.image >= 0) & (x.id >= 0) & (c >= 0), won[np.maximum(c, 0)], -1) if len(won) else np.full(len(at), -1)
        ids, cats = table["id"].combine_chunks(), table["cat"].combine_chunks()
        return pa.table([table["dataset_id"], table["sample_id"], pa.array(np.where(x.kind == PRED, "pred", "gt"), pa.string()), ids, cats, table["conf"], table["confidence"],
                         _taken(ids, truth), _taken(cats, truth), pa.array(value, mask=at < 0), pa.array(claims | (m >= 0)),
                         _taken(ids, m), _taken(cats, m), pa.array(value[np.maximum(m, 0)], mask=m < 0)],
                        names=["dataset_id", "sample_id", "kind", "id", "cat", "conf", "confidence", "g_id", "g_cat", "iou", "claimed", "m_id", "m_cat", "m_iou"])
    return run


def _mapped(preds: DataFrame, gts: DataFrame, run, schema: str) -> DataFrame:
    keys = ", ".join(f"{c} {preds.schema[c].dataType.simpleString()}" for c in ("dataset_id", "sample_id"))
    return _sides(preds, gts).repartition("_h").sortWithinPartitions("_h").mapInArrow(_by_image(run), f"{keys}, {schema}")


def local_pairs(preds: DataFrame, gts: DataFrame, same_class: bool) -> DataFrame:
    """``matching.candidate_pairs`` of images of at most LOCAL_BOXES boxes."""
    return _mapped(preds, gts, _pairs_of(same_class), "p_id string, p_cat string, conf double, g_id string, g_cat string, iou double")


def local_outcomes(preds: DataFrame, gts: DataFrame, iou_threshold: float, same_class: bool) -> DataFrame:
    """``matching.match_outcomes`` of images of at most LOCAL_BOXES boxes."""
    return _mapped(preds, gts, _outcomes_of(float(iou_threshold), same_class),
                   "kind string, id string, cat string, conf double, confidence double, g_id string, g_cat string, iou double, claimed boolean, "
                   "m_id string, m_cat string, m_iou double")

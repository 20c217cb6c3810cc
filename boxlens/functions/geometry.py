"""Box geometry as Column expressions (JVM-side, inside whole-stage codegen).

Boxes are stored as absolute-pixel ``x, y, w, h`` (top-left corner).  Matching works on
corner form ``x1, y1, x2 = x + w, y2 = y + h``; areas are taken from the corners, so a
result equals the corner-form arithmetic of the reference bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(prefix: str = "") -> list[Column]:
    """Columns x1,y1,x2,y2 (with an optional prefix) from bbox_x/y/w/h."""
    return [
        F.col("bbox_x").alias(f"{prefix}x1"),
        F.col("bbox_y").alias(f"{prefix}y1"),
        (F.col("bbox_x") + F.col("bbox_w")).alias(f"{prefix}x2"),
        (F.col("bbox_y") + F.col("bbox_h")).alias(f"{prefix}y2"),
    ]


def intersection(a: str, b: str) -> Column:
    """Overlap area of corner boxes with column prefixes ``a`` and ``b`` (0 if disjoint)."""
    iw = F.greatest(F.lit(0.0), F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1")))
    ih = F.greatest(F.lit(0.0), F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1")))
    return iw * ih


def area(p: str) -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def iou(a: str, b: str, inter: Column | None = None) -> Column:
    """Intersection over union, 0 when the union is not positive."""
    inter = intersection(a, b) if inter is None else inter
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def effective_confidence(c: str = "confidence") -> Column:
    """A missing confidence counts as 1.0."""
    return F.coalesce(F.col(c), F.lit(1.0))


# ---- G1-G3: display-space conversions -------------------------------------------------

def scale_boxes(df, img_w: str = "width", img_h: str = "height", disp_w: str = "display_w",
                disp_h: str = "display_h"):
    """G1: image pixels -> display pixels (independent x/y factors)."""
    sx = F.col(disp_w) / F.col(img_w)
    sy = F.col(disp_h) / F.col(img_h)
    return (df.withColumn("bbox_x", F.col("bbox_x") * sx).withColumn("bbox_w", F.col("bbox_w") * sx)
              .withColumn("bbox_y", F.col("bbox_y") * sy).withColumn("bbox_h", F.col("bbox_h") * sy))


def unscale_boxes(df, img_w: str = "width", img_h: str = "height", disp_w: str = "display_w",
                  disp_h: str = "display_h"):
    """Display pixels -> image pixels (inverse of G1)."""
    sx = F.col(img_w) / F.col(disp_w)
    sy = F.col(img_h) / F.col(disp_h)
    return (df.withColumn("bbox_x", F.col("bbox_x") * sx).withColumn("bbox_w", F.col("bbox_w") * sx)
              .withColumn("bbox_y", F.col("bbox_y") * sy).withColumn("bbox_h", F.col("bbox_h") * sy))


def normalize_boxes(df):
    """A box drawn right-to-left or bottom-to-top has negative w/h; flip it so w,h >= 0."""
    return (df.withColumn("bbox_x", F.when(F.col("bbox_w") < 0, F.col("bbox_x") + F.col("bbox_w")).otherwise(F.col("bbox_x")))
              .withColumn("bbox_y", F.when(F.col("bbox_h") < 0, F.col("bbox_y") + F.col("bbox_h")).otherwise(F.col("bbox_y")))
              .withColumn("bbox_w", F.abs("bbox_w"))
              .withColumn("bbox_h", F.abs("bbox_h")))


# ---- G4: triage label cycle -------------------------------------------------------------

# The click-cycle order of per-annotation triage labels.
TRIAGE_CYCLE = ["tp", "fp", "fn", "mistake"]


def next_triage_label(c: Column) -> Column:
    """Tp -> fp -> fn -> mistake -> tp; anything else -> tp."""
    pairs = []
    for i, lab in enumerate(TRIAGE_CYCLE):
        pairs += [F.lit(lab), F.lit(TRIAGE_CYCLE[(i + 1) % len(TRIAGE_CYCLE)])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit("tp"))

"""Boxes (struct x, y, w, h) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Within [low, high]; ``low`` where these cross."""
    return F.when(high < low, low).otherwise(F.least(F.greatest(value, low), high))


def placed(rect: Column, w: Column, h: Column, cx: Column, cy: Column) -> Column:
    """A box of w by h centred at a relative point of ``rect``, kept inside it."""
    zero = F.lit(0.0)
    x = rect["x"] + clamp(cx * rect["w"] - w / 2, zero, F.greatest(zero, rect["w"] - w))
    y = rect["y"] + clamp(cy * rect["h"] - h / 2, zero, F.greatest(zero, rect["h"] - h))
    return box(x, y, w, h)


def crop_inside(rect: Column, ratio: Column, cx: Column | float = 0.5, cy: Column | float = 0.5) -> Column:
    """The largest box of a width-to-height ratio inside ``rect``, around a relative point; empty boxes stay."""
    cx, cy = (F.lit(c) if isinstance(c, float) else c for c in (cx, cy))
    wide = rect["w"] > ratio * rect["h"]
    w = F.when(wide, rect["h"] * ratio).otherwise(rect["w"])
    h = F.when(wide, rect["h"]).otherwise(rect["w"] / ratio)
    return F.when((rect["w"] <= 0) | (rect["h"] <= 0) | (ratio <= 0), rect).otherwise(placed(rect, w, h, cx, cy))


def cropped(df: DataFrame, rect: str, ratio: float, name: str, cx: Column | float = 0.5, cy: Column | float = 0.5) -> DataFrame:
    """``crop_inside`` of a box column as a column, its size worked out in columns of its own first."""
    cx, cy = (F.lit(c) if isinstance(c, float) else c for c in (cx, cy))
    r, wide = F.col(rect), F.col(rect)["w"] > ratio * F.col(rect)["h"]
    out = df.withColumns({"_w": F.when(wide, r["h"] * ratio).otherwise(r["w"]), "_h": F.when(wide, r["h"]).otherwise(r["w"] / ratio)})
    return out.withColumn(name, F.when((r["w"] <= 0) | (r["h"] <= 0), r).otherwise(placed(r, F.col("_w"), F.col("_h"), cx, cy))).drop("_w", "_h")


def frame(width: Column, height: Column) -> Column:
    return box(F.lit(0.0), F.lit(0.0), width, height)


def tighten(crop: Column, whole: Column, zoom: float, cx: Column, cy: Column) -> Column:
    """A crop shrunk by ``zoom`` around a relative point of the whole; 1 and less leave it."""
    return crop if zoom <= 1.0 else placed(whole, crop["w"] / zoom, crop["h"] / zoom, cx, cy)


def facecam(given: Column, width: Column, height: Column) -> Column:
    """A given box in pixels: fractions where all four are at most 1, kept inside the frame; null stays null."""
    unit = (F.greatest(*(given[c] for c in "xywh")) <= 1) & (F.least(*(given[c] for c in "xywh")) >= 0)
    sx, sy = F.when(unit, width).otherwise(1.0), F.when(unit, height).otherwise(1.0)
    one = F.lit(1.0)
    x = clamp(given["x"] * sx, F.lit(0.0), F.greatest(F.lit(0.0), width - 1))
    y = clamp(given["y"] * sy, F.lit(0.0), F.greatest(F.lit(0.0), height - 1))
    w = clamp(given["w"] * sx, one, F.greatest(one, width - x))
    h = clamp(given["h"] * sy, one, F.greatest(one, height - y))
    return F.when(given.isNotNull(), box(x, y, w, h))


def upscale(src: Column, dst: Column) -> Column:
    """How much a layer grows; the larger axis decides."""
    return F.greatest(F.coalesce(F.try_divide(dst["w"], F.when(src["w"] > 0, src["w"])), F.lit(1.0)), F.coalesce(F.try_divide(dst["h"], F.when(src["h"] > 0, src["h"])), F.lit(1.0)))


def parse_box(text: Column) -> Column:
    """``x,y,w,h`` as a box; null for blanks, ``auto`` and anything else."""
    parts = F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: p.try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(good, box(*(F.try_element_at(parts, F.lit(k)) for k in (1, 2, 3, 4))))

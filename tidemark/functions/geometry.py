"""Boxes as struct<x,y,width,height> columns. Expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import BOX, BoxConfig


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    whole = lambda v, n: v.cast("long").alias(n)
    return F.struct(whole(x, "x"), whole(y, "y"), whole(width, "width"), whole(height, "height"))


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def center(r: Column) -> tuple[Column, Column]:
    return r["x"] + r["width"] / 2, r["y"] + r["height"] / 2


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(r: Column, frame_width, frame_height, minimum: int = 2) -> Column:
    """Inside the frame, with even sizes."""
    fw, fh, least = _lit(frame_width), _lit(frame_height), F.lit(minimum)
    x = F.greatest(F.lit(0), F.least(r["x"], fw - minimum))
    y = F.greatest(F.lit(0), F.least(r["y"], fh - minimum))
    w = F.greatest(least, F.least(r["width"], fw - x))
    h = F.greatest(least, F.least(r["height"], fh - y))
    return rect(x, y, w - w % 2, h - h % 2)


def expand(r: Column, frame_width, frame_height, config: BoxConfig = BOX) -> Column:
    grown = rect(
        F.rint(r["x"] - r["width"] * config.expand_left), F.rint(r["y"] - r["height"] * config.expand_top),
        F.rint(r["width"] * (1 + config.expand_left + config.expand_right)), F.rint(r["height"] * (1 + config.expand_top + config.expand_bottom)),
    )
    return clamp(grown, frame_width, frame_height)


def _shared(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - _shared(a, b)
    return F.when(union > 0, _shared(a, b) / union).otherwise(0.0)


def covered_share(crop: Column, excluded: Column) -> Column:
    return _shared(crop, excluded) / F.greatest(F.lit(1), area(excluded))


def contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x"], r["x"] + r["width"]) & y.between(r["y"], r["y"] + r["height"])


def position(r: Column, frame_width, frame_height) -> Column:
    """Named place on a 3x3 grid."""
    cx, cy = center(r)
    cx, cy = cx / _lit(frame_width), cy / _lit(frame_height)
    across = F.when(cx < 0.35, "left").when(cx > 0.65, "right").otherwise("center")
    down = F.when(cy < 0.35, "top").when(cy > 0.65, "bottom").otherwise("center")
    return (
        F.when((across != "center") & cy.between(0.35, 0.65), F.concat(across, F.lit("_center")))
        .when((across != "center") & (down != "center"), F.concat(down, F.lit("_"), across))
        .when(across != "center", across).otherwise(down)
    )


def side_column(r: Column, frame_width, frame_height) -> Column:
    """Column crop for a camera at the side."""
    fw, fh = _lit(frame_width), _lit(frame_height)
    width = F.least(F.rint(fw * 0.35), F.greatest(F.rint(fw * 0.22), F.rint(r["width"] * 3.6)))
    x = F.when(position(r, fw, fh).startswith("left"), F.lit(0.0)).otherwise(fw - width)
    y = F.greatest(F.lit(0.0), F.rint(r["y"] - r["height"] * 0.8))
    return clamp(rect(x, y, width, F.least(fh - y, F.rint(r["height"] * 3.0))), fw, fh)


def aspect_crop(frame_width, frame_height, target: float, center_x: Column | None = None) -> Column:
    fw, fh = _lit(frame_width), _lit(frame_height)
    cw = F.least(fw.cast("double"), F.rint(fh * target))
    middle = F.coalesce(center_x, fw / 2) if center_x is not None else fw / 2
    ch = F.least(fh.cast("double"), F.rint(fw / target))
    wide = rect(F.rint(middle - cw / 2), F.lit(0), cw, fh)
    tall = rect(F.lit(0), F.rint((fh - ch) / 2), fw, ch)
    return F.when(fw / fh > target, clamp(wide, fw, fh)).otherwise(clamp(tall, fw, fh))


def content_crop(frame_width, frame_height, target: float, facecam: Column, roi: Column) -> Column:
    """Struct (crop, overlap): the cheapest of up to three crops by covered camera, distance to the middle and interest."""
    fw, fh = _lit(frame_width), _lit(frame_height)
    full_height = fw / fh >= target
    cw = F.when(full_height, F.least(fw.cast("double"), F.rint(fh * target))).otherwise(fw.cast("double"))
    ch = F.when(full_height, fh.cast("double")).otherwise(F.least(fh.cast("double"), F.rint(fw / target)))
    vertical = ch < fh
    free = F.when(vertical, fh - ch).otherwise(fw - cw).cast("long")
    options = F.sort_array(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(free / 2), free)))

    def candidate(offset: Column, order: Column) -> Column:
        crop = clamp(rect(F.when(vertical, 0).otherwise(offset), F.when(vertical, offset).otherwise(0), cw, ch), fw, fh)
        overlap = F.coalesce(covered_share(crop, facecam), F.lit(0.0))
        cx, cy = center(crop)
        cost = overlap * 4 + F.abs(cx - fw / 2) / fw + F.abs(cy - fh / 2) / fh - F.coalesce(iou(crop, roi), F.lit(0.0))
        return F.struct(F.round(cost, 12).alias("cost"), order.alias("ord"), overlap.alias("overlap"), crop.alias("crop"))

    best = F.array_min(F.transform(options, candidate))
    return F.struct(best["crop"].alias("crop"), best["overlap"].alias("overlap"))


def scaled(r: Column, width, height, source_width: Column, source_height: Column) -> Column:
    w, h = _lit(width), _lit(height)
    return rect(
        F.rint(r["x"] * w / source_width), F.rint(r["y"] * h / source_height), F.rint(r["width"] * w / source_width), F.rint(r["height"] * h / source_height)
    )


def remapped(r: Column, scale: Column) -> Column:
    """Analysis-resolution box in source coordinates."""
    return rect(*[F.rint(r[f] / scale) for f in ("x", "y", "width", "height")])


def region_score(cx: Column, cy: Column, expected: Column) -> Column:
    """How well a face centre fits the expected region."""
    ex, ey = center(expected)
    distance = F.hypot(cx - ex, cy - ey) / F.greatest(F.lit(1.0), F.hypot(expected["width"], expected["height"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-distance * 4) * F.when(contains(expected, cx, cy), 1.0).otherwise(0.45)))


def size_score(value: Column, low: Column, high: Column) -> Column:
    distance = F.when(value < low, low - value).otherwise(value - high)
    return F.when(value.between(low, high), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - distance / F.greatest(high - low, F.lit(0.01))))

"""Boxes and sizes as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def iou(a: Box, b: Box, least: float = 1e-9) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    both = width * height
    return both / F.greatest(F.lit(least), area(a) + area(b) - both)


def pixel_box(roi: Box, width: Column, height: Column) -> Column:
    """A box of parts of the sides in pixels, rounded half to even and held inside; null where it is empty."""
    edge = lambda part, size: F.greatest(F.lit(0), F.least(size, F.rint(part * size).cast("int")))
    box = [edge(roi[0], width), edge(roi[1], height), edge(roi[2], width), edge(roi[3], height)]
    return F.when((box[2] > box[0]) & (box[3] > box[1]), F.struct(*(x.alias(n) for x, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True))))


def expanded(box: Box, width: Column, height: Column, by: float) -> Column:
    """The box grown by a part of its sides and held inside; null outside the picture or without area."""
    x0, x1 = F.least(box[0], box[2]), F.greatest(box[0], box[2])
    y0, y1 = F.least(box[1], box[3]), F.greatest(box[1], box[3])
    dx, dy = F.rint((x1 - x0) * by).cast("int"), F.rint((y1 - y0) * by).cast("int")
    grown = (F.greatest(F.lit(0), x0 - dx), F.greatest(F.lit(0), y0 - dy), F.least(width, x1 + dx), F.least(height, y1 + dy))
    inside = (x1 > 0) & (y1 > 0) & (x0 < width) & (y0 < height) & (x1 > x0) & (y1 > y0)
    return F.when(inside & (grown[2] > grown[0]) & (grown[3] > grown[1]), F.struct(*(x.cast("int").alias(n) for x, n in zip(grown, ("x0", "y0", "x1", "y1"), strict=True))))


def portrait_crop(width: Column, height: Column) -> Column:
    """The largest centred 3:4 rectangle, by whole units."""
    unit = F.least(F.floor(width / 3), F.floor(height / 4))
    w, h = unit * 3, unit * 4
    left, top = F.floor((width - w) / 2), F.floor((height - h) / 2)
    return F.when((width >= 3) & (height >= 4), F.struct(left.alias("x0"), top.alias("y0"), (left + w).alias("x1"), (top + h).alias("y1")))


def bounded_size(width: Column, height: Column, most_pixels: int, most_width: int, most_height: int) -> Column:
    scale = F.least(F.lit(1.0), F.sqrt(most_pixels / (width * height)), most_width / width, most_height / height)
    shrunk = lambda side: F.when(scale >= 1, side.cast("long")).otherwise(F.greatest(F.lit(1), F.floor(side * scale)))
    return F.struct(shrunk(width).alias("width"), shrunk(height).alias("height"))

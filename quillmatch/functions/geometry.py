"""Rectangles [x0, y0, x1, y1] as arrays of double, y growing downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(*c: Column) -> Column:
    return F.array(*c)


def anchored(annotation: Column, anchor: Column, field: Column) -> Column:
    """The annotation's size, as far from the field as it was from its anchor."""
    x, y = field[0] + (annotation[0] - anchor[0]), field[1] + (annotation[1] - anchor[1])
    return rect(x, y, x + (annotation[2] - annotation[0]), y + (annotation[3] - annotation[1]))


def raw_target(annotation: Column, anchor: Column, field: Column) -> Column:
    return F.when(F.coalesce(F.size(anchor), F.lit(0)) > 0, anchored(annotation, anchor, field)).otherwise(field)


def outside(r: Column, width: Column, height: Column) -> Column:
    """False where the page's size isn't known."""
    return F.when((width <= 0) | (height <= 0), F.lit(False)).otherwise((r[0] < 0) | (r[1] < 0) | (r[2] > width) | (r[3] > height))


def clamped(r: Column, width: Column, height: Column) -> Column:
    return F.when((width <= 0) | (height <= 0), r).otherwise(rect(*[F.greatest(F.lit(0.0), F.least(r[k], (width, height)[k % 2])) for k in range(4)]))


def scaled(r: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    sx, sy = to_width / width, to_height / height
    return rect(r[0] * sx, r[1] * sy, r[2] * sx, r[3] * sy)


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[3], b[3]))


def centre_distance(marker: Column, block: Column) -> Column:
    """From the block's middle to the marker's top."""
    return F.abs((block[1] + block[3]) / 2.0 - marker[1])


def overlap_share(span: Column, other: Column) -> Column:
    """The part of the span's area that the other rectangle covers; 0 for a span without area."""
    w = F.greatest(F.lit(0.0), F.least(span[2], other[2]) - F.greatest(span[0], other[0]))
    h = F.greatest(F.lit(0.0), F.least(span[3], other[3]) - F.greatest(span[1], other[1]))
    area = (span[2] - span[0]) * (span[3] - span[1])
    return F.when(area <= 0, F.lit(0.0)).otherwise(w * h / area)

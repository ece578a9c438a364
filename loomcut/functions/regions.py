"""Boxes, tiles, masks and byte budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corner_crop(width: Column, height: Column, probs: Column, fraction: float, threshold: float) -> Column:
    """[x1, y1, x2, y2] that leaves out the corners (top left, top right, bottom left, bottom right) whose score is above threshold; null where none is."""
    w, h = F.floor(width * fraction), F.floor(height * fraction)
    bad = [F.element_at(probs, i) > threshold for i in (1, 2, 3, 4)]
    x1, y1 = F.when(bad[0] | bad[2], w).otherwise(0), F.when(bad[0] | bad[1], h).otherwise(0)
    x2, y2 = F.when(bad[1] | bad[3], width - w).otherwise(width), F.when(bad[2] | bad[3], height - h).otherwise(height)
    return F.when(bad[0] | bad[1] | bad[2] | bad[3], F.array(*[c.cast("long") for c in (x1, y1, x2, y2)]))


def axis_tiles(total: Column, size: int, stride: int) -> Column:
    """array<struct<begin, end>> of tiles along an axis; the last is moved back to end with the axis."""
    from .frames import tile_starts

    return F.transform(tile_starts(total, size, stride), lambda t: F.struct(F.when(t + size > total, total - size).otherwise(t).cast("long").alias("begin"), F.least(t + size, total).cast("long").alias("end")))


def blend(below: Column, above: Column, mask: Column) -> Column:
    return below * (1 - mask) + above * mask


def normalize_pixel(x: Column, least: float = -1.0, most: float = 1.0) -> Column:
    return x * (most - least) / 255 + least


def to_pixel(x: Column, least: float = -1.0, most: float = 1.0) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x - least) * 255 / (most - least)))).cast("int")


def slot_bytes(c: Column, t: Column, h: Column, w: Column, anchors: int = 3, item: int = 2) -> Column:
    """Bytes of a slot that holds a latent, its anchor frames and two numbers."""
    return c * t * h * w * item + c * max(1, anchors) * h * w * item + 8


def most_slots(budget_gb: Column, grids: int, slot: Column) -> Column:
    return F.floor(budget_gb / (grids * slot / 1e9)).cast("long")


def repaint(ranges: Column, samples: Column, rate: int) -> Column:
    """struct<left, right, ranges>: samples to pad on either side so that all ranges fit, and the ranges moved by the left pad."""
    pad = F.greatest(F.lit(0.0), -F.array_min(F.transform(ranges, lambda r: r["start"])))
    right = F.greatest(F.lit(0), F.floor(F.array_max(F.transform(ranges, lambda r: r["end"])) * rate) - samples)
    moved = F.transform(ranges, lambda r: F.struct((r["start"] + pad).alias("start"), (r["end"] + pad).alias("end")))
    return F.struct(F.floor(pad * rate).cast("long").alias("left"), right.cast("long").alias("right"), moved.alias("ranges"))


def zscore(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


def align_up(n: Column, to: int) -> Column:
    return F.floor((n + (to - 1)) / to) * to


def power_of_two(n: Column) -> Column:
    """The least power of two that is n or more."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n.cast("double"), F.lit(1.0))) - 1e-12)).cast("long")

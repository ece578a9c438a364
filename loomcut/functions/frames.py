"""Frame, chunk and geometry arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snap_down(n: Column, factor: int, rest: int) -> Column:
    """The largest m <= n with m % factor == rest, at least 1; n itself up to 1."""
    return F.when(n <= 1, n).otherwise(F.greatest(F.lit(1), n - F.pmod(n - rest, F.lit(factor))))


def available_frames(requested: Column, there: Column, factor: int = 4, rest: int = 1) -> Column:
    """Frames to take: the request where the clip has as many, else what it has, snapped down."""
    return F.when(requested.isNotNull() & (there >= requested), requested).otherwise(snap_down(there, factor, rest))


def round_up(n: Column, factor: int, rest: int = 0) -> Column:
    return F.floor((n + (factor - 1)) / factor) * factor + rest


def check_shape(height: Column, width: Column, frames: Column, h: int, w: int, f: int, rest: int) -> tuple[Column, Column, Column]:
    """Shape raised to multiples of h and w; frames only where frames % f isn't rest, as ceil(frames / f) * f + rest."""
    up = F.when(F.pmod(frames, F.lit(f)) == rest, frames).otherwise(round_up(frames, f, rest))
    return round_up(height, h), round_up(width, w), up.cast("long")


def dynamic_resolution(height: Column, width: Column, most: int, h: int, w: int) -> tuple[Column, Column]:
    """Size scaled down to at most `most` pixels, then down to multiples."""
    scale = F.sqrt(width * height / F.lit(most))
    big = width * height > most
    new_h, new_w = (F.when(big, F.floor(x / scale)).otherwise(x) for x in (height, width))
    return (F.floor(new_h / h) * h).cast("long"), (F.floor(new_w / w) * w).cast("long")


def cover_resize(height: Column, width: Column, h: int, w: int) -> tuple[Column, Column]:
    """Size that covers h x w at the same aspect ratio."""
    scale = F.greatest(F.lit(float(w)) / width, F.lit(float(h)) / height)
    return F.bround(height * scale).cast("long"), F.bround(width * scale).cast("long")


def frame_id(i: Column, rate: float, raw_rate: Column, count: Column | None = None) -> Column:
    """The source's frame for frame i at another rate, within the clip where count is given."""
    at = F.bround(i / F.lit(float(rate)) * raw_rate).cast("long")
    return at if count is None else F.least(at, count - 1)


def spread(total: Column, n: int) -> Column:
    """n evenly spaced indexes of total, cut to whole numbers; all where there are fewer."""
    m = F.least(F.lit(n), total)
    at = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)).cast("int")), lambda i: F.when(m > 1, F.floor(i * (total - 1) / (m - 1))).otherwise(F.lit(0)).cast("long"))
    return F.when(total > 0, at).otherwise(F.array().cast("array<bigint>"))


def per_second(stamps: Column, most: int = 24) -> Column:
    """For each second the index of the nearest time stamp, the first on ties, for at most `most` seconds."""
    last = F.bround(F.array_max(stamps)).cast("int")
    indexed = F.transform(stamps, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    near = lambda s: F.array_min(F.transform(indexed, lambda x: F.struct(F.abs(x["t"] - s).alias("d"), x["i"].alias("i"))))["i"]
    return F.slice(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), near), 1, most)


def n_chunks(frames: Column, size: int, stride: int, most: int | None = None) -> Column:
    """Windows of `size` frames at every `stride`; what is left over is dropped, and so are windows after the first `most`."""
    n = F.when(frames >= size, F.floor((frames - size) / stride) + 1).otherwise(F.lit(0)).cast("long")
    return n if most is None else F.least(n, F.lit(most))


def chunk_starts(frames: Column, size: int, stride: int, most: int | None = None) -> Column:
    n = n_chunks(frames, size, stride, most)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: i * stride)).otherwise(F.array().cast("array<bigint>"))


def overlap_frames(k: Column, sink: int = 0) -> Column:
    return F.when(k == 1, F.lit(1)).otherwise(4 * (k + sink - 1) + 1)


def latent_frames(pixels: Column) -> Column:
    return F.floor((pixels - 1) / 4).cast("long") + 1


def tile_starts(total: Column, size: int, stride: int) -> Column:
    """Starts of sliding windows, without those that an earlier one already takes to the end."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total.cast("long") - 1, F.lit(0)), F.lit(stride).cast("long"))
    return F.filter(starts, lambda t: (t < stride) | (t - stride + size < total))


def ramp_weight(offset: Column, length: Column, first: Column, last: Column, border: int) -> Column:
    """Weight of a place in a window: rising over the border on the left unless it is the first, falling on the right unless it is the last."""
    if not border:
        return F.lit(1.0)
    left = F.when(~first & (offset < border), (offset + 0.5) / border).otherwise(F.lit(1.0))
    return F.when(~last & (offset >= length - border), (length - 1 - offset + 0.5) / border).otherwise(left)


def pad_or_trim(samples: Column, n: Column) -> Column:
    """An array cut or filled with zeros to n entries."""
    return F.concat(F.slice(samples, F.lit(1), n), F.array_repeat(F.lit(0.0), F.greatest(n - F.size(samples), F.lit(0)).cast("int")))


def mono(channels: Column) -> Column:
    """Mean over channels of array<array<double>>."""
    total = F.aggregate(F.slice(channels, 2, 1 << 30), F.element_at(channels, 1), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(channels))


def to_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def nearest_of(x: Column, choices: list[float]) -> Column:
    """The choice nearest to x, the first on ties."""
    return F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(choices)]))["c"]

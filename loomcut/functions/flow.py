"""Motion from frames: vectors of blocks between consecutive frames, found by trying all shifts within a reach, and what clips come to by them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import luma

EPS = 1e-8


def shifts(reach: int) -> list[tuple[int, int]]:
    """All shifts (down, right) within a reach, short ones first, so that these win where shifts fit alike."""
    span = range(-reach, reach + 1)
    return sorted(((y, x) for y in span for x in span), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))


def block_flow(one: np.ndarray, two: np.ndarray, block: int = 8, reach: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(down, right) of each block of the first frame that lies at least reach from the edges: the shift to where the second frame is most like it, by absolute differences.

    What is nearer to the edge may have left the frame. Frames are of gray levels and of one size, or stacks of such; too small ones give no blocks.
    """
    margin = -(-reach // block) * block
    stack, (h, w) = one.shape[:-2], ((n - 2 * margin) // block * block for n in one.shape[-2:])
    if h <= 0 or w <= 0:
        return np.zeros((*stack, 0, 0)), np.zeros((*stack, 0, 0))
    inner, tries = one[..., margin : margin + h, margin : margin + w], shifts(reach)
    cost = np.empty((len(tries), *stack, h // block, w // block), np.float32)
    inner, off = np.ascontiguousarray(inner), np.empty(inner.shape, np.result_type(one, two))
    for i, (y, x) in enumerate(tries):
        np.abs(np.subtract(inner, two[..., margin + y : margin + y + h, margin + x : margin + x + w], out=off), out=off)
        rows = sum((off[..., k::block, :] for k in range(1, block)), off[..., ::block, :])
        cost[i] = sum((rows[..., k::block] for k in range(1, block)), rows[..., ::block])
    best = np.array(tries, np.float64)[cost.argmin(0)]
    return best[..., 0], best[..., 1]


def shrunk(gray: np.ndarray, times: int) -> np.ndarray:
    """Means of squares of times x times pixels."""
    if times == 1:
        return gray
    h, w = (n // times for n in gray.shape[-2:])
    return gray[..., : h * times, : w * times].reshape(*gray.shape[:-2], h, times, w, times).mean((-3, -1))


def motions(one: np.ndarray, two: np.ndarray, block: int, reach: int, shrink: int, fallback: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean length of the vectors, their coherence, mean absolute difference) of each pair of RGB frames in two stacks of one size. Coherence is the length of the mean unit vector of blocks
    that move over 0.5 pixels, fallback where these are at most 100 pixels.
    """
    a, b = luma(one).astype(np.float32), luma(two).astype(np.float32)
    down, right = (v.reshape(len(a), -1) * shrink for v in block_flow(shrunk(a, shrink), shrunk(b, shrink), block, reach))
    difference = np.abs(a - b).mean((1, 2)).astype(float)
    if not down.shape[1]:
        return np.zeros(len(a)), np.full(len(a), fallback), difference
    size = np.hypot(down, right)
    moving = size > 0.5
    n, over = moving.sum(1), np.where(moving, size, 1.0)
    coherence = np.hypot(*(np.where(moving, v / over, 0.0).sum(1) for v in (down, right))) / np.maximum(n, 1)
    return size.mean(1), np.where(n * block * block > 100, coherence, fallback), difference


def pair_motion(one: np.ndarray, two: np.ndarray, block: int, reach: int, shrink: int, fallback: float) -> tuple[float, float, float]:
    """motions() of one pair."""
    return tuple(float(x[0]) for x in motions(one[None], two[None], block, reach, shrink, fallback))


#: Pixels of a stack of frames that is measured at once.
STACK = 1 << 18


def pairs(frames: DataFrame, clip: str, block: int = 8, reach: int = 6, shrink: int = 1, fallback: float = 1.0, picture: Callable[..., list[bytes | None]] = list, given: tuple[str, ...] = ("data",)) -> DataFrame:
    """(clip, idx, magnitude, coherence, difference) of each frame and the next of its clip, of frames (clip, idx, h, w, data in RGB bytes).

    Frames meet by (clip, idx), so a clip is no group, and sorted, so none goes through the driver; a frame without a next one, or one of another size, gives no row. What meets
    are the columns `given`: with picture, which makes or reads pictures from them in the task that compares these, no picture is exchanged.
    """
    there = F.lit(True) if given != ("data",) else F.col("data").isNotNull()
    a = frames.select(F.col(clip), F.col("idx").cast("long").alias("idx"), "h", "w", *given).where(there)
    b = a.select(F.col(clip), (F.col("idx") - 1).alias("idx"), F.col("h").alias("_h"), F.col("w").alias("_w"), *[F.col(c).alias(f"_{n}") for n, c in enumerate(given)])
    kinds = ["magnitude", "coherence", "difference"]

    @F.pandas_udf("struct<magnitude double, coherence double, difference double>")
    def measure(sizes: pd.DataFrame, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(sizes), 3), np.nan)
        h, w = sizes["h"].to_numpy(), sizes["w"].to_numpy()
        for y, x in {*zip(h.tolist(), w.tolist())}:
            same, step = np.flatnonzero((h == y) & (w == x)), max(1, STACK // (y * x))
            for at in range(0, len(same), step):
                rows = same[at : at + step]
                p, q = (picture(*(df[c].iloc[rows] for c in df)) for df in (one, two))
                known = [i for i, two_ in enumerate(zip(p, q)) if None not in two_]
                stacks = (np.frombuffer(b"".join(s[i] for i in known), np.uint8).reshape(-1, y, x, 3) for s in (p, q))
                if known:
                    out[rows[known]] = np.stack(motions(*stacks, block, reach, shrink, fallback), 1)
        return pd.DataFrame(out, columns=kinds)

    # A number of parts that is asked for stays: rows without pictures are small, what is done with them isn't.
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.repartition(parts, clip, "idx").join(b.repartition(parts, clip, "idx").hint("merge"), [clip, "idx"]).where("h = _h AND w = _w")
    m = measure(F.struct("h", "w"), F.struct(*given), F.struct(*[f"_{n}" for n in range(len(given))]))
    return both.select(clip, "idx", m.alias("m")).select(clip, "idx", "m.*").where("magnitude IS NOT NULL AND NOT isnan(magnitude)")


def clip_motion(frames: DataFrame, clip: str, by: str = "magnitude", digits: int | None = 4, **options) -> DataFrame:
    """(clip, motion_score, motion_jitter_score, flow_coherence, error) of each clip: the mean over its pairs of frames, the deviation over the mean, and the mean coherence, to so many digits.

    by: `magnitude` of the vectors, or `difference` of the gray levels. digits: None where limits are to be held against what was measured, as a score just past a limit may be rounded to it.
    A clip of fewer than two frames gets zeros and an error.
    """
    found = pairs(frames, clip, **options)
    mean = F.avg(by)
    scores = {"motion_score": mean, "motion_jitter_score": F.stddev_pop(by) / (mean + EPS), "flow_coherence": F.avg("coherence")}
    out = found.groupBy(F.col(clip).alias("_clip")).agg(*[(x if digits is None else F.round(x, digits)).alias(n) for n, x in scores.items()])
    clips = frames.select(clip).distinct()
    out = clips.join(out, clips[clip].eqNullSafe(out["_clip"]), "left").drop("_clip")
    error = F.when(F.col("motion_score").isNull(), "fewer than two frames")
    return out.withColumn("error", error).na.fill(0.0, ["motion_score", "motion_jitter_score"])

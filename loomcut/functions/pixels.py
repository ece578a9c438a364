"""Pixel measures of frames, as pandas UDFs over (h, w, data) with data RGB bytes row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame(h: int, w: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def borders(rgb: np.ndarray, threshold: float) -> tuple[int, int, int, int]:
    """Rows and columns from each edge, up to half, before the first with a mean gray above threshold."""
    gray = luma(rgb)
    rows, cols = gray.mean(1), gray.mean(0)

    def depth(x: np.ndarray) -> int:
        half = x[: len(x) // 2]
        over = np.flatnonzero(half > threshold)
        return int(over[0]) if len(over) else len(half)

    return depth(rows), depth(rows[::-1]), depth(cols), depth(cols[::-1])


def laplacian_variance(rgb: np.ndarray) -> float:
    g = np.pad(luma(rgb), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("top", "bottom", "left", "right")]))
def black_border(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([borders(frame(*x), 15) for x in zip(h, w, data)], columns=["top", "bottom", "left", "right"])


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("over", "under")]))
def exposure(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Shares of pixels whose mean over channels is above 250 and below 5."""
    means = [frame(*x).mean(2) for x in zip(h, w, data)]
    return pd.DataFrame([((m > 250).mean(), (m < 5).mean()) for m in means], columns=["over", "under"])


@F.pandas_udf(T.DoubleType())
def blur(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([laplacian_variance(frame(*x)) for x in zip(h, w, data)])


def clip_measures(frames, clip: str = "clip_id"):
    """Per clip: borders (median over frames, cut), mean exposure shares, mean blur score, and whether borders pass."""
    b, e = black_border("h", "w", "data"), exposure("h", "w", "data")
    per = frames.select(clip, "h", "w", b.alias("b"), e.alias("e"), blur("h", "w", "data").alias("score"))
    out = per.groupBy(clip).agg(*[F.median(f"b.{s}").cast("int").alias(f"border_{s}") for s in ("top", "bottom", "left", "right")], F.avg("e.over").alias("overexposed_fraction"), F.avg("e.under").alias("underexposed_fraction"), F.avg("score").alias("blur_score"), F.min(F.least("h", "w")).alias("_side"))
    limit = F.greatest(F.lit(1), F.floor(F.col("_side") * 0.02))
    return out.withColumn("border_pass", F.greatest("border_top", "border_bottom", "border_left", "border_right") < limit).drop("_side")


def flow_statistics(dx: np.ndarray, dy: np.ndarray, fallback: float) -> tuple[float, float]:
    """(mean magnitude, coherence) of a flow field: length of the mean unit vector of pixels that move over 0.5, fallback where at most 100 do."""
    m = np.hypot(dx, dy)
    moving = m > 0.5
    if moving.sum() <= 100:
        return float(m.mean()), fallback
    return float(m.mean()), float(np.hypot((dx[moving] / m[moving]).mean(), (dy[moving] / m[moving]).mean()))

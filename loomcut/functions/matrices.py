"""Matrices held row by row in arrays: wavelets, low rank, orthogonal updates and adapters, as pandas UDFs on numpy. A null or ill-shaped matrix gives null."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the iteration that makes a matrix orthogonal.
STEP = (3.4445, -4.7750, 2.0315)


def _each(work: Callable[..., tuple[np.ndarray, ...]], outs: tuple[str, ...]) -> Callable[..., Column]:
    """A UDF of (rows, arrays...) with struct<outs: array<double>>, or an array where there is one out; the arrays are given as matrices of `rows` rows."""
    def found(rows, arrays):
        for n, *values in zip(rows, *arrays):
            fits = not pd.isna(n) and all(v is not None for v in values) and len(values[0]) and len(values[0]) % int(n) == 0
            yield [x.ravel() for x in work(int(n), *[np.asarray(v, float) for v in values])] if fits else [None] * len(outs)

    def single(rows: pd.Series, *arrays: pd.Series) -> pd.Series:
        return pd.Series([x for x, in found(rows, arrays)], dtype=object)

    def several(rows: pd.Series, *arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(found(rows, arrays)), columns=list(outs))

    return F.pandas_udf(single, "array<double>") if len(outs) == 1 else F.pandas_udf(several, "struct<" + ",".join(f"{o}:array<double>" for o in outs) + ">")


def _orthogonal(x: np.ndarray, steps: int, eps: float) -> np.ndarray:
    """An odd polynomial of a matrix is that of its singular values, so these alone go through the steps."""
    left, values, right = np.linalg.svd(x, full_matrices=False)
    values = values / (np.linalg.norm(values) + eps)
    for _ in range(steps):
        values = np.polyval([STEP[2], 0, STEP[1], 0, STEP[0], 0], values)
    return left * values @ right


def orthogonal(rows: Column, values: Column, steps: int = 5, eps: float = 1e-7) -> Column:
    """The matrix with its singular values drawn near to one."""
    return _each(lambda n, v: (_orthogonal(v.reshape(n, -1), steps, eps),), ("values",))(rows, values)


def low_rank(rows: Column, values: Column, rank: int) -> Column:
    """struct<up, down>: factors (rows x rank, rank x columns) whose product is the nearest matrix of that rank."""

    def work(n, v):
        u, s, w = np.linalg.svd(v.reshape(n, -1), full_matrices=False)
        return u[:, :rank] * s[:rank], w[:rank]

    return _each(work, ("up", "down"))(rows, values)


def fuse(rows: Column, weight: Column, up: Column, down: Column, rank: int, scale: float = 1.0) -> Column:
    """The weight plus scale times the product of an adapter's factors."""
    return _each(lambda n, w, u, d: (w.reshape(n, -1) + scale * u.reshape(n, rank) @ d.reshape(rank, -1),), ("values",))(rows, weight, up, down)


def with_alpha(down: Column, alpha: Column, rank: int) -> Column:
    """An adapter's lower factor with its alpha put in: times alpha over rank; a null alpha changes nothing."""
    return F.when(alpha.isNull(), down).otherwise(F.transform(down, lambda x: x * alpha / rank))


def _half(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.moveaxis(x, axis, 0)
    x = np.concatenate([x, x[-1:]]) if len(x) % 2 else x  # an odd side is mirrored by one
    return np.moveaxis((x[::2] + x[1::2]) / np.sqrt(2), 0, axis), np.moveaxis((x[::2] - x[1::2]) / np.sqrt(2), 0, axis)


def _whole(low: np.ndarray, high: np.ndarray, axis: int, size: int) -> np.ndarray:
    low, high = np.moveaxis(low, axis, 0), np.moveaxis(high, axis, 0)
    out = np.stack([(low + high) / np.sqrt(2), (low - high) / np.sqrt(2)], 1).reshape(-1, *low.shape[1:])[:size]
    return np.moveaxis(out, 0, axis)


def wavelet(rows: Column, values: Column) -> Column:
    """struct<low, across, down, both>: one level of the two-dimensional Haar transform."""

    def work(n, v):
        low, high = _half(v.reshape(n, -1), 1)
        return *_half(low, 0)[:1], _half(high, 0)[0], _half(low, 0)[1], _half(high, 0)[1]

    return _each(work, ("low", "across", "down", "both"))(rows, values)


def from_wavelet(parts: Column, rows: int, columns: int) -> Column:
    """The matrix that wavelet() was given."""

    def work(n, low, across, down, both):
        low, across, down, both = (x.reshape(n, -1) for x in (low, across, down, both))
        return (_whole(_whole(low, down, 0, rows), _whole(across, both, 0, rows), 1, columns),)

    return _each(work, ("values",))(F.lit((rows + 1) // 2), parts["low"], parts["across"], parts["down"], parts["both"])

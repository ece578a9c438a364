"""Nearest lookups in a small grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import _dealt


def nearest(x: Column, grid: list[float], low: float | None = None, high: float | None = None) -> Column:
    """struct<idx, value> of the grid's nearest value, the first on ties, x held within low and high. No join: the grid is a literal."""
    at = x if low is None else F.greatest(F.lit(low), x)
    at = at if high is None else F.least(F.lit(high), at)
    grid_ = F.array(*[F.lit(float(g)) for g in grid])
    near = F.array_min(F.transform(grid_, lambda g, i: F.struct(F.abs(g - at).alias("d"), i.alias("idx"), g.alias("value"))))
    return F.struct(near["idx"].alias("idx"), near["value"].alias("value"))


#: Grids of up to so many rows are sent to every task.
SMALL = 100_000


def nearest_in(df: DataFrame, x: str, grid: DataFrame, value: str, idx: str, small: int = SMALL) -> DataFrame:
    """df with nearest_idx, as nearest() has it, the grid being a table: up to `small` rows are compared by binary search, more by _nearest_ranges(). Null where x is, or without a grid."""
    points = [(float(r[0]), r[1]) for r in grid.where(F.col(value).isNotNull()).select(value, idx).orderBy(value, idx).limit(small + 1).collect()]
    if len(points) > small:
        return _nearest_ranges(df, x, grid, value, idx)
    best: list[tuple[float, int]] = []
    for v, i in points:
        if not best or best[-1][0] != v:
            best.append((v, i))
    if not best:
        return df.withColumn("nearest_idx", F.lit(None).cast("long"))
    values, ids = np.array([v for v, _ in best]), np.array([i for _, i in best])

    @F.pandas_udf("long")
    def find(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float)
        hi = np.clip(np.searchsorted(values, v), 0, len(values) - 1)
        lo = np.maximum(hi - 1, 0)
        dl, dh = np.abs(v - values[lo]), np.abs(v - values[hi])
        take = (dl < dh) | ((dl == dh) & (ids[lo] < ids[hi]))
        return pd.Series(np.where(take, ids[lo], ids[hi])).where(s.notna().reset_index(drop=True)).astype("Int64")

    return df.withColumn("nearest_idx", find(F.col(x).cast("double")))


def _nearest_ranges(df: DataFrame, x: str, grid: DataFrame, value: str, idx: str) -> DataFrame:
    """Rows and grid are dealt by ranges of the value; each row takes the nearer of the grid's entries before and after it, those of other ranges being handed on."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = grid.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(F.min(idx).cast("long").alias("i"))
    points = points.select("_x", F.struct(F.col("_x").alias("v"), "i").alias("_p"))
    both = df.withColumn("_x", F.col(x).cast("double")).unionByName(points, allowMissingColumns=True)
    both = _dealt(both, parts, [F.col("_x")])
    edges = both.groupBy("_part").agg(F.max("_p").alias("_max"), F.min("_p").alias("_min"))
    order = Window.orderBy("_part")  # over the parts
    edges = edges.select("_part", F.last("_max", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_min", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy("_part").orderBy("_x")
    both = both.withColumn("_low", F.last("_p", True).over(inside.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_high", F.first("_p", True).over(inside.rangeBetween(0, Window.unboundedFollowing)))
    out = both.where(F.col("_p").isNull()).join(edges, "_part")
    low, high = F.coalesce("_low", "_before"), F.coalesce("_high", "_after")
    dl, dh = F.abs(F.col("_x") - low["v"]), F.abs(F.col("_x") - high["v"])
    take_low = high.isNull() | (dl < dh) | ((dl == dh) & (low["i"] < high["i"]))
    near = F.when(F.col("_x").isNotNull(), F.when(low.isNotNull() & take_low, low["i"]).otherwise(high["i"]))
    return out.withColumn("nearest_idx", near).select(*df.columns, "nearest_idx")


def overwrite_nearest(schedule: Column, targets: list[float]) -> Column:
    """An array in which each target in turn replaces the entry nearest to it."""
    for t in targets:
        schedule = _overwrite(schedule, float(t))
    return schedule


def _overwrite(schedule: Column, t: float) -> Column:
    near = F.array_min(F.transform(schedule, lambda s, i: F.struct(F.abs(s - t).alias("d"), i.alias("i"))))["i"]
    return F.transform(schedule, lambda s, i: F.when(i == near, F.lit(t)).otherwise(s))

"""Vector expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(a: Column, eps: float = 0.0) -> Column:
    n = norm(a) + eps
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def softmax(scores: Column) -> Column:
    """Softmax over an array."""
    top = F.array_max(scores)
    parts = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(parts, lambda x: x / total)


def mse(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def affine(a: Column, weights: list[float], bias: float) -> Column:
    """A linear head over an embedding; dense layers without activations fold into one."""
    return dot(a, F.array(*[F.lit(float(w)) for w in weights])) + bias


def lpips_layer(a: Column, b: Column, weights: Column) -> Column:
    """Weighted squared distance of two channel vectors normalised to length one."""
    na, nb = normalize(a, 1e-10), normalize(b, 1e-10)
    return F.aggregate(F.zip_with(F.zip_with(na, nb, lambda x, y: F.pow(x - y, F.lit(2.0))), weights, lambda d, w: d * w), F.lit(0.0), lambda s, x: s + x)


def lpips(layers: list[tuple[Column, Column, Column]]) -> Column:
    """Distance of two images from their layers: (positions of one, of the other, weights), positions being arrays of channel vectors; each layer's mean over positions, added up."""
    out = F.lit(0.0)
    for a, b, weights in layers:
        per = F.zip_with(a, b, lambda x, y: lpips_layer(x, y, weights))
        out = out + F.aggregate(per, F.lit(0.0), lambda s, d: s + d) / F.size(a)
    return out


def coherence(dx: Column, dy: Column, least: float = 0.5, pixels: int = 100, fallback: float = 1.0) -> Column:
    """Of a flow field as two arrays: the length of the mean unit vector of the pixels that move over `least`, fallback where at most `pixels` do."""
    moving = F.filter(F.zip_with(dx, dy, lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.sqrt(x * x + y * y).alias("m"))), lambda p: p["m"] > least)
    mean = lambda part: F.aggregate(moving, F.lit(0.0), lambda s, p: s + p[part] / p["m"]) / F.size(moving)
    x, y = mean("x"), mean("y")
    return F.when(F.size(moving) > pixels, F.sqrt(x * x + y * y)).otherwise(F.lit(float(fallback)))


def softmax_rows(df: DataFrame, group: str, value: str, out: str = "p") -> DataFrame:
    """df with out: exp(value) over its sum within the group. The largest value and the sum come from partial aggregates that are joined back, so a group that holds most rows is not gathered.

    A null value gives null and counts for nothing; a null group is a group.
    """
    def joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
        return rows.join(sums.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")

    rows = joined(df, df.groupBy(group).agg(F.max(value).alias("_most"))).withColumn("_e", F.exp(F.col(value) - F.col("_most")))
    return joined(rows, rows.groupBy(group).agg(F.sum("_e").alias("_all"))).withColumn(out, F.col("_e") / F.col("_all")).drop("_most", "_e", "_all")

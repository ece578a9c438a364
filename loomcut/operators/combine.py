"""Joins, fills and unions of metadata tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .rank import share_before


def lookup(left: DataFrame, right: DataFrame, on: str, key: str, value: str, order: str, out: str) -> DataFrame:
    """left with out: the value of the last row of right (by order) whose key equals on; NaN counts as missing."""
    v = F.col(value).cast("double")
    known = right.groupBy(F.col(key).cast("string").alias("_key")).agg(F.max_by(F.when(~F.isnan(v), v), F.col(order)).alias(out))
    return left.join(known, F.col(on).cast("string") == F.col("_key"), "left").drop("_key")


#: Up to so many distinct values are put in order by one task.
FEW = 100_000


def _ordered_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, before): the distinct known values, how often each is there and how many rows come before it in order; ordered by ranges where there are more than FEW."""
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), "counts")
    if counts.count() > FEW:
        return share_before(counts, [value], "n")
    return counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row (median): the entry at n // 2 of the sorted known values, without averaging.

    Only the counts of distinct values are ordered, not the rows.
    """
    counts = _ordered_counts(df, value)
    half = counts.agg(F.floor(F.sum("n") / 2).alias("half"))
    at = counts.crossJoin(F.broadcast(half)).where((F.col("before") <= F.col("half")) & (F.col("half") < F.col("before") + F.col("n")))
    return at.agg(F.min(value).alias("median"))


def percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row (p array<double>): exact percentiles of the known values with linear interpolation; nulls where there are none."""
    counts = _ordered_counts(df, value)
    places = counts.agg(F.array(*[F.lit(float(s)) * (F.sum("n") - 1) for s in shares]).alias("at"))  # one row
    with_places = counts.crossJoin(F.broadcast(places))

    def entry(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value).cast("double")))

    ends = [(entry(F.floor(F.col("at")[i])), entry(F.ceil(F.col("at")[i])), F.first(F.col("at")[i] - F.floor(F.col("at")[i]))) for i in range(len(shares))]
    return with_places.agg(F.array(*[low + (high - low) * part for low, high, part in ends]).alias("p"))


def fill_upper_median(df: DataFrame, value: str) -> DataFrame:
    """df with missing values replaced by the upper median of the known ones."""
    return df.crossJoin(F.broadcast(upper_median(df, value))).withColumn(value, F.coalesce(value, "median")).drop("median")


def union_limit(sources: list[DataFrame], limit: int, order: list[str], strict: bool = False) -> DataFrame:
    """Rows of the sources one after another, up to limit.

    The limit ends only the source in which it is reached: every later source that isn't empty still gives its first row, unless strict.
    Only the first rows of each source, in its order, take part.
    """
    first = []
    for i, df in enumerate(sources):
        head = df.orderBy(*order).limit(limit).withColumn("_source", F.lit(i))
        first.append(head.withColumn("_rn", F.row_number().over(Window.partitionBy("_source").orderBy(*order))))
    every = reduce(DataFrame.unionByName, first)
    sizes = every.groupBy("_source").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = every.join(F.broadcast(sizes.drop("_n")), "_source")
    keep = F.col("_before") + F.col("_rn") <= limit
    if not strict:
        keep = keep | ((F.col("_rn") == 1) & (F.col("_before") >= limit))
    return out.where(keep).drop("_rn", "_before")


def union_limit_by(df: DataFrame, source: list[str], order: list[str], limit: int) -> DataFrame:
    """As union_limit(), for sources that are the groups of a table, one after another in their own order: rows with source_no from 0. Null is a source."""
    first = Window.partitionBy(*source).orderBy(*order)
    heads = df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= limit)
    names = [F.col(c).alias(f"_s{i}") for i, c in enumerate(source)]
    sizes = df.groupBy(*source).agg(F.least(F.count("*"), F.lit(limit)).alias("_size"))
    sizes = share_before(sizes, source, "_size").select(*names, F.col("row").cast("int").alias("source_no"), F.col("before").alias("_before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(source)])
    keep = (F.col("_before") + F.col("_rn") <= limit) | ((F.col("_rn") == 1) & (F.col("_before") >= limit))
    return heads.join(sizes, same).where(keep).drop("_rn", "_before", *[f"_s{i}" for i in range(len(source))])


def later_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which the last one that has a key gives its row."""
    every = reduce(DataFrame.unionByName, [df.withColumn("_i", F.lit(i)) for i, df in enumerate(frames)])
    rest = [c for c in every.columns if c not in (key, "_i")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "_i").alias("r")).select(key, "r.*")


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which the first one that has a key gives its row; conflicts says whether others differ."""
    every = reduce(DataFrame.unionByName, [df.withColumn("_i", F.lit(i)) for i, df in enumerate(frames)])
    rest = [c for c in every.columns if c not in (key, "_i")]
    s = F.struct(*rest)
    return every.groupBy(key).agg(F.min_by(s, "_i").alias("r"), (F.min(s) != F.max(s)).alias("conflicts")).select(key, "r.*", "conflicts")


def merge_options(defaults: Column, given: Column) -> Column:
    """Two maps as one, given entries first."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(given), k)), given)


def pair_by_stem(left: DataFrame, right: DataFrame, stem: str, path: str) -> DataFrame:
    """Pairs (stem, left_path, right_path) of the first paths of each side, inner."""
    a = left.groupBy(stem).agg(F.min(path).alias("left_path"))
    return a.join(right.groupBy(stem).agg(F.min(path).alias("right_path")), stem)


def broadcast_pairs(prompts: Column, images: Column) -> Column:
    """Two arrays zipped, one of length one repeated; other lengths raise."""
    n = F.greatest(F.size(prompts), F.size(images))
    fit = lambda a: F.when(F.size(a) == n, a).when(F.size(a) == 1, F.array_repeat(F.element_at(a, 1), n)).otherwise(F.raise_error(F.lit("lengths differ")))
    return F.zip_with(fit(prompts), fit(images), lambda p, i: F.struct(p.alias("prompt"), i.alias("image")))

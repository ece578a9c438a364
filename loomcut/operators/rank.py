"""Ranking within groups: relative scores, top N, and near-even files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def relative_scores(df: DataFrame, group: str, scores: list[str], out: str = "avg_rel") -> DataFrame:
    """df with rel_<score>: (x - min) / (max - min) within the group, 0.5 where all are equal, and their mean, nulls skipped.

    Rows with a null or NaN score should be dropped before. The extremes come from a partial aggregate, not from a window, and are
    sent to the rows, so a group that holds most rows is not gathered.
    """
    ends = df.groupBy(group).agg(*[f(c).alias(f"_{n}_{c}") for c in scores for n, f in (("lo", F.min), ("hi", F.max))]).withColumnRenamed(group, "_group")
    df = df.join(_sent(ends, "ends"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    for c in scores:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        df = df.withColumn(f"rel_{c}", F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))).drop(f"_lo_{c}", f"_hi_{c}")
    rel = [F.col(f"rel_{c}") for c in scores]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in rel[1:]), F.coalesce(rel[0], F.lit(0.0)))
    known = sum((c.isNotNull().cast("int") for c in rel[1:]), rel[0].isNotNull().cast("int"))
    return df.withColumn(out, F.try_divide(total, known))


def _sent(sizes: DataFrame, name: str) -> DataFrame:
    """A row for each group, written; broadcast up to 100,000 groups, as a join by group would gather each group's rows in one task."""
    kept = stored(sizes, name)
    return F.broadcast(kept) if kept.count() < 100_000 else kept


def top_n(df: DataFrame, group: str, by: Column, ties: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group by `by` descending, then by ties.

    Rows are dealt by a hash into 2n sets for each group; n of these have a greatest value that is no less than the n-th of them, so no row below that is among the first n. Only what is
    left by then, some 1.4n rows without equals, is put in order, so no task sorts its part of the input.
    """
    rows = df.withColumn("_by", by)
    most = rows.groupBy(group, (F.pmod(F.xxhash64(*ties), F.lit(2 * n))).alias("_set")).agg(F.max("_by").alias("_most"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_most").desc()))
    least = most.withColumn("_place", place).groupBy(F.col(group).alias("_group")).agg(F.max(F.when(F.col("_place") == n, F.col("_most"))).alias("_least"))
    rows = rows.join(_sent(least, "least"), F.col(group).eqNullSafe(F.col("_group"))).where(F.col("_least").isNull() | (F.col("_by") >= F.col("_least")))
    order = Window.partitionBy(group).orderBy(F.col("_by").desc(), *ties)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n).drop("_by", "_least", "_group")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(df: DataFrame, parts: int, keys: list[Column]) -> DataFrame:
    """df dealt by ranges of the keys, with _part, the number of a row's range. Ranges come from a sample, which two readers of the plan would draw differently, so they are written."""
    return stored(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranges")


def place_in_group(df: DataFrame, group: str, order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """df with out: the row's place from 1 within its group. Rows are dealt by ranges of (group, order), and places within a part are moved
    by the rows of the group in earlier parts, so a group that holds most rows is no single task. All columns of df are dealt and written, so select those that are needed.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    dealt = _dealt(df, parts or _parts(df), keys)
    counts = dealt.groupBy("_part", F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), "_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    out_ = dealt.withColumn(out, own).join(counts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out_.withColumn(out, F.col(out) + F.col("_n")).drop("_part", "_p", "_g", "_n")


def keep_share(df: DataFrame, group: str, by: Column, ties: list[str], share: float, rank: str = "rank") -> DataFrame:
    """The first round(n * share) rows of each group of n, halves to even."""
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.bround(F.count("*") * share).alias("_keep"))
    ranked = place_in_group(df, group, [by.desc(), *[F.col(t).asc() for t in ties]], rank)
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).where(F.col(rank) <= F.col("_keep")).drop("_group", "_keep")


def file_name(prefix: str, group: Column, rows: Column) -> Column:
    """prefix_group_Nk.csv with N = rows // 1000 + 1."""
    return F.concat(F.lit(f"{prefix}_"), group.cast("string"), F.lit("_"), (F.floor(rows / 1000) + 1).cast("string"), F.lit("k.csv"))


def share_before(df: DataFrame, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """df with `before`: the sum of value over all rows before, and `row`: the place from 0, both in this order over the whole table.

    Rows are dealt by ranges of the order; each part's sums are added up first, so no task gets all rows. All columns of df are dealt and written, so select those that are needed.
    """
    key = [F.col(c) for c in order]
    dealt = _dealt(df, parts or _parts(df), key)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_part").orderBy(*order)
    own = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("before", own).withColumn("row", F.row_number().over(inside) - 1).join(sums, "_part")
    return out.withColumn("before", F.col("before") + F.col("_v")).withColumn("row", F.col("row") + F.col("_n")).drop("_part", "_v", "_n")

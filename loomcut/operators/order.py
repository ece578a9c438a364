"""Batch order: length-grouped permutations, shards, and their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import share_before


def random_key(key: Column, seed: int) -> Column:
    """A hash to order by that other engines have too."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def length_grouped(df: DataFrame, key: str, length: str, group_size: int, mult: int, seed: int = 0) -> DataFrame:
    """df with megabatch, group_id and pos: a permutation by hash, cut into megabatches of group_size * mult rows, each sorted by length descending and
    cut into groups; whole groups in the order of another hash, a short last group at the end.
    """
    out = share_before(df.withColumn("_h", random_key(F.col(key), seed)).withColumn("_one", F.lit(1)), ["_h", key], "_one")
    out = out.withColumnRenamed("row", "_rn").drop("before", "_h", "_one").withColumn("megabatch", F.floor(F.col("_rn") / (group_size * mult)))
    out = out.withColumn("_in", F.row_number().over(Window.partitionBy("megabatch").orderBy(F.desc(length), "_rn")) - 1)
    out = out.withColumn("group_id", F.col("megabatch") * mult + F.floor(F.col("_in") / group_size)).withColumn("_at", F.col("_in") % group_size)
    groups = out.groupBy("group_id").agg(F.count("*").alias("_size"))
    groups = groups.withColumn("_short", (F.col("_size") < group_size).cast("int")).withColumn("_h", random_key(F.col("group_id"), seed + 1))
    groups = share_before(groups, ["_short", "_h", "group_id"], "_size").select("group_id", F.col("row").alias("_turn"))
    return out.join(groups, "group_id").withColumn("pos", F.col("_turn") * group_size + F.col("_at")).drop("_rn", "_in", "_at", "_turn")


def straggler_cost(df: DataFrame, group: str, work: str, group_size: int) -> DataFrame:
    """One row (cost, ideal, over_ideal): the sum over groups of their largest work, and all work spread evenly."""
    by = df.groupBy(group).agg(F.max(work).alias("m"), F.sum(work).alias("s"))
    out = by.agg(F.sum("m").alias("cost"), (F.sum("s") / group_size).alias("ideal"))
    return out.withColumn("over_ideal", F.coalesce(F.try_divide("cost", "ideal"), F.lit(0.0)))


def contiguous_shard(row: Column, total: Column, shards: int) -> Column:
    """Shard of a row number from 0: contiguous ranges, the first total % shards of them longer by one."""
    size, rest = F.floor(total / shards), total % shards
    return F.when(row < rest * (size + 1), F.floor(row / (size + 1))).otherwise(rest + F.floor(F.try_divide(row - rest * (size + 1), size)))


def round_robin_shard(row: Column, shards: int) -> Column:
    return F.pmod(row, F.lit(shards))

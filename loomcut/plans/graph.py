"""Graphs of processing units: edges from last producers, closures, and the split of a plan at a model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import file_system, new_path, stored

#: Units and ends of links in a block, which one task holds.
BLOCK = 4_000_000


def edges(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(source, target): for each parameter that a unit reads, the last earlier unit that writes it. Tables (unit, param)."""
    both = reads.select("unit", "param", F.lit(0).alias("w")).union(writes.select("unit", "param", F.lit(1).alias("w")))
    earlier = Window.partitionBy("param").orderBy("unit").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("w") == 1, F.col("unit"))).over(earlier)
    return both.withColumn("source", last).where("w = 0 and source is not null").select("source", F.col("unit").alias("target")).distinct()


@dataclass(frozen=True)
class _Blocks:
    """Links and units written by block, a range of units. links has (source, target, other): the block of the target; units has (unit, need): how many links lead to it."""

    spark: SparkSession
    bounds: list[int]
    links: str
    units: str

    def of(self, unit: Column) -> Column:
        bounds = np.array(self.bounds, np.int64)
        return F.pandas_udf(lambda s: pd.Series(np.searchsorted(bounds, s.to_numpy(), "right").astype(np.int32)), "int")(unit)


def _by_block(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    df.repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


def _cut(links: DataFrame, units: DataFrame, size: int) -> _Blocks:
    """Blocks of about so many units and ends of links. Links (source, target) and units (unit) are distinct and hold no nulls; only the blocks' bounds come to the driver."""
    spark = links.sparkSession
    ends = units.select(F.col("unit"), F.lit(0).cast("long").alias("need")).union(links.select("target", F.lit(1).cast("long"))).union(links.select("source", F.lit(0).cast("long")))
    n = -(-ends.count() // size)
    bounds = sorted(set(ends.agg(F.percentile_approx("unit", [i / n for i in range(1, n)], 10_000)).first()[0])) if n > 1 else []
    out = _Blocks(spark, bounds, "", "")
    placed = links.select("source", "target", out.of(F.col("target")).alias("other"), out.of(F.col("source")).alias("block"))
    need = ends.groupBy("unit").agg(F.sum("need").alias("need"))
    return _Blocks(spark, bounds, _by_block(placed, "links"), _by_block(need.withColumn("block", out.of(F.col("unit"))), "units"))


def _read(root: str, block: int, columns: list[str]) -> list[np.ndarray]:
    system, at = file_system(f"{root}/block={block}")
    try:
        found = pq.read_table(at, columns=columns, filesystem=system, partitioning=None)
    except FileNotFoundError:  # a block without links
        return [np.zeros(0, np.int64) for _ in columns]
    return [found.column(c).to_numpy() for c in columns]


def _following(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places first[i] to last[i] - 1 of all i, one after another."""
    n = last - first
    return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


#: What blocks tell one another, and, where sent is 0, the units that a step found. A null unit begins a block.
_SENT = "unit long, n long, level int, sent int, block int"


def _steps(blocks: _Blocks, first: DataFrame, work: Callable[[_Block], None]) -> DataFrame:
    """(unit, level) of what is found from the first messages (unit, n, level, block), until no block tells another of anything.

    A step goes on within each block that was told of something as far as its own links lead, and writes what it found and what that means for other blocks. So there are as many steps as
    the longest way changes blocks, not as it has links. A block's earlier messages are gone through again, so no state is kept but them; its links are read where they lie.
    """
    spark, path, links, units = blocks.spark, new_path(blocks.spark, "sent"), blocks.links, blocks.units

    def run(key: tuple, told: pa.Table) -> pa.Table:
        number = key[0].as_py()
        block = _Block(links, units, number)
        unit, fresh = told.column("unit"), told.column("fresh").to_numpy()
        known, begins = np.array(unit.is_valid()), bool((fresh & np.array(unit.is_null())).any())
        ids, n, level = unit.fill_null(0).to_numpy(), told.column("n").to_numpy(), told.column("level").to_numpy()
        for now in (False, True):
            some = known & (fresh == now)
            if now or not begins:
                block.before = block.done.copy()
                block.tell(ids[some], n[some], level[some])
                work(block)
        return block.found()

    first.select("unit", F.col("n").cast("long").alias("n"), F.col("level").cast("int").alias("level"), F.lit(1).alias("sent"), F.col("block").cast("int").alias("block")).write.partitionBy("sent", "block").parquet(f"{path}/step=0")
    step = 0
    while True:
        told = spark.read.schema(_SENT + ", step int").parquet(path)
        active = [r.block for r in told.where(f"sent = 1 AND step = {step}").select("block").distinct().collect()]
        if not active:
            return told.where("sent = 0").select("unit", "level")
        told = told.where("sent = 1").where(F.col("block").isin(active)).select("unit", "n", "level", "block", (F.col("step") == step).alias("fresh"))
        step += 1
        told.repartition(4 * len(active), "block").groupBy("block").applyInArrow(run, _SENT).write.partitionBy("sent", "block").parquet(f"{path}/step={step}")


class _Block:
    """A block's units in order, its links by source, and how far it is: done, how many of its sources are (n), and one more than the highest level among these."""

    def __init__(self, links: str, units: str, number: int):
        self.number = number
        self.units, self.need = _read(units, number, ["unit", "need"])
        order = np.argsort(self.units)
        self.units, self.need = self.units[order], self.need[order]
        source, target, other = _read(links, number, ["source", "target", "other"])
        own = other == number
        self.out = source[~own], target[~own], other[~own]
        order = np.argsort(source[own], kind="stable")
        self.targets = np.searchsorted(self.units, target[own][order])
        self.begin = np.searchsorted(source[own][order], self.units)
        self.end = np.searchsorted(source[own][order], self.units, "right")
        self.done, self.n, self.level = np.zeros(len(self.units), bool), np.zeros(len(self.units), np.int64), np.zeros(len(self.units), np.int32)
        self.before, self.told = self.done, np.zeros(0, np.int64)

    def tell(self, ids: np.ndarray, n: np.ndarray, level: np.ndarray) -> None:
        self.told = np.searchsorted(self.units, ids)
        np.add.at(self.n, self.told, n)
        np.maximum.at(self.level, self.told, level)

    def reach(self) -> None:
        step = np.unique(self.told[~self.done[self.told]])
        while len(step):
            self.done[step] = True
            to = self.targets[_following(self.begin[step], self.end[step])]
            step = np.unique(to[~self.done[to]])

    def count(self) -> None:
        step = np.unique(self.told) if self.before.any() else np.arange(len(self.units))
        step = step[(self.n[step] == self.need[step]) & ~self.done[step]]
        while len(step):
            self.done[step] = True
            to = self.targets[_following(self.begin[step], self.end[step])]
            np.add.at(self.n, to, 1)
            np.maximum.at(self.level, to, np.repeat(self.level[step] + 1, self.end[step] - self.begin[step]))
            step = np.unique(to[self.n[to] == self.need[to]])

    def found(self) -> pa.Table:
        """Rows of _SENT: units that are done since the last messages, and the targets of their links in other blocks."""
        new = np.flatnonzero(self.done & ~self.before)
        at = np.searchsorted(self.units, self.out[0])
        go = (self.done & ~self.before)[at] if len(at) else np.zeros(0, bool)
        to, first, same, n = np.unique(self.out[1][go], return_index=True, return_inverse=True, return_counts=True)
        level = np.zeros(len(to), np.int32)
        np.maximum.at(level, same, self.level[at[go]] + 1)
        unit = np.concatenate([self.units[new], to])
        columns = unit, np.concatenate([np.zeros(len(new), np.int64), n]), np.concatenate([self.level[new], level]), np.repeat([0, 1], [len(new), len(to)]), np.concatenate([np.full(len(new), self.number), self.out[2][go][first]])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["unit", "n", "level", "sent", "block"])


def _links(links: DataFrame) -> DataFrame:
    return links.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct()


def _start(df: DataFrame) -> DataFrame:
    return df.select(F.col("unit").cast("long").alias("unit")).where("unit IS NOT NULL").distinct()


def _reached(blocks: _Blocks, start: DataFrame) -> DataFrame:
    first = start.select("unit", F.lit(1).alias("n"), F.lit(0).alias("level"), blocks.of(F.col("unit")).alias("block"))
    return _steps(blocks, first, _Block.reach).select("unit")


def reachable(links: DataFrame, start: DataFrame, size: int = BLOCK) -> DataFrame:
    """Units (unit) that follow from start along links (source, target), start included; links may form circles.

    Blocks of units go as far as their own links lead and tell other blocks of what lies there, see _steps(): nothing but the numbers of the blocks that are told comes to the driver.
    """
    links, start = stored(_links(links), "links"), stored(_start(start), "start")
    return _reached(_cut(links, start, size), start)


def levels(units: DataFrame, links: DataFrame, size: int = BLOCK) -> DataFrame:
    """(unit, level): 0 for units that no link leads to, else one more than the highest level among the sources of links to it; null on and behind circles. By (level, unit), sources come before targets.

    Within a block, units whose sources all have levels get theirs one after another; counts and levels for the targets in other blocks are what it tells these, see _steps().
    Units of links that aren't in units count too.
    """
    links = stored(_links(links), "links")
    units = stored(_start(units.select("unit").union(links.select("source")).union(links.select("target"))), "units")
    blocks = _cut(links, units, size)
    first = units.sparkSession.range(len(blocks.bounds) + 1).select(F.lit(None).cast("long").alias("unit"), F.lit(0).alias("n"), F.lit(0).alias("level"), F.col("id").alias("block"))
    return units.join(_steps(blocks, first, _Block.count).hint("merge"), "unit", "left")


def split(reads: DataFrame, writes: DataFrame, direct: DataFrame, size: int = BLOCK) -> DataFrame:
    """(unit, related) of all units: related ones use the model directly, follow from one that does, or later update a parameter that the first related reader of it also writes.

    Tables (unit, param) and (unit); params of several plans are told apart by the caller. The steps go on until no unit is added; a step's units are written. Tables that grow meet
    sorted, as broadcast ones would go through the driver.
    """
    links = stored(_links(edges(reads, writes)), "links")
    reads, writes = stored(reads.select(F.col("unit").cast("long").alias("unit"), "param").distinct(), "reads"), stored(writes.select(F.col("unit").cast("long").alias("unit"), "param").distinct(), "writes")
    related = stored(_start(direct), "direct")
    every = stored(_start(reads.select("unit").union(writes.select("unit")).union(related)), "units")
    blocks, new = _cut(links, every, size), related
    related = None
    while True:
        more = _reached(blocks, new)
        if related is not None:
            more = more.join(related.hint("merge"), "unit", "left_anti")
        related = stored(more if related is None else related.union(more), "related")
        first = reads.join(related.hint("merge"), "unit").groupBy("param").agg(F.min("unit").alias("first"))
        updates = writes.join(first.hint("merge"), "param").join(writes.select(F.col("unit").alias("first"), "param").hint("merge"), ["param", "first"]).where("unit > first")
        new = stored(updates.select("unit").distinct().join(related.hint("merge"), "unit", "left_anti"), "updates")
        if new.isEmpty():
            break
    return every.join(related.withColumn("related", F.lit(True)).hint("merge"), "unit", "left").withColumn("related", F.coalesce("related", F.lit(False)))

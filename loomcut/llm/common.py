"""Shared parts of the operators: durable intermediate tables and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, new_path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, put back as it was in the end."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def trim() -> None:
    """Gives memory back that a Python worker, which the next task will use too, holds without need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other C libraries have no such function
        return


def trimmed(work: Callable) -> Callable:
    """A function of batches that trims the worker's memory in the end."""

    def run(batches):
        yield from work(batches)
        trim()

    return run


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage is cut and lost executors cost nothing. options: of the writer."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # shuffle files of the write go with it
        df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Removes what stored() wrote for these frames; call it only when nothing reads them any more."""
    for df in frames:
        discard(df.inputFiles())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def apart(df: DataFrame, added: Iterable[str], operator: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[Column]]:
    """(operator's result for df, df's own columns in it): those that are named like a column that the operator adds pass through under other names."""
    clash = [c for c in df.columns if c.lower() in added]
    names = dict(zip(clash, fresh(df, *[f"own_{c}" for c in clash])))
    out = operator(df.withColumnsRenamed(names) if names else df)
    return out, [F.col(f"`{names.get(c, c)}`").alias(c) for c in df.columns]


#: A node of a graph is a hub from this number of edges on, and this share of all: there are few, so they are broadcast.
HUB, HUB_SHARE = 200, 1 / 1000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long): one row (node, root) per node with an edge, root its smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the stars stand still. A step is one
    aggregate and one join on the node; hubs, of which there are 2000 at most, are joined where their edges lie. Each step is
    written to the shared folder. Null ends and loops are ignored. No edges: no rows.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        per = now.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
        count, mark, most = per.agg(F.sum("n"), F.sum("mark"), F.max("n")).first()
        if not count or seen == (count, mark):
            break
        seen = (count, mark)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        up, limit = both.where("v > u"), max(HUB, int(count * HUB_SHARE))
        if most >= limit:
            hubs = F.broadcast(least.where(F.col("n") >= limit).select("u", "m"))
            large = up.join(hubs, "u").select("u", "v", "m").union(up.join(hubs, "u", "left_anti").join(least, "u").select("u", "v", "m"))
        else:
            large = up.join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "edges")
        drop_stored(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

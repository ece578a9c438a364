"""Bounded buffers of a stream in several state variables by key, and draws from them that leave out a key's own entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .state import slot_of

SLOTS = "key string, slot int, o long, v double, shape string, seen long"


class _Buffer(StatefulProcessor):
    """seen: how many entries have come; slots: a map of the entries that are kept, of which only those that change are written."""

    def __init__(self, k: int, seed: int):
        self.k, self.seed = k, seed

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.slots = handle.getMapState("slots", "slot int", "o long, v double, shape string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, changed = (self.seen.get()[0] if self.seen.exists() else 0), {}
        for r in pd.concat([*rows]).sort_values("o").itertuples(index=False):
            changed[seen if seen < self.k else slot_of(seen, self.k, self.seed)] = (int(r.o), None if pd.isna(r.v) else float(r.v), r.shape)
            seen += 1
        for slot, entry in changed.items():
            self.slots.updateValue((slot,), entry)
        self.seen.update((seen,))
        yield pd.DataFrame([(key[0], slot, *entry, seen) for slot, entry in changed.items()], columns=["key", "slot", "o", "v", "shape", "seen"])

    def close(self) -> None:
        return


def buffered(stream: DataFrame, key: str, order: str, value: str, shape: str, k: int, seed: int = 0) -> DataFrame:
    """For each micro-batch the slots (key, slot, o, v, shape, seen) that it changed, of a buffer of k entries for each key: the first k entries fill it, each later one takes the slot
    that a hash of its number names, so recent ones are likelier to be there. Within a micro-batch entries come in the order of `order`; a null key is a key.

    The state is a counter and a map for each key, so a key's buffer is neither read nor written whole. Needs the RocksDB state store.
    """
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v"), F.col(shape).cast("string").alias("shape"))
    return rows.groupBy("key").transformWithStateInPandas(_Buffer(k, seed), SLOTS, "update", "none")


def run(stream: DataFrame, path: str) -> None:
    """Takes in what has come so far, appends the changed slots by batch below path, and ends; goes on from there next time. A batch that is run again replaces its own rows."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        write.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slots(spark: SparkSession, path: str) -> DataFrame:
    """What the buffers hold now: the last entry of each slot that run() has written."""
    rows = spark.read.schema(f"{SLOTS}, batch int").parquet(f"{path}/rows")
    return rows.groupBy("key", "slot").agg(F.max_by(F.struct("o", "v", "shape"), "batch").alias("e")).select("key", "slot", "e.*")


def draws(requests: DataFrame, held: DataFrame, key: str, ident: str, shape: str, seed: int = 0) -> DataFrame:
    """requests with drawn (o, v of an entry of another key's buffer): entries are numbered by (key, slot); a hash of the request names one of those that aren't its own key's.

    Null where no other key has entries, and where the entry's shape is another than the request's: a miss. Buffers are bounded, so there are few entries for each key; they are
    joined by their number, and a request's own range is joined by its key.
    """
    entries = held.select(F.col("key").alias("_key"), "slot", F.struct("o", "v").alias("_e"), F.col("shape").alias("_shape"))
    sizes = entries.groupBy("_key").agg(F.count("*").alias("_own"))
    before = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_key", "_own", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_first"))  # a row for each key
    at = (F.row_number().over(Window.partitionBy("_key").orderBy("slot")) - 1 + F.col("_first")).alias("_at")
    entries = entries.join(sizes, "_key").select(at, "_e", "_shape")
    total = F.broadcast(sizes.agg(F.coalesce(F.sum("_own"), F.lit(0)).alias("_total")))
    asked = requests.join(sizes.withColumnRenamed("_key", key), key, "left").na.fill(0, ["_own", "_first"]).join(total)
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(ident))), 1, 8), 16, 10).cast("long") % F.nullif(F.col("_total") - F.col("_own"), F.lit(0))
    asked = asked.withColumn("_at", number + F.when(number >= F.col("_first"), F.col("_own")).otherwise(0))
    out = asked.join(entries, "_at", "left")
    return out.withColumn("drawn", F.when(F.col("_shape") == F.col(shape), F.col("_e"))).select(*[F.col(f"`{c}`") for c in requests.columns], "drawn")

"""Clips of a stream: rows of a key that follow one another within a gap, ended by event-time timers; what comes after the watermark is counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

CLIPS = "key string, begin long, last long, n long, total double, head double, tail array<double>"


#: Keys share so many states by their hash: calls of the state store, several to a state and go, cost more than rows do. A task holds the open clips of one state at a time.
STATES = 1024
_OPEN = "key string, begin long, last long, n long, total double, head double, tail array<double>"


class _Clips(StatefulProcessor):
    """open: the clips of the keys of a state that may still go on, each with what the next chunk is to be given: its first value and its last few."""

    def __init__(self, gap: int, tail: int):
        self.gap, self.tail = gap, tail

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def _held(self) -> list[tuple]:
        return [(*c[:6], list(c[6])) for c in self.open.get()] if self.open.exists() else []

    def _await(self, clips: list[tuple], timers: bool) -> None:
        """One timer for a state, at the first end of its clips."""
        first = min(c[2] for c in clips) + self.gap
        there = list(self.handle.listTimers()) if timers else []
        for t in there:
            if t != first:
                self.handle.deleteTimer(t)
        if first not in there:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = self._held()
        known = bool(pieces)
        for pdf in rows:
            pieces += [(k, t, t, 1, v, v, [v]) for k, t, v in zip(pdf["key"].tolist(), pdf["ms"].tolist(), pdf["v"].tolist())]
        clips: list[tuple] = []
        for p in sorted(pieces):
            if clips and p[0] == clips[-1][0] and p[1] - clips[-1][2] <= self.gap:
                name, begin, last, n, total, head, tail = clips[-1]
                clips[-1] = (name, begin, max(last, p[2]), n + p[3], total + p[4], head, (tail + p[6])[-self.tail :])
            else:
                clips.append(p)
        self.open.put(clips)
        self._await(clips, known)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        clips = self._held()
        ended = [c for c in clips if c[2] + self.gap <= now]
        if ended:
            left = [c for c in clips if c[2] + self.gap > now]
            if left:
                self.open.put(left)
                self._await(left, False)
            else:
                self.open.clear()
            yield pd.DataFrame(ended, columns=["key", "begin", "last", "n", "total", "head", "tail"])

    def close(self) -> None:
        return


def ended(stream: DataFrame, key: str, ts: str, value: str, gap_seconds: int, late: str, tail: int = 3) -> DataFrame:
    """(key, begin, last in milliseconds, n, total, head, tail) of each clip, once the watermark, `late` behind the latest time, is past its end: rows of a key of which each is at most the
    gap after the one before. head is the first value, tail the last few in order of time.

    Rows may come in any order until the watermark; later ones are left out, and run() counts them. A null key is '', rows without a time are left out, a null value counts as 0. What is kept is
    open clips alone, in STATES states by the key's hash. Needs the RocksDB state store.
    """
    rows = stream.where(F.col(ts).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    rows = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).withColumn("state", F.pmod(F.xxhash64("key"), F.lit(STATES)))
    return rows.groupBy("state").transformWithStateInPandas(_Clips(gap_seconds * 1000, tail), CLIPS, "append", "EventTime")


def run(stream: DataFrame, path: str) -> int:
    """Takes in what has come so far, appends the clips that have ended below path, and ends; goes on from there next time. How many rows came too late."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/clips").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLIPS).parquet(f"{path}/clips")

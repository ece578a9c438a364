"""Bounded state by key, for streams and for tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import ROUND_CEILING, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rank import _dealt, place_in_group
from ..sources.shared import stored

BUFFER = "key string, seq long, slots string"


def slot_of(seq: int, k: int, seed: int) -> int:
    return int(hashlib.md5(f"{seed}:{seq}".encode()).hexdigest()[:8], 16) % k


def push(slots: list, seq: int, value, k: int, seed: int) -> None:
    """Appends up to k entries, then puts each new one in a random slot, so recent ones are likelier to be there."""
    if len(slots) < k:
        slots.append(value)
    else:
        slots[slot_of(seq, k, seed)] = value


def bounded_buffer(stream: DataFrame, key: str, order: str, value: str, k: int, seed: int = 0) -> DataFrame:
    """For each key and micro-batch (key, seen, slots): a buffer of k values, in the order of `order` within a batch."""

    def update(name, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, slots = state.get if state.exists else (0, [])
        slots = list(slots)
        for v in pd.concat([*batches]).sort_values("o")["v"].tolist():
            push(slots, int(seen), v, k, seed)
            seen += 1
        state.update((seen, slots))
        yield pd.DataFrame({"key": [name[0]], "seen": [seen], "slots": [slots]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, seen long, slots array<double>", "seen long, slots array<double>", "update", GroupStateTimeout.NoTimeout)


def carry(chunks: DataFrame, key: str, order: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each key's rows in order through fold, whose state begins anew for each key."""
    return chunks.groupBy(key).applyInPandas(lambda pdf: fold(pdf.sort_values(order)), schema)


def tail_and_sink(df: DataFrame, key: str, order: str, value: str, window: int) -> DataFrame:
    """df with sink, the key's first value, and tail, its last `window` values so far."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("sink", F.first(value).over(w)).withColumn("tail", F.collect_list(value).over(w.rowsBetween(-(window - 1), 0)))


def threshold_reset(values: Column, limit: float) -> Column:
    """For each entry whether to compute it: the running sum has reached limit, which sets it back to zero; the first and the last are always computed."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<boolean>").alias("out"))
    n = F.size(values)

    def step(s: Column, v: Column) -> Column:
        i, total = F.size(s["out"]), s["sum"] + v
        go = (i == 0) | (i == n - 1) | (total >= limit)
        return F.struct(F.when(go, 0.0).otherwise(total).alias("sum"), F.concat(s["out"], F.array(go)).alias("out"))

    return F.aggregate(values, start, step)["out"]


#: Rows of a key that one task goes through; longer keys are cut.
LONG_KEY = 1_000_000
#: Rows of a block of a longer key.
BLOCK = 16_384


def threshold_resets(df: DataFrame, key: str, order: list[str], value: str, limit: float, most: int = LONG_KEY) -> DataFrame:
    """(key, i, go) for each row: its place from 1 within its key, and what threshold_reset() says of it. A null value counts as 0, a null key is a key; rows that tie in order come in any.

    A key of up to `most` rows goes by in order in one task, sum after sum; longer ones, unless they have negative values or no finite sum, are done by _resets_by_blocks(). The latter
    compares sums over more rows than those since a reset: exactly for decimals, for doubles up to their rounding.
    """
    kind = df.schema[key].dataType.simpleString()
    exact = df.schema[value].dataType.typeName() == "decimal"
    zero = F.lit(0).cast(df.schema[value].dataType if exact else "double")
    rows = df.select(key, *order, F.coalesce(F.col(value) if exact else F.col(value).cast("double"), zero).alias("v"))
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.sum(F.col("v").cast("double")).alias("all"))
    cut = sizes.where((F.col("n") > most) & (F.col("least") >= 0) & (F.col("all") < float("inf")) & (F.lit(limit) > 0)).select("_key")
    if cut.isEmpty():
        return _resets_in_order(rows, key, kind, order, limit)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return _resets_in_order(rows.join(cut, same, "left_anti"), key, kind, order, limit).union(_resets_by_blocks(rows.join(cut, same, "left_semi"), key, order, limit))


def _resets_in_order(rows: DataFrame, key: str, kind: str, order: list[str], limit: float) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.select(key, F.row_number().over(w).cast("long").alias("i"), F.col("v").cast("double").alias("v"), F.lead(F.lit(True)).over(w).isNull().alias("last"))

    def fold(batches):
        total = 0.0
        for batch in batches:
            v, go = batch.column(2).to_numpy(zero_copy_only=False), np.array(batch.column(3).to_numpy(zero_copy_only=False), bool)
            firsts = np.flatnonzero(batch.column(1).to_numpy() == 1)
            go[firsts] = True
            for begin, end in zip(np.append(0, firsts), np.append(firsts, len(v))):
                at = begin
                if begin in firsts:
                    total, at = 0.0, begin + 1
                width = 64
                while at < end:
                    sums = np.cumsum(np.append(total, v[at : min(end, at + width)]))[1:]
                    hit = np.flatnonzero(~(sums < limit))[:1]  # Spark and SQL have NaN above all numbers
                    if len(hit):
                        at, total = at + int(hit[0]) + 1, 0.0
                        go[at - 1] = True
                    else:
                        at, total, width = at + len(sums), float(sums[-1]), width * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(go)], [key, "i", "go"])

    return rows.mapInArrow(fold, f"`{key}` {kind}, i long, go boolean")


def _units(values: pa.Array) -> pa.Array:
    """Decimals as whole numbers of their last place: the same 128 bits, read without a scale."""
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(values), values.buffers(), offset=values.offset)


def _sums(values: pa.Array, limit: float) -> np.ndarray:
    """Running sums; whole numbers are added up exactly, as Python's own where 64 bits might not do."""
    if pa.types.is_floating(values.type):
        return np.cumsum(values.to_numpy())
    if pa.types.is_integer(values.type):
        v = values.to_numpy()
        if float(v.max()) * len(v) + limit < 2**62:
            return np.cumsum(v)
    return np.cumsum(np.array([int(v) for v in values.to_pylist()], object))


def _jumps(sums: np.ndarray, limit: float) -> np.ndarray:
    """For a reset at each row the row of the next one, len(sums) where that is not in the block."""
    return np.maximum(np.searchsorted(sums, sums + limit), np.arange(1, len(sums) + 1))


def _resets_by_blocks(rows: DataFrame, key: str, order: list[str], limit: float) -> DataFrame:
    """The same for keys of any length and values from 0 on.

    Rows are dealt by ranges of key and order, once, and packed into blocks of BLOCK rows; neighbouring keys are told apart by 64 bits of a hash. Which resets a block has depends on
    its first one alone, and that is one of the few rows before which the block's sum is below limit. For each of these rows a block says which sum over the whole key is waited for
    after the block's last reset; rows and what waits for them are sorted together by ranges, so each row leads to one in a later block. These steps are chained by doubling: steps of 2, 4, 8, ...
    blocks are joined from the last ones, and from the first row of a key all entered blocks are reached by the longest steps first. Then each block goes through its rows.

    All rows are exchanged once and written once. What is chained is a few rows of each block; only if limit is beyond the sums of whole blocks these are up to all rows, and
    are joined as often as the logarithm of the number of blocks.
    """
    spark, block = rows.sparkSession, BLOCK
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind, kind_of_v = rows.schema[key].dataType.simpleString(), rows.schema["v"].dataType
    exact = kind_of_v.typeName() == "decimal"
    whole = "decimal(38,0)" if exact else "double"
    unit = whole if not exact or kind_of_v.precision > 18 else "long"
    if exact:  # in units of the last place; sums that 38 digits hold never come to the greatest limit
        limit = int(min(Decimal(str(limit)).scaleb(kind_of_v.scale), Decimal(10) ** 37).to_integral_value(ROUND_CEILING))

    def totals(values: list) -> pa.Array:
        return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)) if exact else pa.array(values, pa.float64())

    def pack(batches):
        held, n, number, last = [], 0, 0, None
        for batch in filter(len, batches):
            hashes, v = batch.column(1).to_numpy(), batch.column(3)
            v = v if not exact else _units(v).cast(pa.int64()) if unit == "long" else _units(v)
            changes = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
            for begin, end in zip([0, *changes], [*changes, len(hashes)]):
                if n and hashes[begin] != last:
                    yield flush(*named, number, held)
                    held, n, number = [], 0, number + 1
                last = hashes[begin]
                while begin < end:
                    took = min(end - begin, block - n)
                    named = batch.column(0)[begin].as_py(), batch.column(2).slice(begin, 1)
                    held, n, begin = [*held, v.slice(begin, took)], n + took, begin + took
                    if n == block:
                        yield flush(*named, number, held)
                        held, n, number = [], 0, number + 1
        if n:
            yield flush(*named, number, held)

    def flush(part, name, number, held):
        v = pa.concat_arrays(held)
        total = totals([_sums(v, 0)[-1]])
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), name, pa.array([len(v)]), total, pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)], ["b", "k", "n", "total", "v"])

    by = [F.col("k"), *[F.col(f"o{n}") for n in range(len(order))]]
    rows = rows.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], "v")
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(F.spark_partition_id().cast("long").alias("part"), F.xxhash64("k").alias("h"), "k", "v")
    blocks = stored(rows.mapInArrow(pack, f"b long, k {kind}, n long, total {whole}, v array<{unit}>"), "blocks", **{"parquet.block.size": 16 << 20})
    of_key = Window.partitionBy("k")
    earlier = of_key.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(whole)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.coalesce(F.sum("total").over(earlier), none)
    places = stored(blocks.select("b", "k", before[0].alias("n0"), before[1].alias("s0"), F.sum("n").over(of_key).alias("rows"), "total"), "places")

    def entries(batches):
        for batch in batches:
            for b, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                p = _sums(values.values, limit)
                first = p[: int(np.searchsorted(p, limit)) + 1]
                first = np.append(0, np.flatnonzero(first[1:] > first[:-1]) + 1)
                to = _jumps(p, limit)
                end = np.where(to < len(p), to, np.arange(len(p)))
                while (end != end[end]).any():
                    end = end[end]
                end = end[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), b)), pa.array(b * block + first), totals(p[first]), totals(p[end] + limit)], ["b", "id", "s", "x"])

    found = blocks.select("b", "v").mapInArrow(entries, f"b long, id long, s {whole}, x {whole}").join(places, "b")
    found = found.where((F.col("id") > F.col("b") * block) | (F.col("s") > 0) | (F.col("n0") == 0)).select(
        "k", "b", "id", (F.col("s0") + F.col("s")).alias("s"), F.greatest(F.col("s0") + F.col("x"), F.col("s0") + F.col("total")).alias("x"), (F.col("n0") == 0).alias("first")
    )
    found = stored(found, "entries")
    # Each row's next block: what waits for a sum stands behind its own block and just before the first row that has it.
    sums = found.select("k", F.col("s").alias("x"), "b", F.lit(0).alias("kind"), "id")
    waits = found.select("k", "x", "b", F.lit(1).alias("kind"), "id")
    mixed = _dealt(sums.union(waits), parts, [F.col(c) for c in ("k", "x", "b", "kind", "id")])
    row = F.when(F.col("kind") == 0, F.col("id"))
    back = Window.partitionBy("_part", "k").orderBy(*[F.col(c).desc() for c in ("x", "b", "kind", "id")]).rowsBetween(Window.unboundedPreceding, -1)
    least = mixed.groupBy("_part", "k").agg(F.min(row).alias("first"))
    later = Window.partitionBy("k").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(F.col("_part").alias("_p"), F.col("k").alias("_k"), F.last("first", True).over(later).alias("later"))
    step = mixed.withColumn("to", F.last(row, True).over(back)).where("kind = 1").join(least, (F.col("_part") == F.col("_p")) & F.col("k").eqNullSafe(F.col("_k")))
    steps = [stored(step.select("id", F.coalesce("to", "later").alias("to")).where("to IS NOT NULL"), "steps")]
    while not steps[-1].isEmpty():
        one = steps[-1]
        steps.append(stored(one.join(one.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to")), "steps"))
    entered = stored(found.where((F.col("id") == F.col("b") * block) & F.col("first")).select("id"), "entered")
    for one in reversed(steps[:-1]):
        entered = stored(entered.union(entered.join(one, "id").select("to")), "entered")
    entered = entered.select(F.expr(f"id DIV {block}").alias("b"), (F.col("id") % block).alias("at"))
    places = stored(places.join(entered, "b", "left").select("b", "n0", "rows", "at"), "places")

    def answers(batches):
        for batch in batches:
            for r, (n0, last, at, values) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("n0", "rows", "at")], batch.column("v"))):
                p = _sums(values.values, limit)
                i = np.arange(n0 + 1, n0 + len(p) + 1)
                go = i == last
                if at is not None:
                    to = _jumps(p, limit).tolist()
                    while at < len(p):
                        go[at], at = True, to[at]
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(np.full(len(p), r))), pa.array(i), pa.array(go)], [key, "i", "go"])

    return blocks.select("b", "k", "v").join(places, "b").mapInArrow(answers, f"`{key}` {kind}, i long, go boolean")


def tumbling(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """df with the number of its count window of `size` rows within its key; a key with most rows is split."""
    placed = place_in_group(df, key, [F.col(c) for c in order.split(",")], "_place")
    return placed.withColumn("window_no", F.floor((F.col("_place") - 1) / size)).drop("_place")


def event_counts(events: DataFrame, ts: str, kind: str, window: str, late: str) -> DataFrame:
    """Counts by event-time window and kind; rows later than `late` are left out of a stream. Time stamps without a zone count as UTC."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")

"""Sharding by extendible hashing.

A document's hash is the first 60 bits of the MD5 of its key. A directory is indexed by a prefix of those bits; a bucket
whose bytes exceed the limit is split on the next bit, others stay, until every bucket fits. The bits are looked at in
rounds of a few: a round adds up bytes by the next bits for the rows of buckets that are still too large, and splits
those buckets in the directory bit by bit from the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

BITS = 60


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, max_bytes: int, step: int = 8) -> list[tuple[int, DataFrame]]:
    """For rows (h, bytes): per round its depth d and a table (prefix of d bits, depth, shard, shard_bytes, shard_docs) of the buckets settled in it."""
    out, depth, left = [], 0, rows
    while depth < BITS:
        deep = min(BITS, depth + step)
        fine = stored(left.groupBy(_prefix(F.col("h"), deep).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "histogram")
        levels = [F.expr(f"struct({d} as depth, shiftright(prefix, {deep - d}) as shard)") for d in range(depth + (depth > 0), deep + 1)]
        sums = fine.select("prefix", "bytes", "docs", F.explode(F.array(*levels)).alias("at")).groupBy("at").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | (F.col("at.depth") == BITS)
        good = sums.where(fits).select("at", "shard_bytes", "shard_docs")
        leaves = fine.select("prefix", F.explode(F.array(*levels)).alias("at")).join(good, "at").groupBy("prefix").agg(F.min_by(F.struct("at", "shard_bytes", "shard_docs"), "at.depth").alias("leaf"))
        leaves = stored(leaves.select("prefix", "leaf.at.depth", "leaf.at.shard", "leaf.shard_bytes", "leaf.shard_docs"), "directory")
        out.append((deep, leaves))
        over = fine.join(leaves, "prefix", "left_anti").select("prefix")
        if over.isEmpty():
            break
        left = left.withColumn("prefix", _prefix(F.col("h"), deep)).join(over, "prefix", "left_semi").drop("prefix")
        depth = deep
    return out


def assign_shards(docs: DataFrame, max_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", step: int = 8) -> DataFrame:
    """docs with shard_depth int, shard string (its hash prefix in bits, '' for the only one), shard_bytes and shard_docs long.

    A document's bytes are the UTF-8 bytes of its text (null: 0). No shard exceeds max_bytes, but for a document that
    does so alone, and rows with the same key, whose hashes no bit tells apart. Repeated keys share a shard, a null key counts as ''.
    Empty table: no rows. Columns of docs named as added ones are replaced.
    """
    added = ("shard_depth", "shard", "shard_bytes", "shard_docs")
    base = docs.select(*[c for c in docs.columns if c.lower() not in added])
    h, size, prefix = fresh(base, "h", "bytes", "prefix")
    rows = stored(base.select(key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("bytes")), "sizes")
    out = base.withColumn(h, key_hash(F.col(key)))
    found = []
    for i, (deep, leaves) in enumerate(directory(rows, max_bytes, step)):
        name, at = fresh(out, f"leaf_{i}", f"at_{i}")
        leaves = leaves.select(F.col("prefix").alias(at), F.struct("depth", "shard", "shard_bytes", "shard_docs").alias(name))
        out = out.withColumn(prefix, _prefix(F.col(h), deep)).join(leaves, F.col(prefix) == F.col(at), "left").drop(prefix, at)
        found.append(F.col(name))
    leaf = F.coalesce(*found)
    bits = F.when(leaf["depth"] == 0, "").otherwise(F.lpad(F.bin(leaf["shard"]), leaf["depth"], "0"))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], leaf["depth"].cast("int").alias("shard_depth"), bits.alias("shard"), leaf["shard_bytes"].alias("shard_bytes"), leaf["shard_docs"].alias("shard_docs"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes docs under path, a folder for each shard; rows of a shard meet in one task, which its byte limit bounds."""
    out = assign_shards(docs, **options)
    out.repartition("shard_depth", "shard").write.option("compression", "zstd").partitionBy("shard_depth", "shard").parquet(path)

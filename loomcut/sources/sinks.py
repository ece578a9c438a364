"""Sinks beside the plain writers: files by name, copies, encoded clips, captions that go on where they stopped, tables by group and logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators.rank import file_name
from . import files
from .shared import aside, exists, file_system, read_bytes, stored, write_bytes


def write_files(df: DataFrame, root: str, name: Column, data: Column) -> DataFrame:
    """(path, length) of a file for each row, named below root, with these bytes; a file of that name is replaced. Files are written when the result is used."""

    def write(batches):
        with aside(root) as begun:
            for batch in batches:
                names, sizes = [], []
                for n, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    write_bytes(f"{root}/{n}", d or b"", begun)
                    names.append(f"{root}/{n}"), sizes.append(len(d or b""))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

    return df.select(name.cast("string").alias("name"), data.cast("binary").alias("data")).mapInArrow(write, "path string, length long")


def write_packs(df: DataFrame, root: str, name: Column, data: Column, most: int = 64 << 20) -> DataFrame:
    """(name, path, at, length) of each row: its bytes lie at that place of a file below root, one after another in files of about `most` bytes. For rows too many to be files of their own.

    The index is written too. A task that is run again begins new files, and the index names those of the one that went through.
    """
    kinds = {"name": pa.string(), "path": pa.string(), "at": pa.int64(), "length": pa.int64()}

    def write(batches):
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for n, d in zip(batch.column(0).to_pylist(), batch.column(1)):
                    d = d.as_buffer() if d.is_valid else b""
                    if out is None:
                        path, at = f"{root}/{uuid.uuid4().hex}.pack", 0
                        system, place = file_system(path)
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(place)
                    out.write(d)
                    rows.append((n, path, at, len(d)))
                    at += len(d)
                    if at >= most:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], [*kinds])
        finally:
            if out is not None:
                out.close()

    rows = df.select(name.cast("string").alias("name"), data.cast("binary").alias("data"))
    return stored(rows.mapInArrow(write, "name string, path string, at long, length long"), "packs")


def _side_effect(df: DataFrame, path: Column, to: Column, work: Callable[[str], bytes], dest: str) -> DataFrame:
    """df with error: null where work(path), bytes, was written to `to`, below dest."""
    names = df.columns

    def run(batches):
        with aside(dest.rstrip("/")) as begun:
            for batch in batches:
                errors = []
                for source, target in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                    try:
                        write_bytes(target, work(source), begun)
                        errors.append(None)
                    except Exception as e:
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(errors, pa.string())], [*names, "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*[F.col(f"`{c}`") for c in names], path.alias("_from"), to.alias("_target")).mapInArrow(run, f"{fields}, error string")


def copy_stage(records: DataFrame, dest: str, path: str = "video_path") -> DataFrame:
    """All records, each file copied to dest/<base name>: path is the copy's where that went well, else as it was; error says why not; collides says
    whether another record's file has the same base name, in which case one of them stays."""
    target = F.concat(F.lit(dest.rstrip("/") + "/"), basename(F.col(path)))
    copied = _side_effect(files.collisions(records, path).withColumn("_to", target), F.col(path), F.col("_to"), read_bytes, dest)
    return copied.withColumn(path, F.when(F.col("error").isNull(), F.col("_to")).otherwise(F.col(path))).drop("_to")


def encode_stage(plan: DataFrame, dest: str, encoder: Callable[[bytes], bytes], path: str = "path") -> DataFrame:
    """Rows of steps.resample_plan() with dest_path and error: what is to be copied is, the rest goes through encoder."""
    target = F.concat(F.lit(dest.rstrip("/") + "/"), basename(F.col(path)))
    rows = plan.withColumn("dest_path", target)
    done = _side_effect(rows.where("action = 'copy'"), F.col(path), F.col("dest_path"), read_bytes, dest)
    return done.union(_side_effect(rows.where("action <> 'copy'"), F.col(path), F.col("dest_path"), lambda p: encoder(read_bytes(p)), dest))


def append_captions(videos: DataFrame, captioner: Callable[[str], str], out: str, path: str = "video_path") -> None:
    """Appends (path, caption) as JSON lines for the videos that out does not have yet; null where captioner raises."""
    from ..operators.scoring import caption

    spark = videos.sparkSession
    if exists(spark, out):
        videos = videos.join(spark.read.schema(f"`{path}` string, caption string").json(out).select(path), path, "left_anti")
    caption(videos, captioner, path).write.mode("append").option("ignoreNullFields", "false").json(out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_groups(df: DataFrame, group: str, root: str, prefix: str = "clips") -> DataFrame:
    """Writes a folder of CSV for each group, named by rank.file_name(); (group, rows, name) of what was written."""
    sizes = df.groupBy(group).agg(F.count("*").alias("rows")).withColumn("name", file_name(prefix, F.col(group), F.col("rows")))
    df.join(F.broadcast(sizes.select(group, "name")) if sizes.count() < 100_000 else sizes.select(group, "name"), group).write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("name").csv(root)
    return sizes


def write_lengths(df: DataFrame, path: str, length: Column) -> DataFrame:
    """Writes df with num_frames as CSV; the summary of what was written: rows, known, least, most."""
    write_csv(df.withColumn("num_frames", length), path)
    back = files.read_metadata(df.sparkSession, path)
    return back.agg(F.count("*").alias("rows"), F.count("num_frames").alias("known"), F.min("num_frames").alias("least"), F.max("num_frames").alias("most"))


def write_ranks(df: DataFrame, rank: Column, root: str) -> None:
    """A cache by rank: a folder for each, which its process reads alone."""
    df.withColumn("rank", rank).write.mode("overwrite").partitionBy("rank").parquet(root)


def append_metrics(df: DataFrame, step: str, metrics: list[str], path: str) -> None:
    """Appends (step, name, value) of every known metric to a log."""
    long = df.select(F.col(step).cast("long").alias("step"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("step", metrics, "name", "value")
    long.where("value is not null").write.mode("append").parquet(path)


def append_lines(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the rows that have come so far as JSON lines, each once, whatever is lost meanwhile; goes on from checkpoint next time."""
    stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def is_checkpoint(step: Column, every: int, last: Column) -> Column:
    """Whether a state is saved after a step: every so many, and after the last one if that isn't one of them."""
    return (step % every == 0) | ((step == last) & (step % every != 0))


def read_if_there(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """(rows of the CSV files by position, their headers skipped, blank rows too; the paths that are not there)."""
    there = [p for p in paths if exists(spark, p)]
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"')
    rows = reader.csv(there) if there else spark.createDataFrame([], schema)
    return rows.dropna("all"), [p for p in paths if p not in there]

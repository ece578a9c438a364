"""Scans of file trees and metadata tables, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extension, natural_key
from .shared import listed

# Suffixes by kind of media.
VIDEO = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "mpeg", "mpg")
IMAGE = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif", "ppm")

PROBE = "width int, height int, fps double, duration double, codec string, pix_fmt string, error string"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = VIDEO, recursive: bool = True) -> DataFrame:
    """(path, length) of files with these suffixes in any case, by path. File contents are not read. Empty files are left out."""
    return listed(spark, root, recursive).where(extension(F.col("path")).isin(*suffixes)).orderBy("path")


def images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Image files by path; raises where there is none."""
    found = scan(spark, root, IMAGE, recursive)
    if found.isEmpty():
        raise ValueError(f"no images below {root}")
    return found


def natural_order(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(natural_key(F.substring_index(path, "/", -1)), path)


def probe(files: DataFrame, prober: Callable[[str], dict]) -> DataFrame:
    """files (path, ...) with what prober(path) returns; where it raises, nulls and the error's type and text."""
    schema = T.StructType([*files.schema.fields, *T._parse_datatype_string(PROBE).fields])
    names = [f.name for f in T._parse_datatype_string(PROBE).fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    got = prober(p)
                    rows.append([got.get(c) for c in names[:-1]] + [None])
                except Exception as e:
                    rows.append([None] * (len(names) - 1) + [f"{type(e).__name__}: {e}"])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return files.mapInPandas(run, schema)


def probe_counts(files: DataFrame, prober: Callable[[str], dict]) -> DataFrame:
    """files (path, length, ...) as probe() has them, with num_frames = duration * fps, halves to even, and file_size_mb; zeros where prober raises."""
    out = probe(files, prober)
    failed = F.col("error").isNotNull()
    known = {"num_frames": F.bround(F.col("duration") * F.col("fps")).cast("int"), "file_size_mb": F.col("length") / 1048576}
    zeros = {c: F.when(failed, 0).otherwise(F.coalesce(c, F.lit(0))) for c in ("width", "height", "fps", "duration")}
    return out.withColumns({c: F.when(failed, 0).otherwise(v) for c, v in known.items()}).withColumns(zeros)


def frame_count(packets: Column, counted: Column, duration: Column, rate: Column) -> Column:
    """The counted frames, else packets, else duration times a rate num/den."""
    num, den = F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(rate, F.lit("/"), F.lit(2)).try_cast("double")
    return F.coalesce(counted, packets, F.bround(duration * F.try_divide(num, F.coalesce(den, F.lit(1.0)))).cast("long"))


def record_key() -> Column:
    return F.coalesce(F.nullif(F.col("video_path"), F.lit("")), F.col("path"), F.lit(""))


def read_metadata(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """A table from .json (one array), .jsonl (blank lines skipped; raised on where strict), .parquet or else CSV with a header."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".jsonl"):
        if strict and not spark.read.text(path).where(F.trim("value") == "").isEmpty():
            raise ValueError(f"{path} has blank lines")
        return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith(".parquet"):
        return reader.parquet(path)
    return (reader if schema else reader.option("inferSchema", True)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSONL file that name a file, by video_path or else by path."""
    df = read_metadata(spark, path, schema)
    for c in ("video_path", "path"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    return df.where(record_key() != "")


def read_video_paths(spark: SparkSession, path: str) -> DataFrame:
    """video_path of every row of a JSONL file; a row without it raises."""
    df = spark.read.schema("video_path string").json(path)
    return df.select(F.coalesce("video_path", F.raise_error(F.lit("a row has no video_path"))).alias("video_path"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Names of a CSV file's columns; its rows are not read."""
    return spark.read.option("header", True).csv(path).columns


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("prompt")).where("prompt <> ''")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def train_rows(captions: DataFrame, listing: DataFrame, video: str = "video_path", strict: bool = False) -> DataFrame:
    """captions with missing: whether the file is not in listing (path); raises on one where strict, else the caller leaves them out and reports them."""
    there = listing.select(F.col("path").alias(video)).distinct().withColumn("missing", F.lit(False))
    out = captions.join(there, video, "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    return out.withColumn("missing", F.when(F.col("missing"), F.raise_error(F.concat(F.lit("missing file "), F.col(video)))).otherwise(False)) if strict else out


def write_survivors(df: DataFrame, path: str, passed: str = "filter_pass", rejects: str | None = None) -> None:
    df.where(F.col(passed)).write.mode("overwrite").json(path)
    if rejects:
        df.where(~F.coalesce(F.col(passed), F.lit(False))).write.mode("overwrite").json(rejects)


def write_train_csv(df: DataFrame, path: str, video: str = "video_path", caption: str = "caption", strict: bool = False) -> None:
    """CSV of (video, prompt), captions trimmed; rows without one are left out, or raised on where strict."""
    prompt = F.trim(caption)
    if strict:
        prompt = F.when(prompt.isNull(), F.raise_error(F.lit("null caption"))).otherwise(prompt)
    df.select(F.col(video).alias("video"), prompt.alias("prompt")).where("prompt is not null").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def collisions(df: DataFrame, path: str = "path") -> DataFrame:
    """df with collides: whether another row's file has the same base name."""
    name = F.substring_index(path, "/", -1)
    many = df.groupBy(name.alias("_name")).agg((F.count("*") > 1).alias("collides"))
    return df.join(many, name == F.col("_name")).drop("_name")

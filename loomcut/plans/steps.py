"""The curation pipeline as named steps over datasets: planned first, run only then."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade
from ..sources import files

STEPS = ("locate", "curate", "copy", "resample", "caption", "csv")


@dataclass(frozen=True)
class Dataset:
    name: str
    raw_root: str
    dest_root: str


@dataclass(frozen=True)
class Task:
    dataset: Dataset
    step: str


def plan(registry: dict[str, Dataset], datasets: list[str], steps: list[str]) -> list[Task]:
    """Tasks in the steps' own order whatever the order given; 'all' stands for all; unknown names raise with the known ones."""
    names = [*registry] if "all" in datasets else datasets
    wanted = [*STEPS] if "all" in steps else steps
    for kind, given, known in (("dataset", names, registry), ("step", wanted, STEPS)):
        if bad := [x for x in given if x not in known]:
            raise ValueError(f"unknown {kind} {', '.join(bad)}; known: {', '.join(known)}")
    return [Task(registry[d], s) for d in names for s in sorted(set(wanted), key=STEPS.index)]


def run(tasks: list[Task], actions: dict[str, Callable[[Dataset], None]], dry_run: bool = False, go_on: bool = False) -> list[tuple[Task, str]]:
    """Runs tasks one after another; what failed with its error. Stops at the first failure unless go_on; dry_run prints only."""
    failed: list[tuple[Task, str]] = []
    for t in tasks:
        if dry_run:
            print(f"{t.dataset.name}: {t.step}", file=sys.stdout)
            continue
        try:
            actions[t.step](t.dataset)
        except Exception as e:
            failed.append((t, f"{type(e).__name__}: {e}"))
            if not go_on:
                break
    return failed


def curate(spark: SparkSession, records: DataFrame, listing: DataFrame, filters: list, overrides: dict | None = None) -> DataFrame:
    """Records whose file is in listing (path), through the cascade."""
    keyed = records.withColumn("_key", files.record_key()).where("_key <> ''")
    there = keyed.join(listing.select(F.col("path").alias("_key")), "_key", "left_semi").drop("_key")
    return cascade.run(there, filters, overrides)


def skip_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo that the sink does not have yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resample_plan(videos: DataFrame, fps: float, tolerance: float = 0.01) -> DataFrame:
    """videos (path, fps, ...) with action copy or encode, whether frames would be doubled (upsampled), and the encoder's arguments."""
    same = F.abs(F.col("fps") - fps) < tolerance
    name = F.substring_index("path", "/", -1)
    args = F.array(F.lit("-i"), F.col("path"), F.lit("-vf"), F.lit(f"fps={fps:g}"), F.lit("-an"), name)
    return videos.withColumn("action", F.when(same, "copy").otherwise("encode")).withColumn("upsampled", F.col("fps") < fps).withColumn("args", F.when(~same, args))


def updated(record: DataFrame, fps: float) -> DataFrame:
    """Records after resampling: the new rate, codec and pixel format; the duration stays."""
    return record.withColumns({"fps": F.lit(float(fps)), "codec": F.lit("h264"), "pix_fmt": F.lit("yuv420p")})

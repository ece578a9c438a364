"""A transactional sink of JSON lines: tasks write files of their own, a commit names them in a manifest, and readers read what manifests name. So each row of a write is there once or,
if the write failed, not at all, however often its tasks were tried."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from .shared import file_system, read_bytes, write_bytes


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


def _files(path: str) -> list[str]:
    """Names of the files below a folder, none where it isn't there."""
    from pyarrow import fs

    system, at = file_system(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file)


def manifests(path: str) -> list[dict]:
    """The commits of a sink, oldest first, from the last one on that replaced what there was."""
    out: list[dict] = []
    for name in _files(f"{path}/_manifests"):
        if name.endswith(".json"):
            one = json.loads(read_bytes(f"{path}/_manifests/{name}"))
            out = [one] if one["replaces"] else [*out, one]
    return out


def _commit(path: str, name: str, messages: list, replaces: bool) -> None:
    done = [m for m in messages if m is not None and m.rows]
    write_bytes(f"{path}/_manifests/{name}.json", json.dumps({"replaces": replaces, "files": [m.name for m in done], "rows": sum(m.rows for m in done)}).encode())


def _remove(path: str, messages: list) -> None:
    for m in messages:
        if m is not None:
            _delete(f"{path}/data/{m.name}")


def _delete(name: str) -> None:
    system, at = file_system(name)
    try:
        system.delete_file(at)
    except FileNotFoundError:
        return


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> _Written:
    """One task's file, written batch by batch; nobody else writes to it."""
    name, rows = f"part-{uuid.uuid4().hex}.jsonl", 0
    system, at = file_system(f"{path}/data/{name}")
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as out:
        for batch in batches:
            out.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode())
            rows += batch.num_rows
    return _Written(name, rows)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, replaces: bool):
        self.path, self.replaces = path, replaces

    def write(self, iterator):
        return _write(self.path, iterator)

    def commit(self, messages) -> None:
        have = _files(f"{self.path}/_manifests")
        number = int(have[-1].split("-")[0]) + 1 if have else 0
        _commit(self.path, f"{number:012d}-{uuid.uuid4().hex}", messages, self.replaces)

    def abort(self, messages) -> None:
        _remove(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    """A batch's manifest has the batch's number, so a batch that is committed again leaves its rows once."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        return _write(self.path, iterator)

    def commit(self, messages, batchId: int) -> None:
        name = f"{batchId:012d}-batch"
        if f"{name}.json" in _files(f"{self.path}/_manifests"):
            _remove(self.path, messages)
        else:
            _commit(self.path, name, messages, False)

    def abort(self, messages, batchId: int) -> None:
        _remove(self.path, messages)


class _Part(InputPartition):
    def __init__(self, name: str | None):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self):
        return [_Part(name) for m in manifests(self.path) for name in m["files"]] or [_Part(None)]

    def read(self, partition):
        if partition.name is not None:
            for line in read_bytes(f"{self.path}/data/{partition.name}").split(b"\n"):
                if line:
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)


class ManifestSource(DataSource):
    """df.write.format("manifest").option("path", ...).mode("append").save(), the same of streams, and spark.read.format("manifest").schema(...).load(path). Values are those of JSON."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def reader(self, schema):
        return _Reader(self.options["path"].rstrip("/"), schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"].rstrip("/"), overwrite)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["path"].rstrip("/"))


def append(df: DataFrame, path: str, replaces: bool = False) -> None:
    df.sparkSession.dataSource.register(ManifestSource)
    df.write.format("manifest").option("path", path).mode("overwrite" if replaces else "append").save()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifest").schema(schema).load(path)


def leftovers(path: str) -> list[str]:
    """Files that no commit names: of tasks that failed, or of commits that were replaced."""
    named = {name for m in manifests(path) for name in m["files"]}
    return [name for name in _files(f"{path}/data") if name not in named]


def vacuum(path: str) -> int:
    """Removes leftovers, and says how many; only while nobody writes."""
    names = leftovers(path)
    for name in names:
        _delete(f"{path}/data/{name}")
    return len(names)


def commit_captions(videos: DataFrame, captioner: Callable[[str], str], path: str, video: str = "video_path", fatal: type[BaseException] | tuple = ()) -> int:
    """Captions of the videos that the sink does not have yet, in one commit; a caption is null where captioner raises, but for errors of `fatal`, which end the go without a trace.
    How many rows the sink has then."""
    spark = videos.sparkSession
    schema = f"`{video}` string, caption string"
    todo = videos.select(F.col(video).cast("string").alias(video)).join(read(spark, path, schema).select(video), video, "left_anti")

    def run(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                try:
                    out.append(captioner(name))
                except fatal:
                    raise
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [video, "caption"])

    append(todo.mapInArrow(run, schema), path)
    return sum(m["rows"] for m in manifests(path))

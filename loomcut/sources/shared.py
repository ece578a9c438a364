"""The folder that driver and executors share, and files on any file system that Arrow knows."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on this machine (tests), a folder of our own, set for the session."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = f"file://{tempfile.mkdtemp(prefix='loomcut-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one uses yet; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/loomcut/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard(files: list[str]) -> None:
    """Removes the paths of new_path() under which these files lie."""
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        for entry in [x for x in _written if folder.endswith(x[1].split("://")[-1].lstrip("/").rstrip("/"))]:
            remove(*entry)
            _written.remove(entry)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """df, written as Parquet (with these options) in the shared folder and read again: what depends on chance or on how rows were dealt is fixed from then on."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, put back as it was in the end."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended before the process does
            return


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length) of the files below root, or of root where it is one; written. As in Spark's listing, patterns in root are followed, hidden and empty files are left out.

    Spark lists a folder on the driver and packs 32 files at most into a task. Here folders are read by tasks, level by level, a folder's names as a stream, and lengths are asked for by many tasks.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    roots = [str(s.getPath().toString()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    if not roots:
        raise FileNotFoundError(root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def names(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for path, below in _entries(folder):
                    rows.append((path, below))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "folder"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "folder"])

    def lengths(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            sizes = [_length(p) for p in paths]
            keep = [i for i, n in enumerate(sizes) if n]
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in keep], pa.string()), pa.array([sizes[i] for i in keep], pa.int64())], ["path", "length"])

    folders, found = spark.createDataFrame([(r,) for r in roots], "path string").coalesce(1), None
    while True:
        level = stored(folders.mapInArrow(names, "path string, folder boolean"), "names")
        files = level.where("not folder").select("path")
        found = files if found is None else found.union(files)
        folders = level.where("folder").select("path")
        if not recursive or folders.isEmpty():
            return stored(found.repartition(parts).mapInArrow(lengths, "path string, length long"), "listed")
        folders = folders.repartition(parts)


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder, which may be a file itself; paths begin as the folder's does."""
    from pyarrow import fs

    system, at = file_system(folder)
    if system.get_file_info(at).is_file:
        yield folder, False
    elif isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as there:
            for e in there:
                if not _hidden(e.name):
                    yield f"{folder.rstrip('/')}/{e.name}", e.is_dir()
    else:
        for e in system.get_file_info(fs.FileSelector(at)):
            if not _hidden(e.base_name):
                yield f"{folder.rstrip('/')}/{e.base_name}", e.type == fs.FileType.Directory


def _length(path: str) -> int | None:
    """A file's length; null where it is gone."""
    if path.startswith(("/", "file:")):
        try:
            return os.stat(file_system(path)[1]).st_size
        except FileNotFoundError:
            return None
    system, at = file_system(path)
    return system.get_file_info(at).size


def file_system(path: str):
    """(Arrow file system, path within it) of a path or URI; file:/x and file:///x are the same."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A seekable file of bytes; a missing one raises FileNotFoundError."""
    system, at = file_system(path)
    return system.open_input_file(at)


def read_bytes(path: str) -> bytes:
    with open_file(path) as f:
        return f.read()


class PartReader:
    """Bytes of files, or of `length` bytes of them from `at` on; the last file stays open, as its parts are read one after another."""

    def __init__(self):
        self.path, self.file = None, None

    def __call__(self, path: str, at: int | None = None, length: int | None = None) -> bytes:
        if at is None:
            return read_bytes(path)
        if path != self.path:
            self.file = open_file(path)
            self.path = path
        out = self.file.read_at(length, at)
        if len(out) < length:
            raise EOFError("the file is cut")
        return out


@contextmanager
def aside(root: str) -> Iterator[str | None]:
    """A hidden folder below root for the files that one task has not written whole; tasks that begin files in one folder wait for one another. It is removed in the end.

    None where it can't be made; what is written then says why for each file.
    """
    path = f"{root}/.{uuid.uuid4().hex}.part"
    system, at = file_system(path)
    try:
        system.create_dir(at, recursive=True)
    except OSError:
        yield None
        return
    try:
        yield path
    finally:
        system.delete_dir(at)


def write_bytes(path: str, data: bytes, begun: str | None = None) -> None:
    """Writes a file whole: under another name first, in the folder `begun` where one is given, so that a task that is run again or beside another leaves no half of it."""
    system, at = file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{file_system(begun)[1] if begun else at}{'/' if begun else '.'}{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, at)


class Joined(io.RawIOBase):
    """Files one after another as one seekable file; only what is read is fetched."""

    def __init__(self, paths: list[str]):
        self.files = [open_file(p) for p in paths]
        self.ends, total = [], 0
        for f in self.files:
            total += f.size()
            self.ends.append(total)
        self.at = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def size(self) -> int:
        return self.ends[-1] if self.ends else 0

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = max(0, to + (0, self.at, self.ends[-1] if self.ends else 0)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        start = 0
        for f, end in zip(self.files, self.ends):
            if self.at < end:
                f.seek(self.at - start)
                got = f.read(min(len(buffer), end - self.at))
                buffer[: len(got)] = got
                self.at += len(got)
                return len(got)
            start = end
        return 0

    def close(self) -> None:
        for f in self.files:
            f.close()
        super().close()

"""Archives as a data source: members of tar and zip files, listed or read, split archives joined."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from .files import VIDEO
from .shared import Joined, file_system, listed, new_path

SUFFIXES = (".tar", ".tar.gz", ".tgz", ".zip")
MEMBERS = "archive string, member string, size long"


def safe(name: str) -> bool:
    """Whether a member stays below the folder it is extracted to."""
    return not name.startswith(("/", "\\")) and ".." not in re.split(r"[\\/]", name) and not re.match(r"[A-Za-z]:", name)


def members(name: str, file, content: bool) -> Iterator[tuple[str, int, bytes | None]]:
    """(member, size, bytes) of files in an archive that is open as a seekable file; unsafe names are refused. One member's bytes are held at a time."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(file) as z:
            for i in z.infolist():
                if not i.is_dir():
                    if not safe(i.filename):
                        raise ValueError(f"unsafe member {i.filename!r}")
                    yield i.filename, i.file_size, z.read(i) if content else None
        return
    with tarfile.open(fileobj=file, mode="r:*") as t:
        for i in t:
            if i.isfile():
                if not safe(i.name):
                    raise ValueError(f"unsafe member {i.name!r}")
                yield i.name, i.size, t.extractfile(i).read() if content else None


def find_archives(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(archive, chunks): whole archives, and split ones (name.tar.000, ...) with their chunks in order."""
    base = F.regexp_replace("path", r"\.\d{3,}$", "")
    return listed(spark, root, recursive).withColumn("archive", base).where(F.lower("archive").rlike(r"\.(tar|tar\.gz|tgz|zip)$")).groupBy("archive").agg(F.sort_array(F.collect_list("path")).alias("chunks")).orderBy("archive")


def list_members(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(archive, member, size, error[, data]) of all archives below root; an archive that can't be read gives its error, a split zip too.

    An archive is read member by member where it lies, its chunks as one file; what has no content asked for is only listed.
    """
    schema = f"{MEMBERS}, error string" + (", data binary" if content else "")

    def read(batches):
        for batch in batches:
            for name, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if len(paths) > 1 and name.lower().endswith(".zip"):
                        raise ValueError("split zip archives are not supported")
                    with io.BufferedReader(Joined(paths), 1 << 20) as file:
                        for member, size, data in members(name, file, content):
                            yield row(name, member, size, None, data)
                except Exception as e:
                    yield row(name, None, None, f"{type(e).__name__}: {e}", None)

    def row(name, member, size, error, data):
        columns = {"archive": pa.array([name], pa.string()), "member": pa.array([member], pa.string()), "size": pa.array([size], pa.int64()), "error": pa.array([error], pa.string())}
        if content:
            columns["data"] = pa.array([data], pa.binary())
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return find_archives(spark, root).repartition("archive").select("archive", "chunks").mapInArrow(read, schema)


def count_videos(spark: SparkSession, root: str) -> DataFrame:
    """(archive, videos) without extracting; 0 where an archive can't be read."""
    listed = list_members(spark, root)
    return listed.groupBy("archive").agg(F.count_if(F.lower(F.substring_index("member", ".", -1)).isin(*VIDEO)).alias("videos"))


#: Bytes of an archive that one task reads.
SPLIT_BYTES = 64 << 20
#: Bytes that opening an archive counts for where ranges are packed.
_OPEN = 4 << 10
INDEX = "archive string, chunks array<string>, member string, size long, at long, held long, method string, crc long, error string"


def _tar_entries(file, begin: int = 0, end: int | None = None, mode: str = "r:") -> Iterator[tarfile.TarInfo]:
    """Entries of a tar file whose first header lies from begin on, before end. Only headers are read, and none is kept."""
    file.seek(begin)
    with tarfile.open(fileobj=file, mode=mode) as t:
        while (i := t.next()) is not None and (end is None or i.offset < end):
            t.members.clear()
            if t.pax_headers and begin:
                raise ValueError("headers for all that follows can't be split")
            yield i


def index_file(name: str, file, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int, str, int | None]]:
    """(member, size, place, bytes held, method, CRC) of files in an archive that is open as a seekable file, from its headers alone; of those whose headers lie from begin to end.

    The place is that of a member's data in a tar file, of its local header in a zip file; a compressed tar file has no places, its method is `stream`.
    """
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(file) as z:
            for i in z.infolist():
                if not i.is_dir() and begin <= i.header_offset and (end is None or i.header_offset < end):
                    yield i.filename, i.file_size, i.header_offset, i.compress_size, f"zip{i.compress_type}", i.CRC
        return
    whole = name.lower().endswith(".tar")
    for i in _tar_entries(file, begin, end, "r:" if whole else "r:*"):
        if i.isfile():
            yield i.name, i.size, i.offset_data if whole else -1, i.size, "tar" if whole else "stream", None


def splits(name: str, file, split_bytes: int) -> list[tuple[int, int | None]]:
    """Ranges of about split_bytes of an archive that begin with a member's header; one for a compressed tar file."""
    if not name.lower().endswith((".tar", ".zip")):
        return [(0, None)]
    begins = (i.offset for i in _tar_entries(file)) if name.lower().endswith(".tar") else sorted(x[2] for x in index_file(name, file))
    out = [0]
    for at in begins:
        if at - out[-1] >= split_bytes:
            out.append(at)
    return [*zip(out, [*out[1:], None])]


def ranges(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> str:
    """Where splits() of the archives (archive) lie, for the data source's option `ranges`: found by tasks, so that the driver opens no archive. (archive, begin, end, held)."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with Joined([path]) as file:
                    size = file.size()
                    found = [(0, None)] if size <= split_bytes else splits(path, file, split_bytes)
                begins, ends = zip(*found)
                held = [(size if end is None else end) - begin for begin, end in found]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(held, pa.int64())], ["archive", "begin", "end", "held"])

    out = new_path(archives.sparkSession, "ranges")
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    archives.select("archive").repartition(parts).mapInArrow(read, "archive string, begin long, end long, held long").write.parquet(out)
    return out


def fetch(file, size: int, at: int, held: int, method: str, crc: int | None) -> bytes:
    """A member's bytes by its entry in the index; nothing else of the archive is read. Raises where the archive ends before, or the bytes have another CRC."""

    def part(begin: int, n: int) -> bytes:
        file.seek(begin)
        out = file.read(n)
        if len(out) < n:
            raise EOFError("the archive is cut")
        return out

    if method == "tar":
        return part(at, size)
    head = part(at, 30)
    names, extra = int.from_bytes(head[26:28], "little"), int.from_bytes(head[28:30], "little")
    raw = part(at + 30 + names + extra, held)
    if method not in ("zip0", "zip8"):
        raise ValueError(f"method {method} is not supported")
    data = raw if method == "zip0" else zlib.decompress(raw, -15, size)
    if zlib.crc32(data) != crc:
        raise ValueError("another CRC")
    return data


def index_members(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The index of all archives below root, a row for each member: archive, chunks, member, size, at, held, method, crc, error. A task reads an archive's headers, no data.

    An archive that can't be read gives what comes before the fault and a row with the error; a member whose name leads out of the folder gives its error.
    """

    def read(batches):
        for batch in batches:
            for name, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    if len(chunks) > 1 and name.lower().endswith(".zip"):
                        raise ValueError("split zip archives are not supported")
                    with Joined(chunks) as file:
                        for member, *entry in index_file(name, file):
                            rows.append((member, *entry, None) if safe(member) else (member, *entry, f"ValueError: unsafe member {member!r}"))
                            if len(rows) == 10_000:
                                yield _index_rows(name, chunks, rows)
                                rows = []
                except Exception as e:
                    rows.append((None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield _index_rows(name, chunks, rows)

    return find_archives(spark, root, recursive).repartition("archive").select("archive", "chunks").mapInArrow(read, INDEX)


def _index_rows(name: str, chunks: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([chunks] * len(rows), pa.list_(pa.string())), *columns], ["archive", "chunks", "member", "size", "at", "held", "method", "crc", "error"])


def read_members(index: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, member, size, data, error) of the members in an index, which may be filtered: only what it still names is read.

    Members are dealt by the range of split_bytes of the archive in which they lie, so many tasks read one archive; a compressed tar file is one task, as it has no places.
    """
    columns = ["chunks", "archive", "member", "size", "at", "held", "method", "crc", "error"]
    split = F.when(F.col("method") == "stream", 0).otherwise(F.floor(F.col("at") / split_bytes))
    rows = index.select(*columns).repartition("archive", split).sortWithinPartitions("archive", "at", "member")

    def read(batches):
        name, file, stream = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                data, error = None, r["error"]
                try:
                    if r["archive"] != name:
                        file, stream, name = io.BufferedReader(Joined(r["chunks"]), 1 << 16), None, r["archive"]
                    if error is None and r["method"] == "stream":
                        stream = stream or _wanted(file)
                        data = stream(r["member"])
                    elif error is None:
                        data = fetch(file, r["size"], r["at"], r["held"], r["method"], r["crc"])
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                one = {"archive": pa.array([r["archive"]]), "member": pa.array([r["member"]], pa.string()), "size": pa.array([r["size"]], pa.int64()), "data": pa.array([data], pa.binary()), "error": pa.array([error], pa.string())}
                yield pa.RecordBatch.from_arrays([*one.values()], [*one])

    return rows.mapInArrow(read, "archive string, member string, size long, data binary, error string")


def _wanted(file):
    """Members of a compressed tar file by name; one that lies further back begins anew."""
    passed: list = [None, None]

    def get(member: str) -> bytes:
        for again in (False, True):
            if passed[0] is None or again:
                file.seek(0)
                passed[0] = tarfile.open(fileobj=file, mode="r|*")
                passed[1] = iter(passed[0])
            for i in passed[1]:
                if i.isfile() and i.name == member:
                    return passed[0].extractfile(i).read()
        raise KeyError(member)

    return get


class _Part(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    """Partitions of ranges of members, found from the headers."""

    def __init__(self, schema, options):
        self.content = "data" in schema.fieldNames()
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.ranges = options.get("ranges")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.pack = int(options.get("packbytes", options.get("packBytes", 0)))
        self.kept: list[tuple[str, str, object]] = []

    def _keeps(self, **given) -> bool:
        tests = {"=": lambda x, v: x == v, "in": lambda x, v: x in v, "starts": str.startswith, "ends": str.endswith, "has": lambda x, v: v in x, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v}
        return all(tests[how](given[c], value) for c, how, value in self.kept if c in given)

    def _found(self) -> Iterator[tuple[str, int, int | None, int]]:
        if self.ranges:
            system, at = file_system(self.ranges)
            rows = dataset(at, filesystem=system, format="parquet").to_table().sort_by([("archive", "ascending"), ("begin", "ascending")])
            for batch in rows.to_batches(10_000):
                yield from (r for r in zip(*[c.to_pylist() for c in batch.columns]) if self._keeps(archive=r[0]))
            return
        for path in self.paths:
            if self._keeps(archive=path):
                with Joined([path]) as file:
                    size = file.size()
                    for begin, end in [(0, None)] if size <= self.split else splits(path, file, self.split):
                        yield path, begin, end, (size if end is None else end) - begin

    def partitions(self):
        out, held = [], 0
        for *one, size in self._found():
            if not out or held + size > self.pack:
                out.append(_Part([]))
                held = 0
            out[-1].ranges.append(tuple(one))
            held += size + _OPEN
        return out or [_Part([])]

    def read(self, partition):
        for path, begin, end in partition.ranges:
            yield from self._members(path, begin, end)

    def _members(self, path: str, begin: int, end: int | None):
        with io.BufferedReader(Joined([path]), 1 << 16) as file:
            if not path.lower().endswith((".tar", ".zip")):
                found = ((m, n, data) for m, n, data in members(path, file, self.content) if self._keeps(member=m, size=n))
            else:
                entries = [*index_file(path, file, begin, end)] if path.lower().endswith(".zip") else index_file(path, Joined([path]), begin, end)
                found = ((m, n, fetch(file, n, *place) if self.content else None) for m, n, *place in entries if self._keeps(member=m, size=n))
            for member, size, data in found:
                if not safe(member):
                    raise ValueError(f"unsafe member {member!r}")
                yield (path, member, size, data) if self.content else (path, member, size)


class _FilteringReader(_Reader):
    def pushFilters(self, filters):
        known = {EqualTo: "=", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            names = getattr(f, "attribute", ())
            if type(f) in known and len(names) == 1 and names[0] in ("archive", "member", "size"):
                self.kept.append((names[0], known[type(f)], f.value))
            else:
                yield f


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("paths", "a.tar,b.zip").load(): partitions of about splitBytes of an archive; bytes are read only where the schema has data.

    For many archives, the option `ranges` names what ranges() has found, in place of paths, and packBytes how many bytes of ranges one partition may hold; without it each range is one.
    With the option pushFilters, for which spark.sql.python.filterPushdown.enabled must be set, filters on archive, member and size leave archives, and members' bytes, unread.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS + (", data binary" if self.options.get("content", "false") == "true" else "")

    def reader(self, schema):
        return (_FilteringReader if self.options.get("pushFilters", "false") == "true" else _Reader)(schema, self.options)

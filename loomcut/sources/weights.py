"""Weight files of the safetensors layout: eight bytes of a length, a JSON header of that length with the type, shape and place of each tensor, then their bytes. Headers are read alone, and tensors by their ranges."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containers import Ranges
from .shared import open_file

# Types by their names in headers; BF16 is the upper half of an F32.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
TENSORS = "name string, dtype string, shape array<long>, begin long, end long, error string"
MOST_HEADER = 100 << 20


def write_weights(tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> bytes:
    names = {np.dtype(t): n for n, t in TYPES.items() if n != "BF16"}
    header, at = {"__metadata__": metadata} if metadata else {}, 0
    for name, x in tensors.items():
        header[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text + b"".join(np.ascontiguousarray(x).tobytes() for x in tensors.values())


def read_header(f: Ranges) -> list[tuple[str, str, list[int], int, int]]:
    """(name, type, shape, begin, end) of the tensors of a file, their places counted from the file's begin, by name; a cut or foreign file raises ValueError."""
    size = struct.unpack("<Q", f.read(0, 8))[0]
    if size > min(f.size, MOST_HEADER):
        raise ValueError("no header of weights")
    try:
        header = json.loads(f.read(8, size))
        found = [(name, x["dtype"], x["shape"], 8 + size + x["data_offsets"][0], 8 + size + x["data_offsets"][1]) for name, x in header.items() if name != "__metadata__"]
    except (UnicodeDecodeError, KeyError, TypeError, AttributeError) as e:
        raise ValueError("no header of weights") from e
    for name, kind, shape, begin, end in found:
        if end > f.size:
            raise ValueError(f"the file ends at {f.size}, before {end}")
        if kind in TYPES and end - begin != int(np.prod(shape, dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize:
            raise ValueError(f"tensor {name!r} has another size")
    return sorted(found)


def tensors(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, dtype, shape, begin, end, error) of each tensor of the files, from their headers; a file that can't be read is one row with the error."""

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                f, rows = None, []
                try:
                    f = Ranges(name)
                    rows = [(*x, None) for x in read_header(f)]
                except Exception as e:
                    rows = [(None, None, None, None, None, f"{type(e).__name__}: {e}")]
                finally:
                    if f:
                        f.close()
                if rows:
                    kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["path", "name", "dtype", "shape", "begin", "end", "error"])

    return found.select(F.col(path).alias("path")).mapInArrow(read, f"path string, {TENSORS}")


def fingerprints(index: DataFrame, with_shape: bool = True) -> DataFrame:
    """(path, fingerprint): the MD5 of a file's names, each also with its shape where asked for, sorted and joined by commas. A file's header is one task's, and so are its names."""
    name = F.col("name")
    keys = F.array(F.concat(name, F.lit(":"), F.array_join(F.transform("shape", lambda x: x.cast("string")), "_")), name) if with_shape else F.array(name)
    one = index.where(name.isNotNull()).select("path", F.explode(keys).alias("key")).groupBy("path").agg(F.md5(F.array_join(F.sort_array(F.collect_list("key")), ",")).alias("fingerprint"))
    return one


def later_wins(index: DataFrame, place: Column) -> DataFrame:
    """The entry of each name in the file whose place is last, as the files of a list replace one another's tensors."""
    fields = [c for c in index.columns if c != "name"]
    return index.where("name IS NOT NULL").groupBy("name").agg(F.max_by(F.struct(*fields), place).alias("e")).select("name", "e.*")


def values(index: DataFrame, piece_bytes: int = 8 << 20) -> DataFrame:
    """(name, path, at, values array<double>) of the tensors in an index, which may be filtered: only their ranges are read, pieces of piece_bytes each by any task; at is a piece's first value."""
    size = F.element_at(F.create_map(*[x for n, t in TYPES.items() for x in (F.lit(n), F.lit(np.dtype(t).itemsize))]), F.col("dtype"))
    rows = index.where("name IS NOT NULL").withColumn("size", F.coalesce(size, F.raise_error(F.concat(F.lit("unknown type "), "dtype")).cast("int")))
    step = (F.floor(F.lit(piece_bytes) / F.col("size")) * F.col("size")).cast("long")
    rows = rows.where(F.col("end") > F.col("begin")).withColumn("step", step).withColumn("from", F.explode(F.sequence(F.col("begin"), F.col("end") - 1, F.col("step"))))
    rows = rows.select("path", "name", "dtype", ((F.col("from") - F.col("begin")) / F.col("size")).cast("long").alias("at"), "from", F.least(F.col("end"), F.col("from") + F.col("step")).alias("to"))
    rows = rows.repartition("path", F.floor(F.col("from") / piece_bytes)).sortWithinPartitions("path", "from")

    def read(batches):
        known, file = None, None
        for batch in batches:
            for path, name, kind, at, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if path != known:
                    known, file = path, open_file(path)
                file.seek(begin)
                x = np.frombuffer(file.read(end - begin), TYPES[kind])
                x = (x.astype("<u4") << 16).view("<f4") if kind == "BF16" else x
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([at]), pa.array([x.astype(float)], pa.list_(pa.float64()))], ["name", "path", "at", "values"])

    return rows.mapInArrow(read, "name string, path string, at long, values array<double>")

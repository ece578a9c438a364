"""Blocks of documents, and counts of hashed n-grams over all of them.

A block is one row: some megabytes of text, with all columns of its documents, as a compressed Arrow stream, written to the shared folder. Its number
and the order of its documents are fixed from then on, so (block, place) names a document whatever its id is.

Counting: each block sorts the distinct n-grams of each kind and cuts them by ranges of the hash, so that a count table is partitioned by hash
range. A range gets from each block one row with the steps between its n-grams and their counts, adds the counts up and answers in the same order.
So nothing but counts travels back, a common n-gram is one entry for each block, and no owner of an n-gram is ever sent.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import fresh, setting, stored, trim, trimmed

BLOCK_BYTES = 4 << 20
MOST_ROWS = 1 << 20
_U = np.uint64
#: An n-gram is told apart by this many bits of its hash.
BITS = 56
#: N-grams of a range: at least so many, and more in very large tables, where a block should still have some for each range.
RANGE, MOST_RANGE = 1 << 21, 1 << 26

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

Batch = pa.RecordBatch


def pack(docs: DataFrame, doc: str, text: str, name: str, extra: Callable[[Batch, int, int], dict[str, pa.Array]] | None = None, schema: str = "", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(blocks, place of the id among the packed columns, place of the text): blocks has (block long, n_bytes long, data binary) and what `extra` makes of a block, of schema.

    The packed columns are those of docs, then the id as a long and, where it isn't a string, the text as one.
    """
    ident, words = fresh(docs, "id", "words")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, F.col(f"`{doc}`").cast("long").alias(ident), F.col(f"`{text}`").cast("string").alias(words))
    id_at, text_at = len(columns), len(columns) + 1

    def blocks(batches):
        number, held, size, many = TaskContext.get().partitionId() << 16, [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            more = extra(batch, id_at, text_at) if extra else {}
            return Batch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), *more.values()], ["block", "n_bytes", "data", *more])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            a = 0
            while a < batch.num_rows:
                b = min(int(np.searchsorted(sums, sums[a] + block_bytes - size, side="right")) - 1, a + MOST_ROWS - many)
                if b <= a and not held:
                    b = a + 1  # a longer text is a block of its own
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size, many, a = size + int(sums[b] - sums[a]), many + b - a, b
                if a < batch.num_rows or size >= block_bytes or many >= MOST_ROWS:
                    yield flush()
                    number, held, size, many = number + 1, [], 0, 0
        if held:
            yield flush()

    packed = rows.mapInArrow(trimmed(blocks), f"block long, n_bytes long, data binary{', ' if schema else ''}{schema}")
    with setting(docs.sparkSession, BATCH, "500"):  # rows are whole texts
        return stored(packed, name), id_at, text_at


def unpack(data: bytes) -> Batch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def place(blocks: np.ndarray | int, at: np.ndarray) -> np.ndarray:
    """A number for the document at a place of a block; blocks have less than 2^24 documents."""
    return (blocks << 24) | at


def ranges(total: int, per_block: int) -> int:
    """Into how many ranges of the hash, as a power of two's exponent, about `total` n-grams are cut."""
    size = min(MOST_RANGE, max(RANGE, 16 * total // max(per_block, 1)))
    return max(0, math.ceil(math.log2(max(total, 1) / size)))


def ordered(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of BITS-bit keys: their first bits are sorted together with their places, which is wrong for some only where these bits agree."""
    n = len(keys)
    low = _U(max(n - 1, 1).bit_length())
    packed = np.sort(((keys << _U(64 - BITS)) >> low << low) | np.arange(n, dtype=_U))
    order = (packed & ((_U(1) << low) - _U(1))).astype(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")


def starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def _binaries(offsets: np.ndarray, raw: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def _small(counts: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts cut at edges: a byte each, and those from 255 on as longs."""
    big = np.flatnonzero(counts >= 255)
    return _binaries(edges, np.minimum(counts, 255).astype(np.uint8).tobytes()), _binaries(np.searchsorted(big, edges) * 8, counts[big].astype(np.int64).tobytes())


def _joined(column: pa.Array | pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _large(few: bytes, many: bytes) -> np.ndarray:
    out = np.frombuffer(few, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(many, np.int64)
    return out


def _sent(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Batch:
    """Rows (part, block, width, keys, few, many), one for each range that has keys: sorted and distinct, steps of `width` bytes."""
    edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=_U) << _U(BITS - bits))
    which = np.flatnonzero(np.diff(edges))
    edges = np.append(edges[which], len(keys))
    steps = np.diff(keys, prepend=_U(0))
    steps[edges[:-1]] = keys[edges[:-1]] - (which.astype(_U) << _U(BITS - bits))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(keys) else 1
    few, many = _small(counts, edges)
    n = len(which)
    return Batch.from_arrays([
        pa.array((which + (kind << bits)).astype(np.int32)), pa.array(np.full(n, block)), pa.array(np.full(n, width, np.int32)),
        _binaries(edges * width, np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()), few, many,
    ], ["part", "block", "width", "keys", "few", "many"])


def _added(group: pa.Table) -> pa.Table:
    """Answers to the rows of one range: each n-gram's count over all blocks, in the order in which the block sent them."""
    widths, sizes = group["width"].to_numpy(), pc.binary_length(group["few"]).to_numpy()
    keys = np.empty(int(sizes.sum()), _U)
    ends = np.cumsum(sizes)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        raw = np.frombuffer(b"".join(x for x, w in zip(group["keys"].to_pylist(), widths.tolist()) if w == width), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        sums = np.cumsum(wide.view(_U).ravel(), dtype=_U)
        own = np.cumsum(sizes[rows])
        before = np.append(_U(0), sums)[own - sizes[rows]]
        at = np.arange(len(raw)) + np.repeat(ends[rows] - own, sizes[rows])
        keys[at] = sums - np.repeat(before, sizes[rows])
    counts = _large(_joined(group["few"]), _joined(group["many"]))
    order = np.argsort(keys)
    first = starts(keys[order])
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
    few, many = _small(total, np.append(0, ends))
    few = pa.array([zlib.compress(x, 1) for x in few.to_pylist()], pa.binary())  # most counts are one
    trim()
    return pa.table({"part": group["part"], "block": group["block"], "few": few, "many": many})


def count(blocks: DataFrame, grams: Callable[[Batch], tuple[np.ndarray, np.ndarray]], bits: int, kind: int = 0) -> DataFrame:
    """(part, block, few, many), stored, few compressed: for each block the counts over all blocks of the n-grams of one kind that `grams` gives: sorted distinct keys of BITS bits, and their counts in the block."""

    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = grams(unpack(data.as_buffer()))
                if len(keys):
                    yield _sent(block, kind, keys, counts, bits)

    sent = blocks.select("block", "data").mapInArrow(trimmed(send), "part int, block long, width int, keys binary, few binary, many binary")
    with setting(blocks.sparkSession, BATCH, "1"):  # rows are whole blocks
        return stored(sent.groupBy("part").applyInArrow(_added, "part int, block long, few binary, many binary"), "counts")


def read_counts(answers: pa.Table) -> np.ndarray:
    """The counts that answer one block's n-grams, kind after kind."""
    answers = answers.sort_by("part")
    return _large(b"".join(map(zlib.decompress, answers["few"].to_pylist())), _joined(answers["many"]))


def keys_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> _U(64 - BITS)


def grams_within(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-grams of words that lie within one text, the index of their first word)."""
    n = len(owner) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return textvec.ngrams(hashes, k)[at], at

"""Words, word hashes and word n-gram hashes of many texts at once, as numpy arrays.

Texts are handled as UTF-8 bytes. A word is a longest run of bytes of a byte class; A-Z count as a-z. Its 64-bit hash mixes
blocks of 8 bytes, no linear function of them, so that words of a regular structure do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes as they are, for words whose case counts.
AS_IS = np.arange(256, dtype=np.uint8)

#: Words are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of digits, letters a-z and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: For each length up to 8 the bits of a little-endian block that count.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def span_blocks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the blocks of 8 bytes, the last one filled up with zeros, of all spans; the index of each span's first one, and the end). No span is empty."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    block_at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - begins
    first = np.append(0, np.cumsum((lengths + 7) >> 3))
    if first[-1] == len(begins):
        return block_at[begins] & _KEEP[lengths], first
    many = np.diff(first)
    at = np.repeat(begins - 8 * first[:-1], many) + 8 * np.arange(first[-1])
    return block_at[at] & _KEEP[np.minimum(np.repeat(ends, many) - at, 8)], first


def hash_blocks(blocks: np.ndarray, first: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its blocks are mixed with their places, added up and mixed again with the length.

    Different seeds give independent hashes.
    """
    salt = _U((seed + 1) * _BASE % (1 << 64))
    heads = first[:-1]
    out = mix(blocks[heads] ^ salt)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = np.diff(first)[long] - 1  # blocks after the first
        ends = np.cumsum(more)
        place = np.arange(int(ends[-1])) - np.repeat(ends - more, more) + 1
        out[long] += np.add.reduceat(mix(blocks[np.repeat(heads[long], more) + place] ^ mix(place.astype(_U) * _U(_STEP) + salt)), ends - more)
    return mix(out + lengths.astype(_U) * _U(_STEP))


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return hash_blocks(*span_blocks(data, begins, ends), ends - begins, seed) if len(begins) else np.zeros(0, _U)


@dataclass
class Words:
    """Words of some texts. first: for each text the index of its first word, and the end; hashes: one for each word."""

    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, case: np.ndarray = _LOWER) -> Words:
    """data: bytes of all texts; offsets: where each begins, and the end; case: what each byte counts as."""
    base = int(offsets[0])
    data, offsets = case[data[base : int(offsets[-1])]], offsets - base
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), np.zeros(0, _U), empty, empty)
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = hash_spans(data, begins, ends)
    return Words(np.searchsorted(begins, offsets), hashes, begins, ends)


def second(data: np.ndarray, offsets: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """Other hashes, independent of the first ones, of some words of the texts that `w` was made of."""
    if not len(at):
        return np.zeros(0, _U)
    base = int(offsets[0])
    return hash_spans(_LOWER[data[base : int(offsets[-1])]], w.starts[at], w.ends[at], seed=1)


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k adjacent words, whatever text they are in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, factor = np.zeros(n, _U), 1
    for i in range(k):
        out += hashes[i : i + n] * _U(factor)
        factor = factor * _STEP % (1 << 64)
    return mix(out + _U(k))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of all its words where they are fewer."""
    grams, out = ngrams(w.hashes, k), []
    first = w.first.tolist()
    for a, b in zip(first, first[1:]):
        n = b - a
        if n >= k:
            s = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(ngrams(w.hashes[a:b], n) if n else np.zeros(0, _U))
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of pieces of about `limit` bytes; a longer text is one piece."""
    data, offsets = utf8(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, data, offsets[a : b + 1]
        a = b

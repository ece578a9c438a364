"""Token-ID output: Parquet files of token lists in ascending document order, and selective reads of them.

The ids are a list column in dictionary encoding (a page of a file holds far fewer distinct ids than tokens), document id
and positions are delta-encoded, row groups and pages are kept small, and the page indexes that the writer adds let a
reader of some documents or of the metadata skip the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec
from .textvec import CHUNK_BYTES, chunks

#: Bytes of tab, line breaks, printable ASCII, and Latin letters and signs of two UTF-8 bytes.
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13]] = _PLAIN[32:127] = _PLAIN[0x80:0xC0] = _PLAIN[0xC2:0xCA] = True
#: What of the signs after byte 0xC2 isn't plain: controls, no-break space, soft hyphen, superscript digits, fractions.
_ODD = np.zeros(256, bool)
_ODD[0x80:0xA1] = _ODD[[0xAD, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
#: What is not an ASCII letter, and which of it is ASCII, but no white space.
_MARK = np.ones(256, bool)
_MARK[65:91] = _MARK[97:123] = False
_SIGN = _MARK & ~_SPACE
_SIGN[128:] = False
#: The byte-level pre-tokenizer's words, for plain text.
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SLOTS, _MOST_UNITS, _MOST_WORDS = 1 << 21, 700_000, 80_000


def _marks(data: np.ndarray) -> np.ndarray:
    """For each byte, and the end, how many before it are part of no letter; letters are ASCII ones and those that begin with byte 0xC3."""
    mark = _MARK[data]
    two = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    mark[:-1] &= ~two
    mark[1:] &= ~two
    return np.append(0, np.cumsum(mark))


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library.

    Such a tokenizer treats each word with the space before it on its own, and no word crosses white space. So texts are cut into
    units at white space, and where signs follow letters, as the pre-tokenizer would; a unit's ids are found once, by the library's model word by word, and kept
    in a hash table that numpy looks up for a whole piece of texts; what is found is compared byte by byte, and a unit that only has
    another's hash is encoded by itself. The table is emptied when it is full. A text with characters beyond Latin, or with a special token's
    string, is encoded whole, and every text is where the file holds another kind of tokenizer.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        kind = json.loads(self.tokenizer.to_str())
        words, model = kind["pre_tokenizer"] or {}, kind["model"]
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token"))
        # Units are those of byte-level BPE; by any other kind whole texts are encoded.
        self.cuts = plain and not kind["normalizer"] and words.get("type") == "ByteLevel" and not words.get("add_prefix_space") and bool(words.get("use_regex"))
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte-level alphabet, learned from the pre-tokenizer itself: a plain word's bytes are mapped to its characters.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {b: byte_level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for b in range(0x80, 0xC0):
            shown[b] = byte_level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1]
        for b in range(0xC2, 0xCA):
            shown[b] = byte_level.pre_tokenize_str(bytes([b, 0xA1]).decode())[0][0][0]
        self.alphabet = {b: c for b, c in shown.items()}
        self.words: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 1
        self.pool[0] = self.end_id
        self.begin, self.length, self.n = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int32), 1
        # The bytes of an entry's unit as blocks: where they begin, how many bytes.
        self.bytes, self.bytes_used = np.zeros(1 << 16, np.uint64), 0
        self.bytes_at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, lists: list[list[int]]) -> np.ndarray:
        """Puts ids into the pool; the numbers of their entries."""
        many = len(lists)
        lengths = np.fromiter(map(len, lists), np.int32, many)
        size = int(lengths.sum())
        while self.used + size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + many > len(self.begin):
            self.begin, self.length, self.bytes_at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.bytes_at, self.size))
        self.pool[self.used : self.used + size] = np.fromiter(chain.from_iterable(lists), np.int32, size)
        self.begin[self.n : self.n + many] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + many] = lengths
        self.used, self.n = self.used + size, self.n + many
        return np.arange(self.n - many, self.n, dtype=np.int32)

    def _unit(self, unit: bytes) -> list[int]:
        out: list[int] = []
        for word in _WORD.findall(unit.decode()):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= _MOST_WORDS:
                    self.words.clear()
                ids = self.words[word] = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]
            out += ids
        return out

    def _units(self, raw: bytes, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """The ids of units; marks: for each byte how many before it are no letters. A unit of letters, after a space or not, is one word."""
        lead = marks[starts + 1] - marks[starts]
        word = (marks[ends] - marks[starts] == lead) & (ends - starts > lead)
        tokenize, alphabet, space, out = self.tokenizer.model.tokenize, self.alphabet, self.alphabet[32], []
        for s, e, one, first in zip(starts.tolist(), ends.tolist(), word.tolist(), lead.tolist()):
            if one and (not first or raw[s] == 32):
                text = raw[s + first : e].decode("latin-1")
                text = text if text.isascii() else text.translate(alphabet)
                out.append([t.id for t in tokenize(space + text if first else text)])
            else:
                out.append(self._unit(raw[s:e]))
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of units; 0 where there is none."""
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.values[slot], 0)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)
            key = self.keys[slot[left]]
            same = key == hashes[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (key != 0)]
        return out

    def _learn(self, hashes: np.ndarray, lists: list[list[int]], sizes: np.ndarray, blocks: np.ndarray, first: np.ndarray) -> None:
        """Adds units with their ids, sizes and bytes as blocks, all new and of distinct hashes."""
        entries = self._add(lists)
        while self.bytes_used + len(blocks) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.bytes_used : self.bytes_used + len(blocks)] = blocks
        self.bytes_at[entries], self.size[entries] = self.bytes_used + first[:-1], sizes
        self.bytes_used += len(blocks)
        slot, left = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = hashes[put], entries[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, number of ids of each)."""
        data, offsets = data[int(offsets[0]) : int(offsets[-1])], (offsets - offsets[0]).astype(np.int64)
        n, many = len(data), len(offsets) - 1
        if self.n > _MOST_UNITS:
            self.clear()
        odd = ~_PLAIN[data]
        if n > 1:
            odd[:-1] |= (data[:-1] == 0xC2) & _ODD[data[1:]]
        whole = (np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) > 0) | (not self.cuts)
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                whole[np.searchsorted(offsets, at, side="right") - 1] = True
                at = raw.find(s, at + 1)
        space = _SPACE[data]
        before = np.append(False, space[:-1]) if n else space
        after = np.append(~space[1:], False) if n else space
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        blank = np.append(False, data[:-1] == 32) if n else space
        start = np.where(space, ~before | after, before & ~blank)
        start[1:] |= ~_MARK[data[:-1]] & _SIGN[data[1:]]  # no word goes on from a letter with a sign or digit
        start[begin] = True
        if whole.any():
            inside = np.repeat(whole, np.diff(offsets))
            start[inside] = False
            start[begin[whole[np.searchsorted(offsets, begin, side="right") - 1]]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        plain = ~whole[doc]
        sizes = ends - starts
        blocks, first = textvec.span_blocks(data, starts, ends)
        hashes = textvec.hash_blocks(blocks, first, sizes)
        hashes[hashes == 0] = 1
        entry = self._find(hashes)
        entry[~plain] = 0
        new = np.flatnonzero((entry == 0) & plain)
        marks = _marks(data) if len(new) else None
        if len(new):
            _, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            count, own = np.diff(first)[at], np.append(0, np.cumsum(np.diff(first)[at]))
            mine = blocks[np.repeat(first[at] - own[:-1], count) + np.arange(own[-1])]
            self._learn(hashes[at], self._units(raw, marks, starts[at], ends[at]), sizes[at], mine, own)
            entry[new] = self._find(hashes[new])
        # A unit that only shares its hash with the one found is encoded by itself.
        same = self.size[entry] == sizes
        known = np.flatnonzero(same & plain)
        count = np.diff(first)[known]
        ahead = np.append(0, np.cumsum(count))
        place = np.arange(ahead[-1])
        differ = blocks[np.repeat(first[known] - ahead[:-1], count) + place] != self.bytes[np.repeat(self.bytes_at[entry[known]] - ahead[:-1], count) + place]
        if differ.any():
            same[known[np.add.reduceat(differ, ahead[:-1]) > 0]] = False
        other = np.flatnonzero(plain & ~same)
        mark = self.used, self.n
        if len(other):
            marks = _marks(data) if marks is None else marks
            entry[other] = self._add(self._units(raw, marks, starts[other], ends[other]))
        if not plain.all():
            at = np.flatnonzero(~plain)
            entry[at] = self._add([self.tokenizer.encode(raw[s:e].decode(), add_special_tokens=False).ids for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        stop = np.searchsorted(doc, np.arange(many), side="right")
        entry = np.insert(entry, stop, 0)  # entry 0 is the end id
        lengths = self.length[entry]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.begin[entry] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.used, self.n = mark
        per = np.append(0, ends)[stop + np.arange(1, many + 1)]
        return flat, np.diff(np.append(0, per))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc: str = "doc_id", end_id: int = 0, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 1000) -> None:
    """Writes doc, part, n_tokens, local_start and ids (end_id last) of every row of docs under path, in ascending order of doc.

    tokenizer: a file of the tokenizers library that every executor can open. Rows are dealt by ranges of (doc, hash of text), so
    file after file is in order; null ids come first, equal ids in the order of their texts' hashes. A null text counts as
    empty and gives end_id alone. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        coder = encoder(tokenizer, end_id)
        for batch in batches:
            for a, b, data, ends in chunks(batch.column(1), CHUNK_BYTES // 4):
                ids, n = coder.encode(data, ends)
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(n.astype(np.int64)), pa.array(at + offsets[:-1]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "part", "n_tokens", "local_start", "ids"])
                at += int(offsets[-1])

    out = rows.mapInArrow(encode, "doc_id long, part int, n_tokens long, local_start long, ids array<int>")
    with common.setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):  # rows are whole texts
        _write(out, path, row_group_bytes, page_bytes, page_rows)


def _write(out: DataFrame, path: str, row_group_bytes: int, page_bytes: int, page_rows: int) -> None:
    (out.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes)).option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.dictionary.page.size", str(1 << 20))
        .parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, n_tokens, start of every document: start counts the ids of all documents before it. The ids aren't read."""
    files = spark.read.schema("doc_id long, part int, n_tokens long, local_start long, ids array<int>").parquet(path)
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each file
    before, base = 0, []
    for part, n in totals:
        base.append((part, before))
        before += n
    at = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    return files.join(at, "part").select("doc_id", "part", "n_tokens", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def read_tokens(spark: SparkSession, path: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Documents with least <= doc_id <= most (all where a bound is None); the range reaches the files' row groups and pages."""
    out = read_metadata(spark, path)
    if least is not None:
        out = out.where(F.col("doc_id") >= least)
    return out if most is None else out.where(F.col("doc_id") <= most)


def with_checksum(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def check(batches):
        _encoders.clear()  # a worker that wrote tokens holds one that it needs no more
        pa.default_memory_pool().release_unused()
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8)
            ends = (np.asarray(lists.offsets) * 4).tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")

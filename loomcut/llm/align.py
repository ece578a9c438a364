"""Cross-tokenizer alignment by segments: every distinct segment of the texts is tokenised and aligned once, the alignments are joined back to where it occurs.

A text is cut before runs of white space whose first character no entry of either vocabulary can join to what stands before it, which is looked up in
the vocabularies. So tokens of a text are those of its segments, one after another, and a segment's end is the end of a token of both.

Documents are packed into blocks, each with its distinct segments, their counts, and its documents as numbers of segments. Counts are added up by segment; each distinct segment is
tokenised, cut into groups and linked; links are counted by pair of ids, weighted by how often their segment occurs; and each block gets what was found for its segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from .common import drop_stored, setting, stored, trim, trimmed

#: More text in a block means fewer segments that several blocks share, and more memory for a task.
BLOCK_BYTES = 32 << 20
_SHOWN = "▁"  # what stands for a space in pieces
_OTHERS = "\n\t\r"


class Aligner:
    """Two tokenizers: A, byte-level BPE of the tokenizers library, and B, BPE with byte fallback of the sentencepiece library.

    Other kinds raise ValueError, as nothing would be known of where texts may be cut, nor that the tokens' bytes are those of the normalized text.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        kind = json.loads(self.a.to_str())
        model, words = kind["model"], kind["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token"))
        if kind["normalizer"] or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex") or not plain:
            raise ValueError(f"{path_a} isn't byte-level BPE without a normalizer")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        own = [p for i, p in enumerate(pieces) if not (as_byte[i] or self.b.is_control(i) or self.b.is_unknown(i))]
        if sum(as_byte) != 256 or self.b.normalize("a b") != f"{_SHOWN}a{_SHOWN}b":
            raise ValueError(f"{path_b} has no byte fallback, or doesn't put a space before the text")
        self.prefix = self.b.piece_to_id(_SHOWN)
        # Where a text may be cut: before a character that no piece has after one that isn't white space, nor after the space that B puts first.
        free = [c for c in _OTHERS if not any(re.search(rf"[^\s{_SHOWN}]{c}|{_SHOWN}{c}", p) for p in own)]
        self.cuts = "".join([*([] if any(_SHOWN in p.lstrip(_SHOWN) for p in own) else [" "]), *free])
        stays = f"[^\\S{re.escape(self.cuts)}]"
        self.segment = re.compile(rf"\s*\S+(?:{stays}\s*\S+)*(?:\s+\Z)?") if self.cuts else re.compile(r"(?s).+")
        # Bytes of each id.
        base = self._alphabet(pre_tokenizers)
        size = max(chain([0], self.a.get_vocab(with_added_tokens=True).values())) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(base[c] for c in token) if all(c in base for c in token) else token.encode()
        self.text_a, self.text_b = list(map(str, range(size))), list(map(str, range(len(pieces))))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace(_SHOWN, " ").encode() for p, one in zip(pieces, as_byte)]

    @staticmethod
    def _alphabet(pre_tokenizers) -> dict[str, int]:
        """The byte for each character of the byte-level alphabet, learned from the pre-tokenizer: those of ASCII, then the two bytes of others."""
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        out = {}
        for code in chain(range(0x80), range(0x80, 0x800, 0x20), range(0x80, 0xC0), range(0x800, 0x10000, 0x800), range(0x10000, 0x110000, 0x10000)):
            if not 0xD800 <= code < 0xE000:
                raw = chr(code).encode()
                out.update(zip(level.pre_tokenize_str(chr(code))[0][0], raw))
        # Bytes that no text has keep the characters that are left, in order.
        left = sorted(set(pre_tokenizers.ByteLevel.alphabet()) - set(out), key=ord)
        out.update(zip(left, sorted(set(range(256)) - set(out.values()))))
        return out

    def segments(self, text: str) -> list[str]:
        """Segments of a space and the text; a text of white space alone is one."""
        return self.segment.findall(f" {text}") or [f" {text}"]

    def has_tokens(self, text: str | None) -> bool:
        """Whether both tokenizers give back the bytes of a space and the text: A always does, B if its normalizer changes nothing and the text has no character that stands for a space."""
        return bool(text) and _SHOWN not in text and self.b.normalize(text) == _SHOWN + text.replace(" ", _SHOWN)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments by A and by B."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a space before what it encodes: that of the segment, or one that is taken off again.
        ids_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return ids_a, [x if s[0] == " " else x[1:] for s, x in zip(segments, ids_b)]

    def align(self, segment: str, ids_a: list[int], ids_b: list[int]) -> tuple[str, list[int]]:
        """(groups as `a1,a2|b1;a3|b2`, links as A id << 32 | B id): a group ends, with a link, where tokens of both end."""
        a, b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        raw = segment.encode()
        if b"".join(a) != raw or b"".join(b) != raw:
            raise ValueError(f"tokens of {segment[:80]!r} have other bytes")
        text_a, text_b = [self.text_a[i] for i in ids_a], [self.text_b[i] for i in ids_b]
        groups, links, i, j, end_a, end_b, from_a, from_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a):
            end_a += len(a[i])
            i += 1
            while end_b < end_a:
                end_b += len(b[j])
                j += 1
            if end_a == end_b:
                groups.append(f"{','.join(text_a[from_a:i])}|{','.join(text_b[from_b:j])}")
                links.append(ids_a[i - 1] << 32 | ids_b[j - 1])
                from_a, from_b = i, j
        return ";".join(groups), links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]




def _split(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together, where they compress best."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _packed(batches):
    """Rows (owner, i, n_a, n_best, count_sum, groups), sorted, as a row for each run of an owner within a batch."""
    for batch in batches:
        owner = batch.column(0).to_numpy()
        edges = np.append(bl.starts(owner), len(owner))
        numbers = [np.ascontiguousarray(batch.column(c).to_numpy(), "<i8") for c in range(1, 5)]
        groups, data = batch.column(5).to_pylist(), []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            columns = (np.diff(numbers[0][a:b], prepend=0), *(x[a:b] for x in numbers[1:]))
            parts = [x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns]
            data.append((b - a).to_bytes(8, "little") + zlib.compress(b"".join(parts) + "\n".join(groups[a:b]).encode(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(owner[edges[:-1]], pa.int64()), pa.array(data, pa.binary())], ["owner", "data"])


def _unpacked(data: list[bytes]) -> tuple[dict[str, np.ndarray], list[str]]:
    """(numbers of segments, their groups) in the order of i, from what _packed() made of one owner's rows."""
    numbers, groups = [np.zeros((0, 4), np.int64)], []
    for x in data:
        n, raw = int.from_bytes(x[:8], "little"), zlib.decompress(x[8:])
        part = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 32 * n).reshape(4, 8, n).transpose(0, 2, 1)).view("<i8").reshape(4, n)
        numbers.append(np.stack([np.cumsum(part[0]), *part[1:]], 1))
        groups += raw[32 * n :].decode().split("\n")
    found = np.concatenate(numbers)
    order = np.argsort(found[:, 0])
    groups = [groups[k] for k in order.tolist()]
    n_a, n_best, count_sum = found[order, 1:].T
    n_groups, commas = (np.array([x.count(sign) + more for x in groups], np.int64) for sign, more in ((";", 1), (",", 0)))
    return {"n_a": n_a, "n_b": commas + 2 * n_groups - n_a, "n_groups": n_groups, "n_best": n_best, "count_sum": count_sum}, groups


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string, and `groups` string if asked for.

    Both tokenizers encode a space and the text without special tokens. Where tokens of both end, a group of tokens ends, and the two tokens are linked. An id pair's
    count is how many links of all documents hold it; n_best: links whose count is the highest of their B id, ties included; count_sum: the counts added up over links.
    groups: `a1,a2|b1;a3|b2,b3`, ids in order; groups_sha256 its lowercase hex digest.

    Null and empty texts and those whose bytes a tokenizer changes have no tokens: zeros and ''; they add to no count. Repeated rows each count. Texts of any length are
    taken whole; a stretch without a place to cut is one segment. path_a, path_b: files that every executor can open. Empty table: no rows. Other columns aren't looked at.
    """
    aligner(path_a, path_b)  # tells the wrong kind of file at once
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches):
        pair, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 24
        place: dict[str, int] = {}
        docs, sizes, at, held = [], [], array("i"), 0

        def flush():
            found = np.frombuffer(at, np.int32)
            one = {"block": pa.array([number]), "docs": pa.array([docs], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "data": pa.array([pa.compress(_split(found), "zstd", asbytes=True)], pa.binary()),
                   "segments": pa.array([list(place)], pa.list_(pa.string())), "counts": pa.array([np.bincount(found, minlength=len(place))], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_arrays([*one.values()], [*one])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [place.setdefault(y, len(place)) for y in pair.segments(x)] if pair.has_tokens(x) else []
                docs.append(doc), sizes.append(len(own)), at.extend(own)
                held += len(x or "") + 16
                if held >= block_bytes:
                    yield flush()
                    number, place, docs, sizes, at, held = number + 1, {}, [], [], array("i"), 0
        if docs:
            yield flush()

    with setting(docs.sparkSession, bl.BATCH, "500"):  # rows are whole texts
        blocks = stored(rows.mapInArrow(trimmed(cut), "block long, docs array<long>, sizes array<int>, data binary, segments array<string>, counts array<long>"), "blocks")
    uses = blocks.select(F.col("block").alias("owner"), F.posexplode(F.arrays_zip("segments", "counts")).alias("i", "s")).select("owner", "i", F.col("s.segments").alias("segment"), F.col("s.counts").alias("n"))

    def tokenise(batches):
        pair = aligner(path_a, path_b)
        for batch in batches:
            segments = batch.column(0).to_pylist()
            ids = pair.encode(segments)
            groups, links = zip(*map(pair.align, segments, *ids)) if segments else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids[0]], pa.int32()), pa.array(groups, pa.string()), pa.array(links, pa.list_(pa.int64()))], ["segment", "n", "n_a", "groups", "links"])

    once = uses.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = stored(once.mapInArrow(trimmed(tokenise), "segment string, n long, n_a int, groups string, links array<long>").withColumn("id", F.monotonically_increasing_id()), "aligned")
    # Links by pair of ids; a pair's low half is its B id.
    links = aligned.select("id", "n", F.explode("links").alias("pair"))
    pairs = links.groupBy("pair").agg(F.sum("n").alias("count"))
    counted = stored(pairs.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pairs")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    pairs = counted.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    sums = links.select("id", "pair").join(pairs, "pair").groupBy("id").agg(F.sum("best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
    scored = stored(aligned.select("id", "segment", "n_a", "groups").join(sums, "id").drop("id"), "scored")
    drop_stored(aligned, counted)
    answers = uses.select("owner", "i", "segment").join(scored, "segment").select("owner", "i", "n_a", "n_best", "count_sum", "groups")
    answers = stored(answers.sortWithinPartitions("owner", "i").mapInArrow(trimmed(_packed), "owner long, data binary"), "answers")
    drop_stored(scored)

    def compose(block: pa.Table, answers: pa.Table) -> pa.Table:
        sizes = np.array(block["sizes"][0].as_py(), np.int64)
        ends = np.cumsum(sizes)
        at = _whole(pa.decompress(block["data"][0].as_py(), 4 * int(sizes.sum()), "zstd", asbytes=True))
        own, groups = _unpacked(answers["data"].to_pylist())
        out = {"doc_id": pa.array(block["docs"][0].as_py(), pa.int64())}
        for c, x in own.items():
            sums = np.append(0, np.cumsum(x[at]))
            out[c] = pa.array(sums[ends] - sums[ends - sizes])
        digests, kept, at = [], [], at.tolist()
        for n, end in zip(sizes.tolist(), ends.tolist()):
            joined = ";".join(map(groups.__getitem__, at[end - n : end]))
            digests.append(hashlib.sha256(joined.encode()).hexdigest() if n else "")
            if with_groups:
                kept.append(joined)
        out["groups_sha256"] = pa.array(digests, pa.string())
        trim()
        return pa.table(out | ({"groups": pa.array(kept, pa.string())} if with_groups else {}))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if with_groups else "")
    composed = blocks.select("block", "docs", "sizes", "data").groupBy("block").cogroup(answers.groupBy("owner")).applyInArrow(compose, schema)
    return composed.withColumn("n_links", F.col("n_groups")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))

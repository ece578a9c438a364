"""Benchmark decontamination: a prefix-filtered containment join of item windows against whole documents.

Both sides are cut into word shingles. For each window of an item its shingles are ordered by rarity (how often they
occur in all documents); a document that contains the window must contain every one of them, so one necessary prefix
token, the rarest, is enough to find it. A document's occurrence of that token fixes where the window would begin
(positional bound), the window must fit between the document's ends (length bound), and then all its words are compared, by two independent
hashes of 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import fresh, stored, trimmed

_BITS = 22


def _lengthen(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths: the group of each member, and its place within the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Lookup:
    """Finds which of many 64-bit hashes are in a small sorted set."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are keys, and the index of their key."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        key = np.searchsorted(self.keys, hashes[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


@dataclass
class Windows:
    """The distinct windows of a block of items: where each begins among the hashes of all items' words, how many words it has, and which items have it; others: other hashes of the words."""

    first: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    others: np.ndarray
    items: list[list[str]]

    def tokens(self, shingle: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(window, shingle's length, hashes of its shingles)."""
        for i, (a, n) in enumerate(zip(self.first.tolist(), self.length.tolist())):
            k = min(shingle, n)
            yield i, k, textvec.ngrams(self.hashes[a : a + n], k)


def item_windows(rows: Iterable[tuple[str, str | None]], window: int) -> Windows:
    """All windows of the items; an item with fewer words, but not none, is one window."""
    found: dict[bytes, tuple[int, int, list[str]]] = {}
    words, at = [np.zeros((0, 2), np.uint64)], 0
    for item, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        offsets = np.array([0, len(data)])
        w = textvec.words(data, offsets, textvec.ALNUM)
        own = np.stack([w.hashes, textvec.second(data, offsets, w, np.arange(len(w.hashes)))], 1)
        for a in range(max(1, len(own) - window + 1) if len(own) else 0):
            part = own[a : a + window]
            items = found.setdefault(part.tobytes(), (at + a, len(part), []))[2]
            if not items or items[-1] != item:
                items.append(item)
        words.append(own)
        at += len(own)
    both = np.concatenate(words)
    first, length = (np.array([x[k] for x in found.values()], np.int64) for k in (0, 1))
    return Windows(first, length, both[:, 0].copy(), both[:, 1].copy(), [sorted(set(x)) for _, _, x in found.values()])


def _grams(w: textvec.Words, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes of the k-grams that lie within one text, index of their first word)."""
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for k in sizes:
        grams = textvec.ngrams(w.hashes, k)
        if len(grams):
            within = np.flatnonzero(owner[: len(grams)] == owner[k - 1 :])
            yield k, grams[within], within


def _count_tokens(docs: DataFrame, text: str, keys: np.ndarray, sizes: list[int]) -> dict[int, int]:
    """How often each of these shingles occurs in all documents."""

    def count(batches):
        look, total = Lookup(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in textvec.chunks(batch.column(0)):
                for _, grams, _ in _grams(textvec.words(data, offsets, textvec.ALNUM), sizes):
                    total += np.bincount(look.find(grams)[1], minlength=len(keys))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(total[at])], ["token", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(trimmed(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def _mark(docs: DataFrame, text: str, windows: Windows, shingle: int, names: list[str], again: bool) -> DataFrame:
    """docs with (n_words, spans as begin, end, ..., items) of this block of windows added to those that are there."""
    tokens = list(windows.tokens(shingle))
    sizes = sorted({k for _, k, _ in tokens})
    keys = np.unique(np.concatenate([t for _, _, t in tokens])) if tokens else np.zeros(0, np.uint64)
    often = _count_tokens(docs, text, keys, sizes) if tokens else {}
    chosen = []  # (prefix token, its place in the window, window)
    for i, _, own in tokens:
        place = min(range(len(own)), key=lambda p: (often.get(int(own[p].view(np.int64)), 0), int(own[p]), p))
        if int(own[place].view(np.int64)) in often:  # else no document has it
            chosen.append((int(own[place]), place, i))
    chosen.sort()
    prefix = np.array([c[0] for c in chosen], np.uint64)
    place, which = np.array([c[1] for c in chosen], np.int64), np.array([c[2] for c in chosen], np.int64)
    index = docs.sparkSession.sparkContext.broadcast((prefix, place, which, windows.first, windows.length, windows.hashes, windows.others, windows.items))
    base = [c for c in docs.columns if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in base), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(T.StringType()))])

    def mark(batches):
        prefix, place, which, first, length, hashes, others, items = index.value
        keys, begin, many = np.unique(prefix, return_index=True, return_counts=True)
        look = Lookup(keys)
        for batch in batches:
            for a, b, data, offsets in textvec.chunks(batch.column(batch.schema.get_field_index(text)).cast(pa.string())):
                piece = batch.slice(a, b - a)
                n_words, spans, listed = [], [], []
                w = textvec.words(data, offsets, textvec.ALNUM)
                n, docs_at, wins_at, from_at = len(w.first) - 1, [], [], []
                for _, grams, at in _grams(w, sizes):
                    found, key = look.find(grams)
                    group, nth = _lengthen(many[key])
                    entry = begin[key][group] + nth
                    win, start = which[entry], at[found][group] - place[entry]
                    doc = np.searchsorted(w.first, at[found][group], side="right") - 1
                    fits = (start >= w.first[doc]) & (start + length[win] <= w.first[doc + 1])
                    win, start, doc = win[fits], start[fits], doc[fits]
                    for mine, own in ((lambda i: w.hashes[i], hashes), (lambda i: textvec.second(data, offsets, w, i), others)):
                        group, nth = _lengthen(length[win])
                        differ = np.bincount(group, weights=mine(start[group] + nth) != own[first[win][group] + nth], minlength=len(win))
                        win, start, doc = win[differ == 0], start[differ == 0], doc[differ == 0]
                    docs_at.append(doc), wins_at.append(win), from_at.append(start)
                doc, win, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs_at, wins_at, from_at))
                order = np.lexsort((start, doc))
                doc, win, start = doc[order], win[order], start[order]
                ends = np.searchsorted(doc, np.arange(n + 1))
                n_words += np.diff(w.first).tolist()
                for i in range(n):
                    s, e = ends[i], ends[i + 1]
                    merged: list[int] = []
                    for x, y in zip((start[s:e] - w.first[i]).tolist(), (start[s:e] + length[win[s:e]] - w.first[i]).tolist()):
                        if merged and x <= merged[-1]:
                            merged[-1] = max(merged[-1], y)
                        else:
                            merged += [x, y]
                    spans.append(merged)
                    listed.append(sorted({x for j in set(win[s:e].tolist()) for x in items[j]}))
                if again:
                    old = piece.column(piece.schema.get_field_index(names[1])).to_pylist(), piece.column(piece.schema.get_field_index(names[2])).to_pylist()
                    spans = [_union(x, y) for x, y in zip(old[0], spans)]
                    listed = [sorted({*x, *y}) for x, y in zip(old[1], listed)]
                arrays = [piece.column(piece.schema.get_field_index(c)) for c in base]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(listed, pa.list_(pa.string()))], [*base, *names])

    return docs.mapInArrow(trimmed(mark), schema)


def _union(x: list[int], y: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(x[::2], x[1::2]), *zip(y[::2], y[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def item_blocks(wanted: DataFrame, most: int) -> tuple[Column, list[int]]:
    """(a row's block by a hash of its item and text, the blocks that there are): blocks hold texts of `most` bytes at most, or one row. There are more of them until all do, so
    rows that share an id, or have none, are dealt like others."""
    sized = wanted.select(F.xxhash64("item", "text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    many = max(1, -(-(sized.agg(F.sum("size")).first()[0] or 0) // most))
    while True:
        found = sized.groupBy(F.pmod("h", F.lit(many)).alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        if found.where((F.col("size") > most) & (F.col("n") > 1)).isEmpty():
            return F.pmod(F.xxhash64("item", "text"), F.lit(many)), sorted(r.b for r in found.select("b").collect())
        many *= 2


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, max_index_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words and n_hit long, hit_spans array<struct<begin, end>> (word indexes, end exclusive, merged), item_ids array<string> (sorted), contaminated boolean.

    A word is hit if it lies inside any occurrence of a window of `window` words of an item (of all its words where
    they are fewer). The items' texts are put in an index that is broadcast only up to max_index_bytes of text, or of one longer item; a larger
    benchmark is dealt by hash into blocks of that size at most, two passes over docs each (one counts, one marks), the documents kept in
    the shared folder between them.
    Null and empty texts have no words and no hits; an item without words hits nothing; a null item id counts as ''.
    Repeated items and documents are all answered. Columns of docs with the names of added ones are replaced.
    """
    added = ["n_words", "n_hit", "hit_spans", "item_ids", "contaminated"]
    out = docs.select(*[c for c in docs.columns if c.lower() not in added])
    names = fresh(out, "n_words", "spans", "items")
    wanted = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    key, blocks = item_blocks(wanted, max_index_bytes)
    for i, b in enumerate(blocks or [0]):
        rows = [(r.item, r.text) for r in wanted.where(key == b).orderBy("item", "text").collect()]
        out = _mark(out, text, item_windows(rows, window), shingle, names, i > 0)
        out = stored(out, "marked") if i < len(blocks) - 1 else out
    n, spans, items = (F.col(f"`{x}`") for x in names)
    base = [F.col(f"`{c}`") for c in out.columns if c not in names]
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(2)), lambda i: F.struct(F.try_element_at(spans, i).alias("begin"), F.try_element_at(spans, i + 1).alias("end")))
    pairs = F.filter(pairs, lambda s: s["begin"].isNotNull())
    return out.select(*base, n.alias("n_words"), F.aggregate(pairs, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("n_hit"), pairs.alias("hit_spans"), items.alias("item_ids"), (F.size(spans) > 0).alias("contaminated"))

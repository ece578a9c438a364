"""LM scoring: stupid-backoff scores of an n-gram model that is counted over all documents.

For a word w after a context v of up to order - 1 words of its text: S(w | v) = (c(v w) - own) / c(v) if the n-gram occurs outside the row itself,
else BACKOFF * S(w | v without its first word); at last S(w) = max(c(w) - own, 1) / N. own counts what the row itself has: without that every rare n-gram
would vouch for itself, and nothing would ever back off. A document's score is the mean of ln S over its words.

Documents are packed into blocks (see blocks). The n-grams of each order are exploded and counted within a block; the table of counts is partitioned by
hash range, each block's n-grams are joined to it there, and the counts go back to the block in the order in which its n-grams went. A block then has the count
of each of its n-grams and adds up its documents' scores; rows of one document are summed in the end.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textvec
from .common import trim

BACKOFF = 0.4


class _Grams:
    """The n-grams of one order in a block: sorted distinct keys, their counts in the block, and for each place in the texts its key and own count."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, k: int, places: bool):
        grams, self.at = bl.grams_within(hashes, owner, k)
        keys = bl.keys_of(grams)
        if not places:
            keys = np.sort(keys)
        else:
            order = bl.ordered(keys)
            keys = keys[order]
        first = bl.starts(keys)
        self.counts = np.diff(np.append(first, len(keys)))
        self.keys = keys[first]
        if places:
            who = owner[self.at[order]]
            new = np.zeros(len(keys), bool)
            new[first] = True
            self.which = np.empty(len(keys), np.int64)
            self.which[order] = np.cumsum(new) - 1
            new[1:] |= who[1:] != who[:-1]
            runs = np.flatnonzero(new)
            self.own = np.empty(len(keys), np.int64)
            self.own[order] = np.repeat(np.diff(np.append(runs, len(keys))), np.diff(np.append(runs, len(keys))))


def _words(batch: pa.RecordBatch, text_at: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts of a block, the text of each)."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for a, b, data, offsets in textvec.chunks(batch.column(text_at)):
        w = textvec.words(data, offsets, textvec.NOT_SPACE)
        hashes.append(w.hashes)
        owner.append(np.repeat(np.arange(a, b, dtype=np.int32), np.diff(w.first)))
    return np.concatenate(hashes), np.concatenate(owner)


def _scores(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, order: int, total: int) -> np.ndarray:
    """ln S of each word of a block; counts answers its n-grams, order after order."""
    value = np.zeros(len(owner))
    context = np.zeros(len(owner), np.int64)  # the count of the n-gram one word shorter that begins at a place
    for k in range(1, order + 1):
        grams = _Grams(hashes, owner, k, True)
        c, counts = counts[: len(grams.keys)][grams.which], counts[len(grams.keys) :]
        others = c - grams.own
        if k == 1:
            value[:] = np.log(np.maximum(others, 1) / total)
        else:
            last, seen = grams.at + k - 1, others > 0
            value[last] = np.where(seen, np.log(np.maximum(others, 1) / np.maximum(context[grams.at], 1)), value[last] + np.log(BACKOFF))
        context[grams.at] = c
    return value


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", order: int = 2, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """One row for each doc_id: doc_id, n_words long, log_score double (sum of ln S), mean_log_score double (null without words).

    Words are runs of anything but ASCII white space, A-Z as a-z; whole texts are scored, by n-grams of up to `order` words. A null or empty text has no words
    and sum 0. Rows with the same doc_id (null too) are added up as one document, each having its own words taken out of the counts; other
    columns are not looked at. Empty table: no rows. N-grams are told apart by 56 bits of their hashes.
    """
    docs = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def size(batch, _, text_at):
        return {"n_words": pa.array([len(_words(batch, text_at)[0])])}

    blocks, id_at, text_at = bl.pack(docs, "doc_id", "text", "blocks", size, "n_words long", block_bytes)
    total, largest = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.max("n_words"), F.lit(0))).first()

    def counted(k: int) -> DataFrame:
        def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found = _Grams(*_words(batch, text_at), k, False)
            return found.keys, found.counts

        return bl.count(blocks, grams, bl.ranges(total, largest), k)

    # Order by order, so that what is exchanged at once doesn't grow with the number of orders.
    answers = reduce(DataFrame.union, [counted(k) for k in range(1, order + 1)])

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        batch = bl.unpack(block["data"][0].as_buffer())
        hashes, owner = _words(batch, text_at)
        values = _scores(hashes, owner, bl.read_counts(answers), order, total) if len(owner) else np.zeros(0)
        n = batch.num_rows
        trim()
        return pa.table({"doc_id": batch.column(id_at), "n_words": np.bincount(owner, minlength=n), "log_score": np.bincount(owner, weights=values, minlength=n)})

    schema = "doc_id long, n_words long, log_score double"
    # A block is a group of its own, so a task holds one at a time.
    rows = blocks.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    out = rows.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and all but letters become word breaks, so digits, marks and markup say nothing. The model is a matrix of
log-probabilities, one row for each hash bucket, broadcast to the executors (buckets x languages doubles); batches are
scored by gathering its rows for the n-grams present and summing them by document.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed
from .textvec import chunks

UNKNOWN = "und"
ORDERS = (1, 2, 3)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter (Unicode category L)."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def features(texts: list[str | None], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order of n-grams (bucket of every n-gram of every text, text after text; where each text's begin, and the end)."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    # a run of other characters counts as one break, and each text has one before its first letter and after its last
    first = np.ones(len(codes), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.zeros(len(codes), bool)
    before[1:] = letter[:-1]
    keep = letter | (before & ~first) | (~letter & first)
    starts = np.flatnonzero(first & letter)
    at = np.searchsorted(np.flatnonzero(keep), starts)
    codes, owner = np.insert(codes[keep], at, 32), np.insert(owner[keep], at, owner[starts])
    out, wide = [], codes.astype(np.uint64)
    for n in ORDERS:
        m = max(len(wide) - n + 1, 0)
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h + wide[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        within = owner[:m] == owner[n - 1 :]
        if n == 1:
            within &= codes != 32
        out.append((((h[within] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), np.searchsorted(owner[:m][within], np.arange(len(low) + 1))))
    return out


def has_letter(texts: list[str | None]) -> np.ndarray:
    letters = _letters()
    return np.array([bool(t) and (t[0].isalpha() or bool(letters[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)].any())) for t in texts], bool)


@dataclass
class Model:
    """langs: sorted; weights: buckets x langs log-probabilities; prior: of langs."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 6000, buckets: int = 1 << 15, alpha: float = 0.5) -> Model:
    """Learns from rows of labelled with text and lang that aren't null: all of a language with up to per_lang rows, else about per_lang of them.

    Which ones depends on a hash of key alone. per_lang bounds what is learned from, not what is scored.
    No labelled rows: a model without languages. Priors are the shares of all labelled rows.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(1 << 20)).alias("draw")).where("text is not null and lang is not null")
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(have)
    if not langs:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    share = F.broadcast(rows.sparkSession.createDataFrame([(x, i, int(min(1.0, per_lang / have[x]) * (1 << 20))) for i, x in enumerate(langs)], "lang string, at int, below long"))
    chosen = rows.join(share, "lang").where("draw < below").select("text", "at")

    def count(batches):
        total = {}
        for batch in batches:
            for a, b, _, _ in chunks(batch.column(0)):
                texts, at = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_numpy()
                for grams, ends in features(texts, buckets):
                    owner = np.repeat(at, np.diff(ends))
                    for i in np.unique(at).tolist():
                        total[i] = total.get(i, 0) + np.bincount(grams[owner == i], minlength=buckets)
        for i, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(n[at])], ["at", "bucket", "n"])

    got = chosen.mapInArrow(trimmed(count), "at int, bucket long, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((buckets, len(langs)), alpha)
    counts[got["bucket"].to_numpy(np.int64), got["at"].to_numpy(np.int64)] += got["n"].to_numpy(float)
    prior = np.log(np.array([have[x] for x in langs], float) / sum(have.values()))
    return Model(langs, np.log(counts / counts.sum(0)), prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double: the most probable language and its posterior probability.

    A text that is null or has no letters, and any text where nothing was learned, is 'und' with score 0. Ties go to the first
    language in code-point order. Whole texts are scored; repeated rows are each scored alike. Columns of docs named lang_pred or score are
    replaced. Empty table: no rows.
    """
    base = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))
    at = base.columns.index(text)
    names = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        langs, weights, prior = sent.value
        columns = [np.ascontiguousarray(weights[:, j]) for j in range(len(langs))]
        for batch in batches:
            for a, b, _, _ in chunks(batch.column(at), 1 << 18):
                piece = batch.slice(a, b - a)
                texts = piece.column(at).cast(pa.string()).to_pylist()
                preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if langs:
                    known, sums = has_letter(texts), np.tile(prior, (len(texts), 1))
                    for grams, ends in features(texts, len(weights)):
                        full = np.flatnonzero(np.diff(ends))
                        for j, own in enumerate(columns):
                            if len(full):
                                sums[full, j] += np.add.reduceat(own[grams], ends[full])
                    scores = np.where(known, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0.0)
                    preds = [langs[i] if k else UNKNOWN for i, k in zip(sums.argmax(1).tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return base.mapInArrow(trimmed(score), schema)


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of key as text leaves 2 when divided by 4; a null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2

"""The training-data pipeline: language ID, near duplicates, decontamination, mixing and sharding of documents.

A stage takes (spark, docs, sf_dir); each result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcut.llm import common, decontam, langid, mixture, ngram_join, shard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# Every stage takes null and repeated doc_ids, null, empty and very long texts, and empty tables (which give empty ones). Columns beside those of documents pass
# through as they are, also those named like a column that an operator adds; the last stage alone adds columns, and replaces ones of their names.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; texts that are null or have no letters, and those where no language is likelier than not, go.

    A null lang teaches nothing and is no reason to go. Each of repeated rows is judged alike. Without any label nothing is known and all rows go.
    """
    model = langid.fit(docs)
    out, own = common.apart(docs, ("lang_pred", "score"), lambda df: langid.predict(df, model))
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0.5)).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that links of five-word shingles at a similarity of 0.8 or more hold together: that with the smallest doc_id.

    Of repeated rows one stays; rows without a doc_id all stay, as none of them is the smallest; texts without words link with nothing, but for
    rows of the same doc_id.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Texts without words have none and stay; repeated rows are judged alike."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out, own = common.apart(docs, ("n_words", "n_hit", "hit_spans", "item_ids", "contaminated"), lambda df: decontam.mark_contamination(df, benchmark))
    return out.where(~F.col("contaminated")).select(*own)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources by weight takes. A null source is a source; repeated rows are documents of their own."""
    out, own = common.apart(docs, ("size", "source_size", "target", "placements"), mixture.mix)
    return mixture.materialize(out).select(*own)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row, by a hash of its doc_id (null: of the empty string), so rows that share it share a shard."""
    added = ("shard_depth", "shard", "shard_bytes", "shard_docs")
    return shard.assign_shards(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *added)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixture", source_mixture), ("sharding", sharding)]

#: Language ID and near duplicates have no form in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between them is written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else common.stored(out, name)
    return docs

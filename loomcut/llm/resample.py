"""Importance resampling towards a target distribution: hashed n-gram features, their log gains, and a draw by perturbed weights.

The words of a text are exploded with their positions, lead() over a text's words puts the following words beside each, the n-grams of every
order are joined from these, hashed to a bucket, counted by bucket, and the buckets' gains are joined back to the features.

Texts are cut into segments of SEGMENT words, each with the words after it that its last n-grams need. A segment is a group of the window, so a very long
text is no single group. Segments are numbered when they are written, so a number means the same row whatever is computed again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Words that a segment owns; a window's group holds up to ORDER - 1 more, and a buffer of a window keeps 4096 rows without a sorter.
SEGMENT = 4000
ORDER, BUCKETS = 3, 10_000
#: Features are made in so many goes, each of every GOES-th segment, so that only that share of the words lies in an exchange at a time.
GOES = 2

#: What separates words, all of it ASCII, and A-Z, which count as a-z.
_BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z as a-z; of a null text none. Signs are mapped to spaces, which takes a tenth of the time of a regular expression."""
    plain = F.translate(F.coalesce(text, F.lit("")), _BETWEEN + _UPPER, " " * len(_BETWEEN) + _LOWER)
    return F.array_remove(F.split(plain, " "), "")


def segments(rows: DataFrame, text: str, segment: int = SEGMENT, order: int = ORDER) -> DataFrame:
    """(row, segment, part, n_words, words) and the other columns of rows, for each segment of a text: its words and the next order - 1, joined by a space; part numbers all segments.

    A text without words has one empty segment.
    """
    cut = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("w", words(F.col(text))).drop(text)
    cut = cut.withColumn("n_words", F.size("w").cast("long"))
    cut = cut.withColumn("segment", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n_words") - 1, F.lit(0)) / segment).cast("int"))))
    cut = cut.withColumn("words", F.array_join(F.slice("w", F.col("segment") * segment + 1, segment + order - 1), " ")).drop("w")
    return cut.withColumn("part", F.monotonically_increasing_id())


def features(parts: DataFrame, segment: int = SEGMENT, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(part, packed long) for each word of segments(): the buckets of the n-grams of 1 to `order` words that begin with it, as digits of base buckets + 1; 0 stands for none."""
    dealt = parts.where("n_words > 0").select("part", "words").repartition("part")  # segments are dealt out, not their words
    exploded = dealt.select("part", F.posexplode(F.split("words", " ")).alias("at", "w0"))
    following = Window.partitionBy("part").orderBy("at")
    ahead = exploded.select("part", "at", "w0", *[F.lead("w0", k).over(following).alias(f"w{k}") for k in range(1, order)]).where(F.col("at") < segment)
    packed = F.lit(0).cast("long")
    for k in range(order):
        gram = F.concat(*[x for i in range(k + 1) for x in (F.lit(" "), F.col(f"w{i}"))][1:])  # null where a following word is missing
        packed += F.coalesce(F.crc32(gram.cast("binary")) % buckets + 1, F.lit(0)) * (buckets + 1) ** k
    return ahead.select("part", packed.alias("packed"))


def _each(found: DataFrame, order: int, buckets: int, *keep: str) -> DataFrame:
    """A row with its bucket for each feature."""
    digit = [F.expr(f"packed div {(buckets + 1) ** k}") for k in range(order)]
    return found.select(*keep, F.explode(F.array(*[(d % (buckets + 1) - 1).cast("int") for d in digit])).alias("bucket")).where("bucket >= 0")


def _totals(found: DataFrame, order: int, buckets: int, name: str) -> DataFrame:
    return _each(found, order, buckets).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain long) for every bucket, from totals (bucket, s) of the source and (bucket, t) of the target: floor of 1000 times the logarithm of the smoothed ratio of shares.

    There are `buckets` rows, whatever the corpus, so the sums over all of them are one small aggregate and the table may be broadcast.
    """
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _noise(doc: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) of a document, from the first 32 bits of a hash of its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def _ranked(scored: DataFrame, parts: int) -> DataFrame:
    """scored with rank: the place from 1 by score, highest first, then doc_id, nulls last. Dealt by ranges, which are written once; places within a part move by the rows of earlier parts."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = stored(scored.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select("row", (F.col("own") + F.col("before")).cast("long").alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, order: int = ORDER, buckets: int = BUCKETS, segment: int = SEGMENT
) -> DataFrame:
    """A row for each row of docs: doc_id, n_features, weight, score, rank, all long.

    Features are all runs of 1 to `order` words; words are runs of digits, letters and everything outside ASCII, A-Z as a-z. weight adds the gains of
    a text's features up, 0 without any; score adds noise that depends on the id and the seed alone. Of the rows with at least `least_words`
    words `percent` of a hundred, rounded down, are drawn by the highest score, ties to the smaller id; rank is null for what isn't drawn.

    A null text has no words, a null id counts as '' in the noise and comes last among ties; of repeated rows each counts in the totals and may be drawn, in any order.
    buckets and order: (buckets + 1) ** order must fit into a long. An empty target has no features, so gains only tell the documents' rare features from common ones. Empty docs: no rows. Other columns aren't looked at.
    """
    if (buckets + 1) ** order >= 1 << 63:
        raise ValueError("the buckets of a word's features don't fit into a long")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = stored(segments(rows, "text", segment, order), "segments")
    wanted = stored(segments(target.select(F.col(f"`{target_text}`").cast("string").alias("text")), "text", segment, order), "target")
    goes = [stored(features(parts.where(F.col("part") % GOES == i), segment, order, buckets), "features", {"parquet.enable.dictionary#packed": "false"}) for i in range(GOES)]
    found = reduce(DataFrame.union, goes)
    gain = stored(gains(_totals(found, order, buckets, "s"), _totals(features(wanted, segment, order, buckets), order, buckets, "t"), buckets), "gains")
    weights = _each(found, order, buckets, "part").join(F.broadcast(gain), "bucket").groupBy("part").agg(F.sum("gain").alias("weight"))
    weights = parts.select("row", "part").join(weights, "part").groupBy("row").agg(F.sum("weight").alias("weight"))
    base = parts.where("segment = 0").select("row", "doc_id", "n_words")
    n_features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, order)), F.col("n_words"))
    scored = base.join(weights, "row", "left").select("row", "doc_id", "n_words", n_features.cast("long").alias("n_features"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    scored = stored(scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "scored")
    drop_stored(parts, *goes, wanted, gain)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranks = _ranked(able.select("row", "score", "doc_id"), int(spark.conf.get("spark.sql.shuffle.partitions"))).where(F.col("rank") <= drawn)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")

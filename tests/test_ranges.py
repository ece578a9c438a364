"""Places and sums over ranges, in tables too large for a sample to hold them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomcut.operators import lookup, rank
from loomcut.streaming import state


def many(spark):
    h = F.xxhash64("id")
    return spark.range(0, 60_000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.pmod(h, F.lit(50))).cast("string")).alias("g"), F.pmod(h, F.lit(9973)).alias("v"), F.repeat(F.lit("x"), 20).alias("more"))


def test_places_in_groups(spark):
    df = many(spark)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = rank.place_in_group(df, "g", [F.col("v"), F.col("id")], "place", 13)
    assert got.join(want, ["id", "g", "v", "place"]).count() == 60_000
    tumbled = state.tumbling(df, "g", "v,id", 7).select("id", "window_no")
    assert tumbled.join(want.select("id", F.floor((F.col("place") - 1) / 7).alias("window_no")), ["id", "window_no"]).count() == 60_000


def test_sums_before(spark):
    df = many(spark)
    w = Window.orderBy("v", "id")
    want = df.select("id", (F.row_number().over(w) - 1).alias("row"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    assert rank.share_before(df, ["v", "id"], "v", 11).select("id", "row", "before").join(want, ["id", "row", "before"]).count() == 60_000


def test_nearest_by_ranges(spark):
    df = many(spark).select("id", (F.col("v") * 1.7).alias("x"), "more")
    grid = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(100_000)) / 3).alias("y"), "id")
    got = {small: lookup.nearest_in(df, "x", grid, "y", "id", small).select("id", "nearest_idx") for small in (10, 100_000)}
    assert got[10].join(got[100_000], ["id", "nearest_idx"]).count() == 60_000

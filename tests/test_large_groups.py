"""The first rows of a group that holds most of the table."""

import pytest
from pyspark.sql import functions as F

from loomcut.operators import rank
from loomcut.sources import shared


def test_top_of_a_large_group(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 1000 == 7, None).when(F.col("id") % 500 == 3, "few").otherwise("most").alias("g"), "id", F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 5000).cast("double").alias("v"))
    with shared.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        scored = rank.relative_scores(rows.na.drop(subset=["v"]), "g", ["v"])
        assert "SortMergeJoin" not in scored._jdf.queryExecution().executedPlan().toString()
        got = {(r.g, r.id): r.rank for r in rank.top_n(rows, "g", F.col("v"), ["id"], 150).collect()}
    want = {}
    for g in ("most", "few", None):
        of = sorted((r for r in rows.collect() if r.g == g), key=lambda r: (r.v is None, -(r.v or 0), r.id))
        want |= {(g, r.id): i for i, r in enumerate(of[:150], 1)}
    assert got == want


@pytest.mark.parametrize("values", [[float("nan"), 1.0, None], [2.0] * 9, []])
def test_top_of_odd_values(spark, values):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "g string, id long, v double")
    got = [(r.id, r.rank) for r in rank.top_n(rows, "g", F.col("v"), ["id"], 2).orderBy("rank").collect()]
    assert got == [(i, i + 1) for i in range(min(2, len(values)))]

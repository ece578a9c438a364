"""Queries that stand for an operator over a whole table, without the filters of their namesakes."""

import re

from pyspark.sql import functions as F

from loomcut import queries

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return queries.QUERIES[name](spark, SF)


def test_every_row_takes_part(spark):
    keys = lambda t, k: {r[0] for r in queries.table(spark, SF, t).select(k).collect()}
    for name, t, k in (("prj24_task_seeds_all", "orders", "o_orderkey"), ("wn8_tiles_all", "part", "p_partkey"), ("set5_first_wins_all", "documents", "doc_id"), ("set5_later_wins_all", "documents", "doc_id"), ("jn6_overwrite_nearest_all", "events", "event_id")):
        assert {r[0] for r in rows(spark, name).select(k).collect()} == keys(t, k), name
    # sf0.001 has fewer than 500 parts, so the cut of wn8 shows only in its plan.
    plan = rows(spark, "wn8_tiles_all")._jdf.queryExecution().optimizedPlan().toString()
    assert "500" not in re.sub(r"#\d+", "", plan)  # numbers of columns may well have those digits
    n = queries.table(spark, SF, "documents").select("source").distinct().count()
    assert {r.source_no for r in rows(spark, "tk2_union_limit_overshoot_all").collect()} == set(range(n))


def test_each_entry_is_nearest_of_some(spark):
    at = rows(spark, "jn6_overwrite_nearest_all").select(F.array_position("moved", F.lit(500.0)).alias("at")).distinct()
    assert {r["at"] for r in at.collect()} == {1, 2, 3}


def test_every_twentieth_vector_is_a_query(spark):
    n = queries.table(spark, SF, "embeddings").count()
    assert {r.left_key for r in rows(spark, "jn8_cosine_matrix_all").select("left_key").distinct().collect()} == set(range(0, n, 20))


def test_similarity_blocks_edges(spark):
    from loomcut.operators import metrics

    vectors = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (2, [3.0, -1.0]), (None, [2.0, 4.0]), (5, None), (6, [1.0]), (7, [1.0, None]), (8, [])]
    df = spark.createDataFrame(vectors, "k long, v array<double>").repartition(2)
    want = metrics.similarity_matrix(df, df, "k", "v").collect()
    plain = lambda rs: sorted(((r[0], r[1], None if r[2] is None else round(r[2], 12)) for r in rs), key=repr)
    for block in (2, 512):
        assert plain(metrics.similarity_blocks(df, df, "k", "v", block).collect()) == plain(want)

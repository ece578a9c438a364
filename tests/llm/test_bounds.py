"""Bounds on what is broadcast, and element types of vectors."""

import random

import numpy as np
import pytest
from brute import contamination, roots
from pyspark.sql import functions as F

from loomcut.llm import decontam, embed_dedup


def test_blocks_of_items_stay_within_the_limit(spark):
    draw = random.Random(2)
    text = lambda: " ".join(draw.choices("abcdefghij", k=30))
    items = [(None, text()) for _ in range(200)] + [("x", text()) for _ in range(100)] + [("x", "same text " * 5)] * 50 + [("long", text() * 60), ("none", None), ("empty", "")]
    wanted = spark.createDataFrame(items, "item_id string, text string").select(F.coalesce("item_id", F.lit("")).alias("item"), "text").distinct()
    key, blocks = decontam.item_blocks(wanted, 1000)
    sizes = wanted.groupBy(key.alias("b")).agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).collect()
    assert sorted(r.b for r in sizes) == blocks and len(blocks) > 15 and all((r.size or 0) <= 1000 or r.n == 1 for r in sizes)
    docs = [(i, " ".join([text(), draw.choice(items)[1] or "", text()])) for i in range(20)]
    few = items[::23]
    got = decontam.mark_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(few, "item_id string, text string"), max_index_bytes=300)
    rows = got.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    assert sorted(map(tuple, rows)) == sorted(contamination(docs, few))


@pytest.mark.parametrize("kind", ["int", "bigint", "smallint", "decimal(10,2)", "double", "float"])
def test_element_types(spark, kind):
    draw = np.random.default_rng(7)
    base = draw.integers(-9, 10, (12, 4))
    rows = [(i, (base[i % 12] * (1 + i // 12) + (i % 5 == 0)).tolist()) for i in range(60)] + [(60, [0, 0, 0, 0]), (61, None), (62, [1, 2]), (63, [2, 4]), (64, [1, None, 2, 3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    links = []
    for i, x in rows:
        for j, y in rows[:i]:
            if x and y and len(x) == len(y) and None not in x + y and any(x) and any(y):
                a, b = np.array(x, float), np.array(y, float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9:
                    links.append((i, j))
    root = roots([i for i, _ in rows], links)
    want = {i: (sum(i in e for e in links), root[i]) for i, _ in rows}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.link_vectors(df).collect()}
    assert got == want

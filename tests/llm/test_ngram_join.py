import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from loomcut.llm import ngram_join

SF2 = "/root/testdata/sf0.01"


def groups(df, **options):
    return sorted(tuple(r) for r in ngram_join.similar_groups(df, **options).collect())


def test_brute(spark):
    df = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    assert groups(df) == brute.similar([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("tile", [ngram_join.TILE, 7])
def test_planted(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs, passage = [], [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(r.choice([6, 30, 120, 400]))]
        for c in range(r.choice([2, 5, 40])):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += [" ".join([word() for _ in range(r.randrange(5, 80))] + passage) for _ in range(60)]
    docs += ["a b c d", "A  b\tc d", "a b c d e", "a b c d e f g h i", "a b c d e f g h i j", None, "", " \n ", "a b c d"]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df) == brute.similar(rows)
    assert groups(df, block_bytes=3000) == brute.similar(rows)


def test_edges(spark):
    df = spark.createDataFrame([(5, "x y z", 1), (5, "x y z", 2), (None, "x y z", 3), (9, None, 4)], "doc_id long, text string, node long")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, 1, 5), (5, 1, 5), (None, 1, 5), (9, 0, 9)], key=repr)
    assert groups(df.limit(0)) == []
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "9", "None"]

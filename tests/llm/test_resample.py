"""Hashed n-gram resampling against a plain version."""

import hashlib
import math
import zlib
from collections import Counter

from brute import WORD, lower
from pyspark.sql import functions as F

from loomcut.llm import queries, resample

SF = "/root/testdata/sf0.001"


def plain(docs, target, percent=5, least=20):
    def features(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    all_s, all_t, found = Counter(), Counter(), [(doc, *features(text)) for doc, text in docs]
    for _, _, f in found:
        all_s.update(f)
    for text in target:
        all_t.update(features(text)[1])
    s_sum, t_sum = sum(all_s.values()), sum(all_t.values())
    gain = [math.floor(1000 * math.log((all_t[b] + 1) * (s_sum + 10000) / ((all_s[b] + 1) * (t_sum + 10000)))) for b in range(10000)]
    rows = []
    for doc, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-score, doc is None, doc or 0, i) for i, (doc, n, _, _, score) in enumerate(rows) if n >= least)
    place = {i: r + 1 for r, (*_, i) in enumerate(able[: percent * len(able) // 100])}
    return sorted(((doc, f, weight, score, place.get(i)) for i, (doc, _, f, weight, score) in enumerate(rows)), key=repr)


def answer(spark, docs, target, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, resample.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), **more).collect()), key=repr)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_importance_resampling(spark, SF).collect()), key=repr) == plain(docs, target)


def test_edges_and_long_texts(spark):
    docs = [(i, f"Some Words, of text {i} that IS É über 漢字 x{i % 7} " * 4) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " ,;!\x00\x7f "), (103, "one"), (104, "one two"), (105, "a_b-C 9 " * 4000), (None, "no id here " * 9), (None, None)]
    target = ["some words of benchmark text", None, "", "über 漢字"]
    want = plain(docs, target, percent=30)
    assert answer(spark, docs, target, percent=30) == want
    assert answer(spark, docs, target, percent=30, segment=7) == want  # a text cut into many segments counts the same
    assert answer(spark, docs, []) == plain(docs, [])
    assert answer(spark, [], target) == []


def test_repeated_rows_are_drawn_by_their_places(spark):
    docs = [(1, "these are the very same words in two rows " * 3)] * 20 + [(2, "others " * 30)] * 20
    got = answer(spark, docs, ["very same words"], percent=50)
    assert sorted(r[-1] for r in got if r[-1]) == list(range(1, 21)) and Counter(r[:-1] for r in got) == Counter(r[:-1] for r in plain(docs, ["very same words"], 50))


def test_what_is_dealt_are_segments(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    parts = resample.segments(docs, "text")
    plan = resample.features(parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate posexplode")  # the exchange lies below the explosion


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, 3, 4, "x")], "doc_id long, text string, part int, row int, words string")
    assert resample.resample(docs, docs).first().n_features == 40 + 39 + 38

"""Words whose structure makes a linear hash meet are told apart by every operator on words."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_lm_score import scores
from test_textvec import regular

from loomcut.llm import decontam, lm_score, ngram_join

PAIRS = [regular(n) for n in (9, 10, 11, 12)]


def docs():
    out = []
    for x, y in PAIRS:
        out += [f"one two {x} three {y}", f"one two {y} three {x}", x, y, f"{x} {x} four five six"]
    return list(enumerate(out))


def test_jaccard(spark):
    rows = docs()
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute.similar(rows)


def test_scores(spark):
    rows = docs()
    want = scores(rows, 3)
    for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect():
        assert r.log_score == pytest.approx(want[r.doc_id][1], rel=1e-9)


def test_contamination(spark):
    rows, items = docs(), [(i, x) for i, (x, _) in enumerate(PAIRS)]
    got = decontam.mark_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {d: (n, hit, bad) for d, n, hit, _, _, bad in brute.contamination(rows, items)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in got.collect()} == want

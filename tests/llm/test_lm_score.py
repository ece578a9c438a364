import math
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from loomcut.llm import lm_score

SF = "/root/testdata/sf0.001"


def scores(docs, order=2):
    words = [(d, brute.SPACE.findall(brute.lower(t))) for d, t in docs]
    grams = lambda x: Counter(tuple(x[i : i + k]) for k in range(1, order + 1) for i in range(len(x) - k + 1))
    counts, out = Counter(), {}
    for _, x in words:
        counts.update(grams(x))
    total = sum(len(x) for _, x in words)
    for d, x in words:
        own, s = grams(x), 0.0
        for i in range(len(x)):
            factor = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(x[i - k + 1 : i + 1])
                n = counts[g] - own[g]
                if k == 1:
                    s += math.log(factor * max(n, 1) / total)
                elif n > 0:
                    s += math.log(factor * n / counts[g[:-1]])
                    break
                factor *= lm_score.BACKOFF
        n, t = out.get(d, (0, 0.0))
        out[d] = n + len(x), t + s
    return out


@pytest.mark.parametrize("order, block_bytes", [(2, lm_score.bl.BLOCK_BYTES), (2, 5000), (1, 3000), (3, lm_score.bl.BLOCK_BYTES), (3, 20000), (4, 1)])
def test_brute(spark, order, block_bytes):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = scores([(r.doc_id, r.text) for r in df.collect()], order)
    got = lm_score.score_documents(df, order=order, block_bytes=block_bytes).collect()
    assert {r.doc_id: r.n_words for r in got} == {d: n for d, (n, _) in want.items()}
    for r in got:
        assert r.log_score == pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9)


def test_edges(spark):
    rows = [(1, "a b a b c"), (2, "A b"), (3, None), (4, ""), (5, "lone"), (2, "a b"), (None, "b c b"), (6, "a " * 40000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, bucket int").repartition(3)
    want = scores(rows)
    got = lm_score.score_documents(df).collect()
    assert len(got) == len(want)
    for r in got:
        n, s = want[r.doc_id]
        assert r.n_words == n and r.log_score == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert (r.mean_log_score is None) == (n == 0)
    assert lm_score.score_documents(df.limit(0)).count() == 0

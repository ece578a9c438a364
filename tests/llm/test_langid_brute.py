import math
import unicodedata
from collections import Counter

import pytest

from loomcut.llm import langid

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def grams(text, buckets):
    """Hashed n-grams of one to three characters; letters alone, one blank for all else, one around the text."""
    low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
    s, out = f" {' '.join(low.split())} ", Counter()
    for n in langid.ORDERS:
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if g != " ":
                h = n
                for c in g:
                    h = (h + ord(c)) * 0x9E3779B97F4A7C15 & M
                    h ^= h >> 29
                out[(h >> 20) % buckets] += 1
    return out


def predicted(rows, labelled, buckets, alpha=0.5):
    langs = sorted({x for _, _, x in labelled if x is not None})
    have = Counter(x for _, t, x in labelled if t is not None and x is not None)
    counts = {x: Counter() for x in langs}
    for _, t, x in labelled:
        if t is not None and x is not None:
            counts[x].update(grams(t, buckets))
    totals = {x: sum(c.values()) + alpha * buckets for x, c in counts.items()}
    out = {}
    for d, t, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out[d] = "und", 0.0
            continue
        mine = grams(t, buckets)
        logs = [math.log(have[x] / sum(have.values())) + sum(n * math.log((counts[x][g] + alpha) / totals[x]) for g, n in mine.items()) for x in langs]
        top = max(logs)
        out[d] = langs[logs.index(top)], 1 / sum(math.exp(x - top) for x in logs)
    return out


def test_brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()] + [(-1, "Hello", None), (-2, "x", None), (-3, "été, où?", None), (-4, "ß1ß", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, buckets=4096)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    want = predicted(rows, rows, 4096)
    assert {d: x for d, (x, _) in got.items()} == {d: x for d, (x, _) in want.items()}
    for d, (_, s) in got.items():
        assert s == pytest.approx(want[d][1], rel=1e-6, abs=1e-9)

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline as p

SF2 = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    """Each stage against a plain version, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect()]
    got = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF2)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        assert tuple(docs.columns[:5]) == p.COLUMNS
    all_docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()]
    assert len(got["language_id"]) >= 0.97 * sum(any(c.isalpha() for c in t or "") for _, t in all_docs)
    keep = {d for d, _, root in brute.similar([x[:2] for x in got["language_id"]]) if d == root}
    assert sorted(x[0] for x in got["near_duplicates"]) == sorted(keep)
    clean = [d for d, *_, bad in brute.contamination([x[:2] for x in got["near_duplicates"]], items) if not bad]
    assert sorted(x[0] for x in got["decontamination"]) == sorted(clean)
    copies = Counter(x[0] for x in got["source_mixture"])
    sizes = {}
    for d, t, s in got["decontamination"]:
        sizes[s] = sizes.get(s, 0) + len(brute.SPACE.findall(t))
    want, taken = brute.targets(sizes), Counter()
    for d, t, s in got["decontamination"]:
        taken[s] += copies[d] * len(brute.SPACE.findall(t))
    assert max(copies.values()) <= 3 and all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 40 for s in want)
    assert Counter(x[0] for x in got["sharding"]) == copies

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
LONG = "the house and the tree of the old river runs under a light that no one sees at night again "
OTHERS = {"score": "double", "lang_pred": "string", "placements": "string", "n_words": "int", "contaminated": "string", "size": "string", "target": "int", "Shard_x": "int", "id": "int", "words": "string", "node": "int"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, LONG * 3, "en", "a", 1), (2, LONG * 3, "en", None, 2), (2, LONG * 3, "en", None, 2), (None, LONG + "one more", "en", "a", 3), (None, None, None, None, None), (3, None, "en", "b", 0),
    (4, "", "en", "b", 0), (5, "  ", None, "b", 2), (6, LONG * 4000, "en", "c", 9), (7, "das haus und der baum die der fluss unter dem licht, das niemand sieht in der nacht", "de", "b", 9),
    (8, "short", "en", "b", 5), (8, "das ist kurz und gut", "de", "b", 9),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, *([None] * len(OTHERS))) for r in rows], SCHEMA + "".join(f", {c} {t}" for c, t in OTHERS.items())).withColumns({c: F.lit(i - 5).cast(t) for i, (c, t) in enumerate(OTHERS.items())})


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_odd_rows(spark, name, stage):
    docs = table(spark, ROWS)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(str(r[c]) == str(docs.first()[c]) for r in rows for c in OTHERS)
    keys = [(r.doc_id, r.text, r.source) for r in rows]
    assert set(keys) <= {(d, t, s) for d, t, _, s, _ in ROWS}
    if name == "language_id":
        assert len(keys) == len([r for r in ROWS if (r[1] or "").strip()])
    elif name == "near_duplicates":
        assert sorted(map(str, keys)) == sorted(map(str, [(d, t, s) for d, t, _, s, _ in ROWS if d not in (2, 6)]))  # the long text repeats the shingles of the first
    elif name == "decontamination":
        assert len(keys) == len(ROWS)
    elif name == "sharding":
        assert len(keys) == len(ROWS) and {r.shard for r in rows} == {""}
    else:
        assert all(keys.count(k) <= 3 * ROWS.count(next(r for r in ROWS if (r[0], r[1], r[3]) == k)) for k in keys)


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_empty_table(spark, name, stage):
    docs = table(spark, []).limit(0)
    out = stage(spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        docs = p.common.stored(stage(spark, docs, SF), name)
    key = lambda df: sorted((r.doc_id, r.shard, r.shard_bytes) for r in df.collect())
    assert key(p.run(spark, SF)) == key(docs)

import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from loomcut.llm import chatfmt, decontam, langid, mixture, queries, shard, tokenbin

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def docs(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def duck(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in Path(sf).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    cols, want = duck(queries.ORACLE[name])
    assert rows(queries.QUERIES[name](spark, SF), *cols) == sorted(want, key=repr)


def test_contamination_brute(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect()]
    got = rows(queries.op10_decontamination(spark, SF2), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(docs(spark, SF2), items), key=repr)


EDGE = [(1, "a b c d e f g h i j k"), (2, "x a b c d e f g h i j y"), (3, None), (4, ""), (5, "short ONE"), (6, "a short one, short one!"), (7, "a b c d e f g h i j " * 300), (2, "x a b c d e f g h i j y"), (None, "é short  one É")]
ITEMS = [(1, "a b c d e f g h i j"), (2, "Short one"), (2, "b c d e f g h i j k"), (3, None), (4, ""), (5, "é"), (None, "short one é")]


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_contamination_edges(spark, limit):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in EDGE], "doc_id long, text string, n_hit int, spans string")
    out = decontam.mark_contamination(df, spark.createDataFrame(ITEMS, "item_id long, text string"), max_index_bytes=limit)
    assert out.columns == ["doc_id", "text", "spans", "n_words", "n_hit", "hit_spans", "item_ids", "contaminated"]
    got = rows(out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated"), "*")
    assert got == sorted(brute.contamination(EDGE, ITEMS), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.mark_contamination(df, none).where("contaminated or n_hit > 0").count() == 0
    assert decontam.mark_contamination(df.limit(0), none).count() == 0


def test_tokens_brute(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(queries.op8_token_output(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got) == brute.tokens(docs(spark), tok)


def test_tokens_edges(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["", None, "a  b\n\n\n c\t\td ", "<|endoftext|>x <|endoftext|>", "  lead", "emoji 😀 漢字  wide nb ​", "it's we'll they've 's 12ab34 _a-b!", "é" * 5000 + " x" * 5000, "\r\n a\x0b\x0c b \x1c\x85 c", "ɏɐ ½ ² ª º À×÷"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, part long").repartition(3)
    tokenbin.write_tokens(df, str(tmp_path / "t"), path)
    back = tokenbin.read_tokens(spark, str(tmp_path / "t"))
    assert sorted(rows(tokenbin.with_checksum(back), "*")) == brute.tokens(list(enumerate(texts)), tok)
    for r in back.collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == [*ids, 0]
    assert sorted(r.doc_id for r in tokenbin.read_tokens(spark, str(tmp_path / "t"), 3, 5).collect()) == [3, 4, 5]
    tokenbin.write_tokens(df.limit(0), str(tmp_path / "e"), path)
    assert tokenbin.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_language_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = queries.op6_language_id(spark, SF2).collect()
    assert len(got) == len(langs)
    import zlib

    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held if r.lang_pred != "und") / len(held) > 0.97


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the quick house and the", "en", 1.0), (2, "das haus und der die", "de", 2.0), (3, None, "en", 0.0), (4, "12 %% 3", None, 0.0), (5, "", "de", 0.0), (6, "the and " * 50000, None, 0.0)], "doc_id long, text string, lang string, score double")
    model = langid.fit(df)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_shards_small_limit(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50), i) for i in range(1000)] + [(5000, "y" * 3000, 1), (None, None, 2), (7, "z" * 500, 3), (7, "z" * 500, 3)], "doc_id long, text string, prefix long")
    got = shard.assign_shards(df, max_bytes=600, step=3).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for s, own in by.items():
        total = sum(len(r.text or "") for r in own)
        assert total == own[0].shard_bytes and len(own) == own[0].shard_docs and len(s) == own[0].shard_depth
        assert total <= 600 or len({r.doc_id for r in own}) == 1
        if s:
            sibling = [r for r in got if r.shard.startswith(s[:-1])]
            assert sum(len(r.text or "") for r in sibling) > 600
    assert {r.shard for r in shard.assign_shards(df).collect()} == {""}
    assert shard.assign_shards(df.limit(0)).count() == 0


def check_mix(spark, df, got, shards):
    sizes = {}
    for r in df.select("source", "text").collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.SPACE.findall(r.text or ""))
    want, taken = brute.targets(sizes), {}
    for r in got:
        assert r.size == len(brute.SPACE.findall(r.text or ""))
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert len(r.placements) <= 3 and all(0 <= p.shard < shards for p in r.placements)
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.placements)
    return want, taken


def test_mixture(spark):
    df = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "source", "text")
    out = mixture.mix(df, shards=8)
    got = out.collect()
    want, taken = check_mix(spark, df, got, 8)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 40), (s, taken[s], want[s])
    assert sorted((r.doc_id, str(r.placements)) for r in got) == sorted((r.doc_id, str(r.placements)) for r in mixture.mix(df.repartition(5), shards=8).collect())
    loads = {}
    for r in got:
        for p in r.placements:
            loads[p.shard] = loads.get(p.shard, 0) + r.size
    assert len(loads) == 8 and mixture.materialize(out).count() == sum(len(r.placements) for r in got)


def test_mixture_edges(spark):
    df = spark.createDataFrame([(1, "a", "x y z", 9), (2, None, "p q", 9), (2, None, "p q", 9), (3, "b", None, 9), (None, "a", "", 9), (4, "é", "w " * 5000, 9)], "doc_id long, source string, text string, h int").withColumn("p_idx", F.lit(1)).withColumn("target", F.lit("x")).withColumn("pick", F.lit(2))
    got = mixture.mix(df, shards=3).collect()
    assert len(got) == 6
    check_mix(spark, df, got, 3)
    assert mixture.mix(df.limit(0)).count() == 0


def test_hypergeometric(spark):
    from math import comb

    import numpy as np

    for k, n, d in [(5, 20, 8), (0, 9, 4), (30, 30, 12), (700, 2000, 900)]:
        us = np.linspace(0.0005, 0.9995, 41)
        got = spark.createDataFrame([(float(u),) for u in us], "u double").selectExpr(mixture.hypergeometric(str(k), str(n), str(d), "u") + " as x").collect()
        cdf = np.cumsum([comb(k, x) * comb(n - k, d - x) / comb(n, d) if 0 <= d - x <= n - k else 0 for x in range(k + 1)])
        assert [r.x for r in got] == [int(np.searchsorted(cdf, u)) for u in us]


def test_chat_round_trip(spark):
    texts = ["a\\b", "\\\\", "<|end|>\n<|role|>x", "</s>[INST] ok [/INST]", "\\x3c|", "<<SYS>>\\x5b<</s>", "", None, "é\n漢"]
    rows_ = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "<|x|>"] * 3, texts))] + [(None, None, None, "n"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chatfmt.format_chat(chatfmt.from_rows(df)).withColumn("f", chatfmt.formatted(F.col("segments")))
    out = out.select("*", chatfmt.read_turns(F.col("f")).alias("back"), chatfmt.loss_spans(F.col("segments")).alias("spans"), chatfmt.read_loss(F.col("segments")).alias("loss"))
    for r in out.collect():
        assert r.back == r.turns
        assert r.f.count("<|") == 3 * len(r.turns) and "[INST]" not in r.f and "</s>" not in r.f
        assert [t.text for t in r.turns if t.role == "assistant"] == r.loss
        assert len(r.spans) == len(r.loss)
    assert chatfmt.format_chat(chatfmt.from_rows(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    import json

    recs = [{"prompt": "p", "completion": "c"}, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "i", "input": "x", "output": "o"}, [{"role": "user", "content": "l"}], {"odd": 1}, {"question": None, "answer": "a"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(90, None), (91, "{bad")], "v long, record string")
    got = {r.v: (r.layout, [tuple(t) for t in r.turns]) for r in chatfmt.normalize(df).collect()}
    assert got[0] == ("prompt-completion", [("user", "p"), ("assistant", "c")])
    assert got[1] == ("messages", [("user", "hi"), ("assistant", "yo")])
    assert got[2] == ("conversations", [("user", "q"), ("assistant", "a")])
    assert got[3] == ("instruction-input-output", [("user", "i\n\nx"), ("assistant", "o")])
    assert got[4] == ("turn-list", [("user", "l")])
    assert got[6] == ("question-answer", [("user", None), ("assistant", "a")])
    assert got[5] == got[90] == got[91] == (None, [])


def mix_brute(rows, hashes, most=3.0, blocks=2048, block_words=20000, slice_docs=4000, near=500):
    """How often each row (key, source, size, h) is taken; hashes: the engine's hash of (block order) and (slice)."""
    from math import ceil

    sizes, groups = {}, {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + size
    want, unit = brute.targets(sizes), max(block_words, -(-sum(sizes.values()) // blocks))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    taken = [0] * len(rows)
    for i, (_, s, size, h) in enumerate(rows):
        groups.setdefault((s, h % max(1, ceil(sizes[s] / unit))), []).append(i)
    for idx, s in enumerate(names):
        own = sorted((hashes["order"](idx, b), b) for x, b in groups if x == s)
        passes = int(want[s] / sizes[s] + 1e-12) if sizes[s] else 1
        left = max(0.0, want[s] - passes * sizes[s])
        for _, b in own:
            docs = groups[s, b]
            words = sum(rows[i][2] for i in docs)
            for i in docs:
                taken[i] += passes
            if left <= 0:
                continue
            if words <= left:
                if passes < ceil(most):
                    for i in docs:
                        taken[i] += 1
                left -= words
                continue
            slices = {}
            for i in docs:
                slices.setdefault(hashes["slice"](rows[i][3]) % max(1, ceil(len(docs) / slice_docs)), []).append(i)
            for at in sorted(slices):
                part = sorted(slices[at], key=lambda i: (rows[i][3], rows[i][2]))
                words = sum(rows[i][2] for i in part)
                if words < left:
                    for i in part:
                        taken[i] += 1
                    left -= words
                    continue
                total, fits = 0, 0
                for i in part:
                    total += rows[i][2]
                    fits += total <= left
                low = fits - near
                for i in part[: max(low, 0)]:
                    taken[i] += 1
                    left -= rows[i][2]
                close = [(j + 1, i) for j, i in enumerate(part) if low < j + 1 <= low + 2 * near]
                for _, _, i in sorted((-rows[i][2], nr, i) for nr, i in close):
                    if rows[i][2] <= left:
                        taken[i] += 1
                        left -= rows[i][2]
                break
            left = 0.0
    return taken


@pytest.mark.parametrize("options, near", [({}, 500), ({"block_words": 900, "slice_docs": 3}, 2), ({"block_words": 10**9, "slice_docs": 7}, 3)])
def test_mixture_brute(spark, monkeypatch, options, near):
    monkeypatch.setattr(mixture, "NEAR", near)
    df = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "source", "text")
    h = F.xxhash64(F.lit(7), F.col("doc_id").cast("string"), F.octet_length("text"))
    given = [(r.doc_id, r.source, len(brute.SPACE.findall(r.text or "")), r.h) for r in df.withColumn("h", F.coalesce(h, F.xxhash64(F.lit(7), F.col("doc_id").cast("string")))).collect()]
    order = {(r.i, r.b): r.o for r in spark.range(30).crossJoin(spark.range(2200).withColumnRenamed("id", "b")).select(F.col("id").cast("int").alias("i"), "b", F.xxhash64(F.lit(7), F.lit("order"), F.col("id").cast("int"), "b").alias("o")).collect()}
    cut = {r.h: r.x for r in spark.createDataFrame([(h,) for *_, h in given], "h long").select("h", F.xxhash64(F.lit(7), F.lit("slice"), "h").alias("x")).collect()}
    want = mix_brute(given, {"order": lambda i, b: order[i, b], "slice": cut.get}, near=near, **options)
    got = {r.doc_id: len(r.placements) for r in mixture.mix(df, **options).collect()}
    assert got == {r[0]: n for r, n in zip(given, want)}

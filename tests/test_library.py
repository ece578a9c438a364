"""Edge cases of the library's operators, against plain Python."""

import io
import math
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcut.functions import frames, judge, pixels, schedule, text, vector
from loomcut.operators import cascade, combine, lookup, metrics, order, rank
from loomcut.plans import graph, steps
from loomcut.sources import archive, files
from loomcut.streaming import state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_rank_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 1.0, 7.0), ("b", 2.0, None)], "g string, x double, y double")
    got = {(r.g, r.y): r.avg_rel for r in rank.relative_scores(df, "g", ["x", "y"]).collect()}
    assert got[("a", 5.0)] == 0.25 and got[("a", 7.0)] == 0.75 and got[("b", None)] == 0.5


def overshoot(sizes, cap):
    out, n = [], 0
    for s, size in enumerate(sizes):
        for i in range(size):
            out.append((s, i))
            n += 1
            if n >= cap:
                break
    return out


@pytest.mark.parametrize("sizes,cap", [([5, 5, 5], 7), ([3, 0, 4, 1], 3), ([2, 2], 9), ([0, 0, 3], 1), ([4, 4, 4], 4)])
def test_union_limit(spark, sizes, cap):
    parts = [spark.createDataFrame([(i,) for i in range(n)], "k int") for n in sizes]
    got = sorted((r._source, r.k) for r in combine.union_limit(parts, cap, ["k"]).collect())
    assert got == overshoot(sizes, cap)
    assert combine.union_limit(parts, cap, ["k"], strict=True).count() == min(cap, sum(sizes))


def test_lookup_and_fill(spark):
    left = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "v string")
    right = spark.createDataFrame([(1, 5.0, 0), (1, 7.0, 1), (2, float("nan"), 0), (4, 1.0, 0)], "k int, d double, o int")
    df = combine.lookup(left, right, "v", "k", "d", "o", "d")
    assert {r.v: r.d for r in df.collect()} == {"1": 7.0, "2": None, "3": None, "4": 1.0}
    assert {r.v: r.d for r in combine.fill_upper_median(df, "d").collect()} == {"1": 7.0, "2": 7.0, "3": 7.0, "4": 1.0}


def test_broadcast_pairs(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x])
    assert [tuple(p) for p in one(spark, combine.broadcast_pairs(a("p"), a(1, 2)))] == [("p", 1), ("p", 2)]
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, combine.broadcast_pairs(a("p", "q"), a(1, 2, 3)))


def test_cascade_stages(spark, tmp_path):
    log = tmp_path / "seen"

    def scorer(pdf, p):
        with open(log, "a") as f:
            f.write("x" * len(pdf))
        if (pdf["id"] == 7).any():
            raise ValueError("bad row")
        return pd.DataFrame({"s": pdf["id"] * 1.0})

    slow = cascade.Filter("slow", lambda p: F.col("s") >= p["least"], {"least": 5.0}, scorer=scorer, schema="s double")
    cheap = cascade.Filter("cheap", lambda p: F.col("id") < 10)
    got = {r.id: r for r in cascade.run(spark.range(100).coalesce(1), [cheap, slow], {"slow": {"least": 6.0}}).collect()}
    assert len(got) == 100 and {i for i, r in got.items() if r.filter_pass} == {6, 8, 9}
    assert got[7].filter_slow_error == "ValueError: bad row" and got[50].filter_slow_pass is None
    assert len(log.read_text()) < 200  # the slow one never saw all rows
    with pytest.raises(ValueError, match="known"):
        cascade.run(spark.range(1), ["nope"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 6), st.integers(1, 4))
def test_length_grouped(spark, lengths, size, mult):
    df = spark.createDataFrame([*enumerate(lengths)], "k long, n long")
    got = order.length_grouped(df, "k", "n", size, mult).collect()
    assert sorted(r.pos for r in got) == [*range(len(lengths))]
    tail = len(lengths) % size
    by = {}
    for r in got:
        by.setdefault(r.group_id, []).append(r.pos)
    assert all(max(p) // size == min(p) // size for p in by.values())
    if tail:
        assert [g for g in by if len(by[g]) == tail and max(by[g]) == len(lengths) - 1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 81, 82])
def test_frames(spark, n):
    want = n if n <= 1 else max(1, max(m for m in range(-4, n + 1) if m % 4 == 1))
    assert one(spark, frames.snap_down(F.lit(n), 4, 1)) == want
    k = min(8, n)
    want = [0] if k == 1 else [int(x) for x in np.linspace(0, n - 1, k)] if k else []
    assert one(spark, frames.spread(F.lit(n), 8)) == want
    starts = one(spark, frames.chunk_starts(F.lit(n), 5, 3))
    assert starts == [*range(0, n - 4, 3)]


def test_per_second_ties(spark):
    assert one(spark, frames.per_second(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.5, 2.5)]))) == [0, 1, 2]


def test_text(spark):
    assert one(spark, text.canonicalize(F.lit(" A_b,  C! <k>"), keep="<k>")) == "a b c <k>"
    assert one(spark, text.whitespace_clean(F.lit("a  b\n"))) == "a b"
    assert one(spark, text.html_unescape_twice(F.lit(" &amp;lt;b "))) == "<b"
    assert one(spark, text.stem(F.lit("/a/b.tar.gz"))) == "b.tar" and one(spark, text.stem(F.lit("/a/b"))) == "b"
    assert one(spark, text.strip_suffixes(F.lit("x.TAR.gz"), [".gz", ".tar.gz"])) == "x"
    assert one(spark, text.to_absolute(F.lit("/x"), "/b")) == "/x" and one(spark, text.to_absolute(F.lit("x"), "")) == "x"
    assert one(spark, text.relative(F.lit("/r/a/b"), "/r/")) == "a/b" and one(spark, text.relative(F.lit("/r/f"), "/r/f")) == "f"
    assert text.parse_override("blur.min=-5") == ("blur", "min", -5) and text.parse_override("blur.min=x") == ("blur", "min", "x") and text.parse_override("bad") is None
    with pytest.raises(Exception, match="no route"):
        one(spark, text.route(F.lit("z"), [(("a",), lambda c: c)], F.lit("z")))


def test_judge(spark):
    assert one(spark, judge.json_text(F.lit('<think>{"a":0}</think> so {"b": 1} ok'))) == '{"b": 1}'
    assert one(spark, judge.json_text(F.lit("none"))) is None
    assert one(spark, judge.repaired_json(F.lit("{'a': 1}"))) == '{"a": 1}'
    assert one(spark, judge.labelled_number(F.lit("**Style Score (1-5)：** 4.5"), "style score")) == 4.5
    assert [one(spark, judge.score_value(F.lit(x))) for x in ("2", "1.7", "N/A", "9", "0")] == [100.0, 60.0, None, None, 0.0]
    assert one(spark, judge.first_number(F.lit("x -3.5 y"))) == -3.5


def test_vectors_and_frechet(spark):
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)] + [(2, [1.0, 2.0, 3.0, 4.0])], "g int, v array<double>").repartition(5)
    stats = metrics.activation_stats(df, "g", "v")
    got = {r.g: r for r in stats.collect()}
    assert np.allclose(np.reshape(got[0].cov, (4, 4)), np.cov(x[::2].T)) and got[2].cov == [0.0] * 16
    assert metrics.frechet_distance(stats, "g", 0, 0).first().distance == pytest.approx(0, abs=1e-6)
    a, b = metrics.frechet_distance(stats, "g", 0, 1).first().distance, metrics.frechet_distance(stats, "g", 1, 0).first().distance
    assert a == pytest.approx(b, rel=1e-6) and a > 0


def test_nearest(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (10.0,), (15.0,), (99.0,)], "x double")
    grid = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 20.0)], "i int, g double")
    want = [0, 0, 1, 1, 2]
    assert [r.nearest_idx for r in lookup.nearest_in(df, "x", grid, "g", "i").orderBy("x").collect()] == want
    assert [r.i for r in df.orderBy("x").select(lookup.nearest(F.col("x"), [0.0, 10.0, 20.0])["idx"].alias("i")).collect()] == want


@pytest.mark.parametrize("name", sorted(schedule.TEMPLATES))
def test_schedules(spark, name):
    got = [r.sigma for r in schedule.sigmas(spark, name, 20).orderBy("step").collect()]
    assert len(got) == 20 and all(a > b for a, b in zip(got, got[1:])) and got[0] == pytest.approx(1.0)
    end = {"Qwen-Image": 0.02, "LTX-2": 0.1}.get(name)
    assert end is None or got[-1] == pytest.approx(end)


def test_pixels(spark):
    h = w = 64
    base = np.random.default_rng(1).integers(60, 200, (h, w, 3), np.uint8)
    black = base.copy()
    black[:10] = 0
    white, dark = np.full((h, w, 3), 255, np.uint8), np.zeros((h, w, 3), np.uint8)
    rows = [("n", h, w, base.tobytes()), ("b", h, w, black.tobytes()), ("w", h, w, white.tobytes()), ("d", h, w, dark.tobytes())]
    got = {r.clip_id: r for r in pixels.clip_measures(spark.createDataFrame(rows, "clip_id string, h int, w int, data binary")).collect()}
    assert got["n"].border_pass and not got["b"].border_pass and got["b"].border_top == 10 and got["b"].border_left == 0
    assert got["w"].overexposed_fraction == 1 and got["d"].underexposed_fraction == 1 and got["w"].blur_score == 0 and got["n"].blur_score > 50
    dx, dy = np.ones((20, 20)), np.zeros((20, 20))
    assert pixels.flow_statistics(dx, dy, 1.0) == (1.0, 1.0) and pixels.flow_statistics(dx[:5], dy[:5], 0.0) == (1.0, 0.0)


def test_files(spark, tmp_path):
    for n in ("b/x10.MP4", "b/x9.mp4", "a.txt", "c.mkv"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"12345")
    found = files.scan(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["x10.MP4", "x9.mp4", "c.mkv"]
    assert [r.path.rsplit("/", 1)[1] for r in files.natural_order(found).collect()] == ["c.mkv", "x9.mp4", "x10.MP4"]

    def prober(path):
        if path.endswith("mkv"):
            raise OSError("no header")
        return {"width": 4, "height": 3, "fps": 25.0, "duration": 2.0}

    got = {r.path[-5:]: r for r in files.probe(found, prober).collect()}
    assert got["c.mkv"].error == "OSError: no header" and got["c.mkv"].width is None and got["9.mp4"].width == 4
    (tmp_path / "m.jsonl").write_text('{"video_path": "", "path": "p"}\n\n{"video_path": "v", "path": null}\n')
    df = files.read_metadata(spark, str(tmp_path / "m.jsonl"), "video_path string, path string")
    assert sorted(r.k for r in df.select(files.record_key().alias("k")).collect() if r.k) == ["p", "v"]
    with pytest.raises(ValueError, match="blank"):
        files.read_metadata(spark, str(tmp_path / "m.jsonl"), strict=True)
    caps = spark.createDataFrame([("a", " hi, \"x\" "), ("b", None)], "video_path string, caption string")
    files.write_train_csv(caps, str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_metadata(spark, str(tmp_path / "csv")).collect()] == [("a", 'hi, "x"')]


def test_archives(spark, tmp_path):
    def tar(name, members):
        buf = io.BytesIO()
        with tarfile.open(fileobj=buf, mode="w") as t:
            for n in members:
                i = tarfile.TarInfo(n)
                i.size = 3
                t.addfile(i, io.BytesIO(b"abc"))
        (tmp_path / name).write_bytes(buf.getvalue())
        return buf.getvalue()

    tar("one.tar", ["a.mp4", "b.txt"])
    tar("evil.tar", ["../x.mp4"])
    whole = tar("tmp.tar", ["s1.mkv", "s2.mp4"])
    (tmp_path / "tmp.tar").unlink()
    (tmp_path / "split.tar.000").write_bytes(whole[:700])
    (tmp_path / "split.tar.001").write_bytes(whole[700:])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/q.mp4", "zz")
    got = {r.archive.rsplit("/", 1)[1]: r.videos for r in archive.count_videos(spark, str(tmp_path)).collect()}
    assert got == {"one.tar": 1, "evil.tar": 0, "split.tar": 2, "z.zip": 1}
    rows = archive.list_members(spark, str(tmp_path), content=True).collect()
    assert {r.member: bytes(r.data) for r in rows if r.member}["d/q.mp4"] == b"zz" and any("unsafe" in (r.error or "") for r in rows)
    spark.dataSource.register(archive.ArchiveSource)
    df = spark.read.format("archive").option("paths", str(tmp_path / "z.zip")).load()
    assert [(r.member, r.size) for r in df.collect()] == [("d/q.mp4", 2)]


def test_plans(spark):
    reg = {"x": steps.Dataset("x", "r", "d"), "y": steps.Dataset("y", "r", "d")}
    tasks = steps.plan(reg, ["all"], ["csv", "locate"])
    assert [(t.dataset.name, t.step) for t in tasks] == [("x", "locate"), ("x", "csv"), ("y", "locate"), ("y", "csv")]
    with pytest.raises(ValueError, match="unknown step"):
        steps.plan(reg, ["x"], ["nope"])

    def fail(d):
        raise OSError("gone")

    ran = []
    acts = {"locate": fail, "csv": ran.append}
    assert len(steps.run(tasks, acts)) == 1 and not ran
    assert len(steps.run(tasks, acts, go_on=True)) == 2 and len(ran) == 2
    e = graph.edges(spark.createDataFrame([(1, "a"), (2, "a")], "unit long, param string"), spark.createDataFrame([(0, "a"), (1, "a")], "unit long, param string"))
    assert sorted(tuple(r) for r in e.collect()) == [(0, 1), (1, 2)]


def test_state(spark):
    slots = []
    for i in range(50):
        state.push(slots, i, i, 8, 0)
    assert len(slots) == 8 and slots[state.slot_of(49, 8, 0)] == 49
    a = F.array(*[F.lit(x) for x in (9.0, 1.0, 1.0, 3.0, 0.5)])
    assert one(spark, state.threshold_reset(a, 2.0)) == [True, False, True, True, True]
    assert math.isclose(one(spark, cascade.jitter(F.array(F.lit(1.0), F.lit(3.0)))), 1 / (2 + 1e-8))


def test_scoring(spark, tmp_path):
    from loomcut import __main__ as cli
    from loomcut.operators import scoring

    def score(model, pdf):
        if (pdf["id"] == 3).any():
            raise ValueError("bad")
        return pdf["id"] * model

    m = scoring.Metric("m", lambda: 2.0, score)
    assert m.compute(spark.range(5)).first().value == pytest.approx((0 + 2 + 4 + 8) / 4)
    videos = spark.createDataFrame([("a",), ("bad",)], "video_path string")
    got = {r.video_path: r.caption for r in scoring.caption(videos, lambda p: {"a": "A"}[p]).collect()}
    assert got == {"a": "A", "bad": None}
    (tmp_path / "r.json").write_text('{"x": ["/r", "/d"]}')
    assert [t.step for t in cli.main([str(tmp_path / "r.json"), "--steps", "csv", "locate"])] == ["locate", "csv"]

import math

import pytest
from pyspark.sql import functions as F

from loomcut.functions import mapping, options
from loomcut.operators import combine, lookup, metrics, scoring
from loomcut.sources import files, sinks


def test_config():
    got, unknown = options.resolve({"rate": 1, "steps": 2, "name": "x"}, {"train": {"rate": 3, "deep": {"steps": 4}}, "odd": 5}, {"steps": 6})
    assert got == {"rate": 3, "steps": 6, "name": "x"} and unknown == ["odd"]


def test_read_config(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 1}}')
    assert options.flatten(options.read_config(str(tmp_path / "a.json"))) == {"b": 1}
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("a:\n  b: 1\nc: x\n")
    assert options.flatten(options.read_config(str(tmp_path / "a.yaml"))) == {"b": 1, "c": "x"}


def test_retries_wait_and_give_up():
    waits, calls = [], []

    def work(error):
        calls.append(1)
        raise error

    with pytest.raises(OSError):
        options.retried(work, sleep=waits.append)(OSError("x"))
    assert waits == [2.0, 5.0] and len(calls) == 3
    with pytest.raises(FileNotFoundError):
        options.retried(work, sleep=waits.append)(FileNotFoundError("x"))
    assert len(calls) == 4


def test_expand():
    assert options.expand("~/x/$A/${B}", {"HOME": "/h", "A": "1", "B": "2"}) == "/h/x/1/2"
    with pytest.raises(ValueError):
        options.expand("$NOPE/x", {})


def test_dimensions():
    known = {"Quality": ["Sharp", "Clean"], "Style": ["Own"]}
    want = [("Quality", "Sharp"), ("Quality", "Clean")]
    assert options.dimensions("Quality", known) == options.dimensions({"Quality": []}, known) == want
    assert options.dimensions("Quality / Clean; Style", known) == [("Quality", "Clean"), ("Style", "Own")]
    assert options.dimensions("Quality, Style", known) == options.dimensions(["Quality", {"Style": ["Own"]}], known) == [*want, ("Style", "Own")]
    with pytest.raises(ValueError, match="unknown dimension"):
        options.dimensions("Quality / Odd", known)


def test_loader_and_search():
    assert options.loader_options(True, None) == {"shuffle": True, "sampler": None}
    with pytest.raises(ValueError):
        options.loader_options(True, object())
    mean, best = options.evolve(lambda x: -sum((v - 3) ** 2 for v in x), [0.0, 0.0], 40, 60, 12, spread=4.0)
    assert all(abs(m - 3) < 0.05 for m in mean) and best[-1] > best[0]
    assert options.evolve(sum, [0.0], 3, 5, 2) == options.evolve(sum, [0.0], 3, 5, 2)


def test_known_metrics(spark):
    m = scoring.named("clip", lambda: 2.0, lambda model, pdf: [model * v for v in pdf["id"]])
    assert m.compute(spark.range(4)).first()["value"] == 3.0 and len(scoring.KNOWN) == 12
    for name in ("nope", "fid"):
        with pytest.raises(ValueError):
            scoring.named(name, int, None)


def test_rounding_by_exact_value(spark):
    xs = [2.675, 0.12345, 1.005, -2.5, 0.5, 1e300, None, float("nan")]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", mapping.rounded(2)("x").alias("y")).collect()
    for r in got:
        x = xs[r.i]
        assert r.y is None or math.isnan(r.y) if x is None or math.isnan(x) else r.y == round(x, 2)


def test_nearest_in_a_large_grid(spark):
    grid = spark.createDataFrame([(float(v), i) for i, v in enumerate([5, 1, 9, 9, 30, -4, 100, 2.5])] + [(None, 99)], "v double, i long").repartition(3)
    df = spark.createDataFrame([(k, x) for k, x in enumerate([0.0, 3.0, 7.0, 9.0, 65.0, 1000.0, -50.0, 1.75, None])], "k int, x double").repartition(3)
    got = lambda small: sorted((r.k, r.nearest_idx) for r in lookup.nearest_in(df, "x", grid, "v", "i", small).collect())
    assert got(2) == got(100_000) == [(0, 1), (1, 7), (2, 0), (3, 2), (4, 4), (5, 6), (6, 5), (7, 1), (8, None)]
    for small in (0, 10):
        assert {r.nearest_idx for r in lookup.nearest_in(df, "x", grid.limit(0), "v", "i", small).collect()} == {None}


def test_percentiles(spark):
    import numpy as np

    df = spark.createDataFrame([(1.0,), (5.0,), (5.0,), (7.0,), (None,), (20.0,)], "v double")
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    assert combine.percentiles(df, "v", shares).first()["p"] == pytest.approx(np.percentile([1, 5, 5, 7, 20], [100 * s for s in shares]).tolist())
    assert combine.upper_median(df, "v").first()["median"] == 5.0 and combine.upper_median(df.limit(0), "v").first()["median"] is None


def test_no_route_raises(spark):
    df = spark.createDataFrame([('{"a": 1}',)], "x string").select(F.parse_json("x").alias("v"))
    with pytest.raises(Exception, match="no route for type map"):
        df.select(mapping.by_type(F.col("v"), [(("string",), lambda v: F.lit("s"))])).collect()


def test_repeats_and_gates(spark):
    df = spark.createDataFrame([(7,), (8,)], "k long")
    assert sorted((r["item"], r.k) for r in mapping.repeated(df, 2, "k").collect()) == [(0, 7), (1, 8), (2, 7), (3, 8)]
    assert mapping.repeated(df, 2, "k", most=0).count() == 0 and mapping.repeated(df.limit(0), 2, "k").count() == 0
    with pytest.raises(Exception, match="as many prompts"):
        spark.range(1).select(mapping.schedule(F.array(F.lit("a"), F.lit("b")), F.lit(3))).collect()
    got = spark.createDataFrame([("x = 'a=b'\ny=1,\nx = \"c\"\nz == 2\n # w = 3",)], "c string").select(mapping.assignments(F.col("c"))).first()[0]
    assert got == {"y": "1", "x": "c"}


def test_strict_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"video_path": "/a"}\n{"path": "/b"}\n')
    with pytest.raises(Exception, match="no video_path"):
        files.read_video_paths(spark, str(tmp_path / "a.jsonl")).collect()
    with pytest.raises(ValueError, match="no images"):
        files.images(spark, str(tmp_path))
    captions = spark.createDataFrame([("/a", "x"), ("/b", "y")], "video_path string, caption string")
    with pytest.raises(Exception, match="missing file /b"):
        files.train_rows(captions, spark.createDataFrame([("/a",)], "path string"), strict=True).collect()
    rows, missing = sinks.read_if_there(spark, [str(tmp_path / "none.csv")], "a int")
    assert rows.count() == 0 and missing == [str(tmp_path / "none.csv")]


def test_similarity_of_large_query_sets(spark, monkeypatch):
    df = spark.range(30).select("id", F.array(F.col("id") + 1.0, F.lit(2.0)).alias("v"))
    many = spark.range(10_050).select("id", F.array(F.col("id") % 7 + 1.0, F.lit(2.0)).alias("v"))
    assert metrics.similarity_matrix(many, df, "id", "v").count() == 10_050 * 30


def test_units_declare_their_columns(spark):
    from loomcut.plans import units

    unit = units.Unit("u", ("a",), ("b",), lambda c: {"b": c["a"]})
    with pytest.raises(ValueError, match="u reads a"):
        units.run_units(spark.range(1), [unit])
    with pytest.raises(ValueError, match="differ: b, c"):
        units.run_units(spark.range(1).withColumn("a", F.lit(1)), [units.Unit("u", ("a",), ("b",), lambda c: {"c": c["a"]})])

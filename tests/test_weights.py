"""Weight files by their headers and ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcut.sources import containers, files, shared, sinks, weights

DRAW = np.random.default_rng(3)
ONE = {"a": DRAW.normal(size=(7, 5)).astype("f4"), "b.c": DRAW.integers(-9, 9, 11), "empty": np.zeros((0, 3), "f2"), "flag": np.array([True, False]), "half": DRAW.normal(size=300).astype("f2"), "big": DRAW.normal(size=5000)}


def folder(spark, **data):
    root = shared.new_path(spark, "w")
    df = spark.createDataFrame([(f"{n}.safetensors", bytearray(d)) for n, d in data.items()], "name string, data binary")
    sinks.write_files(df, root, df.name, df.data).collect()
    return files.scan(spark, root, ("safetensors",))


def test_values_in_pieces(spark):
    index = weights.tensors(folder(spark, one=weights.write_weights(ONE, {"k": "v"})))
    assert {r.name: (r.shape, r.error) for r in index.collect()} == {n: (list(x.shape), None) for n, x in ONE.items()}
    got = {}
    for r in sorted(weights.values(index, 1000).collect(), key=lambda r: r["at"]):
        assert len(r["values"]) <= 1000 and r["at"] == len(got.get(r["name"], []))
        got[r["name"]] = got.get(r["name"], []) + r["values"]
    assert got.keys() == ONE.keys() - {"empty"} and all(np.array_equal(got[n], ONE[n].astype(float).ravel()) for n in got)


def test_only_headers_are_read(tmp_path):
    path = tmp_path / "x.safetensors"
    path.write_bytes(weights.write_weights({"x": np.zeros(1_000_000), "y": np.zeros(3)}))
    f = containers.Ranges(str(path))
    assert [x[0] for x in weights.read_header(f)] == ["x", "y"] and f.fetched < 300


def test_bf16(spark):
    raw = weights.write_weights({"x": np.array([0x3F80, -0x4000, 0x0000], "<i2")})
    size = int.from_bytes(raw[:8], "little")
    text = raw[8 : 8 + size].replace(b'"I16"', b'"BF16"')
    raw = len(text).to_bytes(8, "little") + text + raw[8 + size :]
    row = weights.values(weights.tensors(folder(spark, x=raw))).first()
    assert row["values"] == [1.0, -2.0, 0.0]


@pytest.mark.parametrize("fault", ["", "x", "cut", "short", "json", "size"])
def test_faults_are_rows(spark, fault):
    whole = weights.write_weights(ONE)
    data = {"": b"", "x": b"x" * 100, "cut": whole[:-1], "short": whole[:20], "json": (8).to_bytes(8, "little") + b"[1,2,3] " + b"x" * 20, "size": whole.replace(b"[7, 5]", b"[7, 6]")}[fault] or b"\0"
    row = weights.tensors(folder(spark, bad=data, good=whole)).where("error IS NOT NULL").collect()
    assert len(row) == 1 and row[0].error.startswith("ValueError") and "bad" in row[0].path


def test_later_files_win(spark):
    index = weights.tensors(folder(spark, a=weights.write_weights({"x": np.zeros(2), "y": np.zeros(3)}), b=weights.write_weights({"y": np.ones(1), "z": np.ones(2)})))
    got = {r.name: (r.path[-13], r["shape"]) for r in weights.later_wins(index, F.col("path")).collect()}
    assert got == {"x": ("a", [2]), "y": ("b", [1]), "z": ("b", [2])}

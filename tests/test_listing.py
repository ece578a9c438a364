"""Listings by tasks against Spark's own."""

import os

import pytest
from pyspark.sql import functions as F

from loomcut.sources import files, shared, sinks


def tree(tmp_path):
    for i in range(300):
        folder = tmp_path / f"{'abc'[i % 3]} é%20/{i % 7}" if i % 2 else tmp_path
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{'_' if i % 11 == 0 else ''}{'.' if i % 13 == 0 else ''}{i}.{'png' if i % 5 else 'txt'}").write_bytes(b"x" * (i % 17))
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "1.png").write_bytes(b"x")
    (tmp_path / "_k=1.png").write_bytes(b"x")
    os.symlink(tmp_path / "nowhere.png", tmp_path / "broken.png")
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def spark_lists(spark, root, recursive=True):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).where("length > 0").select("path", "length").collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("recursive", [True, False])
@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_as_spark_lists(spark, tmp_path, prefix, recursive):
    root = tree(tmp_path)
    got = sorted(map(tuple, shared.listed(spark, prefix + root, recursive).collect()))
    assert got == spark_lists(spark, root, recursive) and len(got) > 50


def test_patterns_files_and_none(spark, tmp_path):
    root = tree(tmp_path)
    assert sorted(map(tuple, shared.listed(spark, f"{root}/a*/[13]").collect())) == spark_lists(spark, f"{root}/a*/[13]")
    assert [r.length for r in shared.listed(spark, f"{root}/2.png").collect()] == [2]
    assert shared.listed(spark, f"{root}/empty").isEmpty()
    with pytest.raises(FileNotFoundError):
        shared.listed(spark, f"{root}/none")


def test_tasks_do_not_grow_with_the_files(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i}.png").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path), ("png",))
    with shared.setting(spark, "spark.sql.adaptive.enabled", "false"):
        assert found.count() == 1000 and found.select("path").where(F.lit(True)).rdd.getNumPartitions() < 16
    assert [r.path for r in found.limit(3).collect()] == sorted(f"file:{tmp_path}/{i}.png" for i in range(1000))[:3]


def test_files_are_begun_in_a_folder_for_each_task(spark, tmp_path, monkeypatch):
    began = []
    monkeypatch.setattr(shared.uuid, "uuid4", lambda: began.append(sorted(os.listdir(tmp_path))) or type("", (), {"hex": f"{len(began)}"}))
    with shared.aside(str(tmp_path)) as begun:
        shared.write_bytes(f"{tmp_path}/a", b"x", begun)
        assert [x for x in os.listdir(tmp_path) if x != "a"] == [os.path.basename(begun)] and os.listdir(begun) == []
    rows = spark.range(40).repartition(4)
    monkeypatch.undo()
    sinks.write_files(rows, f"{tmp_path}/out", F.col("id"), F.lit("x")).count()
    assert len(os.listdir(tmp_path / "out")) == 40 and os.listdir(tmp_path) and shared.listed(spark, str(tmp_path)).count() == 41

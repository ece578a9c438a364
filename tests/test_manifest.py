"""The transactional sink: tasks that fail, are tried again, or commit twice."""

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomcut.sources import manifest, shared

SCHEMA = "id long, name string"


def rows(spark, path):  # by id
    return sorted(((r.id, r.name) for r in manifest.read(spark, path, SCHEMA).collect()), key=repr)


def test_append_replace_and_empty(spark):
    path = shared.new_path(spark, "m")
    assert rows(spark, path) == []
    df = spark.range(10).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit('é"\n'), "id")).alias("name"))
    want = [(r.id, r.name) for r in df.collect()]
    manifest.append(df, path)
    assert rows(spark, path) == sorted(want, key=repr)
    manifest.append(df.where("id < 3"), path)
    assert len(rows_of(spark, path)) == 13
    manifest.append(df.where("id = 5"), path, replaces=True)
    assert rows(spark, path) == [(5, 'é"\n5')] and len(manifest.leftovers(path)) > 1
    manifest.vacuum(path)
    assert manifest.leftovers(path) == [] and rows(spark, path) == [(5, 'é"\n5')]
    manifest.append(df.where("false"), path)
    assert rows(spark, path) == [(5, 'é"\n5')]


def rows_of(spark, path):
    return manifest.read(spark, path, SCHEMA).collect()


def test_a_write_that_fails_leaves_nothing(spark):
    path = shared.new_path(spark, "m")
    manifest.append(spark.range(4).select("id", F.lit("a").alias("name")), path)
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("b").alias("name"))
    with pytest.raises(PySparkException):
        manifest.append(bad, path)
    assert rows(spark, path) == [(i, "a") for i in range(4)]


def test_a_task_tried_again_counts_once(spark, tmp_path):
    path = str(tmp_path)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "name": ["x", None]})

    def broken():
        yield batch
        raise OSError("lost")

    writer = manifest._Writer(path, False)
    with pytest.raises(OSError):
        writer.write(broken())
    writer.write(iter([batch]))  # speculative, its message is never committed
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(rows(spark, path)) == [(1, "x"), (2, None)] and len(manifest.leftovers(path)) == 2
    lost = writer.write(iter([batch]))
    writer.abort([lost, None])
    assert len(manifest.leftovers(path)) == 2 and manifest.vacuum(path) == 2


def test_a_batch_committed_again_counts_once(spark, tmp_path):
    batch = pa.RecordBatch.from_pydict({"id": [1], "name": ["x"]})
    writer = manifest._StreamWriter(str(tmp_path))
    for _ in range(2):
        writer.commit([writer.write(iter([batch]))], 0)
    writer.commit([writer.write(iter([batch]))], 1)
    assert rows(spark, str(tmp_path)) == [(1, "x"), (1, "x")] and manifest.leftovers(str(tmp_path)) == []


def test_captions_go_on(spark):
    path, videos = shared.new_path(spark, "c"), spark.createDataFrame([(f"v{i}",) for i in range(20)], "video_path string")

    def captioner(name):
        if name == "v7":
            raise OSError(name)
        return name.upper()

    assert manifest.commit_captions(videos.limit(5), captioner, path) == 5
    assert manifest.commit_captions(videos, captioner, path) == 20 == manifest.commit_captions(videos, captioner, path)
    got = {r.video_path: r.caption for r in manifest.read(spark, path, "video_path string, caption string").collect()}
    assert got == {f"v{i}": None if i == 7 else f"V{i}" for i in range(20)}

"""Archives by an index of their headers, and as a data source that splits."""

import io
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from loomcut.sources import archive, shared

DRAW = random.Random(4)
FILES = {f"{'deep/' * (40 if i % 7 == 0 else 0)}{i}{'é' if i % 5 == 0 else ''}.{'mp4' if i % 2 else 'txt'}": DRAW.randbytes(DRAW.randint(0, 3000)) for i in range(400)}


def tar(files, mode="w", **more):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, **more) as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def folder(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / name.replace("__", ".")).write_bytes(data)
    return str(tmp_path)


ALL = {"a__tar": tar(FILES), "b__tar": tar(FILES, format=tarfile.PAX_FORMAT), "c__tar__gz": tar(FILES, "w:gz"), "d__zip": zipped(FILES), "inner__tar": tar({"x.tar": tar(FILES), "y.txt": b"y"})}


def got(df):
    out = {}
    for r in df.collect():
        assert r.error is None, r.error
        out.setdefault(os.path.basename(r.archive), {})[r.member] = bytes(r.data)
    return out


def test_members_by_ranges(spark, tmp_path):
    whole = ALL["a__tar"]
    root = folder(tmp_path, **ALL, e__tar__000=whole[:100_001], e__tar__001=whole[100_001:])
    want = {n: FILES for n in ("a.tar", "b.tar", "c.tar.gz", "d.zip", "e.tar")} | {"inner.tar": {"x.tar": ALL["a__tar"], "y.txt": b"y"}}
    index = archive.index_members(spark, root)
    assert got(archive.read_members(index, 50_000)) == want == got(archive.read_members(index))
    few = got(archive.read_members(index.where(F.col("member").endswith("1.mp4")), 50_000))
    assert few == {n: {m: d for m, d in f.items() if m.endswith("1.mp4")} for n, f in want.items() if n != "inner.tar"}


def test_many_tasks_read_one_archive(spark, tmp_path):
    index = archive.index_members(spark, folder(tmp_path, a__tar=ALL["a__tar"]))
    with shared.setting(spark, "spark.sql.adaptive.enabled", "false"):
        tasks = archive.read_members(index, 20_000).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1


def test_an_index_reads_headers_alone(tmp_path):
    path = os.path.join(folder(tmp_path, a__tar=tar({f"{i}": bytes(100_000) for i in range(30)})), "a.tar")

    class Counted(shared.Joined):
        n = 0

        def readinto(self, buffer):
            got = super().readinto(buffer)
            Counted.n += got
            return got

    assert len([*archive.index_file(path, Counted([path]))]) == 30 and Counted.n < 30 * 4 * 512


def test_faults_are_rows(spark, tmp_path):
    whole = ALL["a__tar"]
    bad = zipped({"ok.txt": b"ok" * 50, "bad.txt": bytes(5000)})
    at = bad.index(b"bad.txt") + 9
    root = folder(tmp_path, cut__tar=whole[: len(whole) // 2], none__zip=b"no zip", out__tar=tar({"../up": b"x", "in": b"y"}), bad__zip=bad[:at] + b"\x99" + bad[at + 1 :], empty__tar=tar({}))
    rows = {}
    for r in archive.read_members(archive.index_members(spark, root)).collect():
        rows.setdefault(os.path.basename(r.archive), []).append(r)
    assert [r.error[:10] for r in rows["none.zip"]] == ["BadZipFile"]
    assert {r.member: r.error is None for r in rows["out.tar"]} == {"../up": False, "in": True}
    assert {r.member: r.error is None for r in rows["bad.zip"]} == {"ok.txt": True, "bad.txt": False}
    sound = {r.member: bytes(r.data) for r in rows["cut.tar"] if r.error is None}
    assert 100 < len(sound) < 400 and all(FILES[m] == d for m, d in sound.items()) and any(r.error for r in rows["cut.tar"])
    assert "empty.tar" not in rows


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_source(spark, tmp_path, pushed):
    root = folder(tmp_path, **ALL)
    spark.dataSource.register(archive.ArchiveSource)
    paths = ",".join(f"{root}/{n}" for n in ("a.tar", "b.tar", "c.tar.gz", "d.zip"))
    with shared.setting(spark, "spark.sql.python.filterPushdown.enabled", pushed):
        df = spark.read.format("archive").option("paths", paths).option("content", "true").option("pushFilters", pushed).option("splitBytes", 50_000).load()
        assert df.rdd.getNumPartitions() > 8
        plan = df.where("size < 5")._jdf.queryExecution().executedPlan().toString()
        assert ("< 5" in plan.split("BatchScan")[0]) == (pushed == "false")  # what is pushed isn't done again
        rows = df.collect()
        assert len(rows) == 1600 and all(FILES[r.member] == bytes(r.data) for r in rows)
        some = df.where(F.col("member").endswith(".mp4") & (F.col("size") >= 1000) & (F.col("archive") == f"{root}/d.zip")).collect()
        assert {r.member for r in some} == {m for m, d in FILES.items() if m.endswith(".mp4") and len(d) >= 1000} and len(some) == len({r.member for r in some})
        listed = spark.read.format("archive").option("paths", paths).load()
        assert listed.columns == ["archive", "member", "size"] and listed.where("size < 100").count() == 4 * sum(len(d) < 100 for d in FILES.values())
    assert spark.read.format("archive").option("paths", "").load().count() == 0


def test_archives_are_written_in_their_groups(spark, monkeypatch):
    from loomcut import container_queries

    def passed_on(*given):
        raise AssertionError("archives go through a batch of rows")

    monkeypatch.setattr(container_queries.sinks, "write_files", passed_on)
    assert container_queries.src14_index_counts(spark, "/root/testdata/sf0.001").count() > 1

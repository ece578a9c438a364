"""Ranges of many archives found by tasks, and packed into few partitions."""

import pytest
from pyspark.sql import functions as F

from loomcut.sources import archive, shared
from test_archives import FILES, folder, tar, zipped


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_many_archives_are_few_partitions(spark, tmp_path, pushed):
    few = {n: d for n, d in FILES.items() if len(d) < 300}
    root = folder(tmp_path, **{f"{i}__tar": tar(few) for i in range(60)}, **{f"{i}__zip": zipped(few) for i in range(60)}, whole__tar=tar(FILES), whole__zip=zipped(FILES), c__tar__gz=tar(FILES, "w:gz"))
    spark.dataSource.register(archive.ArchiveSource)
    at = archive.ranges(archive.find_archives(spark, root), 50_000)
    assert spark.read.parquet(at).where("archive like '%whole.tar'").count() > 4
    with shared.setting(spark, "spark.sql.python.filterPushdown.enabled", pushed):
        load = lambda pack: spark.read.format("archive").option("ranges", at).option("content", "true").option("pushFilters", pushed).option("packBytes", pack).load()
        assert load(0).rdd.getNumPartitions() > 120 > 10 > load(1 << 20).rdd.getNumPartitions() > 1
        rows = load(1 << 20).collect()
        assert len(rows) == len({(r.archive, r.member) for r in rows}) == 120 * len(few) + 3 * len(FILES) and all(FILES[r.member] == bytes(r.data) for r in rows)
        some = load(1 << 20).where(F.col("archive").endswith("whole.zip") & F.col("member").endswith(".mp4")).collect()
        assert {r.member for r in some} == {m for m in FILES if m.endswith(".mp4")}
    assert spark.read.format("archive").option("ranges", archive.ranges(archive.find_archives(spark, root).where("false"))).load().count() == 0

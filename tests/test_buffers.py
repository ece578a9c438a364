"""Bounded buffers in a stream's state, over several goes, against a plain version."""

import random

from loomcut.sources import shared
from loomcut.streaming import buffers, state


def test_goes_and_restarts(spark):
    path, draw, rows, held = shared.new_path(spark, "b"), random.Random(1), [], {}
    schema = "k string, o long, v double, s string"
    for go in range(3):
        new = [(draw.choice(["a", "a", "b", None]), go * 100 + i, draw.choice([None, float(i)]), str(i % 2)) for i in range(60)]
        rows += new
        spark.createDataFrame(new, schema).repartition(3).write.mode("append").parquet(f"{path}/in")
        buffers.run(buffers.buffered(spark.readStream.schema(schema).parquet(f"{path}/in"), "k", "o", "v", "s", 8, 2), path)
    for k in ("a", "b", ""):
        mine = []
        for e in sorted((o, v, s) for key, o, v, s in rows if (key or "") == k):
            state.push(mine, sum(1 for key, o, *_ in rows if (key or "") == k and o < e[0]), e, 8, 2)
        held |= {(k, i): e for i, e in enumerate(mine)}
    got = {(r.key, r.slot): (r.o, r.v, r.shape) for r in buffers.slots(spark, path).collect()}
    assert got == held


def test_draws(spark):
    held = spark.createDataFrame([("a", 0, 1, 1.0, "x"), ("a", 1, 2, 2.0, "x"), ("b", 0, 3, 3.0, "y")], "key string, slot int, o long, v double, shape string")
    asked = spark.createDataFrame([(i, k, s) for i in range(40) for k in "abc" for s in "xy"], "id long, key string, shape string")
    got = buffers.draws(asked, held, "key", "id", "shape").collect()
    assert len(got) == 240 and all(r.drawn is None or (r.drawn.o == 3) == (r.shape == "y") for r in got)
    assert {r.drawn.o for r in got if r.key == "a" and r.drawn} == {3} and {r.drawn.o for r in got if r.key == "b" and r.drawn} == {1, 2} and {r.drawn.o for r in got if r.key == "c" and r.drawn} == {1, 2, 3}
    assert all((r.drawn is not None) == (r.shape == "y") for r in got if r.key == "a")
    alone = buffers.draws(asked, held.where("key = 'a'"), "key", "id", "shape")
    assert all(r.drawn is None for r in alone.where("key = 'a'").collect())
    assert all(r.drawn is None for r in buffers.draws(asked, held.where("false"), "key", "id", "shape").collect())

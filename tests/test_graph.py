"""Closures, levels and splits of graphs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomcut import queries
from loomcut.plans import graph

SF = "/root/testdata/sf0.001"


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))


def closure(links, start):
    seen, step = set(start), set(start)
    while step:
        step = {t for s, t in links if s in step} - seen
        seen |= step
    return seen


def plain_levels(units, links):
    units = set(units) | {x for e in links for x in e}
    out, step, level = {}, {u for u in units if all(t != u for _, t in links)}, 0
    while step:
        out |= dict.fromkeys(step, level)
        step, level = {u for u in units - set(out) if all(s in out for s, t in links if t == u)}, level + 1
    return {u: out.get(u) for u in units}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    links = list({(draw.randrange(40), draw.randrange(40)) for _ in range(45)})
    start = [draw.randrange(40) for _ in range(3)]
    got = graph.reachable(frame(spark, links, ["source", "target"]), frame(spark, [(x,) for x in start], ["unit"]))
    assert sorted(r.unit for r in got.collect()) == sorted(closure(links, start))
    units = list(range(0, 50, 3))
    assert {r.unit: r.level for r in graph.levels(frame(spark, [(x,) for x in units], ["unit"]), frame(spark, links, ["source", "target"])).collect()} == plain_levels(units, links)


def test_empty_and_odd(spark):
    none = frame(spark, [], ["source", "target"])
    assert graph.reachable(none, frame(spark, [], ["unit"])).collect() == []
    assert [r.unit for r in graph.reachable(none, frame(spark, [(3,), (3,), (None,)], ["unit"])).collect()] == [3]
    assert {r.unit: r.level for r in graph.levels(frame(spark, [(1,), (1,)], ["unit"]), frame(spark, [(2, 2), (2, 3), (1, 4), (1, 4)], ["source", "target"])).collect()} == {1: 0, 2: None, 3: None, 4: 1}


def plain_split(reads, writes, direct):
    units = sorted({u for u, _ in reads + writes} | set(direct))
    ins, outs = {u: [p for x, p in reads if x == u] for u in units}, {u: [p for x, p in writes if x == u] for u in units}
    last, links, chains = {}, set(), {}
    for u in units:
        links |= {(last[p], u) for p in ins[u] if p in last}
        for p in outs[u]:
            last[p] = u
            chains.setdefault(p, []).append(u)
    related, size = set(direct), -1
    while size != len(related):
        size = len(related)
        related = closure(links, related)
        for p in {p for u in related for p in ins[u]}:
            first = min(u for u in related if p in ins[u])
            if first in chains.get(p, []):
                related |= {u for u in chains[p] if u > first}
    return {u: u in related for u in units}


def test_split_of_events(spark):
    rows = [(r.event_id, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    reads, writes = [(u, f"{k}:{u % 4}") for u, k in rows], [(u, f"{k}:{u // 4 % 5}") for u, k in rows]
    want = {}
    for user in {k for _, k in rows}:
        mine = lambda pairs, user=user: [x for x in pairs if x[1].startswith(f"{user}:")]
        want |= plain_split(mine(reads), mine(writes), [u for u, k in rows if k == user and u % 40 == 7])
    got = {r.unit: r.related for r in queries.QUERIES["o8_unit_graph_split"](spark, SF).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_no_collected_sets(spark):
    chain = spark.range(30).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.reachable(chain, spark.range(1).withColumnRenamed("id", "unit")).count() == 31


@pytest.mark.parametrize("seed", range(2))
def test_many_blocks(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(330)] + [(400 + i, 401 + i) for i in range(40)]
    start = [draw.randrange(300), 400, 430, 999]
    got = graph.reachable(frame(spark, links, ["source", "target"]), frame(spark, [(x,) for x in start], ["unit"]), size=150)
    assert sorted(r.unit for r in got.collect()) == sorted(closure(links, start))
    ahead = [(min(e), max(e)) for e in links if e[0] % 17] + [(7, 7), (350, 351), (351, 350), (351, 352)]
    got = graph.levels(frame(spark, [(500,)], ["unit"]), frame(spark, ahead, ["source", "target"]), size=150)
    assert {r.unit: r.level for r in got.collect()} == plain_levels([500], ahead)


def test_long_ways_take_few_steps(spark, monkeypatch):
    made, given = [], graph.new_path
    monkeypatch.setattr(graph, "new_path", lambda session, name: made.append(name) or given(session, name))
    chain = spark.range(20_000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.reachable(chain, spark.range(1).withColumnRenamed("id", "unit")).count() == 20_001
    found = graph.levels(spark.range(1).withColumnRenamed("id", "unit"), chain)
    assert found.agg(F.count("*"), F.max("level")).first() == (20_001, 20_000) and len(made) < 12

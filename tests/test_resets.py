"""Running sums that set themselves back, by order and by pointers, against plain Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomcut.operators import rank
from loomcut.streaming import state


def plain(rows, limit):
    out, by = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append(v or 0.0)
    for k, values in by.items():
        total = 0.0
        for i, v in enumerate(values, 1):
            total += v
            go = i in (1, len(values)) or total >= limit
            total = 0.0 if go else total
            out[k, i] = go
    return out


def answer(spark, rows, limit, most):
    df = spark.createDataFrame(rows, "k string, o long, v double")
    return {(r.k, r.i): r.go for r in state.threshold_resets(df, "k", ["o"], "v", limit, most).collect()}


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_both_ways(spark, most):
    draw = random.Random(most)
    rows = [(draw.choice(["a", "a", "a", "b", "c", None]), i, draw.choice([0.0, 0.25, 0.5, 1.0, 3.0, None])) for i in range(400)] + [("one", 1, 5.0), ("zeros", 1, 0.0), ("zeros", 2, 0.0), ("zeros", 3, None)]
    assert answer(spark, rows, 2.0, most) == plain(rows, 2.0)


@pytest.mark.parametrize("limit", [0.0, -1.0, 0.25, 1e9])
def test_limits(spark, limit):
    rows = [("a", i, float(i % 3)) for i in range(30)]
    assert answer(spark, rows, limit, 0) == plain(rows, limit)


def test_negative_values_go_in_order(spark):
    draw = random.Random(9)
    rows = [(k, i, float(draw.randint(-3, 4))) for i in range(300) for k in "ab"] + [("c", i, 1.0) for i in range(300)]
    assert answer(spark, rows, 5.0, 10) == plain(rows, 5.0)


def test_batches_and_empty(spark):
    rows = [("a", i, 0.125) for i in range(25_000)]
    assert answer(spark, rows, 100.0, 10**6) == plain(rows, 100.0)
    assert state.threshold_resets(spark.createDataFrame([], "k string, o long, v double"), "k", ["o"], "v", 1.0).count() == 0


def test_decimals_are_exact(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id", F.lit("0.1").cast("decimal(10,2)").alias("v"))
    got = {r.i: r.go for r in state.threshold_resets(df, "k", ["id"], "v", 0.3, 0).collect()}
    assert all(got[i] == (i == 1 or i == 1000 or (i - 1) % 3 == 0) for i in got)


def test_rows_are_not_written_anew_for_each_doubling(spark, monkeypatch):
    written, stored = [], state.stored

    def counted(df, name, **options):
        out = stored(df, name, **options)
        written.append(out.count())
        return out

    monkeypatch.setattr(state, "stored", counted)
    monkeypatch.setattr(rank, "stored", counted)
    rows = [("a", i, (i * 7 % 13) / 4) for i in range(20_000)]
    assert answer(spark, rows, 3.0, 0) == plain(rows, 3.0)
    assert sum(written) < len(rows) / 10


@pytest.mark.parametrize("limit", [0.5, 2.0, 40.0, 1e9])
def test_steps_within_and_beyond_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(state, "BLOCK", 7)
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "b", None]), i, draw.choice([0.0, 0.0, 0.0, 0.25, 1.0, 9.0]) if i % 200 < 150 else 0.0) for i in range(600)] + [("z", i, 0.0) for i in range(40)]
    assert answer(spark, rows, limit, 0) == plain(rows, limit)


@pytest.mark.parametrize("kind, unit", [("decimal(18,2)", "0.01"), ("decimal(38,10)", "123456789012345678901.0000000001")])
def test_decimals_of_any_size(spark, monkeypatch, kind, unit):
    monkeypatch.setattr(state, "BLOCK", 11)
    draw, unit = random.Random(3), Decimal(unit)
    rows = [("a", i, draw.randint(0, 5) * unit) for i in range(200)]
    df = spark.createDataFrame(rows, f"k string, o long, v {kind}")
    got = {(r.k, r.i): r.go for r in state.threshold_resets(df, "k", ["o"], "v", 9 * unit, 0).collect()}
    assert got == plain([(k, o, float(v / unit)) for k, o, v in rows], 9.0)


def test_a_limit_between_two_decimals(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id", F.lit("0.10").cast("decimal(10,2)").alias("v"))
    got = {r.i: r.go for r in state.threshold_resets(df, "k", ["id"], "v", 0.304, 0).collect()}
    assert all(got[i] == (i in (1, 100) or (i - 1) % 4 == 0) for i in got)


def test_values_without_a_finite_sum(spark):
    draw, inf, nan = random.Random(2), float("inf"), float("nan")
    values = [draw.choice([0.5, 1.0, 1.0, inf]) for _ in range(100)]
    rows = [("a", i, v) for i, v in enumerate(values)] + [("b", i, nan if v == inf else v) for i, v in enumerate(values)]
    got, both = answer(spark, rows, 4.0, 0), plain(rows[:100], 4.0)
    assert got == both | {("b", i): go for (_, i), go in both.items()}

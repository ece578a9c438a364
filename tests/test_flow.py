"""Motion between frames with shifts that are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcut.functions import flow

DRAW = np.random.default_rng(5)
PLANE = DRAW.integers(0, 256, (96, 120, 3), np.uint8)


@pytest.mark.parametrize("shift", [(0, 0), (3, -2), (-6, 6), (0, 5)])
def test_planted_shifts(shift):
    gray = PLANE[..., 0].astype(np.float32)
    down, right = flow.block_flow(gray, np.roll(gray, shift, (0, 1)))
    assert down.shape == (10, 13) and (down == shift[0]).all() and (right == shift[1]).all()


def test_noise_and_shrinking():
    smooth = np.kron(DRAW.integers(0, 200, (40, 40)), np.ones((4, 4))).astype(np.float32)
    moved = np.roll(smooth, (8, -4), (0, 1)) + DRAW.normal(0, 5, smooth.shape)
    down, right = flow.block_flow(flow.shrunk(smooth, 4), flow.shrunk(moved, 4), 4, 3)
    assert (down == 2).all() and (right == -1).all()


def test_flat_and_small_frames():
    flat = np.full((64, 64), 7, np.float32)
    down, right = flow.block_flow(flat, flat + 1)
    assert not down.any() and not right.any() and flow.block_flow(flat[:12], flat[:12])[0].size == 0
    still = np.zeros((64, 64, 3), np.uint8)
    assert flow.pair_motion(still, still, 8, 6, 1, 1.0) == (0.0, 1.0, 0.0)


def test_coherence_of_opposite_halves():
    two = PLANE.copy()
    two[:48], two[48:] = np.roll(PLANE[:48], 4, 1), np.roll(PLANE[48:], -4, 1)
    length, coherence, _ = flow.pair_motion(PLANE, two, 8, 6, 1, 1.0)
    assert length == pytest.approx(4, abs=0.2) and coherence < 0.3


def test_clips(spark):
    rows = [("even", i, np.roll(PLANE, (2 * i, 0), (0, 1))) for i in range(5)] + [("jerky", i, np.roll(PLANE, (0, k), (0, 1))) for i, k in enumerate([0, 6, 6, 12, 12])] + [("one", 0, PLANE), ("gap", 0, PLANE), ("gap", 2, PLANE)]
    frames = spark.createDataFrame([(c, i, 96, 120, bytearray(x.tobytes())) for c, i, x in rows] + [("one", 1, 8, 8, bytearray(192))], "clip string, idx int, h int, w int, data binary")
    got = {r.clip: r for r in flow.clip_motion(frames, "clip").collect()}
    assert (got["even"].motion_score, got["even"].motion_jitter_score, got["even"].flow_coherence, got["even"].error) == (2.0, 0.0, 1.0, None)
    assert (got["jerky"].motion_score, got["jerky"].motion_jitter_score) == (3.0, 1.0)
    assert all(got[c].error and got[c].motion_score == 0 for c in ("one", "gap"))
    assert flow.clip_motion(frames.where("clip = 'even'"), "clip", by="difference").select(F.col("motion_score") > 10).first()[0]
    assert flow.clip_motion(frames.where("false"), "clip").count() == 0


def test_stacks_and_pictures_made_late(spark):
    step = lambda i: (2 * i % 5, -i % 4)
    one, two = (np.stack([np.roll(PLANE, step(i + d), (0, 1)) for i in range(9)]) for d in (0, 1))
    many = np.stack(flow.motions(one, two, 8, 6, 1, 1.0), 1)
    assert many == pytest.approx(np.array([flow.pair_motion(a, b, 8, 6, 1, 1.0) for a, b in zip(one, two)]))
    rows = spark.range(30).select((F.col("id") % 2).alias("clip"), F.floor(F.col("id") / 2).alias("idx"), F.lit(96).alias("h"), F.lit(120).alias("w"))
    make = lambda k: [None if i == 7 else np.roll(PLANE, step(i), (0, 1)).tobytes() for i in k]
    made = flow.pairs(rows.withColumn("k", F.col("idx")), "clip", picture=make, given=("k",))
    data = F.pandas_udf(lambda k: __import__("pandas").Series(make(k)), "binary")
    late, early = ({(r.clip, r.idx): r.magnitude for r in df.collect()} for df in (made, flow.pairs(rows.withColumn("data", data("idx")), "clip")))
    assert late == early and len(late) == 24
    assert not {"Broadcast", "binary"} & set(made._jdf.queryExecution().executedPlan().toString().replace("<", " ").split())


def test_frames_are_not_broadcast(spark):
    from loomcut import media_queries

    for name in ("flt5_frame_flow", "flt13_motion_from_frames"):
        plan = getattr(media_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=merge)" in plan


def test_limits_hold_before_rounding(spark, tmp_path):
    """A jitter of 0.450045, told to four digits as 0.45, is over 0.45."""
    from loomcut import media_queries

    ids = [7, 10, 13, 20, 24, 26, 28, 31, 36, 38, 40, 43]
    rows = [(i, 1, 1.0) for i in ids] + [(i, 2, 1.0) for i in (0, 6, 42, 48)] + [(99, 3, 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.motion_score, r.jitter, r.passed) for r in media_queries.flt13_motion_from_frames(spark, str(tmp_path)).collect()}
    assert got[1] == (2.3811, 0.45, False) and got[2] == (4.2426, 0.0, True) and got[3] == (0.0, 0.0, False)

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcut.functions import matrices
from loomcut.sources import media, shared, sinks


def images(n, h=3, w=5):
    return [np.random.default_rng(i).integers(0, 256, (h, w, 3)).astype(np.uint8) for i in range(n)]


def test_ppm():
    got = list(media.read_ppm(media.write_ppm(images(3)) + b"P5\n# gray\n2 1\n255\n\x01\x02"))
    assert all((a == b).all() for a, b in zip(got, images(3))) and got[3].tolist() == [[[1] * 3, [2] * 3]]
    with pytest.raises(ValueError):
        list(media.read_ppm(b"GIF89a"))
    assert media.rgba(got[0]).shape == (3, 5, 4) and (media.rgba(got[0])[..., 3] == 255).all()


def test_frames_and_clip(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(media.write_ppm(images(4)))
    (tmp_path / "cut.ppm").write_bytes(media.write_ppm(images(3))[:-4])
    (tmp_path / "odd.ppm").write_bytes(b"nothing")
    names = [str(tmp_path / x) for x in ("a.ppm", "cut.ppm", "odd.ppm", "gone.ppm")]
    table = media.frames(spark.createDataFrame([(x,) for x in names], "path string")).cache()
    got = {}
    for r in table.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.idx, r.error and r.error.split(":")[0]))
    assert got == {"a.ppm": [(i, None) for i in range(4)], "cut.ppm": [(0, None), (1, None)], "odd.ppm": [(None, "ValueError")], "gone.ppm": [(None, "FileNotFoundError")]}
    clip = media.Clip(table, names[0])
    assert len(clip) == 4 and clip.shape == (3, 5) and (clip[-1] == images(4)[3]).all() and clip.gray(0).shape == (3, 5)
    assert clip.resized(6, 10).shape == (6, 10) and (clip.resized(6, 10)[1][::2, ::2] == images(4)[1]).all()
    with pytest.raises(IndexError):
        clip[9]


def test_sound(spark, tmp_path):
    x = np.sin(np.arange(800) / 9) * 0.5
    (tmp_path / "a.wav").write_bytes(media.write_wav(x, 100))
    (tmp_path / "odd.wav").write_bytes(b"x")
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.wav", "odd.wav", "gone.wav")], "path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in media.sound(df, rate=50, start=F.lit(1.0), duration=F.lit(9)).collect()}
    assert got["odd.wav"].samples is None and got["gone.wav"].rate is None
    s = np.array(got["a.wav"].samples)
    assert len(s) == 450 and (s[350:] == 0).all() and np.abs(s[:350] - x[100::2]).max() < 1e-3


def test_files_and_copies(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a/x", b"1"), ("b/x", b"22"), ("c", None)], "name string, data binary")
    assert sorted((r.path.split("/")[-1], r.length) for r in sinks.write_files(rows, f"{root}/in", F.col("name"), F.col("data")).collect()) == [("c", 0), ("x", 1), ("x", 2)]
    records = spark.createDataFrame([(1, f"{root}/in/a/x"), (2, f"{root}/in/b/x"), (3, f"{root}/in/none")], "i int, video_path string")
    got = {r.i: r for r in sinks.copy_stage(records, f"{root}/out").collect()}
    assert got[1].collides and got[2].collides and not got[3].collides and got[3].video_path.endswith("in/none") and "FileNotFound" in got[3].error
    assert shared.read_bytes(f"{root}/out/x") in (b"1", b"22")
    whole = shared.Joined([f"{root}/in/a/x", f"{root}/in/c", f"{root}/in/b/x"])
    assert whole.read() == b"122" and whole.seek(-2, 2) == 1 and whole.read() == b"22"


def test_matrices(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(3, 5))
    df = spark.createDataFrame([(3, m.ravel().tolist()), (3, None), (4, m.ravel().tolist())], "n int, v array<double>")
    got = df.select(matrices.orthogonal(F.col("n"), F.col("v")).alias("o"), matrices.low_rank(F.col("n"), F.col("v"), 2).alias("f"), matrices.wavelet(F.col("n"), F.col("v")).alias("w")).select("*", matrices.from_wavelet(F.col("w"), 3, 5).alias("b")).collect()
    s = np.linalg.svd(np.reshape(got[0].o, (3, 5)))[1]
    assert (s > 0.6).all() and (s < 1.3).all() and got[1].o is None and got[2].o is None
    u, sv, w = np.linalg.svd(m)
    assert np.allclose(np.reshape(got[0].f.up, (3, 2)) @ np.reshape(got[0].f.down, (2, 5)), u[:, :2] * sv[:2] @ w[:2])
    assert np.allclose(got[0].b, m.ravel())


def test_sounds_in_packs(spark, tmp_path):
    rows = [(i, bytearray(media.write_wav(np.full(i + 1, 0.5), 8))) for i in range(40)]
    packs = sinks.write_packs(spark.createDataFrame(rows, "k int, d binary").repartition(2), str(tmp_path / "p"), F.col("k").cast("string"), F.col("d"), most=400)
    assert packs.select("path").distinct().count() == len(list((tmp_path / "p").glob("*.pack"))) > 2
    gone = packs.limit(1).select(F.lit("gone").alias("name"), F.lit(str(tmp_path / "no")).alias("path"), "at", "length")
    got = {r.name: r for r in media.sound(packs.union(gone), at=("at", "length")).collect()}
    assert got.pop("gone").samples is None and {int(k): len(r.samples) for k, r in got.items()} == {i: i + 1 for i in range(40)}


def test_sounds_of_a_table_are_few_files(spark, monkeypatch):
    from loomcut import media_queries

    roots, given = [], sinks.write_packs
    monkeypatch.setattr(sinks, "write_packs", lambda df, root, *a: roots.append(root) or given(df, root, *a))
    n = media_queries.src25_sound(spark, "/root/testdata/sf0.001").count()
    assert n > 10 and spark.read.format("binaryFile").load(roots[0]).count() <= 4


def test_thirds_of_samples_stay_whole(spark, tmp_path):
    """Samples whose third is whole but comes out just below when it is scaled twice, 12 for each user."""
    from loomcut import media_queries

    v = np.arange(3, 30000, 3)
    v = v[(v / 32767 / 3 * 32767).astype(int) < v // 3]
    rows = [(12 * u + i, u, float(x) / 100) for u, x in enumerate(v) for i in range(12)]
    assert 1000 < len(v) and len(rows) < 20000
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name, n in (("src25_sound", 12), ("src26_sound_of_length", 12), ("src28_sound_range", 8)):
        got = {r.user_id: r.total for r in getattr(media_queries, name)(spark, str(tmp_path)).collect()}
        assert got == {u: round(n * (int(x) + int(x) // 3) / 65534, 2) for u, x in enumerate(v)}, name

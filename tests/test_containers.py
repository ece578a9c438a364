"""Headers of media containers, read by ranges."""

import pytest

from loomcut.sources import containers, files, shared, sinks

FRAMES = [bytes([i % 251]) * (1000 + i) for i in range(3000)]


def put(folder, name, data):
    path = f"{folder}/{name}"
    with open(path, "wb") as f:
        f.write(data)
    return path


WRITERS = {
    "a.mp4": lambda x: containers.write_mp4(x, 1920, 1080, 30000, 1001),
    "b.mov": lambda x: containers.write_mp4(x, 1920, 1080, 30000, 1001, b"hvc1", front=True),
    "c.avi": lambda x: containers.write_avi(x, 1920, 1080, 30000, 1001),
    "d.mkv": lambda x: containers.write_mkv(x, 1920, 1080, 33_366_667),
}


@pytest.mark.parametrize("name", list(WRITERS))
def test_header_and_bytes_read(tmp_path, name):
    path = put(tmp_path, name, WRITERS[name](FRAMES))
    f = containers.Ranges(path)
    got = containers.describe(f)
    assert f.fetched < 2000 < 5_000_000 < f.size
    f.close()
    assert (got["width"], got["height"]) == (1920, 1080) and got["fps"] == pytest.approx(30000 / 1001, rel=1e-6) and got["duration"] == pytest.approx(3000 * 1001 / 30000, rel=1e-6)
    f = containers.Ranges(path)
    assert containers.count_packets(f) == 3000 and f.fetched < 3000 * 64
    f.close()
    assert containers.probe(path)["duration"] == round(3000 * 1001 / 30000, 3)


@pytest.mark.parametrize("name", list(WRITERS))
@pytest.mark.parametrize("share", [0.0, 0.0001, 0.3, 0.999])
def test_cut_files_raise(tmp_path, name, share):
    data = WRITERS[name](FRAMES[:50])
    with pytest.raises(ValueError):
        containers.probe(put(tmp_path, name, data[: int(len(data) * share)]))


def test_other_files_raise(tmp_path):
    for data in (b"", b"\0" * 100, b"RIFF\4\0\0\0ABCDxxxx", b"\0\0\0\1ftyp" + bytes(7), b"\x1a\x45\xdf\xa3\x80" + bytes(20), "text of no container".encode()):
        with pytest.raises(ValueError):
            containers.probe(put(tmp_path, "x.mp4", data))


def test_empty_movie(tmp_path):
    got = containers.probe(put(tmp_path, "e.mp4", containers.write_mp4([], 16, 16, 24, 1)))
    assert got["frames"] == 0 and got["fps"] is None


def test_large_boxes_and_unknown_sizes(tmp_path):
    plain = containers.write_mp4(FRAMES[:3], 16, 32, 24, 1)
    at = plain.index(b"mdat") - 4
    size = int.from_bytes(plain[at : at + 4], "big")
    wide = plain[:at] + b"\0\0\0\1mdat" + (size + 8).to_bytes(8, "big") + plain[at + 8 :]
    assert containers.probe(put(tmp_path, "w.mp4", wide))["frames"] == 3
    live = containers.write_mkv(FRAMES[:20], 16, 32, 40_000_000)
    at = live.index((0x18538067).to_bytes(4, "big")) + 4
    live = live[:at] + b"\x01" + b"\xff" * 7 + live[at + 8 :]
    f = containers.Ranges(put(tmp_path, "l.mkv", live))
    assert containers.describe(f)["height"] == 32 and containers.count_packets(f) == 20


def test_samples(tmp_path):
    path = put(tmp_path, "a.mp4", WRITERS["a.mp4"](FRAMES[:40]))
    data = open(path, "rb").read()
    assert [data[a : a + n] for a, n in containers.samples(path)] == FRAMES[:40]


def test_errors_are_rows(spark):
    root = shared.new_path(spark, "odd")
    df = spark.createDataFrame([("a.mp4", bytearray(WRITERS["a.mp4"](FRAMES[:4]))), ("b.mp4", bytearray(b"none")), ("c.mp4", bytearray(b"x"))], "name string, data binary")
    sinks.write_files(df, root, df.name, df.data).collect()
    found = files.scan(spark, root)
    got = {r.path[-5:]: r for r in containers.frame_counts(found).collect()}
    assert got["a.mp4"].frames == 4 and got["b.mp4"].frames is None and got["b.mp4"].error.startswith("ValueError") and got["c.mp4"].error
    assert {r.path[-5:]: r.width for r in containers.probe_files(found).collect()} == {"a.mp4": 1920, "b.mp4": None, "c.mp4": None}
    missing = spark.createDataFrame([("/no/such/file.mp4",)], "path string")
    assert containers.frame_counts(missing).first().error.startswith("FileNotFoundError")


def test_other_rates():
    frames = [bytes([i]) * (i + 1) for i in range(60)]
    data = containers.write_mp4(frames, 16, 32, 3000, 100, b"hvc1")
    for rate, want in ((30, frames), (15, frames[::2]), (60, [x for x in frames for _ in (0, 1)])):
        out = containers.resampled(data, rate)
        head = containers.describe(containers.Ranges(out))
        assert [out[a : a + n] for a, n in containers.samples(out)] == want and head["fps"] == rate and head["duration"] == 2 and head["codec"] == "hevc"
    one = containers.resampled(containers.write_mp4(frames[:1], 16, 32, 3000, 100), 1)
    assert len(containers.samples(one)) == 1 and containers.samples(containers.resampled(containers.write_mp4([], 16, 32, 3000, 100), 5)) == []

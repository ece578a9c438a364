"""Headers of media containers, read by ranges: MP4 and MOV boxes, AVI and WAV chunks, Matroska elements. Media data is never read, only what describes it.

probe() reads a few hundred bytes of a file, whatever its size. count_packets() walks the heads of what lies in a file, where its header doesn't count frames. samples() gives the
ranges of an MP4's samples, so that some frames can be fetched without the rest. The write_ functions put given samples into small valid files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .shared import open_file

# Names of codecs by four-character code or Matroska id, and pixel formats by the profile of an AVC header.
CODECS = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "av01": "av1", "vp08": "vp8", "vp09": "vp9", "mp4v": "mpeg4", "H264": "h264", "XVID": "mpeg4", "MJPG": "mjpeg", "V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "hevc", "V_AV1": "av1", "V_VP8": "vp8", "V_VP9": "vp9"}
AVC_FORMATS = {66: "yuv420p", 77: "yuv420p", 88: "yuv420p", 100: "yuv420p", 110: "yuv420p10le", 122: "yuv422p10le", 244: "yuv444p"}
# Matroska element ids.
_EBML, _SEGMENT, _INFO, _SCALE, _DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
_TRACKS, _TRACK, _NUMBER, _TYPE, _CODEC, _FRAME_NS, _VIDEO, _WIDTH, _HEIGHT = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x23E383, 0xE0, 0xB0, 0xBA
_CLUSTER, _SIMPLE, _GROUP, _BLOCK = 0x1F43B675, 0xA3, 0xA0, 0xA1
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


class Ranges:
    """A file, or its bytes, read by ranges; fetched counts the bytes that were."""

    def __init__(self, source: str | bytes):
        self.file = open_file(source) if isinstance(source, str) else pa.BufferReader(source)
        self.size, self.fetched = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise ValueError(f"the file ends at {self.size}, before {at + n}")
        self.file.seek(at)
        self.fetched += n
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


# MP4 and MOV ---------------------------------------------------------------------------------------------------------------


def _boxes(f: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the contents of the boxes between two places; a box that reaches beyond raises."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", f.read(at, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(at + 8, 8))[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            raise ValueError(f"box {kind.decode('latin-1')!r} at {at} is cut")
        yield kind, at + head, at + size
        at += size


def _tree(f: Ranges, at: int, end: int) -> dict[bytes, list]:
    """Contents of nested boxes: ranges of leaves, dictionaries of parents."""
    out: dict[bytes, list] = {}
    for kind, a, b in _boxes(f, at, end):
        out.setdefault(kind, []).append(_tree(f, a, b) if kind in _PARENTS else (a, b))
    return out


def _times(f: Ranges, at: int) -> tuple[int, int]:
    """(units a second, duration) of a movie or media header."""
    head = f.read(at, 32)
    return struct.unpack_from(">IQ", head, 20) if head[0] == 1 else struct.unpack_from(">II", head, 12)


def _tracks(f: Ranges) -> Iterator[tuple[bytes, dict, dict]]:
    """(kind, boxes, table of samples) of the tracks of a movie."""
    movie = None
    for kind, a, b in _boxes(f, 0, f.size):
        if kind == b"moov":
            movie = _tree(f, a, b)
    if movie is None:
        raise ValueError("no movie box")
    for track in movie.get(b"trak", []):
        media = track[b"mdia"][0]
        yield f.read(media[b"hdlr"][0][0] + 8, 4), track, media[b"minf"][0][b"stbl"][0]


def _video(f: Ranges) -> tuple[dict, dict]:
    for kind, track, table in _tracks(f):
        if kind == b"vide":
            return track, table
    raise ValueError("no video track")


def _mp4(f: Ranges) -> dict[str, Any]:
    track, table = _video(f)
    units, length = _times(f, track[b"mdia"][0][b"mdhd"][0][0])
    a, b = track[b"tkhd"][0]
    width, height = struct.unpack(">II", f.read(b - 8, 8))
    count = struct.unpack(">I", f.read(table[b"stsz"][0][0] + 8, 4))[0]
    a, b = table[b"stsd"][0]
    entry = f.read(a + 8, min(b - a - 8, 128))
    code, at = entry[4:8].decode("latin-1"), entry.find(b"avcC")
    duration = length / units if units else None
    return {"width": width >> 16, "height": height >> 16, "fps": count / duration if duration else None, "duration": duration, "codec": CODECS.get(code, code), "pix_fmt": AVC_FORMATS.get(entry[at + 5]) if at > 0 else None, "frames": count}


def samples(source: str | bytes) -> list[tuple[int, int]]:
    """(place, size) of each sample of an MP4's video track, in order."""
    f = Ranges(source)
    try:
        _, table = _video(f)
        a, b = table[b"stsz"][0]
        fixed, count = struct.unpack(">II", f.read(a + 4, 8))
        sizes = [fixed] * count if fixed else list(struct.unpack(f">{count}I", f.read(a + 12, 4 * count)))
        wide = b"co64" in table
        a, b = table[b"co64" if wide else b"stco"][0]
        n = struct.unpack(">I", f.read(a + 4, 4))[0]
        chunks = struct.unpack(f">{n}{'Q' if wide else 'I'}", f.read(a + 8, n * (8 if wide else 4)))
        a, b = table[b"stsc"][0]
        n = struct.unpack(">I", f.read(a + 4, 4))[0]
        runs = [struct.unpack_from(">III", f.read(a + 8, 12 * n), 12 * i)[:2] for i in range(n)]
    finally:
        f.close()
    out, i = [], 0
    for number, at in enumerate(chunks, 1):
        for _ in range(min(len(sizes) - i, next(many for first, many in reversed(runs) if first <= number))):
            out.append((at, sizes[i]))
            at, i = at + sizes[i], i + 1
    return out


# AVI and WAV ---------------------------------------------------------------------------------------------------------------


def _chunks(f: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = struct.unpack("<4sI", f.read(at, 8))
        if at + 8 + size > end:
            raise ValueError(f"chunk {kind.decode('latin-1')!r} at {at} is cut")
        yield kind, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def _riff(f: Ranges) -> tuple[bytes, list[tuple[bytes, int, int]]]:
    size, kind = struct.unpack("<I4s", f.read(4, 8))
    if size + 8 > f.size:
        raise ValueError(f"the file ends at {f.size}, before {size + 8}")
    return kind, list(_chunks(f, 12, size + 8))


def _avi(f: Ranges, parts: list) -> dict[str, Any]:
    for kind, a, b in parts:
        if kind == b"LIST" and f.read(a, 4) == b"hdrl":
            inner = list(_chunks(f, a + 4, b))
            main = next(f.read(x, 40) for k, x, _ in inner if k == b"avih")
            width, height = struct.unpack_from("<II", main, 32)
            for k, x, y in inner:
                if k == b"LIST" and f.read(x, 4) == b"strl":
                    head = f.read(x + 12, 40)
                    if head[:4] == b"vids":
                        scale, rate, _, count = struct.unpack_from("<IIII", head, 20)
                        code = head[4:8].decode("latin-1")
                        return {"width": width, "height": height, "fps": rate / scale, "duration": count * scale / rate, "codec": CODECS.get(code, code.strip().lower()), "pix_fmt": None, "frames": count}
    raise ValueError("no video stream")


def _wav(f: Ranges, parts: list) -> dict[str, Any]:
    places = {kind: (a, b) for kind, a, b in reversed(parts)}
    form, _, rate, _, block, bits = struct.unpack("<HHIIHH", f.read(places[b"fmt "][0], 16))
    n = (places[b"data"][1] - places[b"data"][0]) // block
    return {"width": None, "height": None, "fps": float(rate), "duration": n / rate, "codec": f"pcm_s{bits}le" if form == 1 else str(form), "pix_fmt": None, "frames": n}


# Matroska ------------------------------------------------------------------------------------------------------------------


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """(a number of variable length, the place behind it); keep: with its length mark, as ids are written. A size of ones alone means unknown and gives -1."""
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("no Matroska number")
    value = int.from_bytes(data[at : at + n], "big")
    if not keep:
        value &= (1 << 7 * n) - 1
        value = -1 if value == (1 << 7 * n) - 1 else value
    return value, at + n


def _elements(f: Ranges, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        head = f.read(at, min(12, end - at))
        kind, n = _number(head, 0, True)
        size, n = _number(head, n, False)
        stop = end if size < 0 else at + n + size
        if stop > end:
            raise ValueError(f"element {kind:x} at {at} is cut")
        yield kind, at + n, stop
        at = stop


def _values(f: Ranges, at: int, end: int) -> dict[int, bytes]:
    return {kind: f.read(a, b - a) for kind, a, b in _elements(f, at, end) if b - a <= 64}


def _segment(f: Ranges) -> tuple[int, int]:
    for kind, a, b in _elements(f, 0, f.size):
        if kind == _SEGMENT:
            return a, b
    raise ValueError("no segment")


def _int(x: bytes) -> int:
    return int.from_bytes(x, "big")


def _mkv(f: Ranges) -> dict[str, Any]:
    info, video = {}, None
    for kind, a, b in _elements(f, *_segment(f)):
        if kind == _INFO:
            info = _values(f, a, b)
        elif kind == _TRACKS:
            for k, x, y in _elements(f, a, b):
                track = _values(f, x, y) if k == _TRACK else {}
                if _int(track.get(_TYPE, b"")) == 1 and video is None:
                    video = track | next((_values(f, p, q) for i, p, q in _elements(f, x, y) if i == _VIDEO), {})
        elif kind == _CLUSTER and video is not None:
            break  # what describes the media stands before it
    if video is None:
        raise ValueError("no video track")
    raw = info.get(_DURATION, b"")
    length = struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if raw else None
    duration = None if length is None else length * (_int(info[_SCALE]) if _SCALE in info else 1_000_000) / 1e9
    step, code = _int(video.get(_FRAME_NS, b"")), video[_CODEC].decode()
    return {"width": _int(video[_WIDTH]), "height": _int(video[_HEIGHT]), "fps": 1e9 / step if step else None, "duration": duration, "codec": CODECS.get(code, code), "pix_fmt": None, "frames": None}


# Any of them ---------------------------------------------------------------------------------------------------------------


def describe(f: Ranges) -> dict[str, Any]:
    head = f.read(0, 12)
    if head[:4] == b"RIFF":
        kind, parts = _riff(f)
        if kind in (b"AVI ", b"WAVE"):
            return (_avi if kind == b"AVI " else _wav)(f, parts)
    elif _int(head[:4]) == _EBML:
        return _mkv(f)
    elif head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
        return _mp4(f)
    raise ValueError("no container that is known")


def probe(path: str) -> dict[str, Any]:
    """width, height, fps, duration in seconds rounded to thousandths, codec, pix_fmt and frames of a file, as far as its header says; what is none of these containers, or cut, raises ValueError."""
    f = Ranges(path)
    try:
        out = describe(f)
    finally:
        f.close()
    return out | {"duration": None if out["duration"] is None else round(out["duration"], 3)}


def count_packets(f: Ranges) -> int:
    """Frames of a Matroska file's video track by the heads of its blocks; of other containers by their header."""
    if _int(f.read(0, 4)) != _EBML:
        return describe(f)["frames"]
    number, count, begin = None, 0, _segment(f)
    for kind, a, b in _elements(f, *begin):
        if kind == _TRACKS:
            tracks = [_values(f, x, y) for k, x, y in _elements(f, a, b) if k == _TRACK]
            number = next((_int(t[_NUMBER]) for t in tracks if _int(t.get(_TYPE, b"")) == 1), None)
        elif kind == _CLUSTER:
            for k, x, y in _elements(f, a, b):
                inner = [(x, y)] if k == _SIMPLE else [(p, q) for i, p, q in _elements(f, x, y) if i == _BLOCK] if k == _GROUP else []
                count += sum(_number(f.read(p, min(8, q - p)), 0, False)[0] == number for p, q in inner)
    return count


def probe_files(found: DataFrame) -> DataFrame:
    """files (path, ...) with what probe() reads of each, or nulls and the error."""
    return files.probe(found, probe)


def frame_counts(found: DataFrame, path: str = "path") -> DataFrame:
    """files with frames long and error: the header's number of frames, else the packets of the video track, else duration times rate; null with the error where a file can't be read."""
    names = found.columns

    def count(batches):
        for batch in batches:
            rows = []
            for name in batch.column(names.index(path)).to_pylist():
                f = None
                try:
                    f = Ranges(name)
                    head = describe(f)
                    packets = count_packets(f) if head["frames"] is None else None
                    rows.append((head["frames"], packets or None, head["duration"], str(head["fps"] or 0), None))
                except Exception as e:
                    rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
                finally:
                    if f:
                        f.close()
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], [*names, "_header", "_packets", "_seconds", "_rate", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    out = found.mapInArrow(count, f"{fields}, _header long, _packets long, _seconds double, _rate string, error string")
    return out.select(*names, files.frame_count(F.col("_packets"), F.col("_header"), F.col("_seconds"), F.col("_rate")).alias("frames"), "error")


def fetch_samples(found: DataFrame, path: str = "path", index: str = "idx") -> DataFrame:
    """files with `data`: the bytes of the one sample that index names; rows of a file share its table of samples, and nothing else of it is read. Null where there is none."""
    names = found.columns

    def fetch(batches):
        known, file = (None, []), None
        for batch in batches:
            out = []
            for name, i in zip(batch.column(names.index(path)).to_pylist(), batch.column(names.index(index)).to_pylist()):
                if known[0] != name:
                    known, file = (name, samples(name)), open_file(name)
                if i is None or not 0 <= i < len(known[1]):
                    out.append(None)
                    continue
                at, size = known[1][i]
                file.seek(at)
                out.append(file.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "data"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.sortWithinPartitions(path, index).mapInArrow(fetch, f"{fields}, data binary")


# Writers -------------------------------------------------------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def write_mp4(frames: list[bytes], width: int, height: int, units: int, step: int, code: bytes = b"avc1", front: bool = False) -> bytes:
    """A movie of one video track: frames of `step` units each, `units` of which are a second; front: what describes it stands before the media."""
    head, length = _box(b"ftyp", b"isom\0\0\2\0isommp42"), len(frames) * step
    full = b"\0\0\0\0"
    config = _box(b"avcC", bytes([1, 100, 0, 31, 255, 224, 0])) if code == b"avc1" else b""
    entry = _box(code, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", width, height, 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), b"\0\x18\xff\xff", config)

    def movie(at: int) -> bytes:
        table = _box(b"stbl", _box(b"stsd", full, struct.pack(">I", 1), entry), _box(b"stts", full, struct.pack(">III", 1, len(frames), step)), _box(b"stsc", full, struct.pack(">IIII", 1, 1, max(1, len(frames)), 1)),
                     _box(b"stsz", full, struct.pack(">II", 0, len(frames)), struct.pack(f">{len(frames)}I", *map(len, frames))), _box(b"stco", full, struct.pack(">II", 1, at)))
        media = _box(b"mdia", _box(b"mdhd", full, struct.pack(">IIIIHH", 0, 0, units, length, 0x55C4, 0)), _box(b"hdlr", full, bytes(4), b"vide", bytes(13)), _box(b"minf", _box(b"vmhd", b"\0\0\0\1", bytes(8)), table))
        track = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIII", 0, 0, 1, 0, length), bytes(52), struct.pack(">II", width << 16, height << 16))
        return _box(b"moov", _box(b"mvhd", full, struct.pack(">IIII", 0, 0, units, length), bytes(80)), _box(b"trak", track, media))

    before = len(head) + (len(movie(0)) if front else 0) + 8
    return head + (movie(before) if front else b"") + _box(b"mdat", *frames) + (b"" if front else movie(before))


def resampled(data: bytes, rate: int) -> bytes:
    """An MP4 of whole samples, as a codec of single frames has them, at another rate: frame i is what the first one shows at its time, so frames are left out or shown again; the last moment is kept, and one frame at least."""
    f = Ranges(data)
    head, places = describe(f), samples(data)
    units = round(head["fps"] * 1000) if head["fps"] else 1
    code = {"h264": b"avc1", "hevc": b"hvc1"}.get(head["codec"], head["codec"].encode()[:4].ljust(4))
    chosen = [places[min(len(places) - 1, i * units // (rate * 1000))] for i in range(max(1, len(places) * rate * 1000 // units))] if places else []
    return write_mp4([f.read(a, n) for a, n in chosen], head["width"], head["height"], rate * 100, 100, code)


def _chunk(kind: bytes, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return struct.pack("<4sI", kind, len(data)) + data + bytes(len(data) & 1)


def write_avi(frames: list[bytes], width: int, height: int, rate: int, scale: int, code: bytes = b"MJPG") -> bytes:
    n = len(frames)
    main = _chunk(b"avih", struct.pack("<10I", 1_000_000 * scale // rate, 0, 0, 0, n, 0, 1, 0, width, height), bytes(16))
    stream = _chunk(b"LIST", b"strl", _chunk(b"strh", b"vids", code, struct.pack("<10I", 0, 0, 0, scale, rate, 0, n, 0, 0, 0), bytes(8)), _chunk(b"strf", struct.pack("<IIIHH4s", 40, width, height, 1, 24, code), bytes(20)))
    body = b"AVI " + _chunk(b"LIST", b"hdrl", main, stream) + _chunk(b"LIST", b"movi", *(_chunk(b"00dc", x) for x in frames))
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def _element(kind: int, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + ((1 << 56) | len(data)).to_bytes(8, "big") + data


def write_mkv(frames: list[bytes], width: int, height: int, step_ns: int, code: bytes = b"V_VP9", per_cluster: int = 16) -> bytes:
    """Blocks of frames of track 1 in clusters; odd clusters hold groups, even ones simple blocks."""
    n8 = lambda x: x.to_bytes(8, "big")
    info = _element(_INFO, _element(_SCALE, n8(1_000_000)), _element(_DURATION, struct.pack(">d", len(frames) * step_ns / 1e6)))
    track = _element(_TRACK, _element(_NUMBER, b"\1"), _element(_TYPE, b"\1"), _element(_CODEC, code), _element(_FRAME_NS, n8(step_ns)), _element(_VIDEO, _element(_WIDTH, n8(width)), _element(_HEIGHT, n8(height))))
    clusters = []
    for c, i in enumerate(range(0, len(frames), per_cluster)):
        blocks = [b"\x81\0\0\0" + x for x in frames[i : i + per_cluster]]
        clusters.append(_element(_CLUSTER, _element(0xE7, n8(i)), *(_element(_SIMPLE, x) if c % 2 == 0 else _element(_GROUP, _element(_BLOCK, x)) for x in blocks)))
    return _element(_EBML, _element(0x4282, b"matroska")) + _element(_SEGMENT, info, _element(_TRACKS, track), *clusters)

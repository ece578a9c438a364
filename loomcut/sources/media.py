"""Frames and sound of files through decoders that are passed in, and plain formats that need none: PPM and PGM images, one or many in a file, and WAV sound."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.options import retried
from ..functions.pixels import luma
from .shared import PartReader, read_bytes

FRAMES = "idx int, h int, w int, data binary, error string"
Image = np.ndarray


def write_ppm(images: list[Image]) -> bytes:
    """Images of RGB bytes one after another."""
    return b"".join(b"P6\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.astype(np.uint8).tobytes() for x in images)


def read_ppm(data: bytes) -> Iterator[Image]:
    """Images of a PPM (color) or PGM (gray) file as RGB; a cut one raises."""
    at, head = 0, re.compile(rb"\s*P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s")
    while at < len(data):
        m = head.match(data, at)
        if not m:
            raise ValueError("no PPM image")
        channels, w, h = (3 if m[1] == b"6" else 1), int(m[2]), int(m[3])
        at = m.end() + channels * w * h
        if at > len(data):
            raise ValueError("a cut image")
        yield np.broadcast_to(np.frombuffer(data, np.uint8, channels * w * h, m.end()).reshape(h, w, channels), (h, w, 3))


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """Sound as 16 bits a sample; samples is (n,) or (n, channels), from -1 to 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples as (n, channels) from -1 to 1, rate)."""
    with wave.open(io.BytesIO(data)) as f:
        kind = {1: "u1", 2: "<i2", 4: "<i4"}[f.getsampwidth()]
        raw = np.frombuffer(f.readframes(f.getnframes()), kind).reshape(-1, f.getnchannels()).astype(float)
        return ((raw - 128) / 128 if kind == "u1" else raw / (32767 if kind == "<i2" else 2147483647)), f.getframerate()


def rgba(image: Image, alpha: int = 255) -> Image:
    return np.concatenate([image[..., :3], np.full((*image.shape[:2], 1), alpha, np.uint8)], 2)


def frames(files: DataFrame, plan: Callable[[int], list[int]] | None = None, decoder: Callable[[bytes], Iterator[Image]] = read_ppm, most: int | None = None, path: str = "path") -> DataFrame:
    """(path, idx, h, w, data, error): frames of each file, in RGB bytes row by row, those that plan picks from the number there are, `most` at the most.

    A file that is cut short gives what comes before the cut. Reading is tried again after an error, a missing file's excepted; what can't be read gives one
    row with the error.
    """
    read = retried(read_bytes)

    def decode(name: str):
        images = []
        try:
            for x in decoder(read(name)):
                images.append(np.asarray(x))
                if most and not plan and len(images) >= most:
                    break
        except Exception as e:
            if not images:
                yield None, None, f"{type(e).__name__}: {e}"
                return
        chosen = range(len(images)) if plan is None else [i for i in plan(len(images)) if 0 <= i < len(images)]
        yield from ((i, images[i], None) for i in list(chosen)[:most])

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for i, x, error in decode(name):
                    h, w, data = (None, None, None) if x is None else (*x.shape[:2], np.ascontiguousarray(x[..., :3]).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["path", "idx", "h", "w", "data", "error"])

    return files.select(F.col(path).alias("path")).mapInArrow(run, f"path string, {FRAMES}")


def sound(files: DataFrame, rate: int | None = None, start: Column | None = None, duration: Column | None = None, decoder: Callable[[bytes], tuple[np.ndarray, int]] = read_wav, path: str = "path", at: tuple[str, str] | None = None) -> DataFrame:
    """files with samples array<double>: the mean of the channels, from `start` seconds on, drawn at `rate` by linear interpolation, cut or filled with zeros to
    `duration` seconds; and rate int. Both null where the file can't be read. at: columns with the place and length of a sound within its file, as sinks.write_packs() has them; else the file is one sound."""
    none = F.lit(None).cast("double")
    rows = files.select("*", F.col(path).alias("_p"), (none if start is None else start.cast("double")).alias("_s"), (none if duration is None else duration.cast("double")).alias("_d"), *[(F.lit(None) if c is None else F.col(c)).cast("long").alias(f"_{n}") for n, c in enumerate(at or (None, None))])
    names = files.columns

    def one(read, name, begin, seconds, *place):
        try:
            x, own = decoder(read(name, *place))
        except Exception:
            return None, None
        x, to = np.asarray(x, float), rate or own
        x = x.mean(1) if x.ndim > 1 else x
        x = x[int((begin or 0) * own) :]
        if to != own and len(x):
            x = np.interp(np.arange(int(len(x) * to / own)) * own / to, np.arange(len(x)), x)
        if seconds is not None:
            n = int(seconds * to)
            x = np.concatenate([x[:n], np.zeros(max(0, n - len(x)))])
        return x.tolist(), to

    def run(batches):
        read = PartReader()
        for batch in batches:
            found = [one(read, *given) for given in zip(*(c.to_pylist() for c in batch.columns[len(names) :]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([r for _, r in found], pa.int32())], [*names, "samples", "rate"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return rows.mapInArrow(run, f"{fields}, samples array<double>, rate int")


class Clip:
    """One clip of a table of frames as a sequence: what is asked for is read, nothing else."""

    def __init__(self, table: DataFrame, path: str, size: tuple[int, int] | None = None):
        self.rows, self.path, self.size = table.where(F.col("path") == path).where("error is null"), path, size

    def __len__(self) -> int:
        return self.rows.count()

    @property
    def shape(self) -> tuple[int, int]:
        r = self.rows.select("h", "w").first()
        return self.size or (r.h, r.w)

    def __getitem__(self, i: int) -> Image:
        found = self.rows.where(F.col("idx") == (i if i >= 0 else len(self) + i)).first()
        if found is None:
            raise IndexError(i)
        x = np.frombuffer(found.data, np.uint8).reshape(found.h, found.w, 3)
        if self.size:
            h, w = self.size
            x = x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]
        return x

    def resized(self, h: int, w: int) -> Clip:
        clip = Clip.__new__(Clip)
        clip.rows, clip.path, clip.size = self.rows, self.path, (h, w)
        return clip

    def gray(self, i: int) -> np.ndarray:
        return luma(self[i])

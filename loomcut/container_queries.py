"""Queries over media containers and archives that are written from whole tables, as many files as these have rows or more than one task to a file."""

from __future__ import annotations

import io
import tarfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans import steps
from .registry import query, table
from .sources import archive, containers, files, media, shared, sinks, weights

# A file for each document, a container of every kind; every ninth is cut in its middle.
_RATES = (10, 12, 15, 20, 24, 25, 30, 50, 60)
_SUFFIX = ("mp4", "mov", "avi", "mkv", "wav")


def _frames_of(doc: int, n: int) -> list[bytes]:
    return [f"{doc}:{i}".encode() for i in range(n)]


@F.pandas_udf(T.BinaryType())
def _container(doc: pd.Series, size: pd.Series) -> pd.Series:
    out = []
    for d, n_chars in zip(doc.tolist(), size.tolist()):
        frames, width, height, rate = _frames_of(d, 1 + n_chars % 97), 16 * (1 + d % 120), 16 * (1 + d % 67), _RATES[d % len(_RATES)]
        kind = d % 5
        if kind < 2:
            data = containers.write_mp4(frames, width, height, rate * 100, 100, b"avc1" if kind == 0 else b"hvc1", front=kind == 1)
        elif kind == 2:
            data = containers.write_avi(frames, width, height, rate, 1)
        elif kind == 3:
            data = containers.write_mkv(frames, width, height, 1_000_000_000 // rate)
        else:
            data = media.write_wav(np.zeros(len(frames)), 8)
        out.append(data[: len(data) // 2] if d % 9 == 0 else data)
    return pd.Series(out)


def _name() -> Column:
    return F.concat(F.lit("d"), F.pmod("doc_id", F.lit(16)), F.lit("/"), "doc_id", F.lit("."), F.element_at(F.array(*[F.lit(s) for s in _SUFFIX]), (F.col("doc_id") % 5 + 1).cast("int")))


def _library(spark: SparkSession, sf: str) -> str:
    """A folder with a container for each document."""
    root = shared.new_path(spark, "library")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    sinks.write_files(docs, root, _name(), _container("doc_id", "n_chars")).write.format("noop").mode("overwrite").save()
    return root


def _doc() -> Column:
    return F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("long").alias("doc_id")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan(spark, _library(spark, sf), _SUFFIX)


_FILES = """
WITH d AS (SELECT doc_id, doc_id % 9 <> 0 AS whole, doc_id % 5 AS kind, 1 + n_chars % 97 AS n, 16 * (1 + doc_id % 120) AS w, 16 * (1 + doc_id % 67) AS h, [10, 12, 15, 20, 24, 25, 30, 50, 60][CAST(doc_id % 9 + 1 AS INTEGER)] AS rate FROM documents) """


@query(_FILES + """
SELECT doc_id, CASE WHEN whole AND kind < 4 THEN CAST(w AS INTEGER) END AS width, CASE WHEN whole AND kind < 4 THEN CAST(h AS INTEGER) END AS height,
       CASE WHEN whole THEN round(CASE kind WHEN 3 THEN 1e9::DOUBLE / (1000000000 // rate) WHEN 4 THEN 8 ELSE rate END, 6) END AS fps,
       CASE WHEN whole THEN round(CASE kind WHEN 3 THEN n * (1000000000 // rate) / 1e9::DOUBLE WHEN 4 THEN n / 8.0::DOUBLE ELSE n / rate::DOUBLE END, 3) END AS duration,
       CASE WHEN whole THEN CASE kind WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'mjpeg' WHEN 3 THEN 'vp9' ELSE 'pcm_s16le' END END AS codec,
       CASE WHEN whole AND kind = 0 THEN 'yuv420p' END AS pix_fmt, NOT whole AS failed FROM d""")
def src2_probe_containers(spark, sf):
    """SRC1, SRC2: size, rate, duration and codec from the headers of real containers; files that are cut give the error."""
    out = containers.probe_files(_found(spark, sf))
    return out.select(_doc(), "width", "height", F.round("fps", 6).alias("fps"), "duration", "codec", "pix_fmt", F.col("error").startswith("ValueError: ").alias("failed")).na.fill(False, ["failed"])


@query(_FILES + "SELECT doc_id, CASE WHEN whole THEN CAST(n AS INTEGER) ELSE 0 END AS num_frames, CASE WHEN whole AND kind < 4 THEN CAST(h AS INTEGER) ELSE 0 END AS height, true AS sized FROM d WHERE kind < 3")
def src3_probe_counts_containers(spark, sf):
    """SRC3: frames from duration and rate, and megabytes, zeros where a file is cut."""
    out = files.probe_counts(_found(spark, sf).where("path not like '%.wav' and path not like '%.mkv'"), containers.probe)
    return out.select(_doc(), "num_frames", "height", ((F.col("file_size_mb") > 0) | F.col("error").isNotNull()).alias("sized"))


@query(_FILES + "SELECT doc_id, CASE WHEN whole THEN n END AS frames FROM d")
def src4_counted_frames(spark, sf):
    """SRC4: frames that the header counts, else the packets of the video track."""
    return containers.frame_counts(_found(spark, sf)).select(_doc(), "frames")


@query(_FILES + "SELECT doc_id, CAST(i AS INTEGER) AS idx, CASE WHEN i < n THEN doc_id || ':' || i END AS data FROM d, (SELECT unnest([0, 7, 30]) AS i) WHERE whole AND kind < 2")
def src21_sample_ranges(spark, sf):
    """SRC21, SRC23: some frames of a file by their ranges, the rest unread."""
    root = _library(spark, sf)
    found = files.scan(spark, root, ("mp4", "mov")).select("path", _doc()).where("doc_id % 9 <> 0")
    asked = found.select("path", "doc_id", F.explode(F.array(F.lit(0), F.lit(7), F.lit(30))).alias("idx"))
    return containers.fetch_samples(asked).select("doc_id", "idx", F.col("data").cast("string").alias("data"))


@query(_FILES + """
SELECT doc_id, CASE WHEN NOT whole THEN 'failed' WHEN rate = 25 THEN 'copied' ELSE 'encoded' END AS done, CASE WHEN whole THEN CASE WHEN rate = 25 THEN n ELSE greatest(1, n * 25 // rate) END END AS frames,
       CASE WHEN whole THEN 25.0::DOUBLE END AS fps FROM d WHERE kind < 2""")
def snk4_encode_containers(spark, sf):
    """SNK4, PRJ14, MTH6: movies of the wanted rate copied, others brought to it; what the files in the new folder say, and which ones failed."""
    root, dest = _library(spark, sf), shared.new_path(spark, "encoded")
    found = containers.probe_files(files.scan(spark, root, ("mp4", "mov")))
    plan = steps.resample_plan(found.select("path", F.coalesce("fps", F.lit(0.0)).alias("fps")), 25.0)
    tried = shared.stored(sinks.encode_stage(plan.select("path", "fps", "action"), dest, lambda data: containers.resampled(data, 25)), "tried")
    made = containers.frame_counts(containers.probe_files(files.scan(spark, dest, ("mp4", "mov"))).select(F.col("path").alias("made"), F.col("fps").alias("new_fps"), "path")).select(_doc(), "frames", "new_fps")
    done = F.when(F.col("error").isNotNull(), "failed").when(F.col("action") == "copy", "copied").otherwise("encoded")
    return tried.select(_doc(), done.alias("done")).join(made, "doc_id", "left").select("doc_id", "done", "frames", F.round("new_fps", 6).alias("fps"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS flat, CAST(n_chars % 97 AS BIGINT) + 1 AS length FROM documents WHERE doc_id % 5 <> 0")
def src19_flat_scan(spark, sf):
    """SRC18, SRC19: images of a folder alone, and of all below it."""
    root, k = shared.new_path(spark, "flat"), F.col("doc_id")
    name = F.concat(F.when(k % 3 == 0, "deep/").otherwise(""), k, F.when(k % 5 == 0, ".txt").when(k % 2 == 0, ".JPG").otherwise(".png"))
    sinks.write_files(table(spark, sf, "documents"), root, name, F.repeat(F.lit("x"), (F.col("n_chars") % 97 + 1).cast("int"))).write.format("noop").mode("overwrite").save()
    flat = files.images(spark, root, recursive=False).select(_doc(), F.lit(True).alias("flat"))
    return files.images(spark, root).select(_doc(), "length").join(flat, "doc_id", "left").na.fill(False, ["flat"])


@query("SELECT doc_id, doc_id % 9 <> 4 AS copied, count(*) OVER (PARTITION BY doc_id // 2) > 1 AS collides FROM documents")
def snk3_copy_documents(spark, sf):
    """SNK3: a file for each document copied to one folder, those that aren't there and those whose names collide told apart."""
    root, k = shared.new_path(spark, "copies"), F.col("doc_id")
    name = F.concat(k % 2, F.lit("/"), F.floor(k / 2), F.lit(".bin"))
    docs = table(spark, sf, "documents").select("doc_id")
    sinks.write_files(docs.where(k % 9 != 4), f"{root}/from", name, k.cast("string")).write.format("noop").mode("overwrite").save()
    out = sinks.copy_stage(docs.select("doc_id", F.concat(F.lit(f"{root}/from/"), name).alias("video_path")), f"{root}/to")
    return out.select("doc_id", F.col("video_path").startswith(f"{root}/to/").alias("copied"), "collides")


# Archives: those of each source in blocks of 500 documents, in turn tar, zip, compressed tar, and tar in two chunks.


def _pack(root: str, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Writes an archive where its group is, so that no batch of rows holds many of them."""
    source, block = key
    kind, out = block % 4, io.BytesIO()
    names = [f"{d % 3}/{d}{'.md' if d % 2 else '.txt'}" for d in pdf["doc_id"]]
    if kind == 1:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, (name, text) in enumerate(zip(names, pdf["text"])):
                z.writestr(name, text, zipfile.ZIP_STORED if i % 3 == 0 else zipfile.ZIP_DEFLATED)
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if kind == 2 else "w", format=tarfile.PAX_FORMAT if kind else tarfile.GNU_FORMAT) as t:
            for name, text in zip(names, pdf["text"]):
                info, data = tarfile.TarInfo(name if name[0] != "2" else "long/" * 40 + name), text.encode()
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    name, data = f"{source}-{block}" + (".tar", ".zip", ".tar.gz", ".tar")[kind], out.getvalue()
    parts = [(name, data)] if kind < 3 else [(f"{name}.000", data[: len(data) // 2]), (f"{name}.001", data[len(data) // 2 :])]
    for name, data in parts:
        shared.write_bytes(f"{root}/{name}", data)
    return pd.DataFrame([(name, len(data)) for name, data in parts], columns=["name", "length"])


def _packed(spark: SparkSession, sf: str) -> str:
    root = shared.new_path(spark, "packed")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"), F.floor(F.col("doc_id") / 500).alias("block"))
    docs.groupBy("source", "block").applyInPandas(lambda key, pdf: _pack(root, key, pdf), "name string, length long").write.format("noop").mode("overwrite").save()
    return root


_PACKED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS source, doc_id // 500 AS block FROM documents),
m AS (SELECT doc_id, source || '-' || block || CASE block % 4 WHEN 1 THEN '.zip' WHEN 2 THEN '.tar.gz' ELSE '.tar' END AS archive, text, block % 4 AS kind,
             CASE WHEN doc_id % 3 = 2 AND block % 4 <> 1 THEN repeat('long/', 40) ELSE '' END || doc_id % 3 || '/' || doc_id || CASE WHEN doc_id % 2 = 1 THEN '.md' ELSE '.txt' END AS member FROM d) """


def _short() -> Column:
    return F.substring_index("archive", "/", -1).alias("archive")


@query(_PACKED + "SELECT archive, member, strlen(text) AS size, md5(text) AS content FROM m")
def src15_members_by_ranges(spark, sf):
    """SRC12, SRC13, SRC15: members of whole, split and compressed archives, each archive read by many tasks by an index from its headers."""
    out = archive.read_members(archive.index_members(spark, _packed(spark, sf)), split_bytes=64 << 10)
    return out.where("error is null").select(_short(), "member", "size", F.md5("data").alias("content"))


@query(_PACKED + "SELECT archive, count(*) AS members, count(*) FILTER (member LIKE '%.md') AS notes, CAST(sum(strlen(text)) AS BIGINT) AS size FROM m GROUP BY archive")
def src14_index_counts(spark, sf):
    """SRC14: what archives hold, from their headers alone."""
    out = archive.index_members(spark, _packed(spark, sf))
    return out.groupBy(_short()).agg(F.count("*").alias("members"), F.count_if(F.col("member").endswith(".md")).alias("notes"), F.sum("size").alias("size"))


@query(_PACKED + "SELECT archive, member, md5(text) AS content FROM m WHERE kind IN (0, 1) AND member LIKE '%.md' AND strlen(text) > 300")
def src15_archive_source(spark, sf):
    """SRC15, SRC17: the data source `archive`, its partitions ranges of members, the filters read by it."""
    root = _packed(spark, sf)
    found = archive.find_archives(spark, root).where("size(chunks) = 1 AND archive NOT LIKE '%gz'")
    spark.dataSource.register(archive.ArchiveSource)
    ranges = archive.ranges(found, 64 << 10)  # by tasks; the driver has their places alone, as of any file source
    with shared.setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        rows = spark.read.format("archive").option("ranges", ranges).option("content", "true").option("pushFilters", "true").option("packBytes", 8 << 20).load()
        out = rows.where(F.col("member").endswith(".md") & (F.col("size") > 300)).select(_short(), "member", F.md5("data").alias("content"))
        return shared.stored(out, "members")


# Weights: a file for 40 vectors each, and files that replace every third of them.


def _weight_file(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    vectors = {f"v.{i}": np.array(x, np.float32) for i, x in zip(pdf["vec_id"], pdf["embedding"])}
    new = {n: (x * 2).astype(np.float64).reshape(2, -1) for n, x in vectors.items() if int(n[2:]) % 3 == 0}
    out = [(f"0/{key[0]}.safetensors", weights.write_weights(vectors, {"format": "np"})), (f"1/{key[0]}.safetensors", weights.write_weights(new))]
    return pd.DataFrame(out, columns=["name", "data"])


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    root = shared.new_path(spark, "weights")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 40).alias("block"))
    sinks.write_files(rows.groupBy("block").applyInPandas(_weight_file, "name string, data binary"), root, F.col("name"), F.col("data")).write.format("noop").mode("overwrite").save()
    return weights.tensors(files.scan(spark, root, ("safetensors",)))


@query("""
WITH v AS (SELECT vec_id // 40 AS block, vec_id, len(embedding) AS d FROM embeddings),
k AS (SELECT '0/' || block AS file, unnest(['v.' || vec_id || ':' || d, 'v.' || vec_id]) AS key FROM v UNION ALL
      SELECT '1/' || block, unnest(['v.' || vec_id || ':2_' || d // 2, 'v.' || vec_id]) FROM v WHERE vec_id % 3 = 0)
SELECT file, md5(string_agg(key, ',' ORDER BY key)) AS fingerprint FROM k GROUP BY file""")
def src30_weight_fingerprints(spark, sf):
    """SRC30, AG25, JN13: fingerprints of weight files from their headers alone."""
    return weights.fingerprints(_weights(spark, sf)).select(F.regexp_extract("path", r"([01]/\d+)\.safetensors$", 1).alias("file"), "fingerprint")


@query("""
SELECT 'v.' || vec_id AS name, CASE WHEN vec_id % 3 = 0 THEN 'F64' ELSE 'F32' END AS dtype,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 4) + 0 AS total FROM embeddings""")
def src30_later_weights_win(spark, sf):
    """SRC30, SET5: tensors of two lists of files, those of the later one replacing others, read by their ranges in pieces."""
    index = weights.later_wins(_weights(spark, sf), F.col("path"))
    pieces = weights.values(index, 128).select("name", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("s"))
    sums = pieces.groupBy("name").agg(F.sum("s").alias("s"))
    return index.join(sums, "name").select("name", "dtype", (F.round("s", 4) + 0).alias("total"))

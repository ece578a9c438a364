"""Queries that write files from the given tables into the shared folder, scan, read or copy them, and return what came back."""

from __future__ import annotations

import contextlib
import io
import json
import tarfile

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import options
from .operators import cascade
from .registry import query, table
from .sources import archive, files, manifest, shared, sinks

#: Suffixes of the files that stand for clips; the third is none of a video.
_KINDS = ("mp4", "MKV", "txt", "mov")
_KIND_SQL = "CASE n_nationkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MKV' WHEN 2 THEN 'txt' ELSE 'mov' END"


def _kind() -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("n_nationkey") % 4 + 1).cast("int"))


def _content() -> Column:
    return F.to_json(F.struct(F.col("n_nationkey").alias("key")))


def _done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _tree(spark: SparkSession, sf: str) -> str:
    """A folder with a file for each nation, in a folder for each region."""
    root = shared.new_path(spark, "tree")
    _done(sinks.write_files(table(spark, sf, "nation"), root, F.concat(F.lit("r"), "n_regionkey", F.lit("/"), "n_name", F.lit("."), _kind()), _content()))
    return root


def _prober(path: str) -> dict:
    k = json.loads(shared.read_bytes(path))["key"]
    if k % 5 == 0:
        raise ValueError("no stream")
    return {"width": k * 16, "height": k * 9, "fps": 24.0 + k, "duration": k / 2, "codec": "h264", "pix_fmt": "yuv420p"}


def _stem() -> Column:
    return F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem")


@query("SELECT 'r' || n_regionkey AS folder, count(*) AS files FROM nation WHERE n_nationkey % 4 <> 2 GROUP BY 1")
def src1_scan_videos(spark, sf):
    """SRC1, SRC16, SRC17: videos below a folder, by the folder they are in."""
    found = files.scan(spark, _tree(spark, sf))
    return found.groupBy(F.regexp_extract("path", "/([^/]*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


@query("SELECT n_name AS stem, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 16 END AS width, CASE WHEN n_nationkey % 5 <> 0 THEN 24.0::DOUBLE + n_nationkey END AS fps, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError: no stream' END AS error FROM nation WHERE n_nationkey % 4 <> 2")
def src2_probe(spark, sf):
    """SRC2: what a prober reads from each file, its error where it fails."""
    return files.probe(files.scan(spark, _tree(spark, sf)), _prober).select(_stem(), "width", "fps", "error")


@query("SELECT n_name AS stem, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE CAST(round_even(n_nationkey / 2.0 * (24 + n_nationkey), 0) AS INTEGER) END AS num_frames, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE n_nationkey * 9 END AS height, n_nationkey % 5 <> 0 AS sized FROM nation WHERE n_nationkey % 4 <> 2")
def src3_probe_counts(spark, sf):
    """SRC3: the probe with frames and megabytes, zeros where it fails."""
    return files.probe_counts(files.scan(spark, _tree(spark, sf)), _prober).select(_stem(), "num_frames", "height", (F.col("file_size_mb") > 0).alias("sized"))


@query("""
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/v/' || doc_id WHEN 1 THEN '' END AS v, CASE WHEN doc_id % 3 = 0 THEN '/p/' || doc_id END AS p FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, coalesce(nullif(v, ''), p) AS key FROM r WHERE coalesce(nullif(v, ''), p, '') <> ''""")
def src6_records(spark, sf):
    """SRC5, SRC6: JSON lines, blank ones skipped, rows that name no file too."""
    path = shared.new_path(spark, "records") + ".jsonl"
    k = F.col("doc_id")
    row = F.to_json(F.struct("doc_id", F.when(k % 4 == 0, F.concat(F.lit("/v/"), k)).when(k % 4 == 1, "").alias("video_path"), F.when(k % 3 == 0, F.concat(F.lit("/p/"), k)).alias("path")))
    table(spark, sf, "documents").select(F.when(k % 7 == 0, "").otherwise(row).alias("value")).write.text(path)
    out = files.read_records(spark, path, "doc_id long, video_path string, path string")
    return out.select("doc_id", files.record_key().alias("key"))


@query("SELECT '/v/' || o_orderkey || '.mp4' AS video_path FROM orders")
def src7_video_paths(spark, sf):
    """SRC7: the one column of paths, which every row must have."""
    path = shared.new_path(spark, "paths") + ".jsonl"
    files.write_jsonl(table(spark, sf, "orders").select(F.format_string("/v/%d.mp4", "o_orderkey").alias("video_path"), "o_orderstatus"), path)
    return files.read_video_paths(spark, path)


@query("SELECT doc_id, lang, 1 AS missing FROM documents")
def src10_merged_csv(spark, sf):
    """SRC10, SNK7: tables of a list of files as one, files that are not there reported."""
    root, docs = shared.new_path(spark, "merge"), table(spark, sf, "documents").select("doc_id", "lang")
    for i in range(3):
        sinks.write_csv(docs.where(F.pmod("doc_id", F.lit(3)) == i), f"{root}/{i}.csv")
    rows, missing = sinks.read_if_there(spark, [f"{root}/{i}.csv" for i in range(4)], "doc_id long, lang string")
    sinks.write_csv(rows, f"{root}/all.csv")
    return files.read_metadata(spark, f"{root}/all.csv", "doc_id long, lang string").withColumn("missing", F.lit(len(missing)))


@query("SELECT column_name AS name, CAST(ordinal_position - 1 AS INTEGER) AS pos FROM information_schema.columns WHERE table_name = 'customer'")
def src11_csv_header(spark, sf):
    """SRC11: the names of a CSV file's columns."""
    path = shared.new_path(spark, "customers")
    sinks.write_csv(table(spark, sf, "customer"), path)
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in files.header(spark, path)])).alias("pos", "name"))


@query("SELECT o_orderkey, o_totalprice / 10000 >= 10 AND o_orderkey % 3 <> 0 AS kept FROM orders")
def snk2_survivors(spark, sf):
    """SNK1, SNK2: records through a filter, survivors and rejects in files of their own."""
    path, k = shared.new_path(spark, "curated"), F.col("o_orderkey")
    wide = k % 3 != 0
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("duration"), F.when(wide, 1920).otherwise(1080).alias("width"), F.when(wide, 1080).otherwise(1920).alias("height"))
    files.write_survivors(cascade.run(df, ["duration_resolution"]), f"{path}/kept.jsonl", rejects=f"{path}/rejected.jsonl")
    read = lambda name: files.read_metadata(spark, f"{path}/{name}.jsonl", "o_orderkey long, filter_pass boolean")
    return read("kept").union(read("rejected")).withColumnRenamed("filter_pass", "kept")


@query("SELECT n_nationkey, n_nationkey % 6 <> 0 AS copied, count(*) OVER (PARTITION BY n_nationkey % 20) > 1 AS collides, 'f' || n_nationkey % 20 || '.bin' AS name FROM nation")
def snk3_copy_stage(spark, sf):
    """SNK3: files copied to one folder, records with their new paths, base names that collide marked."""
    root, k = shared.new_path(spark, "copy"), F.col("n_nationkey")
    name = F.concat(F.lit("d"), k, F.lit("/f"), k % 20, F.lit(".bin"))
    _done(sinks.write_files(table(spark, sf, "nation").where(k % 6 != 0), f"{root}/from", name, _content()))
    records = table(spark, sf, "nation").select(k, F.concat(F.lit(f"{root}/from/"), name).alias("video_path"))
    out = sinks.copy_stage(records, f"{root}/to")
    there = F.col("video_path").startswith(f"{root}/to/")
    return out.select("n_nationkey", there.alias("copied"), "collides", F.substring_index("video_path", "/", -1).alias("name"))


@query("""
WITH s AS (SELECT n_nationkey, n_name || '.' || """ + _KIND_SQL + """ AS name, '{"key":' || n_nationkey || '}' AS s FROM nation)
SELECT name, CASE WHEN n_nationkey % 3 = 1 THEN s ELSE reverse(s) END AS content FROM s""")
def snk4_encode_stage(spark, sf):
    """SNK4: clips of the wanted rate copied, others through an encoder; what lies in the folder then."""
    from .plans import steps

    root, dest = _tree(spark, sf), shared.new_path(spark, "encoded")
    k = F.col("n_nationkey")
    path = F.concat(F.lit(f"{root}/r"), "n_regionkey", F.lit("/"), "n_name", F.lit("."), _kind())
    plan = steps.resample_plan(table(spark, sf, "nation").select(path.alias("path"), (k % 3 * 8.0 + 8).alias("fps")), 16.0)
    _done(sinks.encode_stage(plan.drop("args"), dest, lambda data: data[::-1]))
    found = spark.read.format("binaryFile").load(dest)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("content"))


def _captioner(path: str) -> str:
    if path.endswith("3.mp4"):
        raise OSError("unreadable")
    return f"caption of {path}"


@query("SELECT '/v/' || c_custkey || '.mp4' AS video_path, CASE WHEN c_custkey % 10 <> 3 THEN 'caption of /v/' || c_custkey || '.mp4' END AS caption FROM customer")
def snk5_captions_resumed(spark, sf):
    """SNK5, ST7, FLT18: captions of half the clips, then of all that have none yet."""
    path = shared.new_path(spark, "captions")
    videos = table(spark, sf, "customer").select("c_custkey", F.format_string("/v/%d.mp4", "c_custkey").alias("video_path"))
    sinks.append_captions(videos.where("c_custkey % 2 = 0"), _captioner, path)
    sinks.append_captions(videos, _captioner, path)
    return spark.read.schema("video_path string, caption string").json(path)


def _breaks_down(path: str) -> str:
    if path.endswith("77.mp4"):
        raise MemoryError(path)
    return _captioner(path)


@query("SELECT '/v/' || c_custkey || '.mp4' AS video_path, CASE WHEN c_custkey % 10 <> 3 THEN 'caption of /v/' || c_custkey || '.mp4' END AS caption FROM customer")
def snk5_captions_committed(spark, sf):
    """SNK5, SNK15, ST7: captions in commits: of a third of the clips, then a go that breaks down and leaves files that no commit names, then of all that are left; each is there once."""
    path = shared.new_path(spark, "committed")
    videos = table(spark, sf, "customer").select("c_custkey", F.format_string("/v/%d.mp4", "c_custkey").alias("video_path")).repartition(4, "c_custkey")
    manifest.commit_captions(videos.where("c_custkey % 3 = 0"), _captioner, path)
    with contextlib.suppress(PySparkException):
        manifest.commit_captions(videos, _breaks_down, path, fatal=MemoryError)
    manifest.commit_captions(videos, _captioner, path)
    return manifest.read(spark, path, "video_path string, caption string")


@query("SELECT event_id, event_type AS kind, round(value, 6) AS value FROM events")
def snk15_diagnostics_committed(spark, sf):
    """SNK15, ST7: a stream's rows in commits by batch, over two goes, of which the second has new rows."""
    path, events = shared.new_path(spark, "diagnostics"), table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    spark.dataSource.register(manifest.ManifestSource)
    for go in (0, 1):
        events.where(F.col("event_id") % 2 == go).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        stream.writeStream.format("manifest").option("path", f"{path}/log").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return manifest.read(spark, f"{path}/log", "event_id long, kind string, value double").withColumn("value", F.round("value", 6))


@query("SELECT '/v/' || doc_id AS video, source || ', \"' || lang || '\" it''s' || chr(10) || 'two' AS prompt FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND source IS NOT NULL")
def snk6_train_csv(spark, sf):
    """SNK6: training rows as CSV with quotes, commas and line breaks, read again."""
    path, k = shared.new_path(spark, "train"), F.col("doc_id")
    caption = F.concat(F.lit("  "), "source", F.lit(', "'), "lang", F.lit('" it\'s\ntwo '))
    files.write_train_csv(table(spark, sf, "documents").select(F.concat(F.lit("/v/"), k).alias("video_path"), F.when(k % 5 != 0, caption).alias("caption")), path)
    return files.read_metadata(spark, path, "video string, prompt string")


@query("SELECT 'clips_' || coalesce(lang, 'none') || '_' || CAST(floor(count(*) / 1000) + 1 AS BIGINT) || 'k.csv' AS name, count(*) AS rows FROM documents GROUP BY lang")
def snk8_write_groups(spark, sf):
    """SNK8: a folder of CSV for each group, named by its rows; what lies in them."""
    path = shared.new_path(spark, "groups")
    sinks.write_groups(table(spark, sf, "documents").select("doc_id", "n_chars", F.coalesce("lang", F.lit("none")).alias("lang")), "lang", path)
    return spark.read.option("header", True).csv(path).groupBy("name").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 3 <> 0) AS known, min(c_custkey) FILTER (c_custkey % 3 <> 0) AS least, max(c_custkey) FILTER (c_custkey % 3 <> 0) AS most FROM customer")
def snk9_lengths(spark, sf):
    """SNK9: a table with lengths added, and a summary of what was written."""
    out = sinks.write_lengths(table(spark, sf, "customer").select("c_custkey", "c_name"), shared.new_path(spark, "len"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")))
    return out.select("rows", "known", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))


@query("SELECT event_id, round(value, 6) AS motion_score, value >= 2 AND event_id % 20 / 10.0 <= 1.0 AS passed FROM events")
def snk10_motion_records(spark, sf):
    """SNK10, FLT13: every record with its motion scores, passed or not."""
    path = shared.new_path(spark, "motion") + ".jsonl"
    df = table(spark, sf, "events").select("event_id", F.col("value").alias("motion_score"), (F.col("event_id") % 20 / 10).alias("motion_jitter_score"))
    files.write_jsonl(cascade.run(df, ["motion"]), path)
    return files.read_metadata(spark, path, "event_id long, motion_score double, filter_pass boolean").select("event_id", F.round("motion_score", 6).alias("motion_score"), F.col("filter_pass").alias("passed"))


@query("SELECT CAST(doc_id % 8 AS INTEGER) AS rank, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def snk11_rank_cache(spark, sf):
    """SNK11, SRC9: a cache by rank, read rank by rank."""
    path = shared.new_path(spark, "ranks")
    sinks.write_ranks(table(spark, sf, "documents").select("doc_id", "n_chars"), (F.col("doc_id") % 8).cast("int"), path)
    return spark.read.parquet(path).groupBy("rank").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderkey AS step, 'loss' AS name, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'rate', o_orderkey / 8.0::DOUBLE FROM orders WHERE o_orderkey % 3 <> 0")
def snk12_metric_log(spark, sf):
    """SNK12: metrics appended to a log in two goes."""
    path, k = shared.new_path(spark, "metrics"), F.col("o_orderkey")
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("loss"), F.when(k % 3 != 0, k / 8).alias("rate"))
    for half in (0, 1):
        sinks.append_metrics(df.where(k % 2 == half), "o_orderkey", ["loss", "rate"], path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def snk13_checkpoints(spark, sf):
    """SNK13, ST10: the steps after which a state is saved."""
    df = table(spark, sf, "orders")
    last = df.agg(F.max("o_orderkey")).first()[0]
    return df.where(sinks.is_checkpoint(F.col("o_orderkey"), 500, F.lit(last))).select("o_orderkey")


@query("SELECT event_type AS kind, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def snk15_diagnostics(spark, sf):
    """SNK15, ST7: a stream appended to a log, gone on with once; each row is there once."""
    path, events = shared.new_path(spark, "log"), table(spark, sf, "events")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").select("event_id", F.col("event_type").alias("kind"))
        sinks.append_lines(stream, f"{path}/lines", f"{path}/checkpoint")
    return spark.read.schema("event_id long, kind string").json(f"{path}/lines").groupBy("kind").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


def _tar(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """An archive of a region's files; those of every second region in two chunks."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if key[0] % 3 == 0 else "w") as t:
        for name, data in zip(pdf["name"], pdf["data"]):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data.encode()))
    name, data = f"a{key[0]}.tar" + (".gz" if key[0] % 3 == 0 else ""), out.getvalue()
    parts = [(name, data)] if key[0] % 2 == 0 else [(f"{name}.000", data[: len(data) // 2]), (f"{name}.001", data[len(data) // 2 :])]
    return pd.DataFrame(parts, columns=["name", "data"])


def _archives(spark: SparkSession, sf: str) -> str:
    root = shared.new_path(spark, "archives")
    rows = table(spark, sf, "nation").select("n_regionkey", F.concat("n_name", F.lit("."), _kind()).alias("name"), _content().alias("data"))
    _done(sinks.write_files(rows.groupBy("n_regionkey").applyInPandas(_tar, "name string, data binary"), root, F.col("name"), F.col("data")))
    return root


_ARCHIVE_SQL = "'a' || n_regionkey || '.tar' || CASE WHEN n_regionkey % 3 = 0 THEN '.gz' ELSE '' END"


@query(f"SELECT {_ARCHIVE_SQL} AS archive, CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE 2 END AS chunks FROM nation GROUP BY n_regionkey")
def src12_archives(spark, sf):
    """SRC12, SRC13: archives below a folder, split ones with their chunks."""
    return archive.find_archives(spark, _archives(spark, sf)).select(F.substring_index("archive", "/", -1).alias("archive"), F.size("chunks").alias("chunks"))


@query(f"SELECT {_ARCHIVE_SQL} AS archive, count(*) FILTER (n_nationkey % 4 <> 2) AS videos FROM nation GROUP BY n_regionkey")
def src14_archive_videos(spark, sf):
    """SRC14: how many videos archives hold, without taking them out."""
    return archive.count_videos(spark, _archives(spark, sf)).select(F.substring_index("archive", "/", -1).alias("archive"), "videos")


@query(f"SELECT {_ARCHIVE_SQL} AS archive, n_name || '.' || {_KIND_SQL} AS member, '{{\"key\":' || n_nationkey || '}}' AS data FROM nation")
def src15_archive_members(spark, sf):
    """SRC15: members of archives, plain, compressed and split, with their bytes."""
    out = archive.list_members(spark, _archives(spark, sf), content=True)
    return out.select(F.substring_index("archive", "/", -1).alias("archive"), "member", F.col("data").cast("string").alias("data"))


def _attempts(batches):
    for pdf in batches:
        rows = []
        for k in pdf["o_orderkey"].tolist():
            tried = []

            def work(k=k, tried=tried):
                tried.append(1)
                if k % 7 == 0:
                    raise FileNotFoundError(k)
                if len(tried) <= k % 5:
                    raise OSError("busy")

            try:
                options.retried(work, sleep=lambda s: None)()
                rows.append((k, len(tried), True))
            except OSError:  # a missing file is one too
                rows.append((k, len(tried), False))
        yield pd.DataFrame(rows, columns=["o_orderkey", "attempts", "ok"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE least(o_orderkey % 5 + 1, 3) END AS attempts, o_orderkey % 7 <> 0 AND o_orderkey % 5 < 3 AS ok FROM orders")
def st8_retries(spark, sf):
    """ST8: work tried up to three times, a missing file once."""
    return table(spark, sf, "orders").select("o_orderkey").mapInPandas(_attempts, "o_orderkey long, attempts long, ok boolean")


@query("SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS missing FROM documents WHERE doc_id IS NOT NULL")
def flt14_missing_files(spark, sf):
    """FLT14: captions whose file is not there."""
    name = lambda df: df.select(F.concat(F.lit("/v/"), "doc_id").alias("video_path"), "doc_id")
    docs, listing = name(table(spark, sf, "documents")), name(table(spark, sf, "labels")).select(F.col("video_path").alias("path"))
    return files.train_rows(docs, listing).select("doc_id", "missing")

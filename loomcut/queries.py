"""One query for each operator over the given tables, and the SQL that DuckDB answers the same with."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import container_queries, file_queries, media_queries, record_queries  # they add theirs to QUERIES and ORACLE
from .functions import frames, judge, records, regions, schedule, text, vector
from .operators import cascade, combine, lookup, metrics, order, rank
from .plans import graph, steps
from .registry import ORACLE, QUERIES, query, table
from .sources import shared
from .streaming import buffers, clips, state


# Ranking, fills and unions -------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice p, l_discount d, l_tax t, CASE WHEN l_quantity < 25 THEN 'short' ELSE 'long' END grp FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL),
e AS (SELECT grp, min(p) p0, max(p) p1, min(d) d0, max(d) d1, min(t) t0, max(t) t1 FROM g GROUP BY grp),
r AS (SELECT g.*, CASE WHEN p1 = p0 THEN 0.5 ELSE (p - p0) / (p1 - p0) END rp, CASE WHEN d1 = d0 THEN 0.5 ELSE (d - d0) / (d1 - d0) END rd, CASE WHEN t1 = t0 THEN 0.5 ELSE (t - t0) / (t1 - t0) END rt FROM g JOIN e USING (grp)),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round((rp + rd + rt) / 3, 9) DESC, l_orderkey, l_linenumber) AS rk FROM r)
SELECT grp, l_orderkey || '-' || l_linenumber AS video, 'part of ' || l_orderkey AS prompt, CAST(rk AS INTEGER) AS rank FROM n WHERE rk <= 300""")
def wn1_rank_topn_minmax(spark, sf):
    """WN1, WN2, TK1, FLT15, SET7, PRJ16: relative scores within short and long clips, the best of each as training rows."""
    df = table(spark, sf, "lineitem").na.drop(subset=["l_extendedprice", "l_discount", "l_tax"])
    df = df.withColumn("grp", F.when(F.col("l_quantity") < 25, "short").otherwise("long"))
    scored = rank.relative_scores(df, "grp", ["l_extendedprice", "l_discount", "l_tax"])
    best = rank.top_n(scored, "grp", F.round("avg_rel", 9), ["l_orderkey", "l_linenumber"], 300)
    return best.select("grp", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("video"), F.concat(F.lit("part of "), F.col("l_orderkey")).alias("prompt"), "rank")


@query("""
WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) rk, count(*) OVER (PARTITION BY source) n FROM documents)
SELECT source, doc_id, CAST(rk AS INTEGER) AS rank FROM n WHERE rk <= round_even(n * 0.25, 0)""")
def tk1_keep_share(spark, sf):
    """TK1: a share of each group, halves to even."""
    return rank.keep_share(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", F.col("n_chars"), ["doc_id"], 0.25).select("source", "doc_id", F.col("rank").cast("int").alias("rank"))


@query("SELECT lang, 'clips_' || lang || '_' || CAST(floor(count(*) / 1000) + 1 AS BIGINT) || 'k.csv' AS name FROM documents GROUP BY lang")
def snk8_group_file_names(spark, sf):
    """SNK8, STR17: names of files by group."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", rank.file_name("clips", F.col("lang"), F.col("n")).alias("name"))


@query("""
WITH k AS (SELECT doc_id, max_by(CASE WHEN quality = 1 THEN quality + 0.5 END, toxic) v FROM labels GROUP BY doc_id),
j AS (SELECT d.doc_id, CAST(CASE WHEN v IS NOT NULL THEN d.n_chars END AS DOUBLE) AS len FROM documents d LEFT JOIN k USING (doc_id)),
m AS (SELECT list_sort(list(len) FILTER (len IS NOT NULL))[CAST(floor(count(len) / 2) AS BIGINT) + 1] AS med FROM j)
SELECT doc_id, coalesce(len, med) AS len FROM j, m""")
def jn1_length_join_fill(spark, sf):
    """JN1, AG5: left lookup of the last value by key, what is missing filled with the upper median."""
    labels = table(spark, sf, "labels").withColumn("v", F.when(F.col("quality") == 1, F.col("quality") + 0.5))
    df = combine.lookup(table(spark, sf, "documents").select("doc_id", "n_chars"), labels, "doc_id", "doc_id", "v", "toxic", "found")
    df = df.withColumn("len", F.when(F.col("found").isNotNull(), F.col("n_chars").cast("double")))
    return combine.fill_upper_median(df, "len").select("doc_id", "len")


@query("SELECT min(n_chars) AS min_len, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.95) AS p95, max(n_chars) AS max_len FROM documents")
def ag4_length_summary(spark, sf):
    """AG4: exact percentiles with linear interpolation."""
    out = combine.percentiles(table(spark, sf, "documents"), "n_chars", [0, 0.25, 0.5, 0.75, 0.95, 1])
    names = ("min_len", "p25", "p50", "p75", "p95", "max_len")
    return out.select(*[F.col("p")[i].cast("long" if i in (0, 5) else "double").alias(n) for i, n in enumerate(names)])


@query("""
WITH s AS (SELECT doc_id, dense_rank() OVER (ORDER BY length(source), source) - 1 AS src FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id) rn FROM s),
n AS (SELECT src, least(count(*), 90) n FROM s GROUP BY src), b AS (SELECT src, coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM n)
SELECT doc_id, CAST(src AS INTEGER) AS source_no FROM r JOIN b USING (src) WHERE rn <= 90 AND (before + rn <= 90 OR (rn = 1 AND before >= 90))""")
def tk2_union_limit_overshoot_all(spark, sf):
    """SET1, TK2: union of all sources, in natural order, up to a limit which later sources overshoot by a row each."""
    docs = table(spark, sf, "documents").withColumn("length", F.length("source"))
    return combine.union_limit_by(docs, ["length", "source"], ["doc_id"], 90).select("doc_id", "source_no")


@query("""
SELECT doc_id, quality, max(conf) AS conflicts FROM (
  SELECT doc_id, first_value(quality) OVER w AS quality, min(quality) OVER (PARTITION BY doc_id) <> max(quality) OVER (PARTITION BY doc_id) AS conf
  FROM (SELECT doc_id, quality, 0 AS i FROM labels UNION ALL SELECT doc_id, 1, 1 FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY ALL""")
def set5_first_wins_all(spark, sf):
    """SET5: the same for every document."""
    return combine.first_wins(_labelled(spark, sf, table(spark, sf, "documents")), "doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 1 ELSE l.quality END AS quality FROM (SELECT DISTINCT doc_id, quality FROM labels) l FULL JOIN documents d USING (doc_id)")
def set5_later_wins_all(spark, sf):
    """SET5, SRC30: the same for every document."""
    return combine.later_wins(_labelled(spark, sf, table(spark, sf, "documents")), "doc_id")


def _labelled(spark: SparkSession, sf: str, docs: DataFrame) -> list[DataFrame]:
    """Labels by document, and a label of 1 for each of docs."""
    return [table(spark, sf, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"]), docs.select("doc_id", F.lit(1).alias("quality"))]


@query("SELECT o_orderpriority AS stem, min(o_orderkey) AS left_path, min(c_custkey) AS right_path FROM orders JOIN (SELECT DISTINCT c_mktsegment, c_custkey FROM customer) c ON substr(o_orderpriority, 1, 1) = CAST(c_custkey % 5 + 1 AS VARCHAR) GROUP BY 1")
def jn2_pair_by_stem(spark, sf):
    """JN2, SET2: pairs of the first files by stem."""
    left = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("stem"), F.col("o_orderkey").alias("path"), "o_orderpriority")
    right = table(spark, sf, "customer").select((F.col("c_custkey") % 5 + 1).cast("string").alias("stem"), F.col("c_custkey").alias("path"))
    names = left.select("stem", "o_orderpriority").distinct()
    return combine.pair_by_stem(left, right, "stem", "path").join(names, "stem").select(F.col("o_orderpriority").alias("stem"), "left_path", "right_path")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt18_resume_antijoin(spark, sf):
    """FLT18, JN3, JN4, SET3: what the sink does not have yet."""
    return steps.skip_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn3_accessible(spark, sf):
    """FLT0, JN3: rows whose file is in the listing."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT c_custkey, k, CASE k WHEN 'a' THEN '1' WHEN 'b' THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS v FROM customer, (SELECT unnest(['a', 'b', 'c']) AS k)")
def jn14_config_merge(spark, sf):
    """JN14: defaults merged with given options."""
    lit = lambda *kv: F.create_map(*kv)
    m = combine.merge_options(lit(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), lit(F.lit("b"), F.col("c_mktsegment"), F.lit("c"), F.col("c_nationkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(m).alias("k", "v"))


# Filters and counts ---------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
f AS (SELECT coalesce(n_chars >= 200, false) a, coalesce(lang = 'en', false) b, coalesce(quality = 1, false) c, coalesce(toxic = 0, false) e FROM d),
s AS (SELECT 0 stage_no, 'length' stage, count(*) n_in, count(*) FILTER (a) n_out FROM f UNION ALL SELECT 1, 'language', count(*) FILTER (a), count(*) FILTER (a AND b) FROM f
      UNION ALL SELECT 2, 'quality', count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c) FROM f UNION ALL SELECT 3, 'toxic', count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND e) FROM f)
SELECT CAST(stage_no AS INTEGER) AS stage_no, stage, n_in, n_out, CAST(floor(100 * n_out / greatest(n_in, 1)) AS BIGINT) AS kept_pct FROM s""")
def flt10_filter_funnel(spark, sf):
    """FLT10, AG1: a cascade's funnel in one pass."""
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return cascade.funnel(df, [("length", F.col("n_chars") >= 200), ("language", F.col("lang") == "en"), ("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 0)])


@query("""
SELECT p_partkey, p_size / 5.0 AS duration, CAST(trunc(p_retailprice) AS BIGINT) AS width, p_size * 20 AS height, coalesce(p_size / 5.0 >= 4 AND CAST(trunc(p_retailprice) AS BIGINT) / (p_size * 20.0) <= 2.5 AND CAST(trunc(p_retailprice) AS BIGINT) >= p_size * 20, false) AS filter_pass
FROM part""")
def flt1_duration_resolution(spark, sf):
    """FLT1, PRJ13: a numeric filter of the registry with an override."""
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("duration"), F.floor("p_retailprice").alias("width"), (F.col("p_size") * 20).alias("height"))
    return cascade.run(df, ["duration_resolution"], {"duration_resolution": {"min_duration": 4.0}}).select("p_partkey", "duration", "width", "height", "filter_pass")


@query("""
WITH e AS (SELECT event_id, value % 4 AS m, value % 2 AS j, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 = 1 END AS ok FROM events)
SELECT event_id, coalesce(m >= 2.0 AND j <= 1.0, false) AS motion_pass FROM e WHERE coalesce(ok, true)""")
def flt13_motion_second_pass(spark, sf):
    """FLT13, AG2: the second pass over rows that the first let through, or has not seen."""
    u = F.col("user_id") % 3
    df = table(spark, sf, "events").select("event_id", (F.col("value") % 4).alias("motion_score"), (F.col("value") % 2).alias("motion_jitter_score"), F.when(u == 0, None).otherwise(u == 1).alias("ok"))
    f = cascade.REGISTRY["motion"]
    return df.where(F.coalesce("ok", F.lit(True))).select("event_id", F.coalesce(f.passes(f.defaults), F.lit(False)).alias("motion_pass"))


@query("SELECT user_id, stddev_pop(value) / (avg(value) + 1e-8) AS jitter FROM events GROUP BY user_id")
def ag8_jitter(spark, sf):
    """AG8, FLT5: deviation over mean of a clip's flow magnitudes."""
    return table(spark, sf, "events").groupBy("user_id").agg((F.stddev_pop("value") / (F.avg("value") + 1e-8)).alias("jitter"))


@query("SELECT s.status, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'view', 'purchase', 'failed', 'skipped']) AS status) s LEFT JOIN (SELECT event_type, count(*) n FROM events GROUP BY 1) e ON e.event_type = s.status")
def ag3_status_histogram(spark, sf):
    """AG3: counts by category, those without rows as zero."""
    seeds = spark.createDataFrame([(s,) for s in ("click", "view", "purchase", "failed", "skipped")], "status string")
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return seeds.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) AS bad, min(doc_id) AS first_bad FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def flt17_numeric_guard(spark, sf):
    """FLT17: how many rows have no usable number, and the first."""
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    bad = F.col("quality").isNull() | F.isnan(F.col("quality").cast("double"))
    return df.agg(F.count_if(bad).alias("bad"), F.min(F.when(bad, F.col("doc_id"))).alias("first_bad"))


@query("SELECT doc_id, strpos(text, 'the') > 0 AS found FROM documents")
def flt19_keyword_scan(spark, sf):
    """FLT19: keyword containment."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").contains("the").alias("found"))


@query("SELECT event_type, sqrt(sum(value * value)) AS l2, sum(value) / greatest(1, count(*) FILTER (value > 50)) AS ratio, 1 - count(*) FILTER (value > 50) / greatest(1, count(*)) AS miss_rate FROM events GROUP BY 1")
def ag18_norms_and_ratios(spark, sf):
    """AG18, AG19, AG20: norms by class and guarded ratios."""
    v, ok = F.col("value"), F.count_if(F.col("value") > 50)
    return table(spark, sf, "events").groupBy("event_type").agg(F.sqrt(F.sum(v * v)).alias("l2"), metrics.safe_ratio(F.sum(v), ok).alias("ratio"), (1 - metrics.safe_ratio(ok, F.count("*"))).alias("miss_rate"))


@query("SELECT event_type, avg(value) AS mean, max(value) / avg(value) AS max_over_mean FROM events GROUP BY GROUPING SETS ((event_type), ())")
def ag21_type_and_total(spark, sf):
    """AG21: a mean by type and over all."""
    return table(spark, sf, "events").rollup("event_type").agg(F.avg("value").alias("mean"), (F.max("value") / F.avg("value")).alias("max_over_mean"))


@query("SELECT l_returnflag, count(DISTINCT (l_linestatus, l_linenumber)) > 1 AS varies FROM lineitem GROUP BY 1")
def ag23_distinct_sizes(spark, sf):
    """AG23, AG24: whether a group has more than one size."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.count_distinct("l_linestatus", "l_linenumber") > 1).alias("varies"))


@query("SELECT lang, md5(string_agg(DISTINCT source || ':' || lang, ',' ORDER BY source || ':' || lang)) AS fingerprint FROM documents GROUP BY lang")
def ag25_schema_fingerprint(spark, sf):
    """AG25, JN13: an order-free fingerprint of names."""
    return metrics.schema_fingerprint(table(spark, sf, "documents"), "lang", F.concat_ws(":", "source", "lang"))


# Text and judges ---------------------------------------------------------------------------------------------------------


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean, md5(trim(regexp_replace(lower(regexp_replace(replace(text, '_', ' '), '[!-/:-@\[-`{-~]', '', 'g')), '\s+', ' ', 'g'))) AS canonical FROM documents""")
def str2_text_canonicalize(spark, sf):
    """STR1, STR2, STR4, STR5: white space and punctuation."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean(t, "whitespace")).alias("clean"), F.md5(text.clean(t, "canonicalize")).alias("canonical"))


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '[^/]*$') AS base,
       CASE WHEN split_part(regexp_extract(url, '^https?://([^/]*)', 1), '.', -1) IN ('com', 'net') THEN 'commercial' ELSE 'other' END AS kind FROM pages""")
def prj9_url_route(spark, sf):
    """PRJ8, PRJ9, STR17: routes by extension."""
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    kind = text.route(text.extension(host), [(("com", "net"), lambda c: F.lit("commercial")), (None, lambda c: F.lit("other"))], host)
    return table(spark, sf, "pages").select("page_id", host.alias("host"), text.basename(F.col("url")).alias("base"), kind.alias("kind"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def str9_json_props(spark, sf):
    """STR9, STR10: JSON from a judge's text, quotes repaired."""
    raw = F.concat(F.lit("thinking {x} </think> so: "), F.replace("props", F.lit('"'), F.lit("'")))
    parsed = F.try_parse_json(judge.repaired_json(raw))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("SELECT event_id, value AS score, CAST(user_id % 3 AS DOUBLE) AS first, (event_id % 26 + user_id % 26) / 2.0 AS point FROM events")
def str7_labelled_number(spark, sf):
    """STR7, STR8, STR11, STR13: numbers that a judge writes."""
    df = table(spark, sf, "events")
    line = F.concat(F.lit("**Alignment Score (1-5)：** "), F.format_string("%.17f", "value"))
    exact = F.concat(F.lit("Alignment Score (1-5): *"), F.col("value").cast("decimal(38,18)").cast("string"))
    first = F.concat(F.lit("about "), (F.col("user_id") % 3).cast("string"), F.lit(" of 5"))
    pair = F.format_string('{"score": [%d, %d], "reasoning": "x"}', F.col("event_id") % 26, F.col("user_id") % 26)
    number = F.when(judge.labelled_number(line, "Alignment Score").isNotNull(), judge.labelled_number(exact, "Alignment Score"))
    return df.select("event_id", number.alias("score"), judge.first_number(first).alias("first"), judge.pointwise(pair).alias("point"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS rank FROM events")
def str12_rank_parse(spark, sf):
    """STR12: which image a judge prefers."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("It is a tie.", "Image 1 is clearly better", "I prefer image 2", "Neither")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", judge.rank(said).alias("rank"))


@query("SELECT event_id, [least(CAST(trunc(value) AS BIGINT) * 1000, 63999), event_id % 64000] AS codes FROM events")
def str6_audio_codes(spark, sf):
    """STR6: numbers of marks, held within bounds."""
    marks = F.format_string("x<|audio_code_%d|>y<|audio_code_%d|>", F.floor("value") * 1000, F.col("event_id") % 64000)
    return table(spark, sf, "events").select("event_id", text.audio_codes(marks).alias("codes"))


@query("SELECT c_custkey, 'Quality' AS l1, c_mktsegment AS l2, c_mktsegment AS l3 FROM customer UNION ALL SELECT c_custkey, 'Alignment', 'Layout', '2D Space' FROM customer")
def str14_dims(spark, sf):
    """STR14: dimension lists."""
    raw = F.concat(F.lit("Quality / "), F.col("c_mktsegment"), F.lit("; Alignment / Layout / 2D Space;"))
    return table(spark, sf, "customer").select("c_custkey", F.inline(judge.dims(raw)))


@query("SELECT p_partkey, regexp_extract(p_type, '^(.*) ([^ ]*)$', 1) AS head, regexp_extract(p_type, '^(.*) ([^ ]*)$', 2) AS last FROM part")
def str18_split_last(spark, sf):
    """STR18: what stands before and after the last mark."""
    head, last = text.split_last(F.col("p_type"), " ")
    return table(spark, sf, "part").select("p_partkey", head.alias("head"), last.alias("last"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '/%' THEN p_name ELSE '/data/x/' || p_name END AS path, CAST(trunc(p_retailprice) AS BIGINT) AS whole, coalesce(CAST(CASE WHEN p_size > 25 THEN p_size END AS VARCHAR), '') AS size_text FROM part")
def prj1_conversions(spark, sf):
    """PRJ1, PRJ2, PRJ3, PRJ5, PRJ7: conversions, composed."""
    size = F.when(F.col("p_size") > 25, F.col("p_size"))
    whole = text.compose(text.to_float, text.to_int)(F.col("p_retailprice"))
    return table(spark, sf, "part").select("p_partkey", text.to_absolute(F.col("p_name"), "/data/x/").alias("path"), whole.alias("whole"), text.to_str(size).alias("size_text"))


@query("SELECT name, CAST(row_number() OVER (ORDER BY regexp_extract(name, '^\\D*'), CAST(regexp_extract(name, '\\d+') AS BIGINT), name) AS INTEGER) AS pos FROM (SELECT DISTINCT source || '.jpg' AS name FROM documents)")
def src20_natural_sort(spark, sf):
    """SRC20, TK13: names sorted by the value of their digits."""
    names = table(spark, sf, "documents").select(F.concat("source", F.lit(".jpg")).alias("name")).distinct()
    names = names.withColumn("key", text.natural_key(F.col("name"))).withColumn("one", F.lit(1))
    return rank.share_before(names, ["key", "name"], "one").select("name", (F.col("row") + 1).cast("int").alias("pos"))


@query("SELECT o_orderkey, i AS idx, 42 + i AS seed, o_orderpriority || '-' || i || '.mp4' AS name FROM orders, (SELECT unnest(range(0, 5)) AS i)")
def prj24_task_seeds_all(spark, sf):
    """PRJ12, PRJ23, PRJ24: the same for every prompt."""
    return _task_seeds(table(spark, sf, "orders"))


def _task_seeds(orders: DataFrame) -> DataFrame:
    df = orders.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return df.select("o_orderkey", "idx", (42 + F.col("idx")).alias("seed"), F.concat("o_orderpriority", F.lit("-"), F.col("idx"), F.lit(".mp4")).alias("name"))


# Frames, chunks, geometry ------------------------------------------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN n_chars >= 53 THEN (n_chars - 53) // 40 + 1 ELSE 0 END AS n_chunks, i AS chunk, i * 40 AS start FROM documents, (SELECT unnest(range(0, 6)) AS i)
WHERE n_chars >= 93 AND i < least((n_chars - 53) // 40 + 1, 6)""")
def wn4_chunk_windows(spark, sf):
    """WN4, FLT16: sliding windows of frames, the first six of clips with at least two."""
    n = F.col("n_chars")
    df = table(spark, sf, "documents").withColumn("n_chunks", frames.n_chunks(n, 53, 40)).where("n_chunks >= 2")
    return df.select("doc_id", "n_chunks", F.posexplode(frames.chunk_starts(n, 53, 40, 6)).alias("chunk", "start")).withColumn("chunk", F.col("chunk").cast("long"))


@query("""
SELECT doc_id, CASE WHEN n_chars <= 1 THEN n_chars ELSE greatest(1, n_chars - (n_chars - 1) % 4) END AS snapped, (n_chars + 15) // 16 * 16 AS up,
       CASE WHEN n_chars % 4 = 1 THEN n_chars ELSE (n_chars + 3) // 4 * 4 + 1 END AS frames, CAST(round_even(n_chars / 16.0 * 24, 0) AS BIGINT) AS raw_id, (n_chars - 1) // 4 + 1 AS latent FROM documents""")
def mth2_frame_snap(spark, sf):
    """MTH2, MTH3, MTH6, WN6: snapping frame counts and mapping frame rates."""
    n = F.col("n_chars")
    h, _, f = frames.check_shape(n, n, n, 16, 16, 4, 1)
    return table(spark, sf, "documents").select("doc_id", frames.snap_down(n, 4, 1).alias("snapped"), h.alias("up"), f.alias("frames"), frames.frame_id(n, 16, F.lit(24)).alias("raw_id"), frames.latent_frames(n).alias("latent"))


@query("SELECT doc_id, i AS k, CASE WHEN n_chars > 1 THEN CAST(trunc(i * (n_chars - 1) / (least(8, n_chars) - 1)) AS BIGINT) ELSE 0 END AS idx FROM documents, (SELECT unnest(range(0, 8)) AS i) WHERE i < least(8, n_chars)")
def tk7_sample_indices(spark, sf):
    """TK7: evenly spaced frames."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(frames.spread(F.col("n_chars"), 8)).alias("k", "idx")).withColumn("k", F.col("k").cast("long"))


@query("""
WITH f AS (SELECT l_orderkey AS clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / 40 AS t FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_linenumber * 8 + l_orderkey % 9 AS l_quantity FROM lineitem)),
s AS (SELECT clip, unnest(range(0, CAST(round_even(max(t), 0) AS BIGINT) + 1)) AS s FROM f GROUP BY clip)
SELECT clip, s AS second, arg_min(i, (abs(t - s), i)) AS frame FROM s JOIN f USING (clip) WHERE s < 24 GROUP BY ALL""")
def tk8_one_per_second(spark, sf):
    """TK8, TK6: for each second the nearest frame."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 8 + F.col("l_orderkey") % 9).alias("q")).distinct()
    df = df.select("l_orderkey", "l_linenumber", (F.sum("q").over(w) / 40).alias("t"))
    clips = df.groupBy(F.col("l_orderkey").alias("clip")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))).alias("a"))
    stamps = F.transform("a", lambda x: x["t"])
    return clips.select("clip", F.posexplode(frames.per_second(stamps)).alias("second", "frame")).select("clip", F.col("second").cast("long").alias("second"), F.col("frame").cast("long").alias("frame"))


@query("""
SELECT p_partkey, CAST(floor((CASE WHEN big THEN floor(h / s) ELSE h END) / 16) * 16 AS BIGINT) AS height, CAST(floor((CASE WHEN big THEN floor(w / s) ELSE w END) / 16) * 16 AS BIGINT) AS width
FROM (SELECT p_partkey, p_size * 40 AS h, p_size * 30 + 64 AS w, sqrt((p_size * 30 + 64) * (p_size * 40) / 640000.0) AS s, (p_size * 30 + 64) * (p_size * 40) > 640000 AS big FROM part)""")
def mth4_dynamic_resolution(spark, sf):
    """MTH4: sizes within a pixel budget."""
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40).alias("h"), (F.col("p_size") * 30 + 64).alias("w"))
    h, w = frames.dynamic_resolution(F.col("h"), F.col("w"), 640000, 16, 16)
    return df.select("p_partkey", h.alias("height"), w.alias("width"))


@query("SELECT p_partkey, CAST(round_even(p_size * 40 * greatest(832.0::DOUBLE / (p_size * 30 + 64), 480.0::DOUBLE / (p_size * 40)), 0) AS BIGINT) AS height, CAST(round_even((p_size * 30 + 64) * greatest(832.0::DOUBLE / (p_size * 30 + 64), 480.0::DOUBLE / (p_size * 40)), 0) AS BIGINT) AS width FROM part")
def mth5_cover_resize(spark, sf):
    """MTH5: the size that covers a frame."""
    h, w = frames.cover_resize(F.col("p_size") * 40, F.col("p_size") * 30 + 64, 480, 832)
    return table(spark, sf, "part").select("p_partkey", h.alias("height"), w.alias("width"))


@query("""
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, n, unnest(range(0, n, 5)) AS t FROM (SELECT DISTINCT user_id, n FROM e)),
x AS (SELECT e.user_id, e.i, e.value * (1 + t / 100.0::DOUBLE) AS v, CASE WHEN t + 8 < w.n AND e.i - t >= least(8, w.n - t) - 3 THEN (least(8, w.n - t) - 1 - (e.i - t) + 0.5) / 3 WHEN t > 0 AND e.i - t < 3 THEN (e.i - t + 0.5) / 3 ELSE 1 END AS m
      FROM w JOIN e ON e.user_id = w.user_id AND e.i >= t AND e.i < t + 8 WHERE t < 5 OR t - 5 + 8 < w.n)
SELECT user_id, i AS pos, sum(v * m) / sum(m) AS blended FROM x GROUP BY ALL""")
def ag22_overlap_blend(spark, sf):
    """AG22, WN7: overlapping windows blended with ramps."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events").select("user_id", "value", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    e = e.withColumn("t", F.explode(F.filter(frames.tile_starts(F.col("n"), 8, 5), lambda t: (t <= F.col("i")) & (F.col("i") < t + 8))))
    t, n, i = F.col("t"), F.col("n"), F.col("i")
    m = frames.ramp_weight(i - t, F.least(F.lit(8), n - t), t == 0, t + 8 >= n, 3)
    v = F.col("value") * (1 + t / 100.0)
    return e.groupBy("user_id", i.cast("long").alias("pos")).agg((F.sum(v * m) / F.sum(m)).alias("blended"))


@query("SELECT event_id, list_transform(range(0, CAST(event_id % 7 AS BIGINT)), lambda x: CASE WHEN x < 3 THEN (x + 1) * value ELSE 0 END) AS fitted FROM events")
def mth8_pad_or_trim(spark, sf):
    """MTH8: samples cut or padded to a length."""
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", frames.pad_or_trim(F.array(v, v * 2, v * 3), (F.col("event_id") % 7).cast("int")).alias("fitted"))


@query("SELECT event_id, CAST(trunc(least(1.0, (value / 50 + value / 100) / 2) * 32767) AS INTEGER) AS pcm FROM events")
def mth9_mono_pcm(spark, sf):
    """MTH9: channel mean as 16-bit samples."""
    both = F.array(F.array(F.col("value") / 50), F.array(F.col("value") / 100))
    return table(spark, sf, "events").select("event_id", frames.to_int16(frames.mono(both))[0].alias("pcm"))


@query("SELECT c_custkey, CAST(CASE WHEN r <= 12000 THEN 8000 WHEN r <= 19025 THEN 16000 WHEN r <= 33075 THEN 22050 ELSE 44100 END AS DOUBLE) AS rate FROM (SELECT c_custkey, abs(c_acctbal) * 6 AS r FROM customer)")
def mth10_nearest_rate(spark, sf):
    """MTH10, TK6: the nearest supported rate."""
    return table(spark, sf, "customer").select("c_custkey", frames.nearest_of(F.abs("c_acctbal") * 6, [8000.0, 16000.0, 22050.0, 44100.0]).alias("rate"))


# Schedules ---------------------------------------------------------------------------------------------------------------


_TEMPLATES = ("Wan", "Qwen-Image", "FLUX.1")


@query("""
WITH s AS (SELECT CAST(i AS BIGINT) AS step, 1 - i / 50.0::DOUBLE AS x FROM (SELECT unnest(range(0, 50)) AS i)), q AS (SELECT step, exp(0.8) / (exp(0.8) + (1 / x - 1)) AS y FROM s),
a AS (SELECT 'Wan' AS template, step, 5 * x / (1 + 4 * x) AS sigma FROM s UNION ALL
SELECT 'Qwen-Image', step, 1 - (1 - y) * 0.98 / (1 - (SELECT y FROM q WHERE step = 49)) FROM q UNION ALL
SELECT 'FLUX.1', step, 3 * z / (1 + 2 * z) FROM (SELECT step, 1 + (0.003 / 1.002 - 1) * step / 49.0::DOUBLE AS z FROM s))
SELECT event_id, template, round((1 - sigma) * value + sigma * 2, 9) AS noised FROM events JOIN a ON step = event_id % 50 AND template = ['Wan', 'Qwen-Image', 'FLUX.1'][CAST(event_id % 3 + 1 AS INTEGER)]""")
def mth11_sigma_schedule(spark, sf):
    """MTH11, MTH13: each event's value with the noise of its step, by the schedule of its template."""
    one = lambda t: schedule.sigmas(spark, t, 50).select(F.lit(t).alias("template"), "step", "sigma")
    steps = functools.reduce(DataFrame.union, map(one, _TEMPLATES))  # as many rows as steps
    name = F.element_at(F.array(*map(F.lit, _TEMPLATES)), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", "value", name.alias("template"), (F.col("event_id") % 50).alias("step")).join(F.broadcast(steps), ["template", "step"])
    return rows.select("event_id", "template", F.round(schedule.add_noise(F.col("value"), F.lit(2.0), F.col("sigma")), 9).alias("noised"))


@query("""
WITH s AS (SELECT CAST(i AS BIGINT) AS step, 1 - i / 50.0::DOUBLE AS x FROM (SELECT unnest(range(0, 50)) AS i)), t AS (SELECT step, 5 * x / (1 + 4 * x) * 1000 AS t FROM s),
y AS (SELECT step, exp(-2 * pow((t - 500) / 1000, 2)) AS y FROM t), z AS (SELECT step, y - (SELECT min(y) FROM y) AS z FROM y), w AS (SELECT step, z * (1000 / (SELECT sum(z) FROM z)) * (50 / 1000.0::DOUBLE) AS w FROM z)
SELECT event_id, round(pow(value - 2, 2) * (w + (SELECT w FROM w WHERE step = 1)), 6) AS loss FROM events JOIN w ON step = event_id % 50""")
def mth12_training_weights(spark, sf):
    """MTH12, AG16: each event's squared error by the weight of its step."""
    weights = schedule.training_weights(schedule.sigmas(spark, "Wan", 50)).select("step", "weight")
    rows = table(spark, sf, "events").withColumn("step", F.col("event_id") % 50).join(F.broadcast(weights), "step")
    return rows.select("event_id", F.round(F.pow(F.col("value") - 2, F.lit(2.0)) * F.col("weight"), 6).alias("loss"))


@query("SELECT event_id, round(value + 2 * (0.3 - 0.7), 9) AS stepped, round((1 - 0.7) * value + 0.7 * 2, 9) AS noised, round(2 + 4.5 * (value - 2), 9) + 0 AS guided FROM events")
def mth13_euler_and_guidance(spark, sf):
    """MTH13, MTH16: steps, noise and guidance."""
    v, two = F.col("value"), F.lit(2.0)
    out = {"stepped": schedule.euler_step(v, two, F.lit(0.7), F.lit(0.3)), "noised": schedule.add_noise(v, two, F.lit(0.7)), "guided": schedule.guided(v, two, 4.5)}
    return table(spark, sf, "events").select("event_id", *[(F.round(c, 9) + 0).alias(n) for n, c in out.items()])


@query("""
WITH b AS (SELECT CAST(i AS BIGINT) AS t, pow(sqrt(0.00085) + (sqrt(0.012) - sqrt(0.00085)) * i / 99.0::DOUBLE, 2) AS beta FROM (SELECT unnest(range(0, 100)) AS i)),
a AS (SELECT t, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS a FROM b), p AS (SELECT t, a, coalesce(lag(a) OVER (ORDER BY t), 1) AS b FROM a)
SELECT event_id, round(sqrt(b) * (value - sqrt(1 - a) * 0.5) / sqrt(a) + sqrt(1 - b) * 0.5, 8) AS stepped FROM events JOIN p ON t = event_id % 100""")
def mth14_ddim_alphas(spark, sf):
    """MTH14, WN11: a step of each event's value by the cumulative products of a schedule."""
    a = schedule.ddim_alphas(spark, 100)
    steps = a.select("t", "alpha_bar").join(a.select((F.col("t") + 1).alias("t"), F.col("alpha_bar").alias("before")), "t", "left").na.fill(1.0, ["before"])
    rows = table(spark, sf, "events").withColumn("t", F.col("event_id") % 100).join(F.broadcast(steps), "t")
    return rows.select("event_id", F.round(schedule.ddim_step(F.col("value"), F.lit(0.5), F.col("alpha_bar"), F.col("before")), 8).alias("stepped"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 500 < 30 THEN 0.1 * ((o_orderkey % 500 + 1) / 30.0::DOUBLE) ELSE 0.1 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (o_orderkey % 500 - 30) / 370.0::DOUBLE)))) END AS rate FROM orders")
def mth15_learning_rate(spark, sf):
    """MTH15: warm-up and cosine."""
    return table(spark, sf, "orders").select("o_orderkey", schedule.learning_rate(F.col("o_orderkey") % 500, 0.1, 30, 400, 0.1).alias("rate"))


@query("""
SELECT event_id, arg_min(i, (abs(g - x), i)) AS idx FROM (SELECT event_id, greatest(0, least(999, value * 10)) AS x FROM events), (SELECT i, i * 20.0::DOUBLE + 5 AS g FROM (SELECT unnest(range(0, 50)) AS i)) GROUP BY event_id""")
def jn5_nearest_grid(spark, sf):
    """JN5, TK6: the nearest of a grid, held within bounds."""
    near = lookup.nearest(F.col("value") * 10, [i * 20.0 + 5 for i in range(50)], 0.0, 999.0)
    return table(spark, sf, "events").select("event_id", near["idx"].cast("long").alias("idx"))


@query("""
WITH a AS (SELECT event_id, [value * 10, 450.0, value + 400] AS a FROM events), n AS (SELECT event_id, arg_min(i, (abs(a[i] - 500), i)) AS near FROM a, (SELECT unnest(range(1, 4)) AS i) GROUP BY event_id)
SELECT event_id, [CASE WHEN near = 1 THEN 500.0 ELSE a[1] END, CASE WHEN near = 2 THEN 500.0 ELSE a[2] END, CASE WHEN near = 3 THEN 500.0 ELSE a[3] END] AS moved FROM a JOIN n USING (event_id)""")
def jn6_overwrite_nearest_all(spark, sf):
    """JN6: the same for every event, over entries of which each is the nearest of some."""
    a = F.array(F.col("value") * 10, F.lit(450.0), F.col("value") + 400)
    return table(spark, sf, "events").select("event_id", lookup.overwrite_nearest(a, [500.0]).alias("moved"))


# Vectors and metrics -----------------------------------------------------------------------------------------------------


@query("""
SELECT a.vec_id AS left_key, b.vec_id AS right_key, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity
FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b""")
def jn8_cosine_matrix_all(spark, sf):
    """JN8, AG14: every twentieth vector against all, a query set that grows with the table."""
    df = table(spark, sf, "embeddings")
    out = metrics.similarity_blocks(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding")
    return out.withColumn("similarity", F.round("similarity", 6))


@query("""
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def jn9_clip_score(spark, sf):
    """JN9: scores of pairs by position."""
    df = table(spark, sf, "embeddings")
    other = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return df.join(other, "vec_id").select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("b")), 6).alias("score"))


@query("SELECT conv, i AS candidate, exp(v - m) / s AS p FROM (SELECT user_id AS conv, i, v, max(v) OVER (PARTITION BY user_id) AS m, sum(exp(v - mx)) OVER (PARTITION BY user_id) AS s FROM (SELECT user_id, event_id AS i, value / 10 AS v, max(value / 10) OVER (PARTITION BY user_id) AS mx FROM events))")
def mth17_softmax_pick(spark, sf):
    """MTH17: softmax over candidates."""
    c = table(spark, sf, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("candidate"), (F.col("value") / 10).alias("v"))
    return vector.softmax_rows(c, "conv", "v").select("conv", "candidate", "p")


@query("""
WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(v) AS m, var_samp(v) AS s, count(*) AS n FROM x GROUP BY ALL)
SELECT label, CAST(i AS INTEGER) AS dim, n, round(m, 6) AS mean, round(coalesce(s, 0), 6) AS var FROM m""")
def ag12_activation_stats(spark, sf):
    """AG12: means and covariances by group, added up from batches."""
    stats = metrics.activation_stats(table(spark, sf, "embeddings"), "label", "embedding")
    out = stats.select("label", "n", F.posexplode("mean").alias("i", "mean"), F.col("cov"))
    return out.select("label", (F.col("i") + 1).alias("dim"), "n", F.round("mean", 6).alias("mean"), F.round(F.col("cov")[F.col("i") * 65], 6).alias("var"))


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT a.label, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(coalesce(covar_samp(a.v, b.v), 0), 6) + 0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i >= a.i GROUP BY ALL""")
def ag12_covariance_tiles(spark, sf):
    """AG12: covariances of all pairs of columns, by tiles of columns."""
    tile = 24
    tiles = metrics.covariance_tiles(table(spark, sf, "embeddings"), "label", "embedding", tile)
    out = tiles.select("label", F.col("i").alias("a"), F.col("j").alias("b"), "n", F.size("y").alias("wide"), F.posexplode("p").alias("at", "s"))
    i, j = F.col("a") * tile + F.floor(F.col("at") / F.col("wide")), F.col("b") * tile + F.col("at") % F.col("wide")
    return out.select("label", i.cast("int").alias("i"), j.cast("int").alias("j"), (F.round(F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)), 6) + 0).alias("cov")).where("j >= i")


@query("""
WITH t AS (SELECT event_type, avg(value) AS m, var_samp(value) AS s FROM events GROUP BY event_type), n AS (SELECT *, lead(event_type) OVER (ORDER BY event_type) AS two FROM t)
SELECT a.event_type AS one, b.event_type AS two, round(pow(a.m - b.m, 2) + pow(sqrt(a.s + 1e-6) - sqrt(b.s + 1e-6), 2), 6) AS distance FROM n a JOIN t b ON a.two = b.event_type""")
def ag13_frechet_one_column(spark, sf):
    """AG13: distances of distributions of one column, which have a closed form, of each type of event and the next one."""
    stats = metrics.activation_stats(table(spark, sf, "events").select("event_type", F.array("value").alias("v")), "event_type", "v")
    names = stats.select(F.col("event_type").alias("one"), F.lead("event_type").over(Window.orderBy("event_type")).alias("two"))  # a row for each type
    return metrics.frechet_distances(stats, "event_type", names.where("two IS NOT NULL")).withColumn("distance", F.round("distance", 6))


@query()
def ag13_frechet(spark, sf):
    """AG13: distances of the distributions of each group and the next one."""
    stats = metrics.activation_stats(table(spark, sf, "embeddings"), "label", "embedding")
    return metrics.frechet_distances(stats, "label", stats.select(F.col("label").alias("one"), (F.col("label") + 1).alias("two")))


@query("SELECT avg(a) AS total FROM (SELECT event_type, avg(b) AS a FROM (SELECT event_type, user_id, avg(c) AS b FROM (SELECT event_type, user_id, date_trunc('day', ts) AS d, avg(value) AS c FROM events GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)")
def ag11_macro_average(spark, sf):
    """AG10, AG11: the mean of means of means."""
    df = table(spark, sf, "events").withColumn("d", F.date_trunc("day", "ts"))
    return metrics.macro_average(df, ["event_type", "user_id", "d"], "value")


@query("""
WITH s AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'Layout' WHEN 1 THEN 'Text Rendering' WHEN 2 THEN 'Feature Matching' ELSE 'Own' END AS l2, CASE event_id % 4 WHEN 0 THEN 'Alignment' WHEN 3 THEN 'Quality' ELSE 'Creative Generation' END AS l1,
  event_id % 4 AS l3, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 60.0 WHEN 2 THEN 100.0 WHEN 4 THEN 60.0 END AS s FROM events),
a AS (SELECT user_id, l1, l2, l3, avg(s) s FROM s GROUP BY ALL), b AS (SELECT user_id, l1, l2, avg(s) s FROM a GROUP BY ALL), c AS (SELECT user_id, l1, avg(s) s FROM b GROUP BY ALL)
SELECT user_id, coalesce(avg(s), 0) AS total FROM c GROUP BY user_id""")
def jn7_judge_totals(spark, sf):
    """JN7, AG11: a score tree with levels put right, and its macro average."""
    k = (F.col("event_id") % 4 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*[F.lit(i) for i in x]), k)
    score = F.element_at(F.array(*[F.lit(x) for x in ("0", "1", "2", "N/A", "1.7")]), (F.col("event_id") % 5 + 1).cast("int"))
    df = table(spark, sf, "events").select("user_id", pick("Alignment", "Creative Generation", "Creative Generation", "Quality").alias("l1"), F.lit("Own").alias("l2"), pick("2D Space", "Font", "Feature Mapping", "Unknown").alias("l3"), score.alias("score"))
    return metrics.judge_totals(df, "user_id", "score")


@query("SELECT avg(v) AS mean, var_samp(v) AS variance FROM (SELECT value AS v FROM events ORDER BY value DESC LIMIT 50)")
def tk5_elite(spark, sf):
    """TK5, AG27: mean and variance of the best."""
    return metrics.elite(table(spark, sf, "events"), "value", "value", 50)


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - 0.1, 2))) / 64, 9) AS mse, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * i)) + 0.5, 6) AS head FROM embeddings")
def ag16_mse_and_head(spark, sf):
    """AG16, FLT7: mean squared error, and a linear head over embeddings."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(vector.mse(e, F.array_repeat(F.lit(0.1), 64)), 9).alias("mse"), F.round(vector.affine(e, list(range(1, 65)), 0.5), 6).alias("head"))


# Order and shards ----------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5(doc_id || ':0'), doc_id) - 1 AS rn FROM documents), m AS (SELECT *, rn // 32 AS mb FROM p),
i AS (SELECT *, row_number() OVER (PARTITION BY mb ORDER BY n_chars DESC, rn) - 1 AS k FROM m), g AS (SELECT *, mb * 4 + k // 8 AS gid, k % 8 AS place FROM i),
s AS (SELECT gid, count(*) AS n FROM g GROUP BY gid), t AS (SELECT gid, row_number() OVER (ORDER BY n < 8, md5(gid || ':1'), gid) - 1 AS turn FROM s)
SELECT doc_id, gid AS group_id, turn * 8 + place AS pos FROM g JOIN t USING (gid)""")
def tk3_length_grouped_order(spark, sf):
    """TK3, TK4: a permutation in groups of like length."""
    return order.length_grouped(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8, 4).select("doc_id", "group_id", F.col("pos").cast("long").alias("pos"))


@query("""
WITH p AS (SELECT n_chars, (row_number() OVER (ORDER BY md5(doc_id || ':0'), doc_id) - 1) // 8 AS g FROM documents)
SELECT CAST(sum(m) AS BIGINT) AS cost, sum(s) / 8 AS ideal, sum(m) / (sum(s) / 8) AS over_ideal FROM (SELECT max(n_chars) AS m, sum(n_chars) AS s FROM p GROUP BY g)""")
def ag17_straggler_cost(spark, sf):
    """AG17: what waiting for the longest of each group costs."""
    df = table(spark, sf, "documents").select("doc_id", "n_chars", order.random_key(F.col("doc_id"), 0).alias("h"), F.lit(1).alias("one"))
    df = rank.share_before(df, ["h", "doc_id"], "one").withColumn("g", F.floor(F.col("row") / 8))
    return order.straggler_cost(df, "g", "n_chars", 8)


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard, r % 7 AS turn FROM n")
def tk9_shard_ranges(spark, sf):
    """TK9, TK10: contiguous and round-robin shards by a place counted part by part."""
    df = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("one"))
    ranked = rank.share_before(df, ["doc_id"], "one")
    total = df.count()
    return ranked.select("doc_id", order.contiguous_shard(F.col("row"), F.lit(total), 7).cast("long").alias("shard"), order.round_robin_shard(F.col("row"), 7).cast("long").alias("turn"))


# Windows and state ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sink, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS tail FROM events")
def wn3_lag_sink_tail(spark, sf):
    """WN3, WN12, WN13, JN10, PRJ19, ST5: what one chunk hands to the next."""
    df = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    df = state.tail_and_sink(df, "user_id", "o", "value", 3)
    return df.select("event_id", (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("o"))).alias("diff"), "sink", "tail")


@query("""
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, i, n, 0.0::DOUBLE AS acc, true AS go FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.i, e.n, CASE WHEN e.i = e.n OR r.acc + e.value >= 120 THEN 0 ELSE r.acc + e.value END, e.i = e.n OR r.acc + e.value >= 120 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, CAST(i AS INTEGER) AS i, go FROM r""")
def wn9_threshold_reset(spark, sf):
    """WN9, ST6: a running sum that sets itself back."""
    out = state.threshold_resets(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 120.0)
    return out.select("user_id", F.col("i").cast("int").alias("i"), "go")


@query("""
WITH RECURSIVE e AS (SELECT event_id, CAST(round(value, 2) AS DECIMAL(18, 2)) AS v, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events),
r AS (SELECT i, n, CAST(0 AS DECIMAL(18, 2)) AS acc, true AS go FROM e WHERE i = 1 UNION ALL
      SELECT e.i, e.n, CASE WHEN e.i = e.n OR r.acc + e.v >= 120 THEN CAST(0 AS DECIMAL(18, 2)) ELSE CAST(r.acc + e.v AS DECIMAL(18, 2)) END, e.i = e.n OR r.acc + e.v >= 120 FROM r JOIN e ON e.i = r.i + 1)
SELECT i, go FROM r""")
def wn9_threshold_reset_one_key(spark, sf):
    """WN9, ST6: a running sum that sets itself back, over all events as one key that no task holds."""
    rows = table(spark, sf, "events").select(F.lit(1).alias("k"), "event_id", F.round("value", 2).cast("decimal(18,2)").alias("value"))
    return state.threshold_resets(rows, "k", ["event_id"], "value", 120.0, most=0).select("i", "go")


@query("SELECT user_id, window_no, count(*) AS n, sum(value) AS total FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS window_no FROM events) GROUP BY ALL")
def st9_count_tumble(spark, sf):
    """ST9: windows by count."""
    return state.tumbling(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts,event_id", 4).groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_event_windows(spark, sf):
    """Event-time windows with a watermark, as a batch."""
    return state.event_counts(table(spark, sf, "events"), "ts", "event_type", "1 day", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type AS key, count(*) AS seen, CAST(least(8, count(*)) AS INTEGER) AS kept FROM events GROUP BY 1")
def st1_bounded_buffer(spark, sf):
    """ST1, ST2: a stream of events into bounded buffers by type: how many are seen and kept."""
    events, path = table(spark, sf, "events"), shared.new_path(spark, "buffers")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    out = state.bounded_buffer(stream, "event_type", "event_id", "value", 8)
    write = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    write.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")).start().awaitTermination()
    last = F.max_by(F.struct("seen", F.size("slots").alias("kept")), "seen").alias("r")
    return spark.read.parquet(f"{path}/rows").groupBy("key").agg(last).select("key", "r.*")


_GOES = 4


def _buffers(spark, sf):
    """Events taken in by several goes of a stream, each begun anew from its checkpoint; where its buffers lie."""
    events, path = table(spark, sf, "events"), shared.new_path(spark, "buffers")
    rows = events.select("event_id", "event_type", "value", (F.col("event_id") % 3).cast("string").alias("shape"))
    last = events.agg(F.max("event_id")).first()[0] or 0
    for go in range(_GOES):
        rows.where(F.floor(F.col("event_id") * _GOES / (last + 1)) == go).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        buffers.run(buffers.buffered(stream, "event_type", "event_id", "value", "shape", 16, 5), path)
    return path


_SLOTS = """
WITH s AS (SELECT event_type AS key, event_id, value, event_id % 3 AS shape, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq FROM events),
t AS (SELECT *, CASE WHEN seq < 16 THEN seq ELSE CAST('0x' || substr(md5('5:' || seq), 1, 8) AS BIGINT) % 16 END AS slot FROM s),
slots AS (SELECT key, CAST(slot AS INTEGER) AS slot, max(event_id) AS o, max_by(value, event_id) AS v, max_by(shape, event_id) AS shape FROM t GROUP BY ALL) """


@query(_SLOTS + "SELECT key, slot, o, v FROM slots")
def st1_buffer_slots(spark, sf):
    """ST1: bounded buffers in the state of a stream that is begun again three times; the slots themselves."""
    return buffers.slots(spark, _buffers(spark, sf)).select("key", "slot", "o", "v")


@query(_SLOTS + """, n AS (SELECT *, row_number() OVER (ORDER BY key, slot) - 1 AS pos FROM slots), z AS (SELECT key, count(*) AS own, min(pos) AS first FROM n GROUP BY key), total AS (SELECT count(*) AS total FROM n),
r AS (SELECT e.event_id, e.event_id % 3 AS shape, own, first, CAST('0x' || substr(md5('9:' || e.event_id), 1, 8) AS BIGINT) % (total - own) AS i FROM events e JOIN z ON z.key = e.event_type, total)
SELECT event_id, CASE WHEN n.shape = r.shape THEN n.o END AS drawn FROM r LEFT JOIN n ON n.pos = r.i + CASE WHEN r.i >= first THEN own ELSE 0 END""")
def st2_draws_across_keys(spark, sf):
    """ST2: for each event an entry of another key's buffer, a miss where its shape differs."""
    requests = table(spark, sf, "events").select("event_id", F.col("event_type").alias("key"), (F.col("event_id") % 3).cast("string").alias("shape"))
    return buffers.draws(requests, buffers.slots(spark, _buffers(spark, sf)), "key", "event_id", "shape", 9).select("event_id", F.col("drawn.o").alias("drawn"))


@query("""
WITH e AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) * 1000 AS ms, value, event_id * 3 // ((SELECT max(event_id) FROM events) + 1) AS third FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events)),
g AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN least(third + 1, 2) ELSE third END AS go FROM e),
w AS (SELECT go, max(max(ms)) OVER (ORDER BY go) - 86400000 AS mark FROM g GROUP BY go),
r AS (SELECT g.*, w.mark IS NOT NULL AND g.ms <= w.mark AS late FROM g LEFT JOIN w ON w.go = g.go - 1),
b AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) <= 14400000 AS same FROM r WHERE NOT late),
c AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS clip FROM b),
s AS (SELECT CAST(user_id AS VARCHAR) AS key, min(ms) AS "begin", max(ms) AS last, count(*) AS n, round(sum(value), 4) AS total FROM c GROUP BY user_id, clip)
SELECT * FROM s WHERE last + 14400000 <= (SELECT max(mark) FROM w) UNION ALL SELECT 'late', 0, 0, count(*), NULL FROM r WHERE late""")
def st5_clips_of_stream(spark, sf):
    """ST5, ST9: clips of a stream that comes in three goes, ended by timers; and how many rows came after the watermark."""
    events, path = table(spark, sf, "events"), shared.new_path(spark, "clips")
    last = events.agg(F.max("event_id")).first()[0] or 0
    third = F.floor(F.col("event_id") * 3 / (last + 1))
    rows = events.select(F.date_trunc("second", "ts").alias("ts"), "user_id", "value", F.when(F.col("event_id") % 11 == 0, F.least(third + 1, F.lit(2))).otherwise(third).alias("go"))
    late = 0
    for go in range(3):
        rows.where(F.col("go") == go).drop("go").write.mode("append").parquet(f"{path}/in")
        late += clips.run(clips.ended(spark.readStream.schema(rows.drop("go").schema).parquet(f"{path}/in"), "user_id", "ts", "value", 4 * 3600, "1 day"), path)
    out = clips.read(spark, path).select("key", "begin", "last", "n", F.round("total", 4).alias("total"))
    return out.union(spark.range(1).select(F.lit("late"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(late).cast("long"), F.lit(None).cast("double")))


# Plans ---------------------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE r AS (SELECT s_suppkey AS unit FROM supplier WHERE s_suppkey < 3 UNION SELECT s.s_suppkey FROM r JOIN supplier s ON s.s_suppkey IN (2 * r.unit + 3, r.unit + 50)) SELECT unit FROM r""")
def jn12_reachable(spark, sf):
    """JN12: everything that follows from some units."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"))
    links = s.select(F.col("unit").alias("source"), F.explode(F.array(2 * F.col("unit") + 3, F.col("unit") + 50)).alias("target"))
    return graph.reachable(links.join(s.withColumnRenamed("unit", "target"), "target", "left_semi"), s.where("unit < 3"))


@query("""
SELECT DISTINCT source, target FROM (SELECT event_id AS target, event_id % 3 = 0 AS reads, max(CASE WHEN event_id % 3 <> 0 THEN event_id END) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM events)
WHERE reads AND source IS NOT NULL""")
def jn11_last_producer(spark, sf):
    """JN11: for each unit that reads a parameter the last earlier one that writes it."""
    units = table(spark, sf, "events").select(F.col("event_id").alias("unit"), F.col("event_type").alias("param"))
    return graph.edges(units.where("unit % 3 = 0"), units.where("unit % 3 <> 0"))


_GRAPH = "WITH RECURSIVE e AS (SELECT event_id AS unit, (SELECT max(event_id) FROM events) AS last FROM events), l AS (SELECT unit AS source, unnest([2 * unit + 3, 3 * unit + 1, unit + 1000]) AS target, last FROM e WHERE unit % 10 <> 4), links AS (SELECT source, target FROM l WHERE target <= last), "


def _links(units):
    return units.where("unit % 10 <> 4").select(F.col("unit").alias("source"), F.explode(F.array(2 * F.col("unit") + 3, 3 * F.col("unit") + 1, F.col("unit") + 1000)).alias("target")).join(units.withColumnRenamed("unit", "target"), "target", "left_semi")


@query(_GRAPH + "r AS (SELECT unit FROM e WHERE unit % 700 = 5 UNION SELECT target FROM r JOIN links ON source = r.unit) SELECT unit FROM r")
def jn12_reachable_events(spark, sf):
    """JN12: everything that follows from some of all events."""
    units = table(spark, sf, "events").select(F.col("event_id").alias("unit"))
    return graph.reachable(_links(units), units.where("unit % 700 = 5"))


@query(_GRAPH + "r AS (SELECT unit, 0 AS level FROM e UNION SELECT target, level + 1 FROM r JOIN links ON source = r.unit) SELECT unit, max(level) AS level FROM r GROUP BY unit")
def tk14_unit_levels(spark, sf):
    """TK14: an order of units in which sources come first."""
    units = table(spark, sf, "events").select(F.col("event_id").alias("unit"))
    return graph.levels(units, _links(units))


@query()
def o8_unit_graph_split(spark, sf):
    """O8, JN11, JN12, SET4: each user's events as a plan of units, split into those that depend on a model and those that do not."""
    units = table(spark, sf, "events").select(F.col("event_id").alias("unit"), "user_id")
    named = lambda k: F.concat_ws(":", "user_id", k)
    reads = units.select("unit", named(F.col("unit") % 4).alias("param"))
    writes = units.select("unit", named(F.floor(F.col("unit") / 4) % 5).alias("param"))
    return graph.split(reads, writes, units.where("unit % 40 = 7").select("unit"))


@query("SELECT o_orderkey, CASE WHEN abs(o_orderkey % 3 * 8 + 8 - 16) < 0.01 THEN 'copy' ELSE 'encode' END AS action, o_orderkey % 3 * 8 + 8 < 16 AS upsampled FROM orders")
def snk4_resample_plan(spark, sf):
    """SNK4, PRJ14, O5: which clips are copied and which encoded."""
    df = table(spark, sf, "orders").select("o_orderkey", F.format_string("/v/%d.mp4", "o_orderkey").alias("path"), (F.col("o_orderkey") % 3 * 8.0 + 8).alias("fps"))
    return steps.resample_plan(df, 16.0).select("o_orderkey", "action", "upsampled")


# Records, boxes, tiles -------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, k, v, part FROM (SELECT o_orderkey, unnest(['image', 'scale', 'prompt']) AS k, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS v, unnest(['blockwise', 'controlnet', 'shared']) AS part FROM orders)""")
def prj18_prefix_routing(spark, sf):
    """PRJ18: parameters routed by prefix, the first that fits."""
    m = F.create_map(F.lit("blockwise_controlnet_image"), F.col("o_orderstatus"), F.lit("controlnet_scale"), F.col("o_orderpriority"), F.lit("prompt"), F.col("o_custkey").cast("string"))
    parts = records.route_prefixes(m, [("blockwise_controlnet_", "blockwise"), ("controlnet_", "controlnet")])
    rows = F.flatten(F.array(*[F.transform(F.map_entries(c), _tag(n)) for n, c in parts.items()]))
    return table(spark, sf, "orders").select("o_orderkey", F.inline(rows))


def _tag(name):
    return lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.lit(name).alias("part"))


@query("SELECT c_custkey, unnest(['a.w', 'y.b']) AS k, unnest([c_name, c_mktsegment]) AS v FROM customer")
def prj20_key_rename(spark, sf):
    """PRJ20: keys without a prefix."""
    m = records.strip_prefix(F.create_map(F.lit("pipe.a.w"), F.col("c_name"), F.lit("y.b"), F.col("c_mktsegment")), "pipe.")
    return table(spark, sf, "customer").select("c_custkey", F.explode(m).alias("k", "v"))


@query("SELECT o_custkey, flatten(list([o_orderkey, o_orderkey + 1] ORDER BY o_orderkey)) AS vals FROM orders GROUP BY o_custkey")
def set6_concat_by_key(spark, sf):
    """SET6: arrays of a key joined in order."""
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.array("o_orderkey", F.col("o_orderkey") + 1).alias("vals"))
    return records.concat_by_key(df, "o_custkey", "o_orderkey", "vals")


@query("""
WITH p AS (SELECT p_partkey, p_size * 7 + 40 AS h, p_size * 5 + 40 AS w FROM part),
y AS (SELECT p_partkey, h, unnest(range(0, h, 24)) AS t FROM p), x AS (SELECT p_partkey, w, unnest(range(0, w, 24)) AS t FROM p)
SELECT y.p_partkey, CASE WHEN y.t + 32 > h THEN h - 32 ELSE y.t END AS top, CASE WHEN x.t + 32 > w THEN w - 32 ELSE x.t END AS "left", least(y.t + 32, h) AS bottom, least(x.t + 32, w) AS "right"
FROM y JOIN x USING (p_partkey) WHERE (y.t < 24 OR y.t - 24 + 32 < h) AND (x.t < 24 OR x.t - 24 + 32 < w)""")
def wn8_tiles_all(spark, sf):
    """WN8: the same for every part."""
    return _tiles(table(spark, sf, "part"))


def _tiles(parts: DataFrame) -> DataFrame:
    df = parts.select("p_partkey", (F.col("p_size") * 7 + 40).cast("long").alias("h"), (F.col("p_size") * 5 + 40).cast("long").alias("w"))
    df = df.withColumn("y", F.explode(regions.axis_tiles(F.col("h"), 32, 24))).withColumn("x", F.explode(regions.axis_tiles(F.col("w"), 32, 24)))
    return df.select("p_partkey", F.col("y.begin").alias("top"), F.col("x.begin").alias("left"), F.col("y.end").alias("bottom"), F.col("x.end").alias("right"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN a OR b OR c OR d THEN [CASE WHEN a OR c THEN 192 ELSE 0 END, CASE WHEN a OR b THEN 108 ELSE 0 END, CASE WHEN b OR d THEN 1728 ELSE 1920 END, CASE WHEN c OR d THEN 972 ELSE 1080 END]::BIGINT[] END AS box
FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 > 0.5 AS a, l_tax * 10 > 0.5 AS b, l_quantity / 50 > 0.5 AS c, l_linenumber / 7.0 > 0.5 AS d FROM lineitem)""")
def mth20_corner_crop(spark, sf):
    """MTH20, FLT9: the box that leaves out marked corners."""
    probs = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.col("l_linenumber") / 7)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", regions.corner_crop(F.lit(1920), F.lit(1080), probs, 0.1, 0.5).alias("box"))


@query("SELECT event_id, round(value * 0.75 + 50 * 0.25, 9) AS blended, round(value * 2 / 255 - 1, 9) AS norm, CAST(greatest(0, least(255, floor((value / 50 - 1 + 1) * 255 / 2))) AS INTEGER) AS pixel, round((value - 3) / 2, 9) AS z FROM events")
def mth19_pixels(spark, sf):
    """MTH18, MTH19: blending, pixel ranges, z-scores."""
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(regions.blend(v, F.lit(50.0), F.lit(0.25)), 9).alias("blended"), F.round(regions.normalize_pixel(v), 9).alias("norm"), regions.to_pixel(v / 50 - 1).alias("pixel"), F.round(regions.zscore(v, 3.0, 2.0), 9).alias("z"))


@query("SELECT p_partkey, b AS bytes, CAST(floor(p_retailprice / (50 * b / 1e9)) AS BIGINT) AS slots, CAST((p_size + 15) // 16 * 16 AS BIGINT) AS aligned, CAST(pow(2, ceil(log2(p_size) - 1e-12)) AS BIGINT) AS pow2 FROM (SELECT *, CAST(48 * 14 * p_size * 80 * 2 + 48 * 3 * p_size * 80 * 2 + 8 AS BIGINT) AS b FROM part)")
def mth22_byte_budget(spark, sf):
    """MTH21, MTH22: bytes of slots, and how many fit."""
    b = regions.slot_bytes(F.lit(48), F.lit(14), F.col("p_size").cast("long"), F.lit(80))
    return table(spark, sf, "part").select("p_partkey", b.alias("bytes"), regions.most_slots(F.col("p_retailprice"), 50, b).alias("slots"), regions.align_up(F.col("p_size").cast("long"), 16).alias("aligned"), regions.power_of_two(F.col("p_size")).alias("pow2"))


@query("SELECT event_id, 500::BIGINT AS \"left\", greatest(0, CAST(floor((event_id % 9) * 1000 - 4000) AS BIGINT)) AS \"right\", CAST(event_id % 9 + 0.5 AS DOUBLE) AS last_end FROM events")
def mth23_repaint(spark, sf):
    """MTH23: ranges moved and padded to fit."""
    r = lambda a, b: F.struct(F.lit(a).cast("double").alias("start"), b.cast("double").alias("end"))
    out = regions.repaint(F.array(r(-0.5, F.lit(0)), r(0, F.col("event_id") % 9)), F.lit(4000), 1000)
    return table(spark, sf, "events").select("event_id", out["left"].alias("left"), out["right"].alias("right"), out["ranges"][1]["end"].alias("last_end"))


@query("SELECT l_orderkey, trunc(median(l_linenumber)) AS border, avg(l_quantity) AS mean_score, max(l_quantity) AS max_score FROM lineitem GROUP BY 1")
def ag7_frame_reducers(spark, sf):
    """AG7, AG9, FLT8: mean, largest and cut median over a clip's frames."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.median("l_linenumber").cast("int").cast("double").alias("border"), F.avg("l_quantity").alias("mean_score"), F.max("l_quantity").alias("max_score"))


@query("SELECT o_orderkey, least(1.0, (o_custkey % 50 * 20 + 5 * (o_orderkey % 20)) / 10000.0::DOUBLE) AS coverage FROM orders")
def flt6_text_coverage(spark, sf):
    """FLT6: area of text boxes over the frame's."""
    box = lambda x2, y2: F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))
    boxes = F.array(box(F.col("o_custkey") % 50, F.lit(20)), box(F.lit(5), F.col("o_orderkey") % 20))
    return table(spark, sf, "orders").select("o_orderkey", cascade.text_coverage(boxes, F.lit(100), F.lit(100)).alias("coverage"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 60 ELSE CAST(round_even((o_orderkey % 10) * 30000 / 1001.0::DOUBLE, 0) AS BIGINT) END AS frames FROM orders")
def src4_frame_count(spark, sf):
    """SRC3, SRC4, MTH7: frames counted, by packets, or by duration and rate."""
    from .sources import files

    k = F.col("o_orderkey")
    n = files.frame_count(F.when(k % 3 == 1, k % 60), F.when(k % 3 == 0, k % 40), (k % 10).cast("double"), F.lit("30000/1001"))
    return table(spark, sf, "orders").select("o_orderkey", n.alias("frames"))


@query("SELECT p_partkey, 'blocks.' || p_size || '.attn.q' AS target, CASE WHEN p_size % 3 = 0 THEN '*' WHEN p_size % 3 = 1 THEN 'vae/*' ELSE 'm.safetensors' END AS pattern FROM part")
def str22_adapter_keys(spark, sf):
    """STR19, STR22: layers of adapter keys, globs of files."""
    key = F.concat(F.lit("diffusion_model.blocks."), F.col("p_size"), F.lit(".attn.q."), F.when(F.col("p_size") % 2 == 0, "lora_B.default.weight").otherwise("lora_up.weight"))
    pattern = F.element_at(F.array(F.lit("./"), F.lit("vae/"), F.lit("m.safetensors")), F.col("p_size") % 3 + 1)
    return table(spark, sf, "part").select("p_partkey", records.adapter_target(key).alias("target"), records.file_pattern(pattern).alias("pattern"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':5'), event_id) AS rn FROM events WHERE event_id % 10 <> 3 AND event_id >= 100) WHERE rn = 1")
def st2_sample_excluding(spark, sf):
    """ST2, ST3: a hashed draw by key after a warm-up, some excluded."""
    df = table(spark, sf, "events").where((F.col("event_id") % 10 != 3) & (F.col("event_id") >= 100))
    draw = F.struct(order.random_key(F.col("event_id"), 5), "event_id")
    return df.groupBy("event_type").agg(F.min_by("event_id", draw).alias("event_id"))


@query("SELECT event_id, CASE WHEN k = 1 THEN 1 ELSE 4 * (k + 1) + 1 END AS overlap FROM (SELECT event_id, event_id % 6 + 1 AS k FROM events)")
def wn5_overlap_frames(spark, sf):
    """WN5: frames that chunks share."""
    return table(spark, sf, "events").select("event_id", frames.overlap_frames(F.col("event_id") % 6 + 1, 2).alias("overlap"))


@query("SELECT c_custkey, i AS pos, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS prompt, c_name AS image FROM customer, (SELECT unnest([0, 1]) AS i)")
def prj22_broadcast_pairs(spark, sf):
    """PRJ22, JN9: pairs of prompts and images, a single one repeated."""
    pairs = combine.broadcast_pairs(F.array(F.lit("a"), F.lit("b")), F.array("c_name"))
    return table(spark, sf, "customer").select("c_custkey", F.posexplode(pairs).alias("pos", "x")).select("c_custkey", "pos", "x.prompt", "x.image")


@query("SELECT DISTINCT source AS param FROM documents UNION SELECT DISTINCT lang FROM documents")
def ag28_distinct_union(spark, sf):
    """AG28, SET4: parameters of all units."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("param")).union(docs.select("lang")).distinct()


@query("SELECT doc_id, CASE WHEN (SELECT count(*) FROM documents x WHERE x.source = d.source AND x.n_chars = d.n_chars) > 1 THEN true ELSE false END AS collides FROM documents d")
def snk3_collisions(spark, sf):
    """SNK3: files whose base names collide."""
    from .sources import files

    df = table(spark, sf, "documents").withColumn("path", F.format_string("/r/%d/%s_%d.mp4", "doc_id", "source", "n_chars"))
    return files.collisions(df).select("doc_id", "collides")

__all__ = ["ORACLE", "QUERIES", "container_queries", "file_queries", "media_queries", "record_queries"]

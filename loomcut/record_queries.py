"""Queries for operators over columns of records, pixels of frames and further measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import judge, mapping, pixels, repair, text, vector
from .operators import metrics
from .plans import units
from .registry import query, table
from .streaming import state


@query("SELECT event_id, [CAST(floor(value) AS BIGINT), CAST(floor(value * 2) AS BIGINT)] AS whole FROM events")
def prj6_map_list(spark, sf):
    """PRJ4, PRJ6: a step for each element of a list."""
    step = text.compose(mapping.identity, mapping.each(lambda x: F.floor(x).cast("long")))
    return table(spark, sf, "events").select("event_id", step(F.array("value", F.col("value") * 2)).alias("whole"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'text a' WHEN 1 THEN 'number 5' WHEN 2 THEN 'list of 2' WHEN 3 THEN 'else {"a":1}' WHEN 4 THEN 'else true' ELSE 'number 2.5' END AS routed FROM events""")
def prj8_route_by_type(spark, sf):
    """PRJ8: steps by the type of a value, a last one for any."""
    given = F.element_at(F.array(*[F.lit(x) for x in ('"a"', "5", "[1, 2]", '{"a": 1}', "true", "2.5")]), (F.col("event_id") % 6 + 1).cast("int"))
    routes = [
        (("string",), lambda v: F.concat(F.lit("text "), F.try_variant_get(v, "$", "string"))), (("number",), lambda v: F.concat(F.lit("number "), F.try_variant_get(v, "$", "string"))),
        (("list",), lambda v: F.concat(F.lit("list of "), F.size(F.try_variant_get(v, "$", "array<int>")))), (None, lambda v: F.concat(F.lit("else "), F.to_json(v))),
    ]
    return table(spark, sf, "events").select("event_id", mapping.by_type(F.parse_json(given), routes).alias("routed"))


@query("SELECT c_custkey, upper(c_name) AS c_name, CAST(floor(c_acctbal) AS BIGINT) AS c_acctbal, c_mktsegment FROM customer")
def prj10_map_columns(spark, sf):
    """PRJ10: one step for the columns of data, another for some of them; a special step for other columns does nothing."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return mapping.map_columns(df, ["c_name", "c_acctbal", "absent"], F.upper, {"c_acctbal": lambda x: F.floor(x).cast("long"), "c_mktsegment": F.lower})


@query("SELECT c_custkey, ['/data/' || c_name || '.png', '/abs/x.jpg'] AS images FROM customer")
def prj11_media_bundle(spark, sf):
    """PRJ11: the default step for a column of images."""
    names = F.array(F.concat("c_name", F.lit(".png")), F.lit("/abs/x.jpg"))
    return table(spark, sf, "customer").select("c_custkey", mapping.media_bundle("/data/", ("png", "jpg"), mapping.identity)(names).alias("images"))


@query("""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS n FROM part)
SELECT p_partkey, r + n * i AS item FROM p, (SELECT unnest([0, 1, 2]) AS i) WHERE r + n * i < n * 5 // 2""")
def prj12_repeated(spark, sf):
    """PRJ12: passes over a table, item after item, up to a length of its own."""
    df = table(spark, sf, "part").select("p_partkey")
    return mapping.repeated(df, 3, "p_partkey", most=df.count() * 5 // 2)


@query("SELECT lang, CAST(NULL AS INTEGER) AS absent, doc_id FROM documents")
def prj17_required(spark, sf):
    """PRJ17: the columns that a step asks for."""
    return mapping.required(table(spark, sf, "documents"), ["lang", "absent", "doc_id"]).withColumn("absent", F.col("absent").cast("int"))


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS input_image, arg_max(value, (ts, event_id)) AS end_image FROM events GROUP BY 1")
def prj19_ends(spark, sf):
    """PRJ19: the first and the last of a list."""
    place = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", place).alias("input_image"), F.max_by("value", place).alias("end_image"))


@query("SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS a, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS b, CAST(CAST(value / 7 AS FLOAT) AS DOUBLE) AS c, event_type AS d FROM events")
def prj21_nested_cast(spark, sf):
    """PRJ21: numbers of one type cast wherever they are in lists, maps and structs."""
    df = table(spark, sf, "events")
    df = df.select("event_id", F.struct(F.col("value").alias("a"), F.array(F.col("value") / 3).alias("b"), F.create_map(F.lit("k"), F.array(F.col("value") / 7)).alias("c"), F.col("event_type").alias("d")).alias("x"))
    out = df.select("event_id", mapping.cast_all(F.col("x"), df.schema["x"].dataType, T.FloatType()).alias("x"))
    return out.select("event_id", F.col("x.a").cast("double").alias("a"), F.col("x.b")[0].cast("double").alias("b"), F.col("x.c")["k"][0].cast("double").alias("c"), "x.d")


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS chunk, CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'p' || i END AS prompt FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 4 + 1)) AS i FROM orders)")
def prj23_schedule(spark, sf):
    """PRJ23: a prompt for each chunk, from one or from as many."""
    n = (F.col("o_orderkey") % 4 + 1).cast("int")
    given = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("p"))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("p"), i)))
    return table(spark, sf, "orders").select("o_orderkey", F.posexplode(mapping.schedule(given, n)).alias("chunk", "prompt"))


@query("SELECT event_id, event_id % 1000 >= 250 AND event_id % 1000 < 900 AS trained FROM events")
def flt20_timesteps(spark, sf):
    """FLT20: whether a time step is within a share of all."""
    return table(spark, sf, "events").select("event_id", mapping.within(F.col("event_id") % 1000, 1000, 0.25, 0.9).alias("trained"))


# Frames of 8 by 8 gray pixels, made of embeddings; the first rows of some are black.
_PIXELS = "WITH e AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: CASE WHEN i <= 8 * (vec_id % 3) THEN 0 ELSE CAST(greatest(0, least(255, floor(embedding[i]::DOUBLE * 600 + 128))) AS INTEGER) END) AS p FROM embeddings)"


def _frames(spark, sf):
    def pixel(x, i):
        value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 600 + 128)))
        return F.repeat(F.lpad(F.hex(F.when(i < 8 * (F.col("vec_id") % 3), 0).otherwise(value).cast("long")), 2, "0"), F.lit(3))

    return table(spark, sf, "embeddings").select("vec_id", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(F.transform("embedding", pixel), "")).alias("data"))


_BORDERS = _PIXELS + """,
m AS (SELECT vec_id, label, p, list_transform(range(0, 8), lambda r: list_avg(p[r * 8 + 1 : r * 8 + 8])) AS rows, list_transform(range(0, 8), lambda c: list_avg(list_transform(range(0, 8), lambda r: p[r * 8 + c + 1]))) AS cols FROM e),
d AS (SELECT vec_id, label, p, coalesce(list_position(list_transform(rows[1:4], lambda x: x > 15), true) - 1, 4) AS top, coalesce(list_position(list_transform(list_reverse(rows)[1:4], lambda x: x > 15), true) - 1, 4) AS bottom,
      coalesce(list_position(list_transform(cols[1:4], lambda x: x > 15), true) - 1, 4) AS "left", coalesce(list_position(list_transform(list_reverse(cols)[1:4], lambda x: x > 15), true) - 1, 4) AS "right" FROM m)"""


@query(_BORDERS + 'SELECT vec_id, top, bottom, "left", "right" FROM d')
def flt2_black_border(spark, sf):
    """FLT2: black rows and columns from each edge of a frame."""
    return _frames(spark, sf).select("vec_id", pixels.black_border("h", "w", "data").alias("b")).select("vec_id", "b.*")


@query(_PIXELS + "SELECT vec_id, len(list_filter(p, lambda x: x > 250)) / 64.0::DOUBLE AS over, len(list_filter(p, lambda x: x < 5)) / 64.0::DOUBLE AS under FROM e")
def flt3_exposure(spark, sf):
    """FLT3: shares of pixels that are nearly white and nearly black."""
    return _frames(spark, sf).select("vec_id", pixels.exposure("h", "w", "data").alias("e")).select("vec_id", "e.*")


@query(_PIXELS + """,
l AS (SELECT vec_id, list_transform(range(0, 64), lambda i: p[CASE WHEN i < 8 THEN i + 9 ELSE i - 7 END] + p[CASE WHEN i >= 56 THEN i - 7 ELSE i + 9 END] + p[CASE WHEN i % 8 = 0 THEN i + 2 ELSE i END] + p[CASE WHEN i % 8 = 7 THEN i ELSE i + 2 END] - 4 * p[i + 1]) AS l FROM e)
SELECT vec_id, round(list_var_pop(l) * 4096) AS score FROM l""")
def flt4_blur(spark, sf):
    """FLT4: the variance of the Laplacian."""
    return _frames(spark, sf).select("vec_id", F.round(pixels.blur("h", "w", "data") * 4096).alias("score"))  # a whole number: squares over 64 * 64


@query(_BORDERS + "SELECT label, CAST(trunc(median(top)) AS INTEGER) AS border_top, round(avg(len(list_filter(p, lambda x: x > 250)) / 64.0::DOUBLE), 9) AS overexposed, greatest(trunc(median(top)), trunc(median(bottom)), trunc(median(\"left\")), trunc(median(\"right\"))) < 1 AS border_pass FROM d GROUP BY label")
def flt2_clip_measures(spark, sf):
    """FLT2, FLT3, AG9: a clip's measures, the median or mean over its frames."""
    return pixels.clip_measures(_frames(spark, sf), "label").select("label", "border_top", F.round("overexposed_fraction", 9).alias("overexposed"), "border_pass")


@query("""
WITH m AS (SELECT vec_id, list_filter(list_transform(range(1, 65), lambda i: {'x': embedding[i]::DOUBLE * 5, 'y': embedding[65 - i]::DOUBLE * 5, 'm': sqrt(pow(embedding[i]::DOUBLE * 5, 2) + pow(embedding[65 - i]::DOUBLE * 5, 2))}), lambda s: s.m > 0.5) AS f FROM embeddings)
SELECT vec_id, round(CASE WHEN len(f) > 20 THEN sqrt(pow(list_avg(list_transform(f, lambda s: s.x / s.m)), 2) + pow(list_avg(list_transform(f, lambda s: s.y / s.m)), 2)) ELSE 1 END, 9) AS coherence FROM m""")
def flt5_coherence(spark, sf):
    """FLT5: how alike the directions of moving pixels are."""
    dx = F.transform("embedding", lambda x: x.cast("double") * 5)
    return table(spark, sf, "embeddings").select("vec_id", F.round(vector.coherence(dx, F.reverse(dx), pixels=20), 9).alias("coherence"))


@query("SELECT doc_id, coalesce(max(toxic::DOUBLE), 0) AS nsfw, coalesce(max(toxic::DOUBLE), 0) <= 0.2 AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def flt8_missing_label(spark, sf):
    """FLT8: the score of a label, 0 where a classifier doesn't give it."""
    scores = table(spark, sf, "labels").groupBy("doc_id").agg(F.create_map(F.lit("nsfw"), F.max("toxic").cast("double")).alias("scores"))
    df = table(spark, sf, "documents").select("doc_id").distinct().join(scores, "doc_id", "left")
    nsfw = F.coalesce(F.try_element_at(F.col("scores"), F.lit("nsfw")), F.lit(0.0))
    return df.select("doc_id", nsfw.alias("nsfw"), (nsfw <= 0.2).alias("passed"))


@query("SELECT p_partkey, p_name || '!' AS positive_text, 'bad!' AS negative_text, length(p_name || '!') * 2 AS positive_size, 8 AS negative_size, p_size + 1 AS seed FROM part")
def ux4_units(spark, sf):
    """UX4, PRJ13: units with declared columns, some run for both sides."""
    seed = units.Unit("seed", ("p_size",), ("seed",), lambda c: {"seed": c["p_size"] + 1})
    clean = units.Unit("clean", ("prompt",), ("text",), lambda c: {"text": F.concat(c["prompt"], F.lit("!"))}, ("positive_", "negative_"))
    size = units.Unit("size", ("text", "factor"), ("size",), lambda c: {"size": F.length(c["text"]) * c["factor"]}, ("positive_", "negative_"))
    df = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_name").alias("positive_prompt"), F.lit("bad").alias("negative_prompt"), F.lit(2).alias("factor"))
    out = units.run_units(df, [seed, clean, size])
    return out.select("p_partkey", "positive_text", "negative_text", F.col("positive_size").cast("long").alias("positive_size"), "negative_size", "seed")


def _fade(pdf):
    total, out = 0.0, []
    for v in pdf["value"].tolist():
        total = 0.5 * total + 0.5 * v
        out.append(total)
    return pdf.assign(carried=out)[["event_id", "carried"]]


@query("""
WITH l AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events)
SELECT event_id, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * pow(0.5, len(l) - i + 1))) / 7, 6) AS carried FROM l""")
def st5_carry(spark, sf):
    """ST5: state that goes from each chunk of a clip to the next, and begins anew for each clip."""
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return state.carry(df, "user_id", "event_id", _fade, "event_id long, carried double").select("event_id", F.round(F.col("carried") / 7, 6).alias("carried"))


# Measures ------------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, count(*) FILTER (value >= 50) AS passed, count(*) FILTER (value >= 50) / greatest(count(*), 1)::DOUBLE AS rate FROM events")
def ag2_pass_rate(spark, sf):
    """AG2: how many pass, and their share."""
    return metrics.pass_rate(table(spark, sf, "events"), F.col("value") >= 50)


@query("""
WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
c AS (SELECT vec_id, list_transform(range(0, 8), lambda r: list_transform(x[r * 8 + 1 : r * 8 + 8], lambda v: v::DOUBLE)) AS x, list_transform(range(0, 8), lambda r: list_transform(y[r * 8 + 1 : r * 8 + 8], lambda v: v::DOUBLE)) AS y FROM p),
d AS (SELECT vec_id, unnest(x) AS x, unnest(y) AS y FROM c),
n AS (SELECT vec_id, x, y, sqrt(list_dot_product(x, x)) + 1e-10 AS nx, sqrt(list_dot_product(y, y)) + 1e-10 AS ny FROM d)
SELECT vec_id, round(2 * avg(list_sum(list_transform(range(1, 9), lambda i: i / 10.0::DOUBLE * pow(x[i] / nx - y[i] / ny, 2)))), 9) AS distance FROM n GROUP BY vec_id""")
def ag15_lpips(spark, sf):
    """AG15: a weighted distance of normalised channels, mean over positions, added up over layers."""
    df = table(spark, sf, "embeddings")
    grid = lambda e: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.transform(e, lambda x: x.cast("double")), r * 8 + 1, F.lit(8)))
    pairs = df.select("vec_id", grid("embedding").alias("x")).join(df.select((F.col("vec_id") - 1).alias("vec_id"), grid("embedding").alias("y")), "vec_id")
    weights = F.array(*[F.lit(i / 10) for i in range(1, 9)])
    return pairs.select("vec_id", F.round(vector.lpips([(F.col("x"), F.col("y"), weights)] * 2), 9).alias("distance"))


@query("SELECT user_id, round(sqrt(avg(value * value)), 9) AS rms, CASE WHEN count(*) > 0 THEN 1 - count(*) FILTER (event_id % 3 = 0) / count(*)::DOUBLE ELSE 0 END AS miss_rate, count(*) FILTER (event_id % 3 = 0) / greatest(1, count(*))::DOUBLE AS per_request, sum(event_id % 4) / greatest(1, sum(4))::DOUBLE AS occupancy FROM events GROUP BY 1")
def ag20_buffer_stats(spark, sf):
    """AG20: what a buffer's lookups came to."""
    k = F.col("event_id")
    out = metrics.buffer_stats(F.lit(1), F.when(k % 3 == 0, 1).otherwise(0), F.col("value"), k % 4, F.lit(4))
    return table(spark, sf, "events").groupBy("user_id").agg(*[(F.round(v, 9) if n == "rms" else v).alias(n) for n, v in out.items()])


@query("WITH b AS (SELECT c_custkey, c_acctbal, [c_acctbal, c_acctbal + 1, c_acctbal * 2] AS b FROM customer) SELECT c_custkey, round(0.9 * c_acctbal + 0.1 * list_avg(b), 6) AS mean, round((0.9 * 4 + 0.1 * list_var_samp(b)) / 7, 4) AS variance FROM b")
def ag27_elite_update(spark, sf):
    """AG27: a search's mean and variance moved towards its best draws."""
    a = F.col("c_acctbal")
    mean, variance = metrics.elite_update(a, F.lit(4.0), F.array(a, a + 1, a * 2), 0.9)
    return table(spark, sf, "customer").select("c_custkey", F.round(mean, 6).alias("mean"), F.round(variance / 7, 4).alias("variance"))


@query("""
WITH r AS (SELECT DISTINCT md5(source) AS f, 'model ' || source AS model FROM documents WHERE length(source) = 4 UNION ALL SELECT DISTINCT md5(source), 'other ' || source FROM documents WHERE source LIKE '%1')
SELECT doc_id, model FROM documents LEFT JOIN r ON md5(source) = f""")
def jn13_dispatch(spark, sf):
    """JN13: registered models by fingerprint, all that match."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.md5("source").alias("fingerprint"))
    known = docs.select("source", "fingerprint").distinct()
    registry = known.where(F.length("source") == 4).select("fingerprint", F.concat(F.lit("model "), "source").alias("model"))
    registry = registry.union(known.where(F.col("source").endswith("1")).select("fingerprint", F.concat(F.lit("other "), "source")))
    return metrics.dispatch(docs, "fingerprint", registry).select("doc_id", "model")


@query("SELECT event_id, ('0x' || substr(md5(event_id || ':7'), 1, 12))::BIGINT % 1000000 < 300000 AS taken FROM events")
def st3_chance(spark, sf):
    """ST3: a gate that lets a share through, the same share on every run."""
    return table(spark, sf, "events").select("event_id", mapping.chance(F.col("event_id"), 7, 0.3).alias("taken"))


@query("""
WITH d AS (SELECT event_id, user_id, event_type, md5(event_id || ':3') AS h FROM events)
SELECT user_id, arg_min(event_id, (event_type <> 'click', h, event_id)) AS picked, count(*) FILTER (event_type = 'click') = 0 AS pooled FROM d GROUP BY user_id""")
def st2_pooled_sample(spark, sf):
    """ST2: a hashed draw among entries of the wanted kind, among all where there is none."""
    from .operators.order import random_key

    same = F.col("event_type") == "click"
    draw = F.struct(~same, random_key(F.col("event_id"), 3), F.col("event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", draw).alias("picked"), (F.count_if(same) == 0).alias("pooled"))


# Text and numbers -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS once, md5(text) AS twice, md5(text) AS sound FROM documents WHERE text IS NOT NULL")
def str3_repaired_text(spark, sf):
    """STR3: all documents read with a wrong encoding, once and twice, and put right; those that are sound stay as they are."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    out = {"once": wrong(F.col("text")), "twice": wrong(wrong(F.col("text"))), "sound": F.col("text")}
    return docs.select("doc_id", *[F.md5(repair.undone(c)).alias(n) for n, c in out.items()])


@query("SELECT doc_id, '<' || lang || '> & \"x\"' AS clean FROM documents WHERE lang IS NOT NULL")
def str3_basic_clean(spark, sf):
    """STR3: character references undone twice, trimmed."""
    raw = F.concat(F.lit(" &amp;lt;"), "lang", F.lit("&gt; &amp;amp; &quot;x&quot;\n"))
    return table(spark, sf, "documents").where("lang is not null").select("doc_id", text.html_unescape_twice(raw).alias("clean"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 40 <= 23 THEN event_id % 2 + 1 END AS INTEGER) AS rank FROM events")
def str12_rank_near(spark, sf):
    """STR12: which image is called better, if that is said near its name."""
    k = F.col("event_id")
    said = F.concat(F.lit("Of "), "event_type", F.lit(": Image "), k % 2 + 1, F.lit(" "), F.repeat(F.lit("x"), (k % 40).cast("int")), F.lit("better"), F.when(k % 7 == 0, ", but a tie").otherwise(""))
    return table(spark, sf, "events").select("event_id", judge.rank(said).alias("rank"))


@query("SELECT p_partkey, p_brand AS l1, p_name AS l2, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS l3 FROM part UNION ALL SELECT p_partkey, p_type, p_brand, p_brand FROM part WHERE p_size % 3 = 0")
def str14_dims_given(spark, sf):
    """STR14: dimension lists of two and three levels."""
    third = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" / "), "p_type")).otherwise("")
    more = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit("/"), "p_brand")).otherwise(" ")
    return table(spark, sf, "part").select("p_partkey", F.inline(judge.dims(F.concat("p_brand", F.lit(" / "), "p_name", third, F.lit("; "), more, F.lit(";")))))


@query("SELECT c_custkey, 'Rate \"' || c_name || '\" from 1 to 5: {x} ' || c_mktsegment AS prompt FROM customer")
def str16_template(spark, sf):
    """STR16: a template's names filled in."""
    return table(spark, sf, "customer").select("c_custkey", mapping.fill('Rate "{name}" from 1 to 5: {odd} {segment}', name=F.col("c_name"), segment=F.col("c_mktsegment"), odd=F.lit("{x}")).alias("prompt"))


@query("SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size, 'two' AS twice FROM part")
def str20_assignments(spark, sf):
    """STR20: names and values of lines of code, the last of a name."""
    code = F.concat(F.lit("import x\nname = '"), "p_name", F.lit("'\ntwice = \"one\"\n  size="), "p_size", F.lit(",\nif a == b:\ntwice = 'two'\n"))
    found = table(spark, sf, "part").select("p_partkey", mapping.assignments(code).alias("m"))
    return found.select("p_partkey", *[F.col("m")[n].alias(n) for n in ("name", "size", "twice")])


@query("SELECT event_id, round(value / 7, 3) AS y FROM events")
def mth1_round(spark, sf):
    """MTH1: rounding by a double's exact value."""
    return table(spark, sf, "events").select("event_id", mapping.rounded(3)(F.col("value") / 7).alias("y"))

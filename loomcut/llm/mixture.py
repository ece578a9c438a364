"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by hash into blocks of about equal size. A source's target fixes how many draws of its
blocks the mix takes: whole passes over all of them, then further blocks in a permuted order, of the last one only some
documents. A tree halves the output shards: at each node the left half's number of draws from each source follows the multivariate
hypergeometric law, given the node's own numbers, so the shards' quotas add up exactly to the sources'. A shard then takes
the next draws of each source's permuted order, which are disjoint, and orders its documents by a hash.

Everything is made of DataFrame operations. Random numbers are hashes of seed and place, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: How far from the end of a source's last block documents are chosen by size.
NEAR = 500

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0. Counts the places where such a run begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """For rows (source, size): source, source_size, weight, target, idx. The targets share `share` of all sizes by weight, weights repeating in the sources' order (code point, null last).

    A target stops at `most` times its source's size; the excess goes to the others by weight until none is above. In order of
    source_size / weight the stopped sources come first, so running sums over the table of sources find the level of the rest.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    by = by.withColumn("idx", F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")))
    cap = most * F.col("source_size")
    order = everyone.orderBy(cap / F.col("weight"), "idx")
    total = share * F.sum("source_size").over(everyone)
    lower = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (total - lower) / rest).withColumn("free", cap > F.col("level") * F.col("weight"))
    by = by.withColumn("found", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(cap / F.col("weight"), F.col("idx")))).over(everyone))
    target = F.least(cap, F.coalesce(F.col("found"), F.lit(math.inf)) * F.col("weight"))
    return by.select("source", "source_size", "weight", target.cast("double").alias("target"), "idx")


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_factorial(x: str) -> str:
    """SQL for ln x! by Stirling's series, shifted up by eight to be exact to about 1e-14."""
    series = "(z + 0.5D) * ln(z) - z + 0.9189385332046727D + 1D / (12D * z) - 1D / (360D * z * z * z) + 1D / (1260D * pow(z, 5D))"
    return _let(f"{x} + 8D", "z", f"{series} - ln((z - 7D) * (z - 6D) * (z - 5D) * (z - 4D)) - ln((z - 3D) * (z - 2D) * (z - 1D) * z)")


def hypergeometric(marked: str, total: str, draws: str, u: str) -> str:
    """SQL for how many of `draws` from `total`, of which `marked` are marked, are marked: the quantile at u.

    The probabilities are summed over the values within 12 standard deviations of the mean, outside of which there is no
    mass that a double can show.
    """
    f = _log_factorial
    given = f"named_struct('k', double({marked}), 'n', double({total}), 'd', double({draws}), 'u', {u})"
    spread = "sqrt(greatest(0D, p.k * p.d / p.n * (p.n - p.k) * (p.n - p.d) / (p.n * greatest(p.n - 1D, 1D))))"
    at = _let(spread, "sd", "named_struct('a', bigint(greatest(0D, p.k + p.d - p.n, floor(p.k * p.d / p.n - 12D * sd - 2D))), 'b', bigint(least(p.k, p.d, ceil(p.k * p.d / p.n + 12D * sd + 2D))))")
    fixed = f"{f('p.k')} + {f('(p.n - p.k)')} - {f('p.n')} + {f('p.d')} + {f('(p.n - p.d)')}"
    chance = f"exp(c - {f('i')} - {f('(p.k - i)')} - {f('(p.d - i)')} - {f('(p.n - p.k - p.d + i)')})"
    step = _let(f"s.sum + {chance}", "t", "named_struct('sum', t, 'x', if(s.sum < p.u and t >= p.u, i, s.x))")
    search = _let(fixed, "c", f"aggregate(sequence(w.a, w.b), named_struct('sum', 0D, 'x', w.b), (s, i) -> {step}).x")
    return _let(given, "p", f"if(p.n = 0D, 0L, {_let(at, 'w', f'if(w.a >= w.b, w.b, {search})')})")


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """For rows (idx, draws) of sources: (idx, shard, taken, before): how many of the source's draws the shard takes, and how many earlier shards do.

    A node of the tree is a row with the array of its sources' draws, as long as there are sources. The first half of its shards takes a
    share of its draws in proportion, dealt among the sources one after another, each by the hypergeometric law given what is left.
    """
    node = quotas.where("draws > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("idx"), F.col("draws").alias("n")))).alias("have"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "have")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        whole = F.aggregate("have", F.lit(0).cast("long"), lambda a, s: a + s["n"])
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = node.withColumn("all", whole).withColumn("mid", mid).withColumn("want", F.floor(F.col("all") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long"))
        got = hypergeometric("x.n", "s.pool", "s.want", f"(pmod(xxhash64({seed}, lo, hi, x.idx), {1 << 52}L) + 0.5D) / {float(1 << 52)}D")
        deal = _let(got, "got", "named_struct('pool', s.pool - x.n, 'want', s.want - got, 'left', concat(s.left, array(named_struct('idx', x.idx, 'n', got))))")
        node = node.withColumn("left", F.expr(f"aggregate(have, named_struct('pool', all, 'want', want, 'left', cast(array() as array<struct<idx:int,n:bigint>>)), (s, x) -> {deal}).left"))
        right = F.zip_with("have", "left", lambda h, g: F.struct(h["idx"].alias("idx"), (h["n"] - g["n"]).alias("n")))
        halves = F.array(F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("have")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), right.alias("have")))
        single = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("have").alias("have")))
        node = stored(node.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(single)).alias("node")).select("node.*"), "tree")
    by = node.select(F.col("lo").alias("shard"), F.explode("have").alias("x")).select("x.idx", "shard", F.col("x.n").alias("taken"))
    earlier = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return by.withColumn("before", F.coalesce(F.sum("taken").over(earlier), F.lit(0)))


def _slice(h: Column, many: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("slice"), h), many)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0, shards: int = 16, blocks: int = 2048, block_words: int = 20000, slice_docs: int = 4000, seed: int = 7) -> DataFrame:
    """docs with size, source_size long, target double and placements array<struct<shard int, place long>>, one for each copy that the mix takes.

    size is the number of words (null text: 0). A source stays below its target by less than the smallest
    document left near the end of its last block. No document is taken more than ceil(most) times. There are at most about `blocks` blocks plus one for each source;
    where words run out within one, slices of it of about slice_docs documents are looked at. The table of sources is one row of some steps; it is meant for
    some ten thousand sources.
    A null source is a source of its own, last in order. Documents without words are placed with their blocks. Repeated rows are
    documents of their own; a null key counts as ''. Empty table: no rows. Columns of docs with the names of added ones are replaced.
    """
    added = ("size", "source_size", "target", "placements")
    base = docs.select(*[c for c in docs.columns if c.lower() not in added])
    size, h, idx, block, info, p_idx, p_block = fresh(base, "size", "h", "idx", "block", "info", "p_idx", "p_block")
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.octet_length(F.col(text).cast("string")))
    rows = stored(base.select(F.col(source).cast("string").alias("source"), n_words(F.col(text).cast("string")).alias("size"), hashed.alias("h")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit = max(block_words, -(-total // blocks))
    targets = source_targets(rows, weights, most, share).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / unit)).cast("long"))
    targets = stored(targets, "targets")
    dealt = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select("idx", F.pmod("h", "n_blocks").alias("block"), "size", "h")
    sums = dealt.groupBy("idx", "block").agg(F.sum("size").alias("words"), F.greatest(F.lit(1), F.ceil(F.count("*") / slice_docs)).cast("long").alias("n_slices"))
    # Per source the bounded list of its blocks in permuted order, with the words before each.
    listed = sums.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), F.lit("order"), F.col("idx"), F.col("block")).alias("o"), "block", "words", "n_slices"))).alias("list"))
    listed = listed.join(targets.select("idx", "source_size", "target"), "idx")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(1)).cast("long")
    listed = listed.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<o:int,block:bigint,n_slices:bigint,full:boolean,short:double>>").alias("out"))

    def place(s: Column, x: Column) -> Column:
        after = s["sum"] + x["words"]
        one = F.struct(F.size(s["out"]).alias("o"), x["block"].alias("block"), x["n_slices"].alias("n_slices"), ((F.col("rest") > 0) & (after <= F.col("rest"))).alias("full"), F.when((s["sum"] < F.col("rest")) & (after > F.col("rest")), F.col("rest") - s["sum"]).otherwise(F.lit(0.0)).alias("short"))
        return F.struct(after.alias("sum"), F.concat(s["out"], F.array(one)).alias("out"))

    plan = listed.withColumn("out", F.aggregate("list", start, place)["out"]).select("idx", "passes", F.size("list").alias("n"), F.explode("out").alias("x"))
    # The draws of a source: block o in pass p is draw p * n + o; the pass after the last whole one takes the full blocks and the short one.
    plan = plan.select("idx", "n", F.col("x.o").alias("o"), F.col("x.block").alias("block"), F.col("x.n_slices").alias("n_slices"), F.col("x.short").alias("short"), "passes", (F.col("passes") + (F.col("x.full") & (F.col("passes") < math.ceil(most))).cast("long")).alias("whole"))
    plan = stored(plan, "plan")
    draws = plan.groupBy("idx").agg(F.sum(F.col("whole") + (F.col("short") > 0).cast("long")).cast("long").alias("draws"))
    quotas = shard_quotas(draws, shards, seed).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct(F.col("before"), F.col("shard")))).alias("by"))
    draw = F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") + (F.col("short") > 0).cast("long") - 1))
    drawn = plan.where("whole > 0 or short > 0").withColumn("pass", draw).withColumn("nth", F.col("pass") * F.col("n") + F.col("o"))
    drawn = drawn.join(quotas, "idx").withColumn("shard", F.element_at(F.filter("by", lambda q: q["before"] <= F.col("nth")), -1)["shard"])
    per = drawn.groupBy("idx", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    per = plan.select("idx", "block", "n_slices", "short", "whole").join(per, ["idx", "block"], "left").join(targets, "idx").select("idx", "block", "n_blocks", "n_slices", "source", "source_size", "target", "short", "whole", F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int>>")).alias("draws"))
    per = stored(per, "draws")
    keyed = base.withColumn(h, hashed)
    of = targets.select(F.col("source").alias(idx), F.struct("idx", "n_blocks").alias(info))
    keyed = keyed.join(of, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(idx))).withColumn(idx, F.col(info)["idx"]).withColumn(block, F.pmod(F.col(h), F.col(info)["n_blocks"])).drop(info)
    draws = per.select(F.col("idx").alias(p_idx), F.col("block").alias(p_block), F.struct("source_size", "target", "n_slices", "short", "whole", "draws").alias(info))
    keyed = keyed.join(draws, (F.col(idx) == F.col(p_idx)) & (F.col(block) == F.col(p_block))).drop(p_idx, p_block)
    words, fact = n_words(F.col(f"`{text}`").cast("string")), F.col(info)
    # A short block is cut into slices of some thousand documents by hash. Slices before the one where the words run out are taken whole; of that one
    # the first documents in the order of their hashes are taken, and around the place where the words run out, within NEAR documents on either side, they
    # are chosen by size instead, each that still fits from the largest down. So no task ranks more than a slice, whatever the block's size.
    lean = dealt.join(per.where("short > 0").select("idx", "block", "short", "n_slices"), ["idx", "block"]).withColumn("slice", _slice(F.col("h"), F.col("n_slices"), seed))
    before = Window.partitionBy("idx", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = lean.groupBy("idx", "block", "short", "slice").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = slices.where("before < short and before + words >= short").groupBy("idx", "block").agg(F.min(F.struct("slice", "before")).alias("at"))
    last = stored(last.select("idx", "block", F.col("at.slice").alias("last"), F.col("at.before").alias("before")), "slices")
    group = Window.partitionBy("idx", "block")
    inside = group.orderBy("h", "size")
    lean = lean.join(last, ["idx", "block"]).where("slice = last").withColumn("short", F.col("short") - F.col("before"))
    lean = lean.withColumn("nr", F.row_number().over(inside)).withColumn("sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    lean = lean.withColumn("low", F.count(F.when(F.col("sum") <= F.col("short"), 1)).over(group) - NEAR)
    lean = lean.where(F.col("nr").between(F.col("low"), F.col("low") + 2 * NEAR))
    near = F.array_sort(F.collect_list(F.when(F.col("nr") > F.col("low"), F.struct((-F.col("size")).alias("o"), F.col("nr").alias("nr")))))
    chosen = lean.groupBy("idx", "block", "last", "short", "low").agg(F.coalesce(F.max(F.when(F.col("nr") <= F.col("low"), F.col("sum"))), F.lit(0)).alias("base"), near.alias("near"))
    greedy = "aggregate(near, named_struct('left', short - base, 'nrs', cast(array() as array<int>)), (s, x) -> if(-x.o <= s.left, named_struct('left', s.left + x.o, 'nrs', concat(s.nrs, array(x.nr))), s)).nrs"
    chosen = stored(chosen.select(F.col("idx").alias(p_idx), F.col("block").alias(p_block), F.struct("last", "low", F.expr(greedy).alias("nrs")).alias("chosen")), "chosen")
    nr, total, pick, at = fresh(keyed, "nr", "total", "pick", "slice")
    short = keyed.where(fact["short"] > 0).withColumn(size, words).withColumn(at, _slice(F.col(h), fact["n_slices"], seed))
    picks = chosen.withColumnRenamed("chosen", pick)
    short = short.join(picks, (F.col(idx) == F.col(p_idx)) & (F.col(block) == F.col(p_block))).drop(p_idx, p_block)
    ranked = short.where(F.col(at) == F.col(pick)["last"])
    ranked = ranked.withColumn(nr, F.row_number().over(Window.partitionBy(idx, block).orderBy(h, size, F.xxhash64(f"`{text}`"))))
    taken = (F.col(nr) <= F.col(pick)["low"]) | F.array_contains(F.col(pick)["nrs"], F.col(nr))
    ranked = ranked.withColumn(total, fact["whole"] + taken.cast("long")).drop(nr)
    clear = short.where(F.col(at) != F.col(pick)["last"]).withColumn(total, fact["whole"] + (F.col(at) < F.col(pick)["last"]).cast("long"))
    short = ranked.unionByName(clear).drop(pick, at)
    rest = keyed.where(fact["short"] == 0).withColumn(size, words).withColumn(total, fact["whole"])
    out = rest.unionByName(short)
    place = F.transform(F.slice(fact["draws"], F.lit(1), F.col(total).cast("int")), lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["shard"], d["pass"], F.col(h)).alias("place")))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.col(size).alias("size"), fact["source_size"].alias("source_size"), fact["target"].alias("target"), place.alias("placements"))


def materialize(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with its shard and its place, by which a shard's rows are sorted."""
    shard, at = fresh(mixed, "shard", "place")
    out = mixed.withColumn(at, F.explode("placements"))
    return out.withColumn(shard, F.col(at)["shard"]).withColumn(at, F.col(at)["place"]).drop("placements")


def write_mix(mixed: DataFrame, path: str) -> None:
    """Writes the mix under path, a folder for each output shard, its rows in the order of their places."""
    rows = materialize(mixed)
    rows.repartition("shard").sortWithinPartitions("shard", "place").write.option("compression", "zstd").partitionBy("shard").parquet(path)

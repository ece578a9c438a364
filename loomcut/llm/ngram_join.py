"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

A text's set are the 64-bit hashes of its distinct word shingles. Texts with the same set, as two such hashes of it tell, are one node, named by the place
of its first document. Two nodes link when 100 * |x & y| >= percent * |x | y|. The join goes as follows.

1. Documents are packed into blocks (see blocks), with the distinct sets of each block; sets of all blocks meet by their hashes.
2. Each block learns for its shingles in how many blocks' sets they occur. In the order of that number two nodes that link share one of the first
   |x| - ceil(percent% |x|) + 1 shingles of each. A shingle that occurs no more often than the node itself is the node's own; a node with as many own ones as
   that links with nothing and is done. Of the others, the open ones, the shared ones among their first shingles are kept.
3. Stars: open nodes that share a sketch key are compared with the one among them whose shingles are most common, so large groups
   of near copies fall together after one comparison for each member and key.
4. Tiles: nodes meet in a tile by one of their first shingles and a band of sizes, only where the shingle occurs in two
   components of step 3. The first shingle that two nodes share leaves only what follows it in either to be shared, and the bits that differ
   between two bitmaps bound the overlap from above too; pairs that could still link are compared exactly.
5. Components over the links of both steps. Pairs within a component of step 3 need no comparison: their links cannot change it.
6. Each block gets the components of its distinct sets and names its documents, so copies cost one row for each block.

So no link between components is missed, and a group of g copies gives g rows, not g * g. Where many nodes share a key, AQE splits the joins; sums are added up before
they are exchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks as bl
from . import textvec
from .common import components, drop_stored, setting, stored, trim, trimmed

_U = np.uint64
WORDS = 16  # of 64 bits in a bitmap
KEYS = 8
SALTS = 16
TILE = 2000
_HASHES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    out = []
    for k in _HASHES:
        x = textvec.mix((s ^ _U(k)) * _U(k) + _U(1))
        out.append(int(textvec.mix(np.array([x.sum(dtype=_U) ^ _U(len(s) * 0x9E3779B97F4A7C15 % (1 << 64))], _U)).view(np.int64)[0]))
    return out[0], out[1]


def _bitmap(s: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of shingles has it; the differing bits of two are no more than the shingles that only one has."""
    bits = np.bincount((textvec.mix(s) % _U(WORDS * 64)).astype(np.int64), minlength=WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch(s: np.ndarray) -> np.ndarray:
    """For each of KEYS classes of hashes the least hash in it, made distinct by the class."""
    kind = (s >> _U(5)) % _U(KEYS)
    kinds, at = np.unique(kind, return_index=True)
    return textvec.mix(s[at] + kinds * _U(0x632BE59BD9B4E019)).view(np.int64)


def _distinct(batch: pa.RecordBatch, text_at: int, k: int) -> tuple[list[np.ndarray], list[int], np.ndarray]:
    """(the distinct sets of a block that aren't empty, the place of the first document of each, the set of each document or -1)."""
    known: dict[bytes, int] = {}
    sets, first, which = [], [], np.full(batch.num_rows, -1, np.int32)
    for a, _, data, offsets in textvec.chunks(batch.column(text_at)):
        for i, s in enumerate(textvec.shingle_sets(textvec.words(data, offsets, textvec.NOT_SPACE), k), a):
            if len(s):
                j = which[i] = known.setdefault(s.tobytes(), len(sets))
                if j == len(sets):
                    sets.append(s)
                    first.append(i)
    return sets, first, which


_DESCRIBED = "ids array<long>, which array<int>, h1 array<long>, h2 array<long>, n array<long>, at array<long>, least array<long>, least_at array<long>"


def _describe(k: int):
    def describe(batch: pa.RecordBatch, id_at: int, text_at: int) -> dict[str, pa.Array]:
        sets, first, which = _distinct(batch, text_at, k)
        ids = batch.column(id_at)
        least: list[tuple[int, int] | None] = [None] * len(sets)
        for i, (j, d) in enumerate(zip(which.tolist(), ids.to_pylist())):
            if j >= 0 and d is not None and (least[j] is None or (d, i) < least[j]):
                least[j] = d, i
        marks = [set_hash(s) for s in sets]
        lists = {"h1": [x for x, _ in marks], "h2": [x for _, x in marks], "n": [len(s) for s in sets], "at": first, "least": [x and x[0] for x in least], "least_at": [x and x[1] for x in least]}
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return {"ids": one(ids), "which": one(pa.array(which, pa.int32())), **{c: one(pa.array(x, pa.int64())) for c, x in lists.items()}}

    return describe


def _differ(a: str, b: str) -> Column:
    """How many bits differ between two bitmaps."""
    out = F.lit(0)
    for i in range(WORDS):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _may_link(n1: str, n2: str, bits1: str, bits2: str, percent: int) -> Column:
    """Whether sizes and bitmaps allow a link: |x & y| <= (|x| + |y| - differing bits) / 2 must reach percent / (100 + percent) of |x| + |y|."""
    total = F.col(n1) + F.col(n2)
    sizes = (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
    return sizes & ((total - _differ(bits1, bits2)) * (100 + percent) >= 2 * percent * total)


def _open(blocks: DataFrame, nodes: DataFrame, text_at: int, k: int, percent: int) -> DataFrame:
    """The nodes that may link, stored: (node, n, alone, fame, bits, keys, tokens, own). alone: how many shingles are the node's own; tokens: its first shared ones; fame: how common its shingles are; own: all of them, sorted."""
    total, largest = blocks.select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()

    def grams(batch):
        sets, _, _ = _distinct(batch, text_at, k)
        keys = np.sort(bl.keys_of(np.concatenate([np.zeros(0, _U), *sets])))
        first = bl.starts(keys)
        return keys[first], np.diff(np.append(first, len(keys)))

    answers = bl.count(blocks, grams, bl.ranges(total, largest))
    mine = nodes.select(F.shiftright("node", 24).alias("block"), F.struct(F.col("node").bitwiseAND((1 << 24) - 1).alias("at"), "times").alias("x")).groupBy("block").agg(F.collect_list("x").alias("mine"))
    schema = "node long, n long, alone long, fame double, bits array<long>, keys array<long>, tokens array<long>, own array<long>"

    def pick(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = {c: [] for c in ("node", "n", "alone", "fame", "bits", "keys", "tokens", "own")}
        if block.num_rows:
            number = block["block"][0].as_py()
            sets, first, _ = _distinct(bl.unpack(block["data"][0].as_buffer()), text_at, k)
            times = {x["at"]: x["times"] for x in block["mine"][0].as_py()}
            here = np.array([times.get(i, 0) for i in first], np.int64)
            flat = np.concatenate(sets)
            order = bl.ordered(bl.keys_of(flat))
            new = bl.starts(bl.keys_of(flat)[order])
            df = np.empty(len(flat), np.int64)
            df[order] = np.repeat(bl.read_counts(answers), np.diff(np.append(new, len(flat))))
            size = np.array([len(s) for s in sets])
            start = np.cumsum(size) - size
            alone = np.add.reduceat(df == np.repeat(here, size), start)
            prefix = size - (size * percent + 99) // 100 + 1
            for j in np.flatnonzero((here > 0) & (prefix > alone)).tolist():
                own = df[start[j] : start[j] + size[j]]
                shared = np.flatnonzero(own > here[j])
                shared = shared[np.lexsort((sets[j][shared], own[shared]))][: prefix[j] - alone[j]]
                for c, x in zip(out, (bl.place(number, first[j]), int(size[j]), int(alone[j]), float(own.mean()), _bitmap(sets[j]), _sketch(sets[j]), sets[j][shared].view(np.int64), sets[j].view(np.int64))):
                    out[c].append(x)
        lists = pa.list_(pa.int64())
        trim()
        return pa.table({c: pa.array(x, lists if c in ("bits", "keys", "tokens", "own") else pa.float64() if c == "fame" else pa.int64()) for c, x in out.items()})

    have = blocks.select("block", "data").join(mine, "block")
    with setting(blocks.sparkSession, bl.BATCH, "200"):
        out = stored(have.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(pick, schema), "open")
    drop_stored(answers)
    return out


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) of nodes that link, found by exact intersection of their sorted sets."""
    both = pairs.join(nodes.select(F.col("node").alias("u"), F.col("own").alias("x")), "u").join(nodes.select(F.col("node").alias("v"), F.col("own").alias("y")), "v")

    def compare(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xs, ys = x.values.to_numpy(), y.values.to_numpy()
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            good = []
            for i in range(batch.num_rows):
                a, b = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            at = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(at), batch.column(1).filter(at)], ["u", "v"])

    with setting(pairs.sparkSession, bl.BATCH, "200"):  # rows are two whole sets
        return stored(both.select("u", "v", "x", "y").mapInArrow(trimmed(compare), "u long, v long"), "links")


def _stars(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v): each node with the centre of every sketch key it shares, where sizes and bitmaps allow a link.

    The centre is the node whose shingles are the most common on average: in a group of near copies the one nearest to what all have.
    """
    keyed = nodes.select("node", "fame", F.explode("keys").alias("key"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    centre = keyed.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("best"), F.count("*").alias("times")).where("times > 1")
    # A key of very many nodes is dealt out; few keys have more than one node, so their centres are cheap to repeat.
    centre = centre.select("key", F.col("best.node").alias("centre"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = keyed.join(centre, ["key", "salt"]).where("node <> centre").select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "uv")
    return stored(pairs.join(left, "u").join(right, "v").where(_may_link("n_u", "n_v", "bits_u", "bits_v", percent)).select("u", "v"), "stars")


def _tiles(nodes: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes in different components of `first` that meet in a tile and whose sizes and bitmaps allow a link."""
    base = 100 / percent
    rooted = nodes.select("node", "n", "alone", "tokens").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(rooted.select("node", "root", "n", "alone", F.posexplode("tokens").alias("nth", "token")).select("token", "node", "root", "n", (F.col("alone") + F.col("nth") + 1).alias("pos")), "placed")
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    rows = placed.join(mixed, "token").join(nodes.select("node", "bits"), "node")
    rows = stored(rows.withColumn("band", F.floor(F.log(F.col("n")) / math.log(base) + 1e-9).cast("int")), "tiles")
    # A large tile is dealt out: its left rows into parts of about TILE, each of which meets all right rows.
    large = stored(rows.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE).alias("parts")).where("parts > 1"), "large")
    large = F.broadcast(large) if large.count() <= 100_000 else large  # three numbers a row
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = rows.join(large, ["token", "band"], "left").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    left = left.select("token", "band", "part", *[F.col(c).alias(f"{c}_u") for c in ("node", "root", "n", "bits", "pos")])
    right = rows.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    right = right.join(large, ["token", "band"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    right = right.select("token", "band", "part", "own", *[F.col(c).alias(f"{c}_v") for c in ("node", "root", "n", "bits", "pos")])
    apart = (F.col("root_u") != F.col("root_v")) & ((F.col("own") > F.col("band")) | (F.col("node_u") < F.col("node_v")))
    # Were this the first shingle they share, at most it and what follows could be shared; at the first one the bound holds.
    rest = 1 + F.least(F.col("n_u") - F.col("pos_u"), F.col("n_v") - F.col("pos_v"))
    apart = apart & (rest * (100 + percent) >= percent * (F.col("n_u") + F.col("n_v")))
    pairs = left.join(right, ["token", "band", "part"]).where(apart & _may_link("n_u", "n_v", "bits_u", "bits_v", percent))
    out = stored(pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct(), "pairs")
    drop_stored(rows, placed)
    return out


class _Groups:
    """Blocks of documents; sets: (block, j, h1, h2) of the blocks' distinct sets; named: (h1, h2, n, low) of nodes, low (id, place) being the component's row with the smallest id, null if all are null."""

    def __init__(self, docs: DataFrame, doc: str, text: str, k: int, percent: int, block_bytes: int):
        self.blocks, id_at, text_at = bl.pack(docs, doc, text, "blocks", _describe(k), _DESCRIBED, block_bytes)
        each = F.posexplode(F.arrays_zip("h1", "h2", "n", "at", "least", "least_at")).alias("j", "x")
        self.sets = self.blocks.select("block", each).select("block", "j", "x.*")
        where = lambda c: F.shiftleft("block", 24).bitwiseOR(F.col(c))
        low = F.when(F.col("least").isNotNull(), F.struct(F.col("least").alias("id"), where("least_at").alias("place")))
        nodes = self.sets.select("h1", "h2", "n", where("at").alias("node"), low.alias("low"))
        nodes = stored(nodes.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("times"), F.max("n").alias("n"), F.min("low").alias("low")), "nodes")
        open_ = _open(self.blocks, nodes, text_at, k, percent)
        first = components(_verify(_stars(open_, percent), open_, percent))
        more = _verify(_tiles(open_, first, percent), open_, percent)
        last = stored(components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "roots")
        drop_stored(open_)
        least = last.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("low"))
        linked = last.join(least, "root").select("node", F.col("low").alias("linked"))
        self.named = stored(nodes.join(linked, "node", "left").select("h1", "h2", "n", F.coalesce("linked", "low").alias("low")), "named")


def similar_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles long, component_id long (smallest doc_id reachable by links, itself included).

    Words are runs of anything but ASCII white space, A-Z as a-z; a text with fewer than k words has its whole sequence as one
    shingle; a null text or one without words has none, links with nothing and is its own component. Texts are whole. Repeated rows are
    documents of their own that link; a null doc_id doesn't count as smallest unless a component has no other. Other columns are not looked at.
    Empty table: no rows. Words and shingles are compared by 64-bit hashes, whole sets by 128 bits.
    """
    docs = docs.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    groups = _Groups(docs, "doc_id", "text", k, percent, block_bytes)
    found = groups.sets.select("block", "j", "h1", "h2").join(groups.named, ["h1", "h2"]).groupBy("block").agg(F.collect_list(F.struct("j", "n", F.col("low.id").alias("id"))).alias("found"))

    def name(batches):
        for batch in batches:
            for ids, which, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                which = np.asarray(which.values)
                j, n, low = (found.values.field(i) for i in range(3)) if found.is_valid else [pa.array([], pa.int64())] * 3
                at = np.full(int(which.max(initial=-1)) + 2, len(j), np.int64)
                at[j.to_numpy()] = np.arange(len(j))
                at = pa.array(at[which], mask=which < 0)
                own = pa.array(which < 0)
                sizes = pc.fill_null(n.take(at).cast(pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([ids.values, sizes, pc.if_else(own, ids.values, low.take(at).cast(pa.int64()))], ["doc_id", "n_shingles", "component_id"])

    out = groups.blocks.select("block", "ids", "which").join(found, "block", "left")
    return out.select("ids", "which", "found").mapInArrow(name, "doc_id long, n_shingles long, component_id long")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """docs without rows whose component has a row with a smaller id, or with the same id in an earlier place. Rows with a null id stay.

    Rows that share an id but not a component each stand for their own; of rows without words one of each id stays. All columns are kept as they
    are, whatever their names. Empty table: no rows.
    """
    groups = _Groups(docs, doc, text, k, percent, block_bytes)
    rows = groups.blocks.select("block", F.posexplode(F.arrays_zip("ids", "which")).alias("at", "x")).select("x.ids", "x.which", F.shiftleft("block", 24).bitwiseOR(F.col("at").cast("long")).alias("place"))
    empty = rows.where("which < 0 and ids is not null").groupBy("ids").agg(F.min("place").alias("place"))
    kept = groups.named.where("low is not null").select(F.col("low.place").alias("place")).distinct().union(empty.select("place")).union(rows.where("ids is null").select("place"))
    kept = kept.groupBy(F.shiftright("place", 24).alias("block")).agg(F.collect_list(F.col("place").bitwiseAND((1 << 24) - 1)).alias("kept"))

    def take(block: pa.Table, kept: pa.Table) -> pa.Table:
        if not block.num_rows or not kept.num_rows:
            return schema.empty_table()
        at = pa.array(np.sort(np.asarray(kept["kept"].combine_chunks().values)))
        packed = bl.unpack(block["data"][0].as_buffer()).take(at)
        return pa.table(packed.columns[:-2], names=packed.schema.names[:-2])

    schema = to_arrow_schema(docs.schema)
    return groups.blocks.select("block", "data").groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(take, docs.schema)

"""Embedding near-duplicates: an exact metric range join over cells of pivots.

The metric is the angle between vectors, the radius r the angle whose cosine is the least similarity. Pivots are vectors of a bounded sample
of the table, each the farthest from those before; each vector belongs to the cell of its nearest pivot, and a cell has the radius R of its farthest vector. By the
triangle inequality a vector x can be within r of something in cell b only if angle(x, pivot b) <= R(b) + r, so x is
replicated to the boundary of those cells alone. A cell with more rows than a block holds is dealt by hash into blocks. Each pair of
blocks is a tile, which joins independently: single precision finds candidates with a margin, double precision decides.

Equal vectors are one node, so copies cost nothing. A tile returns, for each node with links, their number and the smallest node
of its component within the tile, not the pairs. Where the data have no clusters (random directions far apart), no pivot excludes much,
and the work grows with the square of the number of vectors, as for any exact method; replication is then rows * blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, stored

_CHUNK = 128
#: Values in a block of vectors; a tile, two blocks, is what a task holds.
BLOCK_VALUES = 1 << 21


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _join_tile(x: np.ndarray, y: np.ndarray | None, times_x: np.ndarray, times_y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors x and y (None: x with itself) in one numbering: (linked vectors, counted with their copies, of each; local root of each)."""
    same = y is None
    y = x if same else y
    shift = 0 if same else len(x)
    n = shift + len(y)
    counts, parent = np.zeros(n, np.int64), np.arange(n)
    margin = 1e-4 + 1e-7 * x.shape[1]
    x32, y32 = x.astype(np.float32), y.astype(np.float32).T.copy()

    def root(i: np.ndarray) -> np.ndarray:
        r = parent[i]
        while (up := parent[r]).tolist() != r.tolist():
            r = up
        parent[i] = r
        return r

    for a in range(0, len(x), _CHUNK):
        rough = x32[a : a + _CHUNK] @ y32 >= least - margin
        if same:
            own = np.arange(len(rough))
            rough[own, a + own] = False
        i, j = np.nonzero(rough)
        if len(i) > rough.size // 50:
            exact = (x[a : a + _CHUNK] @ y.T >= least) & rough
            i, j = np.nonzero(exact)
        elif len(i):
            good = np.einsum("ij,ij->i", x[a + i], y[j]) >= least
            i, j = i[good], j[good]
        if not len(i):
            continue
        counts[a : a + len(rough)] += np.bincount(i, weights=times_y[j], minlength=len(rough)).astype(np.int64)
        if not same:
            counts[shift:] += np.bincount(j, weights=times_x[a + i], minlength=len(y)).astype(np.int64)
        edge = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for s, e in zip(edge, np.append(edge[1:], len(i))):
            roots = np.unique(root(np.append(j[s:e] + shift, a + i[s])))
            parent[roots] = roots[0]
    return counts, root(np.arange(n))


def link_vectors(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", least: float = 0.9, block_rows: int | None = None, sample_values: int = 1 << 18, max_pivots: int = 2048) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links long (other rows with cosine >= least), component_id long (smallest vec_id reachable by links, itself included), kept boolean (vec_id = component_id).

    Components are floats or doubles; integers and decimals count as doubles. A vector that is null, empty, zero or holds a null, NaN or infinite component links with nothing and is kept. Vectors of different
    lengths don't link. Repeated rows are vectors of their own and link with their copies; a null vec_id isn't
    smallest unless a component has no other; other columns are not looked at. Empty table: no rows. sample_values and max_pivots bound what the driver
    holds to choose pivots from; beyond max_pivots cells are cut into more blocks. block_rows: vectors in a block; None: as many as have BLOCK_VALUES values.
    """
    kind = vectors.select(F.col(f"`{embedding}`")).schema[0].dataType.simpleString()
    e = F.col(f"`{embedding}`") if kind == "array<float>" else F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec}`").cast("long").alias("vec_id"), e.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    good = F.coalesce(finite, F.lit(False))
    # Equal vectors are one node: two hashes of 64 bits tell vectors apart, a number names them.
    rows = rows.withColumns({f"h{i}": F.when(good, F.xxhash64(F.lit(i), F.size("e"), "e")) for i in (1, 2)})
    nodes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.first("e").alias("e"), F.count("*").alias("times"), F.min("vec_id").alias("low"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    links = None
    for dim, n in sorted((r.dim, r.n) for r in nodes.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).collect()):
        got = _join(nodes.where(F.size("e") == dim).select("node", "e", "times"), dim, n, least, block_rows or max(256, BLOCK_VALUES // dim), sample_values, max_pivots)
        links = got if links is None else links.union(got)
    ids = rows.select("vec_id", "h1", "h2")
    if links is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    edges = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    smallest = edges.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("least"))
    per = nodes.select("h1", "h2", "node", "times", "low").join(links.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(edges.join(smallest, "root").select("node", "least"), "node", "left")
    per = stored(per.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "linked")
    out = ids.where("h1 is not null").join(per, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.union(ids.where("h1 is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def choose_pivots(sample: np.ndarray, blocks: int, r: float, most: int) -> np.ndarray:
    """Pivots among unit vectors: each the farthest from those before it, as many as leave the least to compare.

    With the first 1, 4, 16, ... times `blocks` of them the share of the sample in cells whose ball comes within r of a vector is found; more
    pivots are taken only if they lessen it by a fifth.
    """
    most = min(most, max(1, len(sample) // 8))  # a cell of few vectors tells nothing about its radius
    far, chosen, nearest = np.full(len(sample), np.inf), [], np.zeros(len(sample), np.int64)
    best, taken, size = np.inf, 1, min(blocks, most)
    while True:
        while len(chosen) < size:
            i = int(far.argmax()) if chosen else 0
            angle = _angles(sample, sample[i : i + 1])[:, 0]
            nearest[angle < far] = len(chosen)
            far = np.minimum(far, angle)
            chosen.append(i)
        radius = np.zeros(size)
        np.maximum.at(radius, nearest, far)
        held = np.bincount(nearest, minlength=size) / len(sample)
        some = sample[:: max(1, len(sample) // 512)]
        share = float(((_angles(some, sample[chosen]) <= radius + r) @ held).mean())
        if share < 0.8 * best:
            best, taken = share, size
        if blocks == 1 or size >= most or far.max() <= 0:
            return sample[chosen[:taken]]
        size = min(4 * size, most)


def _join(nodes: DataFrame, dim: int, n: int, least: float, block_rows: int, sample_values: int, max_pivots: int) -> DataFrame:
    """(node, n, root): linked vectors of each node, counted with their copies, and its local root, tile by tile."""
    r = math.acos(max(-1.0, min(1.0, least)))
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(max(64, sample_values // dim)).select("e").collect()
    sample = _unit(np.array([x for row in chosen for x in row.e], np.float64), dim)
    pivots = choose_pivots(sample, max(1, -(-n // block_rows)), r, max_pivots)
    many = len(pivots)

    def pieces(batches):
        """Batches cut so that their angles to all pivots stay few, with those and the values."""
        for batch in batches:
            step = max(1, (1 << 21) // many)
            for a in range(0, batch.num_rows, step):
                piece = batch.slice(a, step)
                flat = piece.column(1).flatten().to_numpy(zero_copy_only=False)
                yield piece, _angles(_unit(flat, dim), pivots), flat

    def assign(batches):
        for batch, angle, _ in pieces(batches):
            cell = angle.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], ["node", "e", "times", "cell", "angle"])

    kind = nodes.schema["e"].dataType.simpleString()
    homes = stored(nodes.mapInArrow(assign, f"node long, e {kind}, times long, cell int, angle double"), "cells")
    cells = {c.cell: (c.radius, c.n) for c in homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # at most max_pivots
    radius = np.array([cells.get(c, (-10.0, 0))[0] for c in range(many)])
    blocks = np.array([-(-cells.get(c, (0, 0))[1] // block_rows) for c in range(many)])
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])

    def replicate(batches):
        for batch, angle, flat in pieces(batches):
            flat = flat.reshape(-1, dim)
            node, times = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cell = batch.column(3).to_numpy()
            own = first[cell] + (node.view(np.uint64) % blocks[cell].astype(np.uint64)).astype(np.int64)
            near = angle <= radius + r + 1e-9
            near[np.arange(len(cell)), cell] = True
            # Every row with each block of the cells near it.
            at, to = np.nonzero(near)
            group = np.repeat(np.arange(len(at)), blocks[to])
            other = first[to][group] + np.arange(len(group)) - np.repeat(np.cumsum(blocks[to]) - blocks[to], blocks[to])
            at = at[group]
            low, high = np.minimum(own[at], other), np.maximum(own[at], other)
            key = low * total + high
            order = np.argsort(key * 2 + (own[at] > low), kind="stable")
            at, low, high, key = at[order], low[order], high[order], key[order]
            side = own[at] > low
            cut = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (side[1:] != side[:-1])))[: len(at)]
            ends = np.append(cut[1:], len(at))
            for a in range(0, len(cut), 256):  # a part of the tiles at a time, each a row of its own
                s, e = cut[a : a + 256], ends[a : a + 256]
                parts = list(zip(s.tolist(), e.tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[s]), pa.array(side[s]), pa.array([node[at[i:j]].tobytes() for i, j in parts], pa.binary()),
                    pa.array([times[at[i:j]].tobytes() for i, j in parts], pa.binary()), pa.array([flat[at[i:j]].tobytes() for i, j in parts], pa.binary()),
                ], ["tile", "side", "nodes", "times", "vectors"])

    real = np.float32 if "float" in kind else np.float64

    def join(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy(zero_copy_only=False)
        sides = []
        for s in (False, True):
            part = group.filter(pa.array(side == s))
            load = lambda c, t, part=part: np.frombuffer(b"".join(part[c].to_pylist()), t)
            sides.append((load("nodes", np.int64), load("times", np.int64), load("vectors", real)))
        (nx, tx, x), (ny, ty, y) = sides
        tile = group["tile"][0].as_py()
        if tile // total == tile % total:
            counts, root = _join_tile(_unit(x, dim), None, tx, tx, least)
            who = nx
        elif not len(nx) or not len(ny):
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        else:
            counts, root = _join_tile(_unit(x, dim), _unit(y, dim), tx, ty, least)
            who = np.concatenate([nx, ny])
        at = np.flatnonzero(counts)
        return pa.table({"node": who[at], "n": counts[at], "root": who[root[at]]})

    packed = homes.mapInArrow(replicate, "tile long, side boolean, nodes binary, times binary, vectors binary")
    return stored(packed.groupBy("tile").applyInArrow(join, "node long, n long, root long"), "links")

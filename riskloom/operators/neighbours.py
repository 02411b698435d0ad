"""Exact k nearest neighbours of distinct points by k-d cells.

A k-d tree grown on a bounded sample deals the points to shards.  A point's neighbours in its own shard bound its
radius; it then goes as a query to the other shards whose bounding box meets that ball, and the best of all shards are
merged.  Inside a shard a local k-d tree does the same with small leaves, so the points compared per point depend on the
data's own dimension and not on the number of points.  Shards have about ``SHARD_POINTS`` points at every size (up to
2^MAX_DEPTH shards), and the queries of a shard that many balls meet are dealt to several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHARD_POINTS = 4_096       # points of a shard, as planned
LEAF_POINTS = 32           # points of a leaf of a shard's own tree
SAMPLE_PER_SHARD = 32      # sampled points behind each shard of the top tree
MAX_DEPTH = 14             # bounds the sample, the tree and the boxes that every task gets
BLOCK_CELLS = 1 << 21      # of a matrix of points against boxes: 16 MB
QUERY_ROWS = 50_000        # foreign queries of a shard that one task takes


def _halves(x: np.ndarray):
    """(dimension, cut) of the widest dimension with points on both sides of its median; None for equal points."""
    for c in np.argsort(-x.std(axis=0), kind="stable") if len(x) else ():
        v = np.sort(x[:, c])
        if v[0] == v[-1]:
            continue
        cut = v[(len(v) - 1) // 2]
        return int(c), float(cut if cut < v[-1] else v[np.searchsorted(v, cut) - 1])
    return None


def top_tree(sample: np.ndarray, depth: int):
    """(dimensions, cuts) of a heap-ordered tree: node n has children 2n+1 (at or below its cut) and 2n+2."""
    dims, cuts = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
    held = {0: sample}
    for n in range(len(dims)):
        here = held.pop(n)
        got = _halves(here)
        if got:
            dims[n], cuts[n] = got
        low = here[:, dims[n]] <= cuts[n]
        held[2 * n + 1], held[2 * n + 2] = here[low], here[~low]
    return dims, cuts


def shard_of(x: np.ndarray, tree) -> np.ndarray:
    dims, cuts = tree
    node = np.zeros(len(x), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
    return node - len(dims)


def box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(points, boxes) squared distances, a little below the true ones so that rounding drops no box."""
    out = np.zeros((len(x), len(low)))
    for c in range(x.shape[1]):
        d = np.maximum(np.maximum(low[None, :, c] - x[:, c, None], x[:, c, None] - high[None, :, c]), 0.0)
        out += d * d
    return out * (1.0 - 1e-9)


def _leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    work, out = [np.arange(len(x))], []
    while work:
        at = work.pop()
        got = _halves(x[at]) if len(at) > leaf else None
        if got is None:
            out.append(at)
            continue
        low = x[at, got[0]] <= got[1]
        work += [at[low], at[~low]]
    return out


def shard_neighbours(x, keys, q, q_keys, reach, k: int, leaf: int = LEAF_POINTS):
    """(distances, neighbour rows, points compared): the k nearest ``x`` of each query within its squared ``reach``.

    Ties go to the smaller key; a point is not its own neighbour; missing neighbours have distance inf and row -1.
    """
    best = np.full((len(q), k), np.inf)
    who = np.full((len(q), k), -1, np.int64)
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    if not len(x) or not len(q):
        return best, who, 0
    cells = _leaves(x, leaf)
    low = np.stack([x[c].min(axis=0) for c in cells])
    high = np.stack([x[c].max(axis=0) for c in cells])
    compared = 0
    for block in _leaves(q, leaf):
        for a in range(0, len(block), 4 * leaf):            # equal queries stay in one leaf
            on = block[a:a + 4 * leaf]
            far = box_distance(q[on], low, high)
            for c in np.argsort(far.min(axis=0), kind="stable"):
                near = np.flatnonzero(far[:, c] <= np.minimum(best[on, k - 1], reach[on]))
                if not len(near):
                    continue
                rows, cell = on[near], cells[c]
                d2 = np.zeros((len(rows), len(cell)))
                for f in range(x.shape[1]):
                    d2 += (q[rows, f][:, None] - x[cell, f][None, :]) ** 2
                compared += d2.size
                d2[q_keys[rows][:, None] == keys[cell][None, :]] = np.inf
                d = np.concatenate([best[rows], d2], axis=1)
                w = np.concatenate([who[rows], np.broadcast_to(cell, d2.shape)], axis=1)
                w[np.isinf(d)] = -1
                o = np.lexsort((np.where(w < 0, len(keys), rank[w]), d), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(d, o, 1), np.take_along_axis(w, o, 1)
    return best, who, compared


def _points(table):
    n = table.num_rows
    x = table.column("x").combine_chunks() if isinstance(table, pa.Table) else table.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def _keys(column) -> np.ndarray:
    return np.array(column.to_pylist()) if len(column) else np.zeros(0, np.int64)


def nearest(points: DataFrame, cols, k: int = 5, key: str = "txn_id", ask: str | None = None,
            shard_points: int = SHARD_POINTS) -> DataFrame:
    """(i, nn_rank 0..k-1, j, d2): the k nearest other points (Euclidean, ties by key) of every point, or of those whose
    boolean column ``ask`` is true.  Points with a null or NaN coordinate take no part."""
    spark = points.sparkSession
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    asks = F.col(ask) if ask else F.lit(True)
    pts = cut_lineage(points.filter(whole).select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
                                                  asks.alias("ask")))
    key_type = pts.schema["key"].dataType.simpleString()
    n = pts.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / shard_points))))
    want = SAMPLE_PER_SHARD << depth
    order = F.xxhash64(F.lit(5), "key")
    share = min(1.0, 2 * want / max(1, n))
    picked = pts.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("x", "key").orderBy(order, "key").limit(want)
    shared = spark.sparkContext.broadcast(top_tree(_points(picked.toArrow()).reshape(-1, len(cols)), depth))

    def deal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(_points(batch), shared.value).astype(np.int32) if batch.num_rows else [], pa.int32()),
                                              *batch.columns], names=["shard", "key", "x", "ask"])

    dealt = cut_lineage(pts.mapInArrow(deal, f"shard int, key {key_type}, x array<double>, ask boolean"))
    boxes = sorted(dealt.groupBy("shard").agg(F.array(*[F.min(F.col("x")[c]) for c in range(len(cols))]).alias("low"),
                                              F.array(*[F.max(F.col("x")[c]) for c in range(len(cols))]).alias("high")).collect())
    numbers = np.array([b["shard"] for b in boxes], np.int64)
    low, high = (np.array([b[s] for b in boxes], float).reshape(-1, len(cols)) for s in ("low", "high"))
    hull = spark.sparkContext.broadcast((numbers, low, high))

    def found(q_keys, keys, best, who, extra=()):
        size = (who >= 0).sum(axis=1)
        at = who[who >= 0]
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(best[who >= 0]), keys.take(pa.array(at))], names=["d2", "j"])
        return pa.Table.from_arrays([q_keys, *extra, pa.ListArray.from_arrays(offsets, pairs)], names=["i", *["shard", "x", "reach"][:len(extra)], "near"])

    def at_home(table):
        table = table.combine_chunks()
        x, keys = _points(table), _keys(table.column("key"))
        on = np.flatnonzero(table.column("ask").to_numpy(zero_copy_only=False).astype(bool))
        best, who, _ = shard_neighbours(x, keys, x[on], keys[on], np.full(len(on), np.inf), k)
        mine = table.take(pa.array(on))
        return found(mine.column("key"), table.column("key").combine_chunks(), best, who,
                     (mine.column("shard"), mine.column("x"), pa.array(best[:, k - 1])))

    near = f"array<struct<d2:double,j:{key_type}>>"
    home = cut_lineage(dealt.groupBy("shard").applyInArrow(at_home, f"i {key_type}, shard int, x array<double>, reach double, near {near}"))

    def abroad(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            all_numbers, all_low, all_high = hull.value
            x = _points(batch)
            reach = batch.column("reach").to_numpy()
            own = batch.column("shard").to_numpy()
            rows, shards = [], []
            step = max(1, BLOCK_CELLS // max(1, len(all_numbers)))       # points x boxes held at once
            for a in range(0, len(x), step):
                meets = box_distance(x[a:a + step], all_low, all_high) <= reach[a:a + step, None]
                at, to = np.nonzero(meets & (all_numbers[None, :] != own[a:a + step, None]))
                rows.append(at + a)
                shards.append(to)
            row, to = pa.array(np.concatenate(rows)), np.concatenate(shards)
            yield pa.RecordBatch.from_arrays([pa.array(all_numbers[to].astype(np.int32)), batch.column("i").take(row), batch.column("x").take(row),
                                              batch.column("reach").take(row)], names=["shard", "i", "x", "reach"])

    asked = cut_lineage(home.select("i", "shard", "x", "reach").mapInArrow(abroad, f"shard int, i {key_type}, x array<double>, reach double"))
    blocks = F.broadcast(cut_lineage(asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))))   # a row a shard

    def visit(_key, left, right):
        x, keys = _points(left), _keys(left.column("key"))
        best, who, _ = shard_neighbours(x, keys, _points(right), _keys(right.column("i")), right.column("reach").to_numpy(), k)
        return found(right.column("i"), left.column("key").combine_chunks(), best, who)

    copies = (dealt.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "x"))
    queries = (asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64(F.lit(9), "i"), F.col("blocks")).cast("int").alias("block"), "i", "x", "reach"))
    guests = copies.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(visit, f"i {key_type}, near {near}")
    rank = Window.partitionBy("i").orderBy("d2", "j")
    return (home.select("i", "near").unionByName(guests).select("i", F.explode("near").alias("n")).select("i", "n.d2", "n.j")
            .withColumn("nn_rank", F.row_number().over(rank) - 1).filter(F.col("nn_rank") < k).select("i", "nn_rank", "j", "d2"))

"""Approximate nearest neighbours by inner product: a hash-prefix (LSH) forest.

Every vector gets, per tree, a long hash string (the signs of random projections).  The index cuts the vectors into shards;
a shard keeps each tree as a sorted array of its strings.  A query descends every tree by binary search to its longest prefix
match, then all trees ascend together, one prefix length at a time, until enough candidates are gathered;
candidates are scored exactly.  Queries go to the shards in blocks, and the best of all shards are merged.

Edge cases: null, zero and ragged (length other than the table's commonest) vectors and those with null or non-finite components take
no part; repeated rows are separate candidates and separate queries: each gets a list of its own under its vec_id, in which rows of the same vec_id
may stand, but not the row itself; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only

TREES = 40
BITS = 32                  # hash string length
SHARD_ROWS = 8_192         # vectors of a shard, as planned
BLOCK_ROWS = 32_768        # queries of a block
AT_ONCE = 256              # queries that descend together
SHARE = 0.5                # candidates wanted, as a share of a shard's vectors
MIN_CANDIDATES = 400       # and at least so many
TOP = 20
SEED = 1234


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TREES * BITS))


def hash_strings(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, TREES) hash strings as integers, the first projection in the highest bit."""
    bits = (x @ p > 0).reshape(len(x), TREES, BITS)
    return np.packbits(bits, axis=2).view(">u4").reshape(len(x), TREES).astype(np.int64)


class Forest:
    """Sorted arrays of hash strings over one shard's vectors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.p = planes(x.shape[1])
        h = hash_strings(x, self.p)
        self.order = np.argsort(h, axis=0, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=0)

    def candidates(self, q: np.ndarray, want: int):
        """Yield (query, candidate rows): the longest prefix length at which all trees together give ``want`` rows."""
        n = len(self.x)
        h = hash_strings(q, self.p)
        lo = np.zeros((BITS + 1, len(q), TREES), np.int32)
        hi = np.zeros((BITS + 1, len(q), TREES), np.int32)
        for t in range(TREES):
            for length in range(BITS + 1):           # the run of strings that share the first ``length`` bits
                shift = BITS - length
                base = (h[:, t] >> shift) << shift
                lo[length, :, t] = np.searchsorted(self.sorted[:, t], base, side="left")
                hi[length, :, t] = np.searchsorted(self.sorted[:, t], base + (1 << shift), side="left")
        held = (hi - lo).sum(axis=2)                  # (length, query): candidates with repetitions
        for i in range(len(q)):
            length = int((held[:, i] >= want).sum()) - 1       # deepest level with enough, repetitions counted
            mark = np.zeros(n, bool)
            while True:
                for t in range(TREES):
                    mark[self.order[lo[max(length, 0), i, t]:hi[max(length, 0), i, t], t]] = True
                if length <= 0 or int(mark.sum()) >= min(want, n):
                    break
                length -= 1                           # ascend one level in every tree
            yield i, np.flatnonzero(mark)


def best(forest: Forest, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, q_rows: np.ndarray, top: int):
    """(query row, vec id, score) of the best candidates of each query in this shard."""
    want = max(MIN_CANDIDATES, int(SHARE * len(ids)))
    out = []
    for a in range(0, len(q), AT_ONCE):
        found = forest.candidates(q[a:a + AT_ONCE], want)
        out += _scored(forest, rows, ids, q[a:a + AT_ONCE], q_rows[a:a + AT_ONCE], found, top)
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _scored(forest, rows, ids, q, q_rows, found, top) -> list:
    out = []
    for i, at in found:
        at = at[rows[at] != q_rows[i]]
        s = np.einsum("ij,j->i", forest.x[at], q[i])
        if len(at) > top:
            edge = np.partition(s, len(s) - top)[len(s) - top]
            on = s >= edge
            at, s = at[on], s[on]
        o = np.lexsort((ids[at], -s))[:top]
        out.append((np.full(len(o), q_rows[i]), ids[at][o], s[o]))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) rows that take part: doubles, finite, not zero, of the commonest length."""
    rows = only(vectors, vec_id="bigint", embedding="array<double>").withColumnRenamed("embedding", "v").filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (dim["d"] if dim else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def search(vectors: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest rows of each row whose vec_id is divisible by ``every``.

    Work: every (query block, shard) pair is one group, found by an equi-join on block and shard numbers.
    """
    rows = cut_lineage(usable(vectors).withColumn("row", F.monotonically_increasing_id()))       # numbers stay with their rows
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n // (every * BLOCK_ROWS)))
    shard = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).cast("int")
    index = rows.select(shard.alias("shard"), "row", "vec_id", "v")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                           F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(blocks)).cast("int").alias("block"), "row", "v")
    schema = "row bigint, vec_id bigint, score double"

    def run(_key, left, right):
        mine = left.column("row").to_numpy()
        q_rows = right.column("row").to_numpy()
        empty = not len(mine) or not len(q_rows)
        found = ([], [], []) if empty else best(Forest(_matrix(left.column("v"))), mine, left.column("vec_id").to_numpy(), _matrix(right.column("v")), q_rows, top)
        return pa.table({"row": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (copies.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, schema))
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    names = asked.select(F.col("row").alias("_q"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, F.col("row") == F.col("_q")).select("query_id", "rank", "vec_id", "score")

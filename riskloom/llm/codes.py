"""Embedding near-duplicates by randomly rotated binary codes with stored correction factors.

A vector's code is the signs of its rotated unit vector; stored beside it are f, the inner product of code and vector, and the
rotated vector rounded to 8 bits.  For a second vector q, <code, q> / f estimates the cosine without bias, and its confidence bound
follows from f.  Pairs whose upper bound (from either side) is under the threshold are done; the others are computed again from the original
vectors in double precision, and only that decides.

Candidates share a cell: in each of several tables the place and sign of the largest of a few random projections (several such
digits for large inputs), so cells stay near ``CELL_ROWS`` vectors.  The number of tables follows from the chance that a pair
at the threshold shares a cell, so that at most ``MISS`` of such pairs share none.  Codes alone go to the cells; a vector goes
to a cell only if a pair of it there needs exact computation.  Cells above ``BLOCK_ROWS`` are cut into blocks, and every two blocks meet
in a task of their own.  A pair counts in the first table where it shares a cell, so links are counted without emitting
pairs; a task gives each vector's number of links and a spanning forest, joined by star rounds.

Equal vectors collapse to one node before all this.  Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, their own id as component); vectors link only with vectors of their own length; rows that
repeat a vec_id are vectors of their own; a null vec_id links, but names no component (null if it reaches no other id) and isn't kept.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import connected_components, local_components, only

THRESHOLD = 0.95
MISS = 0.001               # of the pairs right at the threshold may share no cell
CELL_ROWS = 4_096          # vectors of a cell, as planned
BLOCK_ROWS = 8_192         # vectors of a block
MAX_DIGIT = 32             # projections of one digit of a cell's number
EPSILON = 1.9              # width of the confidence bound, in standard errors
SEED = 20_24
TILE = 1_024
MAX_HOT = 100_000          # large cells whose list is broadcast; beyond that it is joined


# ---------------------------------------------------------------- codes

@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)           # lengths can't overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encode(u: np.ndarray) -> np.ndarray:
    """(rows, bytes) records: f, scale and rounding error (float32), the rotated vector in 8 bits, the code's bits."""
    dim = u.shape[1]
    o = u @ rotation(dim)
    scale = np.abs(o).max(axis=1) / 127
    q = np.rint(o / scale[:, None])
    off = np.sqrt(((o - q * scale[:, None]) ** 2).sum(axis=1))
    head = np.stack([np.abs(o).sum(axis=1) / math.sqrt(dim), scale, off], axis=1).astype("<f4")
    return np.concatenate([head.view(np.uint8).reshape(len(u), 12), q.astype(np.int8).view(np.uint8), np.packbits(o > 0, axis=1)], axis=1)


class Codes:
    """Unpacked records: signs, correction factors, bound widths and the rounded vectors."""

    def __init__(self, records: np.ndarray, dim: int):
        head = np.ascontiguousarray(records[:, :12]).view("<f4")
        self.f, self.off = head[:, 0], head[:, 2]
        self.q = records[:, 12:12 + dim].view(np.int8).astype(np.float32) * head[:, 1:2]
        self.signs = (np.unpackbits(records[:, 12 + dim:], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
        miss = np.sqrt(np.maximum(0.0, 1 - self.f ** 2)) / self.f
        self.width = EPSILON * miss / math.sqrt(max(1, dim - 1))

    def __getitem__(self, on) -> Codes:
        got = Codes.__new__(Codes)
        got.f, got.off, got.q, got.signs, got.width = self.f[on], self.off[on], self.q[on], self.signs[on], self.width[on]
        return got

    def upper(self, other: Codes) -> np.ndarray:
        """Upper confidence bounds of the cosines with ``other``, estimated from this side's codes."""
        return (self.signs @ other.q.T + other.off) / self.f[:, None] + self.width[:, None]


def undecided(a: Codes, b: Codes, threshold: float) -> np.ndarray:
    """(rows of a, rows of b): pairs that the bounds of neither side rule out."""
    low = threshold - 1e-5                                  # single precision
    return (a.upper(b) >= low) & (b.upper(a).T >= low)


# ---------------------------------------------------------------- cells

def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(projections a digit, digits, tables) for ``n`` vectors."""
    cells = -(-n // CELL_ROWS)
    if cells <= 1:
        return 1, 0, 1
    digits = max(1, math.ceil(math.log(cells) / math.log(2 * MAX_DIGIT) - 1e-9))
    width = math.ceil(cells ** (1 / digits) / 2 - 1e-9)
    rng = np.random.default_rng(SEED)                       # two unit vectors' projections: correlated normals
    x = rng.standard_normal((50_000, width))
    y = threshold * x + math.sqrt(1 - threshold * threshold) * rng.standard_normal(x.shape)
    same = (_digit(x) == _digit(y)).mean() ** digits
    return width, digits, max(1, math.ceil(math.log(MISS) / math.log1p(-same)))


def _digit(p: np.ndarray) -> np.ndarray:
    at = np.abs(p).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(p, at[..., None], axis=-1)[..., 0] > 0)


def cell_numbers(u: np.ndarray, width: int, digits: int, tables: int) -> np.ndarray:
    """(rows, tables) cell numbers."""
    out = np.zeros((len(u), tables), np.int64)
    for t in range(tables if digits else 0):
        p = u @ np.random.default_rng([SEED, u.shape[1], t]).standard_normal((u.shape[1], digits * width))
        for d in _digit(p.reshape(len(u), digits, width)).T:
            out[:, t] = out[:, t] * (2 * width) + d
    return out


# ---------------------------------------------------------------- Spark

def _usable(column: str = "v"):
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
                      & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, key): ``key`` names the vector, null for those that take no part."""
    rows = only(vectors, vec_id="bigint", embedding="array<double>").withColumnRenamed("embedding", "v")
    name = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "v")), 16, "0") for k in (1, 2)])
    return rows.withColumn("key", F.when(_usable(), name))


def nodes(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, key, copies, low, dim, v, cells, record): the distinct vectors with their codes, checkpointed."""
    rows = rows.filter("key is not null")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.approx_count_distinct("key").alias("n")).collect()
    plans = {r["dim"]: plan(r["n"], threshold) for r in sizes}
    one = (rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.any_value("v").alias("v"))
           .select(F.monotonically_increasing_id().alias("node"), "key", "copies", "low", F.size("v").alias("dim"), "v"))

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                u = unit(_matrix(part.column("v"), dim))
                cells = cell_numbers(u, *plans[dim])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int64())), pa.array([x.tobytes() for x in encode(u)], pa.binary())],
                                                 names=[*part.schema.names, "cells", "record"])

    return cut_lineage(one.mapInArrow(run, "node bigint, key string, copies bigint, low bigint, dim int, v array<double>, cells array<bigint>, record binary"))


_PLACE = ["dim", "tab", "cell", "i", "j"]


def _dealt(coded: DataFrame) -> DataFrame:
    """(node, record, part, *_PLACE): every node in its cells; the parts i and j of a cell that meet."""
    held = coded.select("node", "dim", "record", F.posexplode("cells").alias("tab", "cell"))
    cell = ["dim", "tab", "cell"]
    large = (held.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS)
             .select(*cell, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts")))
    large = cut_lineage(large)
    if large.limit(MAX_HOT + 1).count() <= MAX_HOT:
        large = F.broadcast(large)
    held = held.join(large, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return (held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("node", "record", "part", *cell, F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j")))


def _tiles(n: int):
    return [(a, min(a + TILE, n)) for a in range(0, n, TILE)]


def _sides(i: int, j: int, part: np.ndarray):
    """Rows of both sides, and whether they are the same rows."""
    return (np.arange(len(part)), np.arange(len(part)), True) if i == j else (np.flatnonzero(part == i), np.flatnonzero(part == j), False)


def _near(dealt: DataFrame, threshold: float) -> DataFrame:
    """(node, part, *_PLACE): nodes with a pair there that the codes don't rule out."""
    out = pa.schema([("node", pa.int64()), ("part", pa.int32()), ("dim", pa.int32()), ("tab", pa.int32()), ("cell", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])

    def run(key, table):
        dim, tab, cell, i, j = (k.as_py() for k in key)
        part = table.column("part").to_numpy()
        raw = b"".join(x.as_buffer() for x in table.column("record").combine_chunks())
        codes = Codes(np.frombuffer(raw, np.uint8).reshape(len(part), -1), dim)
        left, right, same = _sides(i, j, part)
        near = np.zeros(len(part), bool)
        other = codes[right]
        for a, b in _tiles(len(left)):
            hit = undecided(codes[left[a:b]], other, threshold)
            if same:
                hit[np.arange(b - a), np.arange(a, b)] = False
            near[left[a:b]] |= hit.any(axis=1)
            near[right] |= hit.any(axis=0)
        n = int(near.sum())
        fixed = [pa.array(np.full(n, x), f.type) for x, f in zip((dim, tab, cell, i, j), list(out)[2:], strict=True)]
        return pa.table([pa.array(table.column("node").to_numpy()[near]), pa.array(part[near], pa.int32()), *fixed], schema=out)

    return dealt.groupBy(*_PLACE).applyInArrow(run, "node bigint, part int, dim int, tab int, cell bigint, i int, j int")


def _first_shared(x: np.ndarray, y: np.ndarray, tab: int) -> np.ndarray:
    """Pairs whose first shared cell is that of table ``tab``."""
    return (x[:, :tab] != y[:, :tab]).all(axis=1)


def _links(near: DataFrame, coded: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n links of node a (b null), and the edges (a, b) of spanning forests."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(key, table):
        dim, tab, _cell, i, j = (k.as_py() for k in key)
        node, copies, part = (table.column(c).to_numpy() for c in ("node", "copies", "part"))
        u = unit(_matrix(table.column("v"), dim))
        cells = np.stack(table.column("cells").to_numpy())
        left, right, same = _sides(i, j, part)
        n = np.zeros(len(node), np.int64)
        tree = np.zeros((2, 0), np.int64)
        for a, b in _tiles(len(left)):
            x, y = np.nonzero(u[left[a:b]] @ u[right].T >= threshold)
            x, y = left[a:b][x], right[y]
            on = x < y if same else np.ones(len(x), bool)
            x, y = x[on], y[on]
            for c in range(0, len(x), 1 << 20):
                p, q = x[c:c + (1 << 20)], y[c:c + (1 << 20)]
                first = _first_shared(cells[p], cells[q], tab)
                p, q = p[first], q[first]
                np.add.at(n, p, copies[q])
                np.add.at(n, q, copies[p])
                tree = np.concatenate([tree, [p, q]], axis=1)
                root = local_components(len(node), *tree)                     # the forest so far: at most a link a node
                on = np.flatnonzero(root != np.arange(len(node)))
                tree = np.stack([on, root[on]])
        on = np.flatnonzero(n)
        null = pa.nulls(len(on), pa.int64())
        return pa.table([pa.array(np.concatenate([node[on], node[tree[0]]])), pa.chunked_array([null, pa.array(node[tree[1]])]),
                         pa.array(np.concatenate([n[on], np.zeros(tree.shape[1], np.int64)]))], schema=out)

    there = near.join(coded.select("node", "copies", "v", "cells"), "node")
    return there.groupBy(*_PLACE).applyInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``."""
    rows = _keyed(vectors)
    coded = nodes(rows, threshold)
    found = cut_lineage(_links(_near(_dealt(coded), threshold), coded, threshold))
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    member = connected_components(found.filter("b is not null").select("a", "b"))
    member = cut_lineage(member.join(coded.select("node", "low"), "node"))
    lowest = member.groupBy("component").agg(F.min("low").alias("least"))
    member = member.join(lowest, "component").select("node", "least")
    at = (coded.select("node", "key", "copies", "low").join(links, "node", "left").join(member, "node", "left")
          .filter("copies > 1 or n is not null")                        # the rest are alone
          .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "low").alias("least")))
    got = rows.select("vec_id", "key").join(at, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return (got.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))

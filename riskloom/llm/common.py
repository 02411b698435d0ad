"""Helpers shared by the operators of this subpackage.

Text columns reach NumPy as one ``uint8`` array with row offsets (no Python string per row), in pieces
of a few MB, so a task's memory is bounded by ``PIECE_BYTES`` or its longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PIECE_BYTES = 1 << 20

U64 = np.uint64


# ---------------------------------------------------------------- Arrow text as bytes

def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string/binary Arrow array; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Row ranges [a, b) whose bytes stay under ``limit`` (a single longer row comes alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def text_pieces(col, limit: int = PIECE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) pieces of a text column."""
    data, offsets = text_buffers(col)
    for a, b in pieces(offsets, limit):
        lo, hi = offsets[a], offsets[b]
        yield a, b, data[lo:hi], offsets[a:b + 1] - lo


def words64(data: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte word starting at every byte (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", buffer=padded.data, strides=(1,)).copy()


# ---------------------------------------------------------------- words and shingles

def is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_layout(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None):
    """Single-spaced, A-Z lower-cased bytes of a piece with its words ``[^\\x20\\x09-\\x0D]+``.

    Returns (bytes, word starts, word ends, first word of each row, original starts, original ends);
    words never cross rows, nor the byte positions ``breaks``.
    """
    n = len(offsets) - 1
    body = np.concatenate([data, np.full(1, 32, np.uint8)])
    body = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint8)
    space = is_space(body)
    first = np.zeros(len(body), bool)                     # rows begin here
    first[offsets[:-1][offsets[:-1] < len(body)]] = True
    if breaks is not None:
        first[breaks] = True
    begins = np.flatnonzero(~space & (first | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(~space & np.concatenate([space[1:] | first[1:], [True]])) + 1
    lengths = ends - begins
    # words laid out again with one space between them
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int64)
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    shift = np.repeat(begins - starts, lengths)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(starts)), lengths)
    out[at] = body[at + shift]
    row_first = np.searchsorted(begins, offsets[:-1], side="left")
    row_first = np.concatenate([row_first, [len(begins)]]).astype(np.int64)[:n + 1]
    return out, starts, starts + lengths, row_first, begins, ends


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """The first four results of ``word_layout``."""
    return word_layout(data, offsets)[:4]


def shingles(starts: np.ndarray, ends: np.ndarray, row_first: np.ndarray, width: int):
    """(starts, ends, row) of the ``width``-word shingles; a shorter row is one shingle, an empty one none."""
    count = np.diff(row_first)
    n_sh = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), n_sh)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    a = row_first[:-1][row] + within
    b = np.minimum(a + width, row_first[1:][row]) - 1
    return starts[a], ends[b], row


_P = [U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                       0x27D4EB2F165667C5)]              # fixed values: the primes of XXH64


def _rotl(x, r):
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, word):
    return _rotl(acc + word * _P[1], 31) * _P[0]


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges at once (equal to Spark's ``xxhash64`` of one string column)."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    w = words64(data)
    w = np.concatenate([w, np.zeros(1, np.uint64)])
    lens = (ends - starts).astype(np.int64)
    with np.errstate(over="ignore"):
        s = U64(seed)
        h = np.full(n, s + _P[4], np.uint64)
        long = np.flatnonzero(lens >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + _P[0] + _P[1], s + _P[1], s, s - _P[0])]
            stripes, p = lens[long] // 32, starts[long]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for j in range(4):
                    v[j][on] = _round(v[j][on], w[p[on] + 32 * k + 8 * j])
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                x = (x ^ _round(U64(0), v[j])) * _P[0] + _P[3]
            h[long] = x
        h += lens.astype(np.uint64)
        p, rest = starts + (lens // 32) * 32, lens % 32
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            h[on] = _rotl(h[on] ^ _round(U64(0), w[p[on] + 8 * k]), 27) * _P[0] + _P[3]
        p, rest = p + (rest // 8) * 8, rest % 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ ((w[p[on]] & U64(0xFFFFFFFF)) * _P[0]), 23) * _P[1] + _P[2]
        p, rest = p + (rest // 4) * 4, rest % 4
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _rotl(h[on] ^ ((w[p[on] + k] & U64(0xFF)) * _P[4]), 11) * _P[0]
        h ^= h >> U64(33)
        h *= _P[1]
        h ^= h >> U64(29)
        h *= _P[2]
        h ^= h >> U64(32)
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


# ---------------------------------------------------------------- components

def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component (edges given as index arrays)."""
    lab = np.arange(n)
    while len(u):
        a, b = lab[u], lab[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        on = lo != hi
        if not on.any():
            break
        u, v = u[on], v[on]
        np.minimum.at(lab, hi[on], lo[on])
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: the smallest node reachable.

    Alternating large-star and small-star rounds.  A node's minimum is a partially aggregated
    ``min`` and goes back to its edges by an equi-join that AQE can split, so no neighbourhood is ever
    gathered in one task.  Each round is checkpointed; null ends and self-loops are ignored.
    """
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .filter("a is not null and b is not null and a <> b").distinct())
    e = cut_lineage(e)
    last = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: the larger neighbours of a node point to its minimum
        e = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .filter("a <> b").distinct())
        # small star: a node and its smaller neighbours point to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                       F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
             .select("x.a", "x.b").filter("a <> b").distinct())
        e = cut_lineage(e)
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    roots = e.select(F.col("b").alias("a")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


# ---------------------------------------------------------------- schemas

def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types; extra columns and their names don't matter."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c
                                       for c, t in zip(columns, schema, strict=True)], schema=schema)

"""SimHash near-duplicates through vantage-point trees.

A 64-bit fingerprint's bit is set when over half of the text's shingle hashes (XXH64, seed 42) have it.
Equal fingerprints collapse to one node.  Fingerprints within b bits agree up to one bit in one of b // 2 + 1
blocks, so each block is a view of its own, searched with radius 1: whole 64-bit distances of unlike texts all lie near 32, which
gives a triangle bound little to prune, and blocks keep both the copies of a node and the comparisons few.

In each view a vantage-point tree, grown on a bounded sample, cuts the nodes into shards by Hamming distance.  A node is
owned by one shard, and goes as a query to the later shards that its ball overlaps (at most one a bit of the block).  Each
shard grows a local tree over its own points, descends it with all of its points and queries at once, dropping branches by
the triangle bound, compares whole fingerprints at the leaves, and emits a spanning forest (never the pairs of a group);
distributed star rounds join the shards' forests.

Edge cases: null or blank text has fingerprint zero and links like any other; a repeated doc_id gives one row a
row; a null doc_id keeps its fingerprint, and its component is the smallest non-null doc_id of it, if any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import connected_components, local_components, only, shingles, text_pieces, word_spans, xxh64

WIDTH = 4                 # words a shingle
MAX_BITS = 4              # linked at this many differing bits or fewer
SHARD_POINTS = 16_384     # own points of a shard, as planned
SAMPLE_PER_SHARD = 64     # sampled fingerprints for each shard of the top tree
MAX_SHARDS = 1 << 14      # bounds the sample (2^20 fingerprints) and the tree that every task gets
LEAF = 192                # own points of a local leaf
BLOCK = 1 << 22           # cells of one comparison block


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    body, starts, ends, row_first = word_spans(data, offsets)
    a, b, row = shingles(starts, ends, row_first, width)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if len(row) == 0:
        return out
    bits = np.unpackbits(xxh64(body, a, b).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    size = np.diff(np.concatenate([first, [len(row)]]))
    out[row[first]] = np.packbits(ones * 2 > size[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches):
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for a, b, data, offsets in text_pieces(batch.column("text")):
                fp[a:b] = text_fingerprints(data, offsets, width)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))], schema=out)

    return only(docs, doc_id="bigint", text="string").mapInArrow(compute, "doc_id bigint, fp bigint")


def _distance(x: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def _split(points: np.ndarray):
    """(vantage point, radius): inner points are at ``radius`` or nearer; None if nothing separates them."""
    v = points[0]
    d = _distance(points, v)
    r = int(np.median(d))
    if not (d > r).any():
        r = int(d.max()) - 1
    return (v, r) if r >= 0 and (d <= r).any() and (d > r).any() else None


def views(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of which one differs in a bit at most, if ``bits`` differ in all."""
    m = bits // 2 + 1
    edge = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def block(fp: np.ndarray, view: tuple[int, int]) -> np.ndarray:
    shift, width = view
    return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def top_tree(sample: np.ndarray, shards: int):
    """(vantage points, radii) of a heap-ordered tree: node k has children 2k+1 (inner) and 2k+2."""
    depth = max(0, int(np.ceil(np.log2(max(1, shards)))))
    points, radii = np.zeros(2 ** depth - 1, np.uint64), np.full(2 ** depth - 1, 64, np.int64)
    held = {0: sample}
    for k in range(len(points)):
        here = held.pop(k, np.zeros(0, np.uint64))
        cut = _split(here) if len(here) > 1 else None
        if cut:
            points[k], radii[k] = cut
        inner = _distance(here, points[k]) <= radii[k]
        held[2 * k + 1], held[2 * k + 2] = here[inner], here[~inner]
    return points, radii


def leaf_of(x: np.ndarray, tree) -> np.ndarray:
    points, radii = tree
    node = np.zeros(len(x), np.int64)
    for _ in range((len(points) + 1).bit_length() - 1):
        node = 2 * node + 1 + (_distance(x, points[node]) > radii[node])
    return node - len(points)


def route(x: np.ndarray, width: int, tree):
    """(leaf, row, own) of block values: each row's own leaf, and the later leaves that hold a value one bit away."""
    n = len(x)
    own = leaf_of(x, tree)
    leaf, rows = [own], [np.arange(n)]
    if len(tree[0]):
        size = len(tree[0]) + 1
        near = [(np.arange(n) * size + leaf_of(x ^ np.uint64(1 << k), tree)) for k in range(width)]
        cell = np.unique(np.concatenate(near))
        row, to = cell // size, cell % size
        on = to > own[row]
        leaf.append(to[on])
        rows.append(row[on])
    mine = np.concatenate([np.ones(n, bool), np.zeros(sum(map(len, rows)) - n, bool)])
    return np.concatenate(leaf), np.concatenate(rows), mine


def _leaf_edges(fp, idx, mine, bits):
    """Spanning edges (row, row) of the links between the leaf's own points and all of its points."""
    own = idx[mine]
    if not len(own):
        return []
    found_u, found_v = [], []
    step = max(1, BLOCK // max(1, len(own)))
    for a in range(0, len(idx), step):
        q = idx[a:a + step]
        i, j = np.nonzero(_distance(fp[q][:, None], fp[own][None, :]) <= bits)
        u, v = q[i], own[j]
        on = u != v
        if on.any():                                    # keep a spanning forest of the block only
            ids, inv = np.unique(np.concatenate([u[on], v[on]]), return_inverse=True)
            lab = local_components(len(ids), inv[:on.sum()], inv[on.sum():])
            star = np.flatnonzero(lab != np.arange(len(ids)))
            found_u.append(ids[star])
            found_v.append(ids[lab[star]])
    return list(zip(found_u, found_v, strict=True))


def shard_edges(fp: np.ndarray, own: np.ndarray, view: tuple[int, int], bits: int):
    """Spanning forest (u, v) of all links of a view that touch an own point, by a local vantage-point tree.

    Two points that a node separates meet because the inner one also goes outward as a query
    where the triangle bound allows; queries follow both sides wherever it allows.
    """
    us, vs = [], []
    x, reach = block(fp, view), 1
    work = [(np.arange(len(fp)), own.copy())]
    while work:
        idx, mine = work.pop()
        n_own = int(mine.sum())
        cut = _split(x[idx[mine]]) if n_own > LEAF else None
        if cut is None:
            for u, v in _leaf_edges(fp, idx, mine, bits):
                us.append(u)
                vs.append(v)
            continue
        v, r = cut
        d = _distance(x[idx], v).astype(np.int64)
        inner = d <= r
        go_in = inner | (~mine & (d - reach <= r))
        go_out = ~inner | (d + reach > r)
        work.append((idx[go_in], mine[go_in]))
        work.append((idx[go_out], mine[go_out] & ~inner[go_out]))
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    lab = local_components(len(fp), u, v)
    star = np.flatnonzero(lab != np.arange(len(fp)))
    return star, lab[star]


def linked_nodes(nodes: DataFrame, max_bits: int = MAX_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(node, component) of the distinct fingerprints ``nodes(fp)`` that have a link; both are fingerprints."""
    spark = nodes.sparkSession
    n = nodes.count()
    shards = min(MAX_SHARDS, 1 << max(0, int(np.ceil(np.log2(max(1, n / shard_points))))))
    want = shards * SAMPLE_PER_SHARD
    rate = min(1.0, 2 * want / max(1, n))
    key = F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 30))
    sample = nodes.filter(key < int(rate * (1 << 30)) + 1).select("fp").orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(want).toArrow()
    points = sample.column("fp").to_numpy().view(np.uint64)
    cuts = views(max_bits)
    shared = spark.sparkContext.broadcast([top_tree(block(points, v), shards) for v in cuts])
    routed_schema = pa.schema([("shard", pa.int32()), ("fp", pa.int64()), ("own", pa.bool_())])

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for k, v in enumerate(cuts):
                leaf, rows, own = route(block(fp.view(np.uint64), v), v[1], shared.value[k])
                yield pa.record_batch([pa.array((leaf * len(cuts) + k).astype(np.int32)), pa.array(fp[rows]), pa.array(own)], schema=routed_schema)

    def link(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        own = table.column("own").to_numpy(zero_copy_only=False)
        u, v = shard_edges(fp, own, cuts[key[0].as_py() % len(cuts)], max_bits)
        return pa.table({"a": pa.array(fp[u].view(np.int64)), "b": pa.array(fp[v].view(np.int64))})

    routed = nodes.select("fp").mapInArrow(deal, "shard int, fp bigint, own boolean")
    found = routed.groupBy("shard").applyInArrow(link, "a bigint, b bigint")     # ends are fingerprints
    return connected_components(found)


def near_groups(fps: DataFrame, max_bits: int = MAX_BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, fp, component_id) of ``fps(doc_id, fp)``: the component is its smallest doc_id.

    All rows of one fingerprint share a node; links are found between nodes only.
    """
    fps = cut_lineage(fps)
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    comp = linked_nodes(nodes, max_bits, shard_points)
    named = comp.join(nodes, comp["node"] == nodes["fp"]).select("fp", "component", nodes["node"].alias("low"))
    low = named.groupBy("component").agg(F.min("low").alias("low"))
    linked = named.select("fp", "component").join(low, "component").select("fp", F.col("low").alias("component_id"))
    by_node = (nodes.join(linked, "fp", "left")
               .select("fp", F.coalesce("component_id", "node").alias("component_id")))
    return fps.join(by_node, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every document."""
    got = near_groups(fingerprints(docs, width), max_bits)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group stays: the least by (doc_id, hash of the text, hash of the row), whatever rows repeat its id.
    Rows with a null doc_id are no copies of named ones; of those in a group one stays too."""
    columns = docs.columns
    text = F.col("text").cast("string")
    whole = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in columns])
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__th": F.xxhash64(text), "__rh": whole})
    out = pa.schema([(c, pa.int64()) for c in ("id", "th", "rh", "fp")])

    def compute(batches):
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for a, b, data, offsets in text_pieces(batch.column("text")):
                fp[a:b] = text_fingerprints(data, offsets, width)
            yield pa.record_batch([*batch.columns[:3], pa.array(fp.view(np.int64))], schema=out)

    rows = keyed.select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("__rh").alias("rh"), text.alias("text"))
    rows = rows.mapInArrow(compute, "id bigint, th bigint, rh bigint, fp bigint")
    equal = cut_lineage(rows.groupBy("fp", "id", "th", "rh").agg(F.count("*").alias("n")))
    least = cut_lineage(equal.groupBy("fp", F.isnull("id").alias("unnamed")).agg(F.min(F.struct("id", "th", "rh", "n")).alias("low")))
    comp = linked_nodes(cut_lineage(least.select("fp").distinct()), max_bits).select(F.col("node").alias("fp"), "component")
    least = least.join(comp, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component"), "unnamed").agg(F.min("low").alias("low"))
    stay = cut_lineage(least.select(F.col("component").alias("__component"), F.col("unnamed").alias("__unnamed"), F.coalesce("low.id", F.lit(0)).alias("__key"),
                                    F.col("low.th").alias("__th"), F.col("low.rh").alias("__rh"), F.col("low.n").alias("__n")))
    keyed = keyed.withColumns({"__unnamed": F.isnull("__id"), "__key": F.coalesce("__id", F.lit(0))})
    named = ["__unnamed", "__key", "__th", "__rh"]
    alone = keyed.join(stay.filter("__n = 1"), named).select(*[F.col(f"`{c}`") for c in columns])
    again = keyed.join(stay.filter("__n > 1"), named).dropDuplicates(["__component", "__unnamed"]).select(*[F.col(f"`{c}`") for c in columns])
    return alone.unionAll(again)

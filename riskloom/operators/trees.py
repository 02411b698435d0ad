"""Random forest for classification (H3-H5), grown level by level from histograms.

The rows are binned once (a byte a feature) and kept in checkpointed blocks.  For each level every task walks its blocks
through the trees as they are, counts each open node's drawn features by (bin, class) and sends one histogram per tree; the
histograms are added up by tree, where the best split of each node is found.  Only splits (a row a tree) reach the driver.
Bootstrap counts are hashes of (seed, block, row, tree): nothing is kept per row and tree.  Rules as MLlib's: Gini gain,
``sqrt`` features a node, at most ``max_bins`` bins, ``min_leaf`` rows a child, sibling leaves of one prediction merged.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 16_384                # rows walked at once
ROWS_PER_PARTITION = 1_000_000     # of binned rows: a byte a feature
DRAWS = 4                          # trees whose bootstrap counts come from one 64-bit hash
PURE = 2.0 ** -52
TOP = 4                            # steps by whole columns: at most 31 nodes
LEAF = 1 << 20                     # a cut above every bin
_GAMMA, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _poisson_table() -> np.ndarray:
    """Poisson(1) by 16 random bits."""
    p = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(p, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


POISSON = _poisson_table()


def bootstrap_counts(seed: int, block: int, n: int, group: int) -> np.ndarray:
    """(n, ``DRAWS``) Poisson(1) counts of a block's rows in the trees of a group."""
    start = np.random.SeedSequence([seed & 0xFFFFFFFF, block, group]).generate_state(1, np.uint64)[0]
    z = (np.arange(1, n + 1, dtype=np.uint64) * _GAMMA) + start
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return POISSON[(z ^ (z >> np.uint64(31))).view(np.uint16).reshape(n, DRAWS)]


def to_bins(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin b holds what is above cut b-1 and not above cut b; NaN comes last."""
    return np.searchsorted(cuts, values, side="left")


def find_cuts(train: DataFrame, cols: list, max_bins: int) -> list[np.ndarray]:
    """Cut points of every column: between all values where there are few, else quantiles of all rows; a value that holds
    several quantiles is a bin of its own."""
    def values(batches):
        seen = [np.zeros(0)] * len(cols)
        for batch in batches:
            for k, c in enumerate(batch.columns):
                if len(seen[k]) <= max_bins:
                    x = c.to_numpy(zero_copy_only=False)
                    seen[k] = np.unique(np.concatenate([seen[k], x[~np.isnan(x)]]))[:max_bins + 1]
        sizes = [len(s) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(cols), dtype=np.int32), sizes)), pa.array(np.concatenate(seen))], names=["f", "v"])

    doubles = train.select(*[F.col(c).cast("double").alias(c) for c in cols])
    some = cut_lineage(doubles.mapInArrow(values, "f int, v double").distinct())      # at most max_bins + 1 values a column and partition
    few = {r["f"] for r in some.groupBy("f").count().filter(F.col("count") <= max_bins).collect()}
    held: dict = {}
    for r in some.filter(F.col("f").isin(list(few))).collect() if few else ():
        held.setdefault(r["f"], []).append(r["v"])
    many = [k for k in range(len(cols)) if k not in few]
    probs = [i / max_bins for i in range(1, max_bins)]
    rows = doubles.agg(*[F.percentile_approx(F.nanvl(F.col(cols[k]), F.lit(None).cast("double")), probs, 10_000).alias(f"q{k}") for k in many]).first() if many else ()
    out = []
    for k in range(len(cols)):
        if k in few:
            v = np.sort(np.array(held.get(k, []), float))
            out.append(v[:-1] + (v[1:] - v[:-1]) / 2)
        else:
            q = rows[f"q{k}"]
            v, n = np.unique(np.array([] if q is None else q, float), return_counts=True)
            out.append(np.unique(np.concatenate([v, np.nextafter(v[n > 1], -np.inf)])))
    return out


def packed(train: DataFrame, cols: list, label: str, weight: str | None, cuts: list, parts: int) -> DataFrame:
    """Checkpointed blocks of binned rows: n, number, bins (a column after the other), labels, weights."""
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16

    def pack(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([to_bins(t.column(k).to_numpy(), c).astype(kind) for k, c in enumerate(cuts)])
            y = t.column(len(cuts)).to_numpy().astype(np.uint8)
            w = t.column(len(cuts) + 1).to_numpy().tobytes() if weight else b""
            return pa.RecordBatch.from_arrays([pa.array([t.num_rows], pa.int32()), pa.array([number], pa.int64()), *[pa.array([b], pa.binary()) for b in (x.tobytes(), y.tobytes(), w)]],
                                              names=["n", "number", "x", "y", "w"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(a, BLOCK_ROWS)
                if size + piece.num_rows > BLOCK_ROWS:
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(piece)
                size += piece.num_rows
        if held:
            yield block()

    rows = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in cols], F.col(label).cast("double").alias("_y"),
                        *([F.col(weight).cast("double").alias("_w")] if weight else []))
    return cut_lineage(rows.repartition(parts).mapInArrow(pack, "n int, number long, x binary, y binary, w binary"))


class Tree:
    """Nodes in the order they were made: feature, cut and left child (the right one is next); a leaf leads to itself."""

    def __init__(self, feature, cut, left, leaf, stats, gain):
        self.feature, self.cut, self.left, self.leaf, self.stats, self.gain = feature, cut, left, leaf, stats, gain

    @classmethod
    def root(cls, classes: int) -> "Tree":
        return cls(np.zeros(1, np.int64), np.full(1, LEAF, np.int64), np.zeros(1, np.int64), np.ones(1, bool), np.zeros((1, classes)), np.zeros(1))

    def grow(self, nodes, feature, cut, gain, low, high):
        """Split ``nodes``; returns the numbers of their left children."""
        first = len(self.left) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.gain[nodes], self.left[nodes], self.leaf[nodes] = feature, cut, gain, first, False
        n = 2 * len(nodes)
        new = len(self.left) + np.arange(n)
        self.feature, self.cut, self.left = np.append(self.feature, np.zeros(n, np.int64)), np.append(self.cut, np.full(n, LEAF)), np.append(self.left, new)
        self.leaf, self.gain = np.append(self.leaf, np.ones(n, bool)), np.append(self.gain, np.zeros(n))
        self.stats = np.concatenate([self.stats, np.stack([low, high], axis=1).reshape(n, -1)])
        return first

    def prune(self) -> "Tree":
        """Sibling leaves with the same prediction become one leaf."""
        says = self.stats.argmax(axis=1)
        for k in np.flatnonzero(~self.leaf)[::-1]:
            a, b = self.left[k], self.left[k] + 1
            if self.leaf[a] and self.leaf[b] and says[a] == says[b]:
                self.feature[k], self.cut[k], self.left[k], self.leaf[k], self.gain[k] = 0, LEAF, k, True, 0.0
        return self


def gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1.0 - (stats * stats).sum(axis=-1) / (total * total), 0.0)


def best_splits(counts, weights, chosen, base, bins, min_leaf: int):
    """(feature, cut, gain, left, right) of each node from its histograms; gain 0 where no split is allowed."""
    classes = counts.shape[1]
    most = int(bins.max())
    on = np.arange(most)[None, None, :] < bins[chosen][:, :, None]
    at = np.where(on, base[:, :, None] + np.arange(most), 0)
    n, w = (np.where(on[..., None], h[at], 0.0).cumsum(axis=2) for h in (counts, weights))
    rows, low = n.sum(axis=-1), w[:, :, :-1]
    high = w[:, :, -1:] - low
    whole = w[:, 0, -1]
    total = whole.sum(axis=-1)[:, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gini(whole)[:, None, None] - (low.sum(axis=-1) * gini(low) + high.sum(axis=-1) * gini(high)) / total
    fits = on[:, :, 1:] & (rows[:, :, :-1] >= min_leaf) & (rows[:, :, -1:] - rows[:, :, :-1] >= min_leaf)
    gain = np.where(fits, gain, 0.0).reshape(len(chosen), -1)
    best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(chosen), int)
    j, cut = np.divmod(best, max(1, most - 1))
    k = np.arange(len(chosen))
    return chosen[k, j], cut, gain[k, best] if gain.shape[1] else np.zeros(len(k)), low[k, j, cut] if most > 1 else whole, high[k, j, cut] if most > 1 else whole, whole, classes


class _Open:
    """What a level needs of a tree: the nodes to split, the features drawn for each, where their histograms lie."""

    def __init__(self, tree: Tree, number: int, nodes, bins, k: int, seed: int, level: int):
        self.tree, self.number, self.nodes = tree, number, nodes
        draw = np.random.default_rng([seed & 0xFFFFFFFF, number, level]).random((len(nodes), len(bins)))
        self.chosen = np.sort(draw.argsort(axis=1)[:, :k], axis=1)
        ends = bins[self.chosen].T.ravel().cumsum()          # a region for each place of a drawn feature
        self.base = (ends - bins[self.chosen].T.ravel()).reshape(k, -1).T
        self.parts = [0, *ends.reshape(k, -1)[:, -1].tolist()]
        self.size = self.parts[-1]
        self.slot = np.full(len(tree.left), -1, np.int64)
        self.slot[nodes] = np.arange(len(nodes))


def _top(tree: Tree, codes: np.ndarray, n: int, classes: int, depth: int, node: int = 0):
    """Node of every row after ``depth`` steps: whole columns compared, cheaper than a lookup a row while nodes are few."""
    if depth == 0 or tree.leaf[node]:
        return np.uint8(node)
    a, left = tree.feature[node] * n, tree.left[node]
    right = codes[a:a + n] > codes.dtype.type(tree.cut[node] * classes + classes - 1)
    low, high = (_top(tree, codes, n, classes, depth - 1, k) for k in (left, left + 1))
    return low ^ ((low ^ high) & (np.uint8(0) - right.view(np.uint8)))          # high where right, without a branch a row


def _walk(tree: Tree, steps: int, codes: np.ndarray, n: int, classes: int, rows: np.ndarray):
    """(rows, node) of the rows that aren't in a leaf before the last step; ``codes`` are bin * classes + class."""
    node = np.broadcast_to(_top(tree, codes, n, classes, min(steps, TOP)), n)[rows].astype(np.int64)
    start, last = tree.feature * n, tree.cut * classes + classes - 1
    for _ in range(TOP, steps):
        on = ~tree.leaf.take(node)
        if np.count_nonzero(on) < 0.9 * len(node):
            rows, node = rows[on], node[on]
        at = start.take(node)
        at += rows
        right = codes.take(at) > last.take(node)
        node = tree.left.take(node)
        node += right
    return rows, node


def _histogram(one: _Open, level: int, codes, n: int, w, counts, classes: int, out: np.ndarray) -> None:
    """Add a block to a tree's histograms; ``codes`` are bin * classes + class, a feature after the other."""
    rows, node = _walk(one.tree, level, codes, n, classes, np.flatnonzero(counts != 0))
    at = one.slot.take(node)
    if not (on := at >= 0).all():
        rows, at = rows[on], at[on]
    c = counts.take(rows).astype(float)
    for j in range(one.chosen.shape[1]):
        index = (one.chosen[:, j] * n).take(at)
        index += rows
        index = ((one.base[:, j] - one.parts[j]) * classes).take(at) + codes.take(index)
        a, b = one.parts[j] * classes, one.parts[j + 1] * classes
        out[0, a:b] += np.bincount(index, c, minlength=b - a)
        if w is not None:
            out[1, a:b] += np.bincount(index, c * w.take(rows), minlength=b - a)


SPLITS = "tree int, feature array<int>, cut array<int>, gain array<double>, low array<double>, high array<double>, whole array<double>"


def grow_forest(train: DataFrame, cols: list, label: str, weight: str | None, n_trees: int, max_depth: int, min_leaf: int, max_bins: int, seed: int) -> "ForestModel":
    spark = train.sparkSession
    y = F.col(label).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    odd = F.lit(False)
    for c in cols:
        odd = odd | F.coalesce(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(True))
    seen = train.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(w).alias("a"), F.max(w).alias("b"), F.count_if(odd).alias("odd")).limit(101).collect()
    if not seen or len(seen) > 100 or any(r["y"] is None or r["y"] != int(r["y"]) or not 0 <= r["y"] < 100 for r in seen):
        raise ValueError(f"{label!r} must hold whole class numbers from 0 (fewer than 100), in at least one row")
    if any(r["a"] is None or r["a"] < 0 for r in seen):
        raise ValueError(f"{weight!r} must not be negative or null")
    if any(r["odd"] for r in seen):
        raise ValueError(f"{sum(r['odd'] for r in seen)} rows with a null, NaN or infinite feature: the forest learns from numbers only")
    classes = max(2, 1 + max(int(r["y"]) for r in seen))
    per_class = np.ones(classes)                             # one weight a class needs no weights beside the rows
    for r in seen:
        per_class[int(r["y"])] = r["a"]
    by_row = any(r["a"] != r["b"] for r in seen)
    cuts = find_cuts(train, cols, max_bins)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(sum(r["n"] for r in seen) / ROWS_PER_PARTITION))
    blocks = packed(train, cols, label, weight if by_row else None, cuts, parts)
    bins = np.array([len(c) + 1 for c in cuts], np.int64)
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16
    wide = np.uint16 if int(bins.max()) * classes <= 65_536 else np.uint32     # of bin * classes + class
    k = math.ceil(math.sqrt(len(cols)))
    trees = [Tree.root(classes) for _ in range(n_trees)]
    nodes = [np.zeros(1, np.int64) for _ in trees]
    for level in range(max_depth):
        todo = {t: _Open(trees[t], t, nodes[t], bins, k, seed, level) for t in range(n_trees) if len(nodes[t])}
        if not todo:
            break
        shared = spark.sparkContext.broadcast(todo)

        def count(batches):
            here = []
            for b in batches:
                for r in b.to_pylist():
                    codes = np.frombuffer(r["x"], kind).reshape(len(cols), -1).astype(wide) * wide(classes) + np.frombuffer(r["y"], np.uint8)
                    here.append((r["n"], r["number"], codes.ravel(), np.frombuffer(r["w"]) if by_row else None))
            for g in range(0, n_trees, DRAWS):
                some = [shared.value[t] for t in range(g, min(g + DRAWS, n_trees)) if t in shared.value]
                hists = [np.zeros((1 + by_row, one.size * classes)) for one in some]
                for n, number, codes, weights in here if some else ():
                    drawn = bootstrap_counts(seed, number, n, g // DRAWS)
                    for one, out in zip(some, hists, strict=True):
                        _histogram(one, level, codes, n, weights, np.ascontiguousarray(drawn[:, one.number - g]), classes, out)
                for one, out in zip(some, hists, strict=True) if here else ():
                    yield pa.RecordBatch.from_arrays([pa.array([one.number], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["tree", "h"])

        def best(table):
            one = shared.value[table.column("tree")[0].as_py()]
            out = np.zeros((1 + by_row, one.size * classes))
            for h in table.column("h"):
                out += np.frombuffer(h.as_buffer()).reshape(out.shape)
            counts = out[0].reshape(-1, classes)
            weights = out[1].reshape(-1, classes) if by_row else counts * per_class
            feature, cut, gain, low, high, whole, _ = best_splits(counts, weights, one.chosen, one.base, bins, min_leaf)
            whole_numbers = [pa.array([v.tolist()], pa.list_(pa.int32())) for v in (feature, cut)]
            doubles = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (gain, low, high, whole)]
            return pa.Table.from_arrays([pa.array([one.number], pa.int32()), *whole_numbers, *doubles], names=["tree", "feature", "cut", "gain", "low", "high", "whole"])

        found = blocks.mapInArrow(count, "tree int, h binary").groupBy("tree").applyInArrow(best, SPLITS).collect()   # a row a tree
        shared.unpersist()
        nodes = [np.zeros(0, np.int64) for _ in trees]
        for r in found:
            t, tree = r["tree"], trees[r["tree"]]
            gain = np.array(r["gain"])
            low, high, whole = (np.array(r[c]).reshape(len(gain), classes) for c in ("low", "high", "whole"))
            if level == 0:
                tree.stats[0] = whole[0]
            on = gain > 0
            if not on.any():
                continue
            first = tree.grow(todo[t].nodes[on], np.array(r["feature"])[on], np.array(r["cut"])[on], gain[on], low[on], high[on])
            made = np.stack([first, first + 1], axis=1).ravel()
            nodes[t] = made[gini(tree.stats[made]) >= PURE]
    return ForestModel(list(cols), cuts, [t.prune() for t in trees])


class ForestModel(Model, MLWritable, MLReadable):
    """A grown forest: adds the vector ``probability``, the mean over trees of the leaves' class shares."""

    def __init__(self, feature_cols=(), cuts=(), trees=()):
        super().__init__()
        self.feature_cols, self.cuts, self.trees = list(feature_cols), list(cuts), list(trees)

    @property
    def featureImportances(self) -> DenseVector:             # noqa: N802 - as MLlib names it
        """Gain times weight over the splits of a feature, each tree normalised, the mean normalised again (H5)."""
        total = np.zeros(len(self.feature_cols))
        for t in self.trees:
            on = ~t.leaf
            own = np.bincount(t.feature[on], t.gain[on] * t.stats[on].sum(axis=1), minlength=len(total))
            total += own / own.sum() if own.sum() > 0 else 0.0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts = self.cuts
        trees = [(t, t.stats / np.maximum(t.stats.sum(axis=1, keepdims=True), 1e-300)) for t in self.trees]
        shared = dataset.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf("array<double>")
        def probability(*columns: pd.Series) -> pd.Series:
            n, total = len(columns[0]), 0.0
            x = np.concatenate([to_bins(c.to_numpy(dtype=float, na_value=np.nan), k) for c, k in zip(columns, cuts, strict=True)]).astype(np.uint16)
            for tree, share in shared.value:
                node = np.broadcast_to(_top(tree, x, n, 1, TOP), n).astype(np.int64)
                rows = np.flatnonzero(~tree.leaf.take(node))
                while len(rows):
                    at = node[rows]
                    at = tree.left.take(at) + (x.take(tree.feature.take(at) * n + rows) > tree.cut.take(at))
                    node[rows] = at
                    rows = rows[~tree.leaf.take(at)]
                total = total + share.take(node, axis=0)
            return pd.Series(list(total / total.sum(axis=1, keepdims=True)))

        return dataset.withColumn("probability", array_to_vector(probability(*[F.col(c).cast("double") for c in self.feature_cols])))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:                   # noqa: N802 - as MLlib names it
        m, spark = self.model, SparkSession.active()
        DefaultParamsWriter.saveMetadata(m, path, spark)
        spark.createDataFrame([(k, c, v.tolist()) for k, (c, v) in enumerate(zip(m.feature_cols, m.cuts, strict=True))], "number int, feature string, cuts array<double>").write.parquet(f"{path}/features")
        spark.createDataFrame([(k, t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.leaf.tolist(), t.stats.tolist(), t.gain.tolist()) for k, t in enumerate(m.trees)],
                              "number int, feature array<long>, cut array<long>, left array<long>, leaf array<boolean>, stats array<array<double>>, gain array<double>").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        features = spark.read.parquet(f"{path}/features").orderBy("number").collect()
        trees = spark.read.parquet(f"{path}/trees").orderBy("number").collect()
        model = ForestModel([r["feature"] for r in features], [np.array(r["cuts"], float) for r in features],
                            [Tree(*(np.array(r[c], np.int64) for c in ("feature", "cut", "left")), np.array(r["leaf"], bool), np.array(r["stats"], float), np.array(r["gain"], float)) for r in trees])
        return model._resetUid(metadata["uid"])

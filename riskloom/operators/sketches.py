"""Sketches that keep work out of shuffles, or that are stored and merged instead of scanning again.

* ``Bloom``: which rows can't match a key set, decided without a shuffle (C2, C3, E2).
* ``distinct_sketches`` / ``quantile_sketches``: HLL and KLL sketches per group, written once and united on read (C7, D1, H10).
* ``top_values``: the most frequent values; hashed counts rule out all but a few before anything is counted by value (D21).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS_PER_KEY = 10          # about 1 % of foreign keys pass with three hashes
MAX_WORDS = 1 << 20        # of 64 bits: a filter of 8 MB at most; beyond that more foreign keys pass
HASHES = 3


def row_digest(columns) -> dict:
    """Columns _hi, _lo: a 128-bit digest of a row; nulls are told apart by their place."""
    columns = list(columns)
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return {f"_{n}": F.xxhash64(F.lit(k), nulls, *columns) for k, n in enumerate(["hi", "lo"])}


class Bloom:
    """A Bloom filter of some key columns' values, as a one-row frame with an array of 64-bit words."""

    def __init__(self, words: DataFrame, n_words: int, columns):
        self.words, self.n_words, self.columns = words, n_words, list(columns)

    @classmethod
    def of(cls, keys: DataFrame, columns) -> Bloom | None:
        """Built by one aggregate over the (distinct) keys; None without keys."""
        n = keys.count()
        if not n:
            return None
        n_words = min(MAX_WORDS, 1 << max(4, math.ceil(math.log2(n * BITS_PER_KEY / 64 + 1))))
        bit = F.explode(F.array(*cls._bits(columns, n_words)))
        zero = keys.sparkSession.range(n_words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
        held = keys.select(bit.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))).alias("b"))
        words = held.unionAll(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
        one = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("_bloom"))      # at most MAX_WORDS
        return cls(cut_lineage(one), n_words, columns)

    @staticmethod
    def _bits(columns, n_words: int) -> list:
        return [F.pmod(F.xxhash64(F.lit(100 + k), *columns), F.lit(n_words * 64)) for k in range(HASHES)]

    def mark(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the flag ``out``: false if its key is certainly not in the set (null keys never are)."""
        hit = F.lit(True)
        for p in self._bits(self.columns, self.n_words):
            hit = hit & (F.getbit(F.get("_bloom", F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
        for c in self.columns:
            hit = F.col(c).isNotNull() & hit
        return df.crossJoin(F.broadcast(self.words)).withColumn(out, hit).drop("_bloom")                                     # one row


# ---------------------------------------------------------------- stored sketches

LG_K = 14                  # HLL: 2^14 registers, a standard error of 0.65 %
KLL_K = 400                # KLL: a rank error of about 1 %


def distinct_sketches(df: DataFrame, columns, by=(), lg_k: int = LG_K) -> DataFrame:
    """(by, column, sketch): an HLL sketch of each column's values in each group; union them with ``distinct_estimates``."""
    wide = df.groupBy(*by).agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(f"_s{k}") for k, c in enumerate(columns)])
    return _long(wide, by, columns)


def _long(wide: DataFrame, by, columns) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{k}").alias("sketch")) for k, c in enumerate(columns)])
    return wide.select(*by, F.explode(items).alias("_x")).select(*by, "_x.*")


def distinct_estimates(sketches: DataFrame, by=()) -> DataFrame:
    """(by, column, n_distinct): the estimates of united sketches; any groups written apart may be united."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def quantile_sketches(df: DataFrame, columns, by=(), k: int = KLL_K) -> DataFrame:
    """(by, column, sketch): a KLL sketch of each column's non-missing values in each group (``quantile_estimates`` merges them)."""
    x = {c: F.col(c).cast("double") for c in columns}
    wide = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(x[c]), x[c]), F.lit(k)).alias(f"_s{i}") for i, c in enumerate(columns)])
    return _long(wide, by, columns).filter("sketch is not null")


def quantile_estimates(sketches: DataFrame, probs, by=()) -> DataFrame:
    """(by, column, prob, quantile) of merged sketches."""
    probs = [float(p) for p in probs]
    got = sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch").alias("s")).filter(F.kll_sketch_get_n_double("s") > 0)
    values = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(p) for p in probs]))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), values.alias("quantile"))
    return got.select(*by, "column", F.explode(pairs).alias("_x")).select(*by, "column", F.col("_x.prob").alias("prob"), F.col("_x.quantile").alias("quantile"))


# ---------------------------------------------------------------- frequent values

CELLS = 1 << 16            # hashed counts: the rows of the first shuffle, whatever the number of values


def top_values(df: DataFrame, column: str, n: int, out: str = "count") -> DataFrame:
    """(column, out): exactly the ``n`` most frequent values (ties by value; null counts as one).

    A hash cell's count bounds the count of each value in it.  The values of the largest cells are counted first; the n-th largest count
    found is a floor, and only values in cells that reach it are counted at all.  Where all values are about equally frequent that
    rules out little, and the counts cost what they would have."""
    cell = F.pmod(F.xxhash64(column), F.lit(CELLS)).cast("int").alias("_cell")
    rows = df.select(column, cell)
    cells = cut_lineage(rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")))
    counts = lambda on: rows.join(F.broadcast(on.select("_cell")), "_cell").groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias(out))
    first = counts(cells.orderBy(F.desc("_n"), "_cell").limit(2 * n)).orderBy(F.desc(out)).limit(n).collect()
    floor = first[-1][out] if len(first) == n else 1
    return counts(cells.filter(F.col("_n") >= floor)).orderBy(F.desc(out), column).limit(n)

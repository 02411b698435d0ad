"""Document fingerprints: the k smallest distinct hashes of a text's word shingles (bottom-k sketch).

Sketches merge (the k smallest of a union) and estimate resemblance, containment and the number of
distinct shingles.  A text with fewer than k shingles has an exact sketch.

Edge cases: null text is empty; an empty or blank text has the empty sketch, which is like another empty one (1.0) and
unlike any other (0.0); equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, only, shingles, text_pieces, word_spans, xxh64

WIDTH = 5                  # words a shingle
K = 128                    # hashes a sketch
ROWS_PER_RANGE = 2_000     # documents of an id range, as planned
MAX_RANGES = 10_000        # bounds the cut points that the driver holds
_LAST = (1 << 63) - 1


def piece_sketches(data: np.ndarray, offsets: np.ndarray, k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    body, starts, ends, row_first = word_spans(data, offsets)
    a, b, row = shingles(starts, ends, row_first, width)
    h = xxh64(body, a, b)
    at = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        x = h[at[i]:at[i + 1]]
        if len(x) > 8 * k:                       # the k smallest distinct ones are among the smallest few k, copies aside
            small = np.unique(np.partition(x, 4 * k)[:4 * k])
            x = small if len(small) >= k else np.unique(x)
        else:
            x = np.unique(x)
        out.append(x[:k])
    return out


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's k smallest that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    first = np.concatenate([[True], both[1:] != both[:-1]])
    n = min(k, int(first.sum()))
    limit = both[first][n - 1]
    return float((twice & (both <= limit)).sum()) / n


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles behind a sketch (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, k=k), k)
    return min(1.0, resemblance(a, b, k) * union / max(1.0, distinct_count(a, k)))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, sketch): the sorted hashes, sign bit flipped so that signed order is theirs."""
    out = pa.schema([("doc_id", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("text")):
                got = [(x ^ np.uint64(1 << 63)).view(np.int64) for x in piece_sketches(data, offsets, k, width)]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(got, pa.list_(pa.int64()))], schema=out)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, sketch array<bigint>")


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """One sketch per ``key`` of ``parts(key, sketch)``: hashes are made distinct with partial aggregation and the k
    smallest taken with Spark's partial window limit, so a hot key never meets in one task whole."""
    h = parts.select(key, F.explode("sketch").alias("h")).distinct()
    top = h.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("r") <= k)
    return top.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def _ranges(ids: DataFrame):
    """(cut points, [(first id of a range, range before it)]) of ``ids(id)``: the driver holds a row a range."""
    n = ids.count()
    m = int(min(MAX_RANGES, max(1, -(-n // ROWS_PER_RANGE))))
    cuts = ids.agg(F.percentile_approx("id", [x / m for x in range(1, m)], 100 * m)).first()[0] if m > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    part = _range_of(cuts)
    firsts = sorted((r["p"], r["id"]) for r in ids.groupBy(part("id").alias("p")).agg(F.min("id").alias("id")).collect())
    before = [firsts[k - 1][0] for k in range(len(firsts))]      # the first one comes after the last
    return cuts, [(x[1], p) for x, p in zip(firsts, before, strict=True)]


def _range_of(cuts: np.ndarray):
    @F.pandas_udf("int")
    def part(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))
    return part


def with_edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text ends in the first code points of the next document (ascending doc_id, ties by text, null ids last;
    after the last comes the first).  Ids are cut into ranges, each range is sorted in one partition, and a copy of the next
    range's first row closes it, so the texts are shuffled once and no window spans the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(_LAST)))
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    cuts, firsts = _ranges(rows.select("id"))
    if not firsts:
        return spark.createDataFrame([], schema)
    ahead = F.broadcast(spark.createDataFrame(firsts, "id bigint, before int"))        # a row a range
    part = _range_of(cuts)
    own = F.struct(F.col("part"), F.lit(0).alias("ahead"))
    more = F.struct(F.col("before").alias("part"), F.lit(1).alias("ahead"))
    dealt = (rows.withColumn("part", part("id")).join(ahead, "id", "left")
             .withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, more))))
             .select("to.part", "to.ahead", "id", "doc_id", "text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(max(n, len(firsts)), "part").sortWithinPartitions("part", "ahead", "id", "text")
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def sketch_all(texts):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        return piece_sketches(np.frombuffer(b"".join(raw), np.uint8), offsets, k, width)

    def flush(held):
        """Rows of ``held`` but the last, each with the row after it."""
        texts = [r[3] for r in held]
        own_s = sketch_all(texts)
        pick = [i for i in range(len(held) - 1) if held[i][1] == 0 and held[i][0] == held[i + 1][0]]
        edited = []
        for i in pick:
            t = texts[i]
            m = len(t) // 4
            edited.append(t[:len(t) - m] + texts[i + 1][:m])
        ed_s = sketch_all(edited)
        return pa.record_batch([
            pa.array([held[i][2] for i in pick], pa.int64()), pa.array([len(texts[i]) for i in pick], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([encode(own_s[i]) for i in pick], pa.string()), pa.array([encode(x) for x in ed_s], pa.string()),
            pa.array([resemblance(own_s[i], x, k) for i, x in zip(pick, ed_s, strict=True)], pa.float64()),
            pa.array([resemblance(own_s[i], own_s[i + 1], k) for i in pick], pa.float64())], schema=out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [batch.column(c) for c in ("part", "ahead", "doc_id", "text")]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in cols)
                held.append(row)
                size += len(row[3])
                if size >= PIECE_BYTES and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield flush(held)

    return dealt.mapInArrow(run, schema)

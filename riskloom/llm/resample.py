"""Importance resampling towards a target distribution, over hashed word features.

Words come from an untrained ``Split`` pre-tokeniser of the ``tokenizers`` library over the A-Z lower-cased text, as byte
offset pairs.  A feature is a window of 1 to ``max_words`` consecutive pairs; the CRC-32 of its bytes (words single-spaced) names a
bucket.  Two histograms, one of all raw documents and one of all target texts, give each bucket an integer gain (the smoothed
log-ratio in thousandths); a document's weight is the sum of its features' gains, and a Gumbel draw keyed by its id turns
the weights into a weighted sample without replacement.

The texts are tokenised once: the features' bucket numbers (2 or 4 bytes each) are checkpointed, and both the histogram and the weights
are read from them.  The gain table is bounded by the number of buckets.  Ranks come from a range-partitioned sort whose
partitions are numbered by their totals, so no task holds more than a partition.

Edge cases: null and empty texts have no feature and weight 0; a null doc_id draws with the empty text as its id and ties
after all others; rows that repeat an id (or an id and a text) are separate documents with one draw, so they score alike for equal texts and
take ranks one after the other; an empty target gives every bucket's gain against T = 0; without eligible documents nothing is drawn.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from ..session import cut_lineage
from .common import only, text_pieces

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # after lower-casing: 0-9, a-z and everything beyond ASCII
BUCKETS = 10_000
MAX_WORDS = 1              # longest feature, in words
MIN_WORDS = 20             # shorter documents are weighed, but not drawn
PERCENT = 10               # of the eligible documents are drawn
SEED = "2024"
WINDOW = 1 << 18           # bytes that the pre-tokeniser sees at once (more if one word is longer)
ACCURACY = 10_000          # of the approximate quantile that spares the sort most documents
LONG_FEATURE = 64          # longer features are hashed one by one


@functools.cache
def _splitter():
    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


@functools.cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte ranges at once."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")            # the ranges that still have bytes are a prefix
    size, at = size[order], starts[order]
    c = np.full(len(size), 0xFFFFFFFF, np.uint32)
    table = _crc_table()
    n_long = int(np.searchsorted(-size, -LONG_FEATURE, side="left"))
    for k in range(int(size[n_long]) if n_long < len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        c[n_long:n] = (c[n_long:n] >> np.uint32(8)) ^ table[(c[n_long:n] ^ data[at[n_long:n] + k]) & np.uint32(255)]
    c ^= np.uint32(0xFFFFFFFF)
    view = memoryview(np.ascontiguousarray(data))
    for k in range(n_long):
        c[k] = zlib.crc32(view[at[k]:at[k] + size[k]])
    out = np.empty_like(c)
    out[order] = c
    return out


def _word_bytes() -> np.ndarray:
    b = np.arange(256)
    return (b >= 0x80) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122))


def _windows(low: np.ndarray):
    """Byte ranges of one text, each at most ``WINDOW`` long unless a single word is longer; they part outside words."""
    a, n = 0, len(low)
    while n - a > WINDOW:
        gap = np.flatnonzero(~_word_bytes()[low[a:a + WINDOW]])
        if len(gap):
            b = a + int(gap[-1]) + 1
        else:
            rest = np.flatnonzero(~_word_bytes()[low[a + WINDOW:]])
            b = a + WINDOW + int(rest[0]) + 1 if len(rest) else n
        yield a, b
        a = b
    if a < n:
        yield a, n


def word_offsets(low: np.ndarray) -> np.ndarray:
    """(words, 2) byte offsets of the words of one A-Z lower-cased text."""
    got = []
    for a, b in _windows(low):
        text = PreTokenizedString(low[a:b].tobytes().decode("utf-8", "replace"))
        _splitter().pre_tokenize(text)
        pairs = [s[1] for s in text.get_splits("original", "byte")]
        if pairs:
            got.append(np.array(pairs, np.int64) + a)
    return np.concatenate(got) if got else np.zeros((0, 2), np.int64)


def features(data: np.ndarray, offsets: np.ndarray, max_words: int = MAX_WORDS):
    """(bytes, starts, ends, row, words per row) of a piece's features: windows over the rows' offset pairs."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    each = [word_offsets(low[a:b]) + a for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    count = np.array([len(x) for x in each], np.int64)
    pairs = np.concatenate(each) if each else np.zeros((0, 2), np.int64)
    row = np.repeat(np.arange(len(each)), count)
    if max_words == 1:
        return low, pairs[:, 0], pairs[:, 1], row, count
    size = pairs[:, 1] - pairs[:, 0]
    starts = np.concatenate([[0], np.cumsum(size + 1)])[:-1]                 # laid out again, one space apart
    body = np.full(int((size + 1).sum()), 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    body[np.repeat(starts, size) + within] = low[np.repeat(pairs[:, 0], size) + within]
    a, b, r = [], [], []
    for n in range(1, max_words + 1):
        same = row[n - 1:] == row[:len(row) - n + 1]
        a.append(starts[:len(row) - n + 1][same])
        b.append((starts + size)[n - 1:][same])
        r.append(row[n - 1:][same])
    r = np.concatenate(r)
    order = np.argsort(r, kind="stable")
    return body, np.concatenate(a)[order], np.concatenate(b)[order], r[order], count


def hashed(docs: DataFrame, key: str | None, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, found) of ``docs(key, text)``: ``found`` packs the features' bucket numbers."""
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")
    rows = only(docs, **{key: "bigint", "text": "string"}) if key else only(docs, text="string").withColumn("key", F.lit(None).cast("bigint"))
    out = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("found", pa.binary())])

    def run(batches):
        for batch in batches:
            keys = batch.column(key or "key")
            for a, b, data, offsets in text_pieces(batch.column("text")):
                body, starts, ends, row, words = features(data, offsets, max_words)
                found = (crc32(body, starts, ends) % np.uint32(buckets)).astype(width)
                n = np.bincount(row, minlength=b - a)
                edge = np.concatenate([[0], np.cumsum(n)])
                yield pa.record_batch([keys.slice(a, b - a), pa.array(words), pa.array(n.astype(np.int64)),
                                       pa.array([found[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], schema=out)

    return rows.mapInArrow(run, "key bigint, n_words bigint, n_features bigint, found binary")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows: one partial histogram a task, summed by bucket."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("found"):
                held += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=buckets)
        on = np.flatnonzero(held)
        yield pa.record_batch([pa.array(on.astype(np.int32)), pa.array(held[on])], names=["bucket", "n"])

    got = found.select("found").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(((t + 1)(S + n)) / ((s + 1)(T + n)))) of the two histograms."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _draw_of(key: str, seed: str):
    """The Gumbel part of a score, in thousandths, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weigh(found: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row of ``hashed``."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            weight = [int(gain[np.frombuffer(x.as_buffer(), width)].sum()) for x in batch.column("found")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    got = found.mapInArrow(run, "key bigint, n_words bigint, n_features bigint, weight bigint")
    return got.withColumn("score", F.col("weight") + _draw_of("key", seed))


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N eligible rows."""
    base = cut_lineage(weighed.withColumn("_row", F.monotonically_increasing_id()))     # frozen: tells equal rows apart
    able = F.col("n_words") >= min_words
    # an approximate quantile, lowered by twice its rank error, spares most rows the sort and drops none that is drawn
    low = max(0.0, 1.0 - percent / 100 - 2.0 / ACCURACY)
    n, cut = base.agg(F.count_if(able), F.percentile_approx(F.when(able, F.col("score")), low, ACCURACY)).first()
    wanted = n * percent // 100
    near = F.coalesce(able & (F.col("score") >= F.lit(cut if cut is not None else 0)), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("_row")]
    ranked = cut_lineage(base.filter(near).repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_seq", F.monotonically_increasing_id()))          # partition in the high bits, place in the low 33
    part = F.shiftright("_seq", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)         # a row a partition
    starts = (ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    place = F.col("_start") + F.col("_seq").bitwiseAND((1 << 33) - 1) + 1
    top = (ranked.withColumn("_part", part).join(F.broadcast(starts), "_part")
           .withColumn("rank", F.when(place <= wanted, place)).drop("_part", "_start", "_seq"))
    return top.unionByName(base.filter(~near).withColumn("rank", F.lit(None).cast("bigint"))).drop("_row")


def resample(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs(doc_id, text)``, drawn towards ``target(text)``."""
    found = cut_lineage(hashed(docs, "doc_id", max_words, buckets))
    gain = gains(histogram(found, buckets), histogram(hashed(target, None, max_words, buckets), buckets))
    got = draw(weigh(found, gain, seed), percent, min_words)
    return got.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")

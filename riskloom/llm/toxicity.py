"""Toxicity by multiple-instance learning: sentence probabilities combined by noisy-or.

A document is toxic if any sentence is: P = 1 - prod(1 - p_s), p_s = sigmoid(bias + sum of its words' weights).
Only document labels train the weights (hashed words, full-batch Adagrad with an L1 pull; weights are not negative, so
no harmless word hides a toxic one), on a bounded sample of labelled rows, whole texts of any length; the fitted p_s then point to the
offending sentences.

Edge cases: null and empty texts have no sentence and score 0; a repeated label row counts once, as toxic if
any is; a doc_id that repeats with several texts has no label of its own and doesn't train (equal rows train once); null labels
and null ids don't train; long texts train and are scored whole; without a label of each kind every score is the label mean (0 if none);
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import only, text_pieces, xxh64

BITS = 18                  # hashed words
SAMPLE_PER_CLASS = 3000    # labelled documents used for training, of each label
TRAIN_BYTES = 16_000_000   # text of one label's sample: the rest of the sample is left out once it is reached
MIN_DOCS = 10              # words in fewer training documents have no weight
EPOCHS = 200
RATE, L1, BIAS = 1.0, 1e-5, -8.0
THRESHOLD = 0.3


def sentences(data: np.ndarray, offsets: np.ndarray):
    """(word bucket, sentence of each word, row of each sentence, start, stop) of a piece."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    begins = np.flatnonzero(letter & (first | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & np.concatenate([~letter[1:] | first[1:], [True]])) + 1 if n else begins
    if not len(begins):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    bucket = (xxh64(low, begins, ends, 7) >> np.uint64(64 - BITS)).astype(np.int64)
    stop = (low == 46) | (low == 33) | (low == 63) | (low == 10)
    breaks = np.concatenate([[0], np.cumsum(stop)])
    row = np.searchsorted(offsets, begins, side="right") - 1
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (breaks[begins[1:]] > breaks[ends[:-1]])])
    sent = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(begins)]]) - 1
    base = offsets[row[head]]
    return bucket, sent, row[head], begins[head] - base, ends[tail] - base


def _softplus(z):
    return np.logaddexp(0.0, z)


def _train(bucket, sent, doc, y, weight):
    """Weights of the noisy-or model: words -> sentences -> documents."""
    pairs = np.unique(doc[sent].astype(np.int64) << BITS | bucket)
    on = np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= MIN_DOCS
    bucket, sent = bucket[on[bucket]], sent[on[bucket]]
    w = np.zeros(1 << BITS)
    b, gw, gb = BIAS, np.full(1 << BITS, 1e-8), 1e-8
    n_s, n_d = len(doc), len(y)
    for _ in range(EPOCHS):
        z = b + np.bincount(sent, weights=w[bucket], minlength=n_s)
        s = np.bincount(doc, weights=_softplus(z), minlength=n_d)
        s = np.maximum(s, 1e-12)
        d_s = weight * (1.0 - y / -np.expm1(-s))
        d_z = d_s[doc] / (1.0 + np.exp(-z))
        g = np.bincount(bucket, weights=d_z[sent], minlength=1 << BITS)
        gw += g * g
        step = RATE / np.sqrt(gw)
        w = np.clip(w - step * g - step * L1, 0.0, 12.0)
        gd = d_z.sum()
        gb += gd * gd
        b -= 0.1 * gd / np.sqrt(gb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Train on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``: at most ``per_class`` documents of each label,
    those with the smallest md5 of doc_id, and of these so many as ``TRAIN_BYTES`` hold (one at least).  Class weights restore the labels' own shares."""
    lab = (only(labels, doc_id="bigint", toxic="int").filter("doc_id is not null and toxic is not null")
           .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    mean = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return {"mean": mean, "w": None, "b": 0.0}
    key = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)
    cut = F.lit("")
    for c, n in counts.items():
        cut = F.when(F.col("toxic") == c, F.lit(f"{int(min(1.0, per_class / n) * 0xFFFFFFFF):08x}")).otherwise(cut)
    chosen = lab.filter(key <= cut)                    # about per_class rows a label, so its broadcast is bounded
    rows = only(docs, doc_id="bigint", text="string").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = cut_lineage(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"), F.max("text").alias("other"))
                       .filter("text = other").drop("other"))                                                              # a row an id: bounded
    size = F.octet_length("text")
    upto = F.sum(size).over(Window.partitionBy("toxic").orderBy(key, "doc_id").rowsBetween(Window.unboundedPreceding, 0))   # about per_class rows
    held = rows.select("doc_id", (upto - size < TRAIN_BYTES).alias("fits")).filter("fits").select("doc_id")
    rows = rows.join(F.broadcast(held), "doc_id")
    out = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("buckets", pa.list_(pa.int32())), ("sents", pa.list_(pa.int32()))])

    def words(batches):
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("text")):
                bucket, sent, row, _, _ = sentences(data, offsets)
                at = np.searchsorted(row[sent], np.arange(b - a + 1)) if len(sent) else np.zeros(b - a + 1, np.int64)
                first = np.searchsorted(row, np.arange(b - a))
                yield pa.record_batch([
                    batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a).cast(pa.int32()),
                    pa.array([bucket[at[k]:at[k + 1]] for k in range(b - a)], pa.list_(pa.int32())),
                    pa.array([sent[at[k]:at[k + 1]] - first[k] for k in range(b - a)], pa.list_(pa.int32()))], schema=out)

    got = rows.mapInArrow(words, "doc_id bigint, toxic int, buckets array<int>, sents array<int>").orderBy("doc_id").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    bl = got.column("buckets").combine_chunks()
    sl = got.column("sents").combine_chunks()
    size = np.diff(bl.offsets.to_numpy())
    bucket, local = bl.flatten().to_numpy(), sl.flatten().to_numpy()
    if not len(bucket) or len(set(y.tolist())) < 2:
        return {"mean": mean, "w": None, "b": 0.0}
    # words kept as presence per sentence; sentences numbered over all documents
    doc_of = np.repeat(np.arange(len(y)), size)
    _, sent = np.unique(doc_of * (int(local.max()) + 1) + local, return_inverse=True)
    cell = np.unique(sent.astype(np.int64) << BITS | bucket)
    sent_u, bucket_u = cell >> BITS, cell & ((1 << BITS) - 1)
    doc = np.zeros(int(sent.max()) + 1, np.int64)
    doc[sent] = doc_of
    share = np.where(y == 1, mean, 1 - mean) / np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
    w, b = _train(bucket_u, sent_u, doc, y, share)
    return {"mean": mean, "w": w.astype(np.float32), "b": float(b)}


def _sentence_scores(model, data, offsets):
    bucket, sent, row, start, stop = sentences(data, offsets)
    if not len(bucket):
        return np.zeros(0), row, start, stop
    z = np.bincount(sent, weights=model["w"][bucket], minlength=len(row)) + model["b"]
    return z, row, start, stop


_SPOT = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of ``docs(doc_id, text)``."""
    return score_and_locate(docs, model, threshold).drop("offending")


def score_and_locate(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, offending) of ``docs(doc_id, text)``; ``offending``: the sentences (UTF-8 byte offsets) whose own
    probability reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(_SPOT))])

    def run(batches):
        m = shared.value
        for batch in batches:
            p = np.full(batch.num_rows, m["mean"])
            spots, held = [], np.zeros(batch.num_rows, np.int64)
            if m["w"] is not None:
                for a, b, data, offsets in text_pieces(batch.column("text")):
                    z, row, start, stop = _sentence_scores(m, data, offsets)
                    p[a:b] = -np.expm1(-np.bincount(row, weights=_softplus(z), minlength=b - a))
                    own = 1.0 / (1.0 + np.exp(-z))
                    on = np.flatnonzero(own >= threshold)
                    held[a:b] = np.bincount(row[on], minlength=b - a)
                    spots.append(pa.StructArray.from_arrays([pa.array(start[on], pa.int64()), pa.array(stop[on], pa.int64()), pa.array(own[on])], fields=list(_SPOT)))
            edge = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                                   pa.ListArray.from_arrays(edge, pa.concat_arrays([pa.array([], _SPOT), *spots]))], schema=out)

    return only(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, score double, predicted int, offending array<struct<start:bigint,stop:bigint,score:double>>")


def offending(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, stop, score): one row a sentence whose own probability reaches the threshold."""
    return score_and_locate(docs, model, threshold).select("doc_id", F.explode("offending").alias("x")).select("doc_id", "x.*")

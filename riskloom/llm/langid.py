"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language on the executors (partial ``sum`` per (language,
bucket)); the smoothed log-probability matrix (``buckets`` x languages) is broadcast in blocks of ``BLOCK_LANGS`` languages
(16 MB each), and batches are scored in NumPy by summing the matrix rows of the n-grams that occur, block by block with a
running log-sum-exp.  Every language of the labels is learned; their number is that of the blocks.

Edge cases: a null text or one without a letter (Unicode category L) gets ``und`` and score 0; a text whose letters form no
n-gram seen in training is scored by the priors; with no labelled row at all every text is ``und``; ties go to the language whose
name comes first; rows that repeat an id train and are scored as rows of their own, and a null id doesn't train; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import only, text_pieces

BUCKETS = 1 << 15          # hashed n-grams
ORDERS = (1, 2, 3)         # n-gram lengths in characters
SAMPLE_PER_LANG = 3000     # labelled rows used for training, per language (smallest md5 of doc_id)
BLOCK_LANGS = 64           # languages of one block of the matrix
UND = "und"

_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket, row) of every character n-gram of a piece; characters are lower-cased code points."""
    low = data.tobytes().decode("utf-8", "replace").lower()
    start = (data & 0xC0) != 0x80
    if len(low) != int(start.sum()):                 # lower-casing changed a length: row by row
        rows = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.array([len(r) for r in rows], np.int64)
        low = "".join(rows)
    else:
        sizes = np.diff(np.concatenate([[0], np.cumsum(start)])[offsets])
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    out, rows = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[:len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1:] * np.uint32(0x9E3779B1))
        if n in ORDERS and len(h):
            x = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            x = ((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            same = row[:len(c) - n + 1] == row[n - 1:]
            out.append(x[same].astype(np.int32))
            rows.append(row[:len(c) - n + 1][same])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(rows)


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict:
    """Train on ``docs(doc_id, text, lang)``: at most ``per_lang`` labelled rows a language, those with the
    smallest md5 of doc_id.  Rows with null text or lang don't train."""
    rows = only(docs, doc_id="bigint", text="string", lang="string").filter("lang is not null and text is not null")
    key = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)
    # the cut-off key of each language comes from an aggregate over all labelled rows, not from a sort in one task
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count("*").alias("n")))
    counts = sizes.orderBy("lang").collect()                 # a row a language
    if not counts:
        return {"langs": [], "logp": [], "prior": np.zeros(0)}
    langs = sorted(r["lang"] for r in counts)
    total = sum(r["n"] for r in counts)
    prior = {r["lang"]: np.log(r["n"] / total) for r in counts}
    at = {lang: k for k, lang in enumerate(langs)}
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    cut = F.lpad(F.lower(F.hex(F.floor(share * F.lit(float(0xFFFFFFFF))).cast("bigint"))), 8, "0")
    chosen = rows.join(F.broadcast(sizes.select("lang", cut.alias("cut"))), "lang").filter(key <= F.col("cut"))       # a row a language
    out = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            code = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b, data, offsets in text_pieces(batch.column("text")):
                bucket, row = _grams(data, offsets)
                cell, n = np.unique(code[a:b][row] * BUCKETS + bucket, return_counts=True)
                yield pa.record_batch([pa.array((cell // BUCKETS).astype(np.int32)),
                                       pa.array((cell % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], schema=out)

    cells = (chosen.select("lang", "text").mapInArrow(count, "lang int, bucket int, n bigint")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    lang, bucket, n = (cells.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    blocks = []
    for a in range(0, len(langs), BLOCK_LANGS):
        on = (lang >= a) & (lang < a + BLOCK_LANGS)
        table = np.ones((min(BLOCK_LANGS, len(langs) - a), BUCKETS))                # add-one smoothing
        np.add.at(table, (lang[on] - a, bucket[on]), n[on])
        blocks.append(np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T))
    return {"langs": langs, "logp": blocks, "prior": np.array([prior[x] for x in langs])}


def _score_texts(column, blocks: list, prior: np.ndarray):
    """(index of the best language, posterior) of an Arrow text column; the last index is ``und``."""
    n_lang = len(prior)
    best, prob = np.full(len(column), n_lang), np.zeros(len(column))
    for a, b, data, offsets in text_pieces(column) if n_lang else ():
        ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        letters = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[offsets]) > 0
        for r in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[r] = bool(_LETTER.search(data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")))
        bucket, row = _grams(data, offsets)
        top, sums, who, first = np.full(b - a, -np.inf), np.zeros(b - a), np.zeros(b - a, np.int64), 0
        for block in blocks:                                 # the best so far, and the sum of exponents relative to it
            logp = block.value
            width = logp.shape[1]
            total = np.stack([np.bincount(row, weights=logp[:, k][bucket], minlength=b - a) for k in range(width)], axis=1) + prior[first:first + width]
            here = total.max(axis=1)
            new = np.maximum(top, here)
            with np.errstate(under="ignore"):
                sums = sums * np.exp(top - new) + np.exp(total - new[:, None]).sum(axis=1)
            who = np.where(here > top, first + total.argmax(axis=1), who)
            top, first = new, first + width
        with np.errstate(under="ignore"):
            p = 1.0 / sums
        best[a:b] = np.where(letters, who, n_lang)
        prob[a:b] = np.where(letters, p, 0.0)
    return best, prob


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of ``docs(doc_id, text)``: score is the posterior of the best language."""
    names = np.array([*model["langs"], UND], object)
    blocks, prior = [docs.sparkSession.sparkContext.broadcast(x) for x in model["logp"]], model["prior"]
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches):
        for batch in batches:
            best, prob = _score_texts(batch.column("text"), blocks, prior)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(prob)], schema=out)

    return only(docs, doc_id="bigint", text="string").mapInArrow(score, "doc_id bigint, lang_pred string, score double")


def annotate(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with columns __lang_pred and __lang_score; whole rows pass as Arrow batches, so no join is needed."""
    names = np.array([*model["langs"], UND], object)
    blocks, prior = [docs.sparkSession.sparkContext.broadcast(x) for x in model["logp"]], model["prior"]
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__lang_score", T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches):
        for batch in batches:
            best, prob = _score_texts(batch.column(at), blocks, prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(prob)],
                                             names=[*batch.schema.names, "__lang_pred", "__lang_score"])

    return docs.mapInArrow(score, schema)


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2):
    """True for rows whose crc32 of the id's text has the given remainder (null ids are in no fold)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))

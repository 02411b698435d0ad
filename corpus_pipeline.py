"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, mixing, BPE.

Each stage takes all documents its predecessor kept, written as Parquet and read again; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.llm import bpe, langid, mixing, simhash, substrings
from riskloom.llm.queries import tokenizer_path
from riskloom.session import ensure_checkpoint_dir

MIN_LANG_SCORE = 0.5       # a prediction no likelier than that is rejected


def language_id(spark, docs, sf_dir):
    """Documents without a recognisable language go; a null lang becomes the predicted one.

    The text is scored where it lies: prediction and text pass Python together, so no join is needed.
    """
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.annotate(docs, model)
    keep = (F.col("__lang_pred") != langid.UND) & (F.col("__lang_score") >= MIN_LANG_SCORE)
    return found.filter(keep).withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def substring_dedup(spark, docs, sf_dir):
    """Repeated lines, sentences and passages go from the texts; n_chars follows. A document left without text stays, empty."""
    got = substrings.dedup(docs, part_words=substrings.RUN_WORDS)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_to_targets(spark, docs, sf_dir):
    """Documents sampled to the raked token weights."""
    return mixing.sample(docs)


def bpe_tokens(spark, docs, sf_dir):
    """Token count and digests of every document's encoding and decoding."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing_to_targets", mixing_to_targets),
    ("bpe_tokens", bpe_tokens),
]

#: fitted models and hashes that SQL doesn't have; the stages are tested against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each stage's output is written to the shared checkpoint folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs

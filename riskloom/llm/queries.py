"""Registered queries of the operators in this subpackage: ``name -> (callable, DuckDB SQL or None)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, bpe, codes, forest, langid, mixing, resample, simhash, sketch, substrings, suffixes, toxicity, warc

#: where the public tokenizer files lie; a parameter of the operator, read when the query runs
TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark, sf_dir):
    return suffixes.dedup_report(_table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark, sf_dir):
    return sketch.with_edits(_table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    got = mixing.sampling_report(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 6).alias("prob"), "keep")


def op6_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_bpe(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(~langid.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score_and_locate(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted", "offending")


def op9_substring_dedup(spark, sf_dir):
    return substrings.report(_table(spark, sf_dir, "documents"), part_words=substrings.RUN_WORDS)


def op10_ann(spark, sf_dir):
    return forest.search(_table(spark, sf_dir, "embeddings"))


def op11_resampling(spark, sf_dir):
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_embedding_dedup(spark, sf_dir):
    return codes.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark, sf_dir):
    return align.token_alignment(_table(spark, sf_dir, "documents"), *map(tokenizer_path, ALIGNED))


_SQL6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS holder FROM p GROUP BY d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
   ((CAST(('0x' || substr(p.d || '00', 1 + ((5 * k) // 8) * 2, 4)) AS BIGINT) >> (11 - ((5 * k) % 8))) & 31) AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM p JOIN m USING (d)"""

# DuckDB has no CRC-32: its table of 256 steps comes from the rule, and only distinct words are hashed
_SQL11 = r"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
   lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT doc_id, text, true AS raw, row_number() OVER () AS r FROM documents UNION ALL SELECT NULL, text, false, -row_number() OVER () FROM benchmark),
words AS MATERIALIZED (SELECT raw, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
kinds AS MATERIALIZED (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(w)), lambda k: CAST('0x' || substr(hex(encode(w)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
   lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), tab),
cells AS (SELECT bucket, count(*) FILTER (WHERE raw) AS s, count(*) FILTER (WHERE NOT raw) AS t FROM words JOIN kinds USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
   FROM cells, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM cells)),
sums AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM words JOIN kinds USING (w) JOIN gains USING (bucket) WHERE raw GROUP BY r),
scored AS (SELECT doc_id, r, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
   FROM texts LEFT JOIN sums USING (r) WHERE raw),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
   count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM ranked"""

QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_simhash": (op3_simhash, None),
    "op4_fingerprints": (op4_fingerprints, None),
    "op5_mixing": (op5_mixing, mixing.oracle()),
    "op6_warc": (op6_warc, _SQL6),
    "op7_bpe": (op7_bpe, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_substring_dedup": (op9_substring_dedup, None),
    "op10_ann": (op10_ann, None),
    "op11_resampling": (op11_resampling, _SQL11),
    "op12_embedding_dedup": (op12_embedding_dedup, None),
    "op13_token_alignment": (op13_token_alignment, None),
}

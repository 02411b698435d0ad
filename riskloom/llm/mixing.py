"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Only DataFrame functions.  Token counts are aggregated to cells (source, language, topic); a cell's weight
is raked in turn to the target marginals of the three dimensions; a document is kept with probability
``min(1, budget * weight / tokens of its cell)``, decided by a hash of its id.

Every value has its own target, and the cell table is raked at its full size: marginals are partially aggregated
sums that go back to the cells by an equi-join, stored each round, and no window is used.

Edge cases: null source or lang is the value ``(null)``; null or blank text has no tokens and probability 0;
an empty table gives an empty result; rows that repeat a doc_id share its decision; a null id hashes as
``null``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

ALPHA = 0.7               # default target of a value: its token share to this power, normalised
BUDGET = 0.5              # expected tokens kept, as a share of all tokens
ROUNDS = 8                # passes over the three marginals
SEED = 42
BROADCAST_CELLS = 200_000  # cells (about 100 bytes each) up to which the cell table is broadcast
CELLS_PER_TASK = 50_000
DIMS = ("source", "lang", "topic")

#: topic -> substrings that mark it, first match wins (else ``prose``)
TOPICS = {"legal": ("rights reserved", "icensed under", "opyright"), "contact": ("@",),
          "noise": ("###", "***", "%%%")}


def n_tokens(text) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    out = F
    for name, marks in TOPICS.items():
        test = F.lit(False)
        for m in marks:
            test = test | F.contains(col, F.lit(m))
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("prose"))


def uniform(doc_id, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id's text: the first 8 hex digits of an md5."""
    text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cells_of(docs: DataFrame) -> DataFrame:
    """``docs`` with the cell columns and token counts: (doc_id, source, lang, topic, n_tokens)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in ("source", "lang")],
                       topic_of(text).alias("topic"), n_tokens(text).alias("n_tokens"))


def _group(d: str, targets: dict) -> Column:
    """The target group of a value: its own, or ``other`` if a given mapping doesn't name it (its weight is 0)."""
    own = F.concat(F.lit("="), d)
    return F.when(F.col(d).isin([str(v) for v in targets[d]]), own).otherwise(F.lit("other")) if d in targets else own


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back.  A checkpoint keeps the planner's size of a join, the product of
    its sides', which over the rounds becomes a number of millions of digits; files have their real size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/mixing-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _packed(cells: DataFrame) -> DataFrame:
    """``cells``, stored in as many files as their number needs."""
    cells = cut_lineage(cells)
    return _stored(cells.coalesce(1 + cells.count() // CELLS_PER_TASK))


def _marginal(out: DataFrame, d: str, value: str) -> DataFrame:
    return out.groupBy(f"g_{d}").agg(F.sum(value).cast("double").alias("__m"))


def rake(pooled: DataFrame, targets: dict | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """``pooled(g_source, g_lang, g_topic, n)`` with weights ``w`` that sum to 1 and fit the marginals.

    ``targets`` maps a dimension to {value: share}; a dimension without one gets its groups' token shares to the
    power ``alpha``.  Values missing from a given mapping get weight 0.
    """
    pooled = _packed(pooled)
    whole = float(pooled.agg(F.sum("n")).first()[0] or 1)
    out = pooled.withColumn("w", F.col("n").cast("double") / F.lit(whole))
    goals = {}
    for d in DIMS:
        m = _marginal(pooled, d, "n")
        if d in (targets or {}):
            total = sum(float(v) for v in targets[d].values())
            goal = F.lit(0.0)
            for value, share in targets[d].items():
                goal = F.when(F.col(f"g_{d}") == f"={value}", F.lit(float(share) / total)).otherwise(goal)
            goals[d] = _stored(m.select(f"g_{d}", goal.alias("__t")))
        else:
            m = _stored(m.select(f"g_{d}", F.pow("__m", F.lit(alpha)).alias("__p")))
            total = float(m.agg(F.sum("__p")).first()[0] or 1)
            goals[d] = m.select(f"g_{d}", (F.col("__p") / F.lit(total)).alias("__t"))
    for _ in range(rounds):
        for d in DIMS:
            factor = _marginal(out, d, "w").join(goals[d], f"g_{d}").select(f"g_{d}", F.when(F.col("__m") > 0, F.col("__t") / F.col("__m")).otherwise(F.lit(0.0)).alias("__f"))
            out = out.join(factor, f"g_{d}").select(*pooled.columns, (F.col("w") * F.col("__f")).alias("w"))
        out = _stored(out)
    return out


def probabilities(docs: DataFrame, targets: dict | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, n, w, prob) per cell of ``docs`` that has tokens, checkpointed."""
    cells = cells_of(docs).groupBy(*DIMS).agg(F.sum("n_tokens").alias("n")).filter("n > 0")
    cells = _packed(cells.select("*", *[_group(d, targets or {}).alias(f"g_{d}") for d in DIMS]))
    keys = [f"g_{d}" for d in DIMS]
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    raked = rake(cells.groupBy(*keys).agg(F.sum("n").alias("n")), targets, alpha, rounds)
    rate = raked.select(*keys, (F.col("w") / F.col("n")).alias("rate"))
    return cut_lineage(cells.join(rate, keys).select(
        *DIMS, "n", (F.col("rate") * F.col("n")).alias("w"), F.least(F.lit(1.0), F.lit(budget * total) * F.col("rate")).alias("prob")))


def _with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Left join on the cell; broadcast up to a checked number of cells, else an equi-join AQE can split."""
    small = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(cells) if small else cells, list(DIMS), "left")


def sampling_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: its cell, n_tokens, the cell's weight, prob, and keep."""
    p = probabilities(docs, **options).select(*DIMS, "w", "prob")
    out = _with_cells(cells_of(docs), p)
    prob = F.when(F.col("n_tokens") > 0, F.coalesce("prob", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("doc_id", *DIMS, "n_tokens", F.coalesce("w", F.lit(0.0)).alias("weight"), prob.alias("prob"),
                      (uniform("doc_id") < prob).alias("keep"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The kept documents, with the columns of ``docs``."""
    columns = docs.columns
    p = probabilities(docs, **options).select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("prob").alias("__prob"))
    small = p.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    text = F.col("text").cast("string")
    rows = docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("(null)")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("(null)")),
                             "__topic": topic_of(text)})
    kept = rows.join(F.broadcast(p) if small else p, [f"__{d}" for d in DIMS]).filter((uniform("doc_id") < F.col("__prob")) & (n_tokens(text) > 0))
    return kept.select(*[F.col(f"`{c}`") for c in columns])


def oracle(alpha: float = ALPHA, rounds: int = ROUNDS, budget: float = BUDGET, seed: int = SEED, table: str = "documents") -> str:
    """DuckDB SQL for ``sampling_report``'s rows, rounds unrolled."""
    topic = " ".join("WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS.items())
    ctes = [f"""docs AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang,
 CASE {topic} ELSE 'prose' END AS topic, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM {table})""",
            "c0 AS (SELECT source, lang, topic, sum(n_tokens) AS n FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for d in DIMS:
        ctes.append(f"g_{d} AS (SELECT {d}, '=' || {d} AS g, sum(n) AS m FROM c0 GROUP BY {d})")
        ctes.append(f"t_{d} AS (SELECT g, pow(CAST(sum(m) AS DOUBLE), {alpha}) / sum(pow(CAST(sum(m) AS DOUBLE), {alpha})) OVER () AS t FROM g_{d} GROUP BY g)")
    joins = " ".join(f"JOIN g_{d} USING ({d})" for d in DIMS)
    keys = ", ".join(f"g_{d}" for d in DIMS)
    ctes.append("cg AS (SELECT source, lang, topic, n, " + ", ".join(f"g_{d}.g AS g_{d}" for d in DIMS) + f" FROM c0 {joins})")
    ctes.append(f"pool AS (SELECT {keys}, sum(n) AS n FROM cg GROUP BY ALL)")
    ctes.append("w0 AS (SELECT pool.*, " + ", ".join(f"t_{d}.t AS t_{d}" for d in DIMS) + ", CAST(n AS DOUBLE) / sum(n) OVER () AS w FROM pool "
                + " ".join(f"JOIN t_{d} ON t_{d}.g = pool.g_{d}" for d in DIMS) + ")")
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY g_{d}) AS w) FROM w{k})")
            k += 1
    ctes.append(f"r AS (SELECT {keys}, least(1.0, {budget} * sum(n) OVER () * w / n) AS prob FROM w{k})")
    ctes.append(f"p AS (SELECT source, lang, topic, prob FROM cg JOIN r USING ({keys}))")
    u = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{seed}'), 1, 8)) AS BIGINT) / 4294967296.0"
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN coalesce(prob, 0.0) ELSE 0.0 END, 6) AS prob,
 {u} < CASE WHEN n_tokens > 0 THEN coalesce(prob, 0.0) ELSE 0.0 END AS keep
FROM docs LEFT JOIN p USING (source, lang, topic)""")

"""Explanation prompt column (B24): one text prompt per scored row.

The reference builds a language-model prompt per suspicious transaction; here it is a
column expression over a scored DataFrame (``concat`` + ``to_json``), so it runs in
codegen on any number of rows, batch or stream.  JSON is compact (no indentation) and
keeps null keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed text of the prompt (must equal the reference's wording).
PREAMBLE = ("Tu es un analyste fraude. Analyse les signaux et justifie la decision.\n"
            "Reponds uniquement en JSON avec les cles: risk_level, reasons, actions.\n"
            "Input:\n")
INSTRUCTIONS = [
    "Explain why the transaction may be fraudulent.",
    "Reference each provided signal explicitly.",
    "Give a short risk level: low, medium, or high.",
    "Respond in French with concise bullet points.",
]


def explanation_prompt(df: DataFrame, score: str = "score", amount: str = "amount",
                       type_col: str = "type", hour: str = "hour",
                       feature_hour: str | None = None, out: str = "prompt") -> DataFrame:
    hour_col = F.col(hour) if feature_hour is None else F.coalesce(F.col(hour), F.col(feature_hour))
    payload = F.struct(
        F.struct(
            F.col(amount).alias("amount"),
            F.col(type_col).alias("type"),
            hour_col.alias("hour"),
            F.col("balance_diff_orig").alias("balance_diff_orig"),
            F.col("dest_zero_balance").alias("dest_zero_balance"),
        ).alias("transaction"),
        F.col(score).cast("double").alias("model_score"),
        F.array(*[F.lit(s) for s in INSTRUCTIONS]).alias("instructions"),
    )
    text = F.concat(F.lit(PREAMBLE), F.to_json(payload, {"ignoreNullFields": "false"}))
    return df.withColumn(out, text)

"""Row-local column expressions.

Everything here is a ``Column`` built from ``pyspark.sql.functions`` only, so it stays
inside whole-stage codegen and works unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HIGH_RISK_HOURS, STEPS_PER_DAY, STEPS_PER_WEEK, CLASS_NAMES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(cond: Column) -> Column:
    """Null-safe 0/1 int flag: a null condition counts as false (pandas semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def safe_div(num, den, default: float | None = 0.0) -> Column:
    """``num / den``; ``default`` when the denominator is 0 or null (ANSI-safe)."""
    q = F.try_divide(_c(num), _c(den))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


# --- temporal (B1-B4) -------------------------------------------------------
def hour_of(step="step") -> Column:
    return F.pmod(_c(step), F.lit(STEPS_PER_DAY))


def day_of(step="step") -> Column:
    return F.floor(_c(step) / F.lit(STEPS_PER_DAY)).cast("bigint")


def week_of(step="step") -> Column:
    return F.floor(_c(step) / F.lit(STEPS_PER_WEEK)).cast("bigint")


def is_weekend_of(day="day") -> Column:
    return flag(F.pmod(_c(day), F.lit(7)) >= 5)


# --- behavioural (B6-B9, B14) --------------------------------------------------
def high_risk_hour_of(hour="hour", hours=None) -> Column:
    hours = HIGH_RISK_HOURS if hours is None else list(hours)
    return flag(_c(hour).isin(hours))


def transfer_cashout_of(type_col="type") -> Column:
    return flag(_c(type_col).isin("TRANSFER", "CASH_OUT"))


def balance_diff_of(old="oldbalanceOrg", new="newbalanceOrig") -> Column:
    return _c(old) - _c(new)


def dest_zero_balance_of(dest="nameDest", old="oldbalanceDest", new="newbalanceDest") -> Column:
    return flag(_c(dest).startswith("C") & (_c(old) == 0) & (_c(new) == 0))


def log1p_of(col="amount") -> Column:
    return F.log1p(_c(col))


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """NumPy ``isclose`` (tolerance relative to ``b``)."""
    return F.abs(_c(a) - _c(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(_c(b))


def class_name_of(label="isFraud") -> Column:
    out = None
    for k, v in CLASS_NAMES.items():
        out = (F.when(_c(label) == k, F.lit(v)) if out is None
               else out.when(_c(label) == k, F.lit(v)))
    return out


def classify(score="score", threshold: float = 0.5) -> Column:
    """1 when ``score >= threshold``."""
    return flag(_c(score) >= F.lit(float(threshold)))


# --- deterministic randomness ------------------------------------------------
def order_key(key="txn_id", seed: int = 42) -> Column:
    """Engine-independent pseudo-random order: md5 of ``key:seed`` as hex text."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}")))


def uniform_of(key="txn_id", seed: int = 42, salt: str = "") -> Column:
    """Uniform [0,1) from the first 8 hex digits of md5(key:seed[salt])."""
    text = F.concat(_c(key).cast("string"), F.lit(f":{seed}{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def num(col) -> Column:
    """Column as double with NaN turned into null, so aggregates skip it (pandas/NumPy
    ``nan``-skipping semantics: mean, std, skew, corr, scaler fits)."""
    x = _c(col).cast("double")
    return F.when(~F.isnan(x), x)

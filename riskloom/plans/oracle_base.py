"""Shared DuckDB CTEs of the oracle: the ``transactions`` view and its features.

Each oracle query is ``WITH <TX_CTES> SELECT ...`` over the driver's pre-registered
``events`` view, computed by the same integer rules as ``sources/fixture.py``.
"""

TX_CTES = """
ev_base AS (
  SELECT event_id AS txn_id,
         CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) + 1 AS step,
         CASE event_type WHEN 'signup' THEN 'CASH_IN' WHEN 'error' THEN 'CASH_OUT'
                         WHEN 'view' THEN 'DEBIT' WHEN 'click' THEN 'PAYMENT'
                         WHEN 'purchase' THEN 'TRANSFER' END AS type,
         value, user_id,
         (event_id * 7919) % 10007 AS h1,
         (event_id * 104729) % 997 AS h2
  FROM events),
ev_lab AS (
  SELECT *, CAST(h2 AS DOUBLE) / 2 AS bal,
         CASE WHEN type IN ('TRANSFER', 'CASH_OUT')
                   AND h1 < CASE WHEN step % 24 <= 9 OR step % 24 = 23 THEN 900 ELSE 90 END
              THEN 1 ELSE 0 END AS isFraud
  FROM ev_base),
ev_amt AS (
  SELECT *, round(value * CASE WHEN isFraud = 1 THEN CAST(10 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 2) AS amount,
         (type = 'PAYMENT' OR h2 % 20 = 0 OR (isFraud = 1 AND h2 % 2 = 0)) AS dz
  FROM ev_lab),
transactions AS (
  SELECT txn_id, step, type, amount,
         'C' || CAST(user_id AS VARCHAR) AS nameOrig,
         CASE WHEN isFraud = 1 THEN amount ELSE bal END AS oldbalanceOrg,
         CASE WHEN isFraud = 1 THEN CAST(0 AS DOUBLE)
              WHEN type = 'CASH_IN' THEN round(bal + amount, 2)
              ELSE round(greatest(bal - amount, CAST(0 AS DOUBLE)), 2) END AS newbalanceOrig,
         CASE WHEN type = 'PAYMENT' THEN 'M' ELSE 'C' END
           || CAST((user_id * 31 + h2) % 150 AS VARCHAR) AS nameDest,
         CASE WHEN dz THEN CAST(0 AS DOUBLE) ELSE round(bal * 2, 2) END AS oldbalanceDest,
         CASE WHEN dz THEN CAST(0 AS DOUBLE) ELSE round(bal * 2 + amount, 2) END AS newbalanceDest,
         CAST(isFraud AS INTEGER) AS isFraud,
         CAST(CASE WHEN isFraud = 1 AND type = 'TRANSFER' AND amount > 1200 THEN 1 ELSE 0 END AS INTEGER)
           AS isFlaggedFraud
  FROM ev_amt),
features AS (
  SELECT *,
         step % 24 AS hour,
         CAST(floor(step / 24) AS BIGINT) AS day,
         CAST(floor(step / 168) AS BIGINT) AS week,
         CAST(CASE WHEN step % 24 IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 23) THEN 1 ELSE 0 END AS INTEGER)
           AS high_risk_hour,
         CAST(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 1 ELSE 0 END AS INTEGER)
           AS is_transfer_or_cashout,
         oldbalanceOrg - newbalanceOrig AS balance_diff_orig,
         CAST(CASE WHEN starts_with(nameDest, 'C') AND oldbalanceDest = 0 AND newbalanceDest = 0
                   THEN 1 ELSE 0 END AS INTEGER) AS dest_zero_balance
  FROM transactions)
"""


def with_tx(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the transactions/features CTEs (+ optional extra CTEs)."""
    ctes = TX_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


# Encoded model frame, exact stratified 70/15/15 split (quotas by floor + largest
# remainder, ties to the smaller class) and the train-fitted scaler, as DuckDB CTEs.
ENC_CTE = """
enc AS (
  SELECT txn_id, step, hour, day, week, high_risk_hour, is_transfer_or_cashout, balance_diff_orig,
         dest_zero_balance,
         CAST(CASE WHEN type = 'CASH_IN' THEN 1 ELSE 0 END AS INTEGER) AS type_CASH_IN,
         CAST(CASE WHEN type = 'CASH_OUT' THEN 1 ELSE 0 END AS INTEGER) AS type_CASH_OUT,
         CAST(CASE WHEN type = 'DEBIT' THEN 1 ELSE 0 END AS INTEGER) AS type_DEBIT,
         CAST(CASE WHEN type = 'PAYMENT' THEN 1 ELSE 0 END AS INTEGER) AS type_PAYMENT,
         CAST(CASE WHEN type = 'TRANSFER' THEN 1 ELSE 0 END AS INTEGER) AS type_TRANSFER,
         ln(1 + amount) AS log_amount, isFraud
  FROM features)
"""


def quota_ctes(src: str, label: str, prefix: str, train_frac: str = "CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)",
               second_frac: str = "CAST(0.5 AS DOUBLE)", n_train_expr: str | None = None) -> str:
    """CTEs ``{prefix}quotas(c, q_train, q_val)`` for the two-step stratified split."""
    p = prefix
    n_train = n_train_expr or f"sum(cnt) - CAST(ceil(({train_frac}) * sum(cnt)) AS BIGINT)"
    return f"""
{p}cc AS (SELECT {label} AS c, count(*) AS cnt FROM {src} GROUP BY {label}),
{p}s1 AS (SELECT sum(cnt) AS n, {n_train} AS n_train FROM {p}cc),
{p}a1 AS (SELECT c, cnt, CAST(cnt * (SELECT n_train FROM {p}s1) AS DOUBLE) / (SELECT n FROM {p}s1) AS cont
          FROM {p}cc),
{p}b1 AS (SELECT c, cnt, cont, floor(cont) AS fl FROM {p}a1),
{p}c1 AS (SELECT c, cnt, CAST(fl AS BIGINT)
            + CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, c)
                        <= (SELECT n_train FROM {p}s1) - sum(fl) OVER () THEN 1 ELSE 0 END AS q_train
          FROM {p}b1),
{p}d1 AS (SELECT c, q_train, cnt - q_train AS tmp FROM {p}c1),
{p}s2 AS (SELECT sum(tmp) AS n2, sum(tmp) - CAST(ceil(({second_frac}) * sum(tmp)) AS BIGINT) AS n_val
          FROM {p}d1),
{p}a2 AS (SELECT c, q_train, tmp,
                 CASE WHEN (SELECT n2 FROM {p}s2) = 0 THEN CAST(0 AS DOUBLE)
                      ELSE CAST(tmp * (SELECT n_val FROM {p}s2) AS DOUBLE) / (SELECT n2 FROM {p}s2) END AS cont
          FROM {p}d1),
{p}b2 AS (SELECT c, q_train, tmp, cont, floor(cont) AS fl FROM {p}a2),
{p}quotas AS (SELECT c, q_train, CAST(fl AS BIGINT)
            + CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, c)
                        <= (SELECT n_val FROM {p}s2) - sum(fl) OVER () THEN 1 ELSE 0 END AS q_val
          FROM {p}b2)
"""


SPLIT_CTES = ENC_CTE.strip() + "," + quota_ctes("enc", "isFraud", "sp_") + """,
ranked AS (
  SELECT e.*, row_number() OVER (PARTITION BY isFraud ORDER BY md5(CAST(txn_id AS VARCHAR) || ':42'), txn_id) AS rk
  FROM enc e),
split_rows AS (
  SELECT r.* EXCLUDE (rk),
         CASE WHEN rk <= q.q_train THEN 'train' WHEN rk <= q.q_train + q.q_val THEN 'val' ELSE 'test' END AS split
  FROM ranked r JOIN sp_quotas q ON r.isFraud = q.c),
scaler AS (
  SELECT avg(step) AS m_step, stddev_pop(step) AS s_step, avg(hour) AS m_hour, stddev_pop(hour) AS s_hour,
         avg(day) AS m_day, stddev_pop(day) AS s_day, avg(week) AS m_week, stddev_pop(week) AS s_week,
         avg(log_amount) AS m_log_amount, stddev_pop(log_amount) AS s_log_amount,
         avg(balance_diff_orig) AS m_balance_diff_orig, stddev_pop(balance_diff_orig) AS s_balance_diff_orig
  FROM split_rows WHERE split = 'train'),
scaled AS (
  SELECT r.txn_id, r.split, r.isFraud,
         (r.step - m_step) / CASE WHEN s_step > 0 THEN s_step ELSE 1 END AS step,
         (r.hour - m_hour) / CASE WHEN s_hour > 0 THEN s_hour ELSE 1 END AS hour,
         (r.day - m_day) / CASE WHEN s_day > 0 THEN s_day ELSE 1 END AS day,
         (r.week - m_week) / CASE WHEN s_week > 0 THEN s_week ELSE 1 END AS week,
         r.high_risk_hour, r.is_transfer_or_cashout,
         (r.balance_diff_orig - m_balance_diff_orig)
           / CASE WHEN s_balance_diff_orig > 0 THEN s_balance_diff_orig ELSE 1 END AS balance_diff_orig,
         r.dest_zero_balance, r.type_CASH_IN, r.type_CASH_OUT, r.type_DEBIT, r.type_PAYMENT, r.type_TRANSFER,
         (r.log_amount - m_log_amount) / CASE WHEN s_log_amount > 0 THEN s_log_amount ELSE 1 END AS log_amount
  FROM split_rows r, scaler)
"""


def with_split(body: str, extra_ctes: str = "") -> str:
    extra = SPLIT_CTES.strip()
    if extra_ctes.strip():
        extra = extra + ",\n" + extra_ctes.strip()
    return with_tx(body, extra)

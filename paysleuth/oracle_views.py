"""The payment views in DuckDB SQL, as common table expressions shared by all checks."""

TX = """
tx AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         'user_' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(length(CAST(user_id AS VARCHAR)), 4) AS INTEGER), '0') AS user_id,
         'merchant_' || lpad(CAST(k AS VARCHAR), CAST(greatest(length(CAST(k AS VARCHAR)), 4) AS INTEGER), '0') AS merchant_id,
         (['retail','food','travel','entertainment','gas_station','online','pharmacy'])[k % 7 + 1] AS merchant_category,
         value AS amount,
         (['AR','BR','US','MX','CL','CO','PE','UY','PY','BO','ES','UK','FR','DE'])[
            (CASE WHEN event_id % 20 < 17 THEN user_id ELSE event_id END) % 14 + 1] AS country,
         ts AS "timestamp", epoch_us(ts) AS us,
         CASE WHEN event_id % 10 < 6 THEN 'mobile' WHEN event_id % 10 < 9 THEN 'web' ELSE 'pos' END AS device_type,
         CASE WHEN event_type = 'signup' AND k >= 90 THEN NULL ELSE event_type = 'error' AND k < 10 END AS is_fraud,
         CAST(round(value * 100) AS BIGINT) AS c
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""

SHIP = """
ship AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(l_suppkey AS VARCHAR) AS merchant_id, l_linestatus AS merchant_category, l_extendedprice AS amount,
         o_orderstatus AS country, CAST(l_shipdate AS TIMESTAMP) AS "timestamp", epoch_us(l_shipdate) AS us,
         o_orderpriority AS device_type, l_returnflag = 'R' AS is_fraud,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

BUY = """
buy AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(l_suppkey AS VARCHAR) AS merchant_id, l_extendedprice AS amount, o_orderstatus AS country,
         CAST(o_orderdate AS TIMESTAMP) + to_minutes(l_linenumber) AS "timestamp",
         epoch_us(o_orderdate) + l_linenumber * 60000000 AS us
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

PH = """
ph AS (
  SELECT event_id AS id, CAST(event_id AS VARCHAR) AS transaction_id, event_id % 3 + 1 AS model_version_id,
         least(value / 200, 1.0) AS prediction_score, least(value / 200, 1.0) >= 0.5 AS prediction_label,
         CASE WHEN event_type = 'signup' AND k >= 90 THEN NULL ELSE event_type = 'error' AND k < 10 END AS actual_label,
         ts AS "timestamp", epoch_us(ts) AS us, (k + 1) * CAST(0.5 AS DOUBLE) AS latency_ms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""

MD = """
md AS (
  SELECT s_suppkey + 1 AS id, 'payment-fraud' AS model_name, CAST(s_suppkey + 1 AS VARCHAR) AS version,
         'run_' || s_suppkey AS run_id,
         TIMESTAMP '2023-12-01 00:00:00' + to_hours(s_suppkey) AS created_at, s_suppkey = 1 AS is_active,
         ((s_suppkey * 37) % 101) / CAST(100 AS DOUBLE) AS f1_score,
         ((s_suppkey * 53) % 101) / CAST(100 AS DOUBLE) AS "precision",
         ((s_suppkey * 71) % 101) / CAST(100 AS DOUBLE) AS recall,
         ((s_suppkey * 89) % 101) / CAST(100 AS DOUBLE) AS auc_roc,
         TIMESTAMP '2023-11-01 00:00:00' AS training_data_from,
         TIMESTAMP '2023-12-01 00:00:00' + to_hours(s_suppkey) AS training_data_to
  FROM supplier)
"""

DR = """
dr AS (
  SELECT event_id AS id, ts AS report_date, event_id % 3 + 1 AS model_version_id, k / CAST(100 AS DOUBLE) AS drift_score,
         '{"data_drift": {"tx_count_1h": {"drift_score": 0.' || lpad(CAST(k AS VARCHAR), 2, '0')
         || '}, "amount_sum_1h": {"drift_score": 0.' || lpad(CAST((k * 7) % 100 AS VARCHAR), 2, '0')
         || '}, "log_amount": {"drift_score": 0.' || lpad(CAST((k * 13) % 100 AS VARCHAR), 2, '0')
         || '}}, "model_drift": {"detected": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
         || ', "f1_degradation": -0.' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') || '}}' AS feature_drifts,
         k >= 30 AS alert_triggered, CASE WHEN k >= 30 THEN 'triggered_retraining_dag' END AS remediation_action, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'view'))
"""

AL = """
al AS (
  SELECT event_id AS id,
         (['HIGH_FRAUD_RATE','LOW_TRANSACTION_VOLUME','LOW_PREDICTION_RATE'])[k % 3 + 1] AS alert_type,
         (['INFO','WARNING','HIGH','CRITICAL'])[k % 4 + 1] AS severity, 'alert ' || event_id AS message,
         ts AS triggered_at, CASE WHEN k % 5 = 0 THEN ts + INTERVAL 10 MINUTE END AS acknowledged_at,
         CASE WHEN k % 5 = 0 THEN 'operator' END AS acknowledged_by
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'))
"""

# Features by window functions over the view ``src`` (range frames on microseconds).
BEHAVIOUR = """
seen AS (
  SELECT *, us = min(us) OVER (PARTITION BY user_id, country) AS new_c,
         us = min(us) OVER (PARTITION BY user_id, merchant_id) AS new_m,
         CASE WHEN row_number() OVER (PARTITION BY user_id, country ORDER BY us, transaction_id) = 1 THEN 1 END AS fc,
         CASE WHEN row_number() OVER (PARTITION BY user_id, merchant_id ORDER BY us, transaction_id) = 1 THEN 1 END AS fm
  FROM {src}),
feat AS (
  SELECT *, count(*) OVER h AS tx_count_1h, count(*) OVER d AS tx_count_24h, count(*) OVER w AS tx_count_7d,
         coalesce(CAST(sum(c) OVER h AS BIGINT), 0) / CAST(100 AS DOUBLE) AS amount_sum_1h,
         coalesce(CAST(sum(c) OVER d AS BIGINT), 0) / CAST(100 AS DOUBLE) AS amount_sum_24h,
         CAST(count(*) OVER h AS DOUBLE) AS tx_velocity_1h,
         coalesce((us - max(us) OVER p) / CAST(1000000 AS DOUBLE), -1.0) AS seconds_since_last_tx,
         CASE WHEN coalesce(CAST(sum(c) OVER p AS BIGINT), 0) > 0
              THEN amount / (CAST(sum(c) OVER p AS BIGINT) / CAST(100 AS DOUBLE) / count(*) OVER p)
              ELSE 1.0 END AS amount_ratio_vs_user_avg,
         CAST(new_c AS DOUBLE) AS is_country_new, count(fc) OVER p AS distinct_countries_seen,
         CAST(new_m AS DOUBLE) AS is_merchant_new, count(fm) OVER p AS distinct_merchants_seen
  FROM seen
  WINDOW h AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING),
         d AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING),
         w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING),
         p AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""

# Category codes fitted on the labelled rows of ``tx``.
CODES = """
gm AS (SELECT avg(CAST(is_fraud AS INTEGER)) AS g FROM tx WHERE is_fraud IS NOT NULL),
mc AS (SELECT merchant_category AS cat, (sum(CAST(is_fraud AS INTEGER)) + 10 * any_value(g)) / (count(*) + 10) AS code
       FROM tx, gm WHERE is_fraud IS NOT NULL GROUP BY 1),
co AS (SELECT country AS cat, (sum(CAST(is_fraud AS INTEGER)) + 10 * any_value(g)) / (count(*) + 10) AS code
       FROM tx, gm WHERE is_fraud IS NOT NULL GROUP BY 1),
dv AS (SELECT device_type AS cat, row_number() OVER (ORDER BY min(us)) - 1 AS code
       FROM tx WHERE is_fraud IS NOT NULL GROUP BY 1)
"""

MATRIX = """
mx AS (
  SELECT f.*, ln(1 + amount) AS log_amount, hour("timestamp") AS hour_of_day,
         isodow("timestamp") - 1 AS day_of_week,
         coalesce(mc.code, g) AS merchant_category_encoded, coalesce(co.code, g) AS country_encoded,
         coalesce(dv.code, -1) AS device_type_encoded
  FROM feat f CROSS JOIN gm LEFT JOIN mc ON mc.cat = f.merchant_category LEFT JOIN co ON co.cat = f.country
  LEFT JOIN dv ON dv.cat = f.device_type)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


def behaviour(src: str = "tx") -> str:
    return BEHAVIOUR.format(src=src)

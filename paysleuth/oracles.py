"""For each query the SQL that DuckDB runs on the same tables."""

from paysleuth.oracle_views import AL, BUY, CODES, DR, MATRIX, MD, PH, SHIP, TX, behaviour, with_
from paysleuth.operators.monitor import NOT_NULL
from paysleuth.schemas import MODEL_INPUT

SQL: dict[str, str] = {}

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
MIDDLE = "TIMESTAMP '2024-01-16 00:00:00'"

_WHOLE = {
    "hour_of_day", "day_of_week", "device_type_encoded", "tx_count_1h", "tx_count_24h", "tx_count_7d",
    "distinct_countries_seen", "distinct_merchants_seen",
}
_DIRECT = ["log_amount", "hour_of_day", "day_of_week", "merchant_category_encoded", "country_encoded",
           "device_type_encoded"]
_WINDOW = ["tx_count_1h", "tx_count_24h", "tx_count_7d", "amount_sum_1h", "amount_sum_24h", "tx_velocity_1h",
           "seconds_since_last_tx"]
_PROFILE = ["amount_ratio_vs_user_avg", "is_country_new", "distinct_countries_seen", "is_merchant_new",
            "distinct_merchants_seen"]
_MODEL = [f for f in _DIRECT + _WINDOW + _PROFILE if f not in ("tx_velocity_1h", "distinct_countries_seen")]


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) AS {name or expression}"


def shown(names: list[str]) -> str:
    return ", ".join(n if n in _WHOLE else r6(n) for n in names)


_FEATURES = with_(TX, behaviour())
_FULL = with_(TX, behaviour(), CODES, MATRIX)
# shipments with one row per (id, time): the smallest content
_SHIP = with_(
    SHIP,
    """one AS (SELECT * FROM ship QUALIFY row_number() OVER (PARTITION BY transaction_id, us ORDER BY user_id,
       merchant_id, merchant_category, amount, country, device_type, is_fraud) = 1)""",
    behaviour("one"),
)
_BEHAVIOUR = f'SELECT transaction_id, user_id, "timestamp", {shown(_WINDOW + _PROFILE)} FROM feat'

# ---- sources, sinks, ingest

_TX_COLUMNS = """transaction_id, user_id, merchant_id, merchant_category, amount, country, "timestamp", device_type,
 CAST(sha256(user_id || '|' || strftime("timestamp", '%Y%m%d%H')) AS VARCHAR) AS ip_hash"""

SQL["scan_transactions"] = with_(TX) + f"""SELECT {_TX_COLUMNS}, is_fraud FROM tx
WHERE is_fraud IS NOT NULL AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'"""
SQL["scan_recent"] = with_(TX) + f"""SELECT {_TX_COLUMNS}, is_fraud FROM tx
WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR"""
SQL["user_history_7d"] = with_(TX) + f"""SELECT {_TX_COLUMNS}, is_fraud FROM tx
WHERE user_id = 'user_0007' AND "timestamp" >= {NOW} - INTERVAL 7 DAY"""
SQL["stream_source"] = with_(TX) + f"""SELECT {_TX_COLUMNS} FROM tx
WHERE CAST(transaction_id AS BIGINT) % 10 NOT IN (1, 2, 3, 5)"""
SQL["stream_source_features"] = _FEATURES + f"""SELECT transaction_id, "timestamp",
{", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in _WINDOW + _PROFILE)} FROM feat"""
SQL["dead_letter_split"] = with_(TX) + """SELECT
CASE WHEN CAST(transaction_id AS BIGINT) % 10 IN (1, 2, 3, 5) THEN 'dead' ELSE 'good' END AS sink, transaction_id,
CASE WHEN CAST(transaction_id AS BIGINT) % 10 IN (1, 2, 3, 5) THEN NULL ELSE amount END AS amount FROM tx"""
SQL["stream_dead_letters"] = with_(TX) + """SELECT
CASE WHEN CAST(transaction_id AS BIGINT) % 10 IN (1, 2, 3, 5) THEN 'dead' ELSE 'good' END AS sink, count(*) AS n
FROM tx GROUP BY 1"""
SQL["validate_uuid"] = with_(TX) + """, h AS (SELECT transaction_id AS number, md5(transaction_id) AS m,
  CAST(transaction_id AS BIGINT) % 5 AS n FROM tx),
d AS (SELECT *, substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-'
  || substring(m, 17, 4) || '-' || substring(m, 21, 12) AS dashed FROM h)
SELECT number, CASE n WHEN 0 THEN dashed WHEN 1 THEN m WHEN 2 THEN '{' || dashed || '}' ELSE 'urn:uuid:' || dashed END
  AS transaction_id FROM d WHERE n <> 4"""
SQL["validate_request"] = with_(TX) + """, b AS (SELECT transaction_id, CAST(transaction_id AS BIGINT) AS n, amount FROM tx),
w AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'missing country'
  WHEN (CASE WHEN n % 7 = 0 THEN -amount ELSE amount END) <= 0 THEN 'amount must be greater than 0'
  WHEN n % 13 = 0 THEN 'missing feature tx_count_7d' END AS reason FROM b)
SELECT transaction_id, reason IS NULL AS valid, reason FROM w"""
SQL["upsert_transactions"] = with_(TX) + f"SELECT {_TX_COLUMNS}, is_fraud FROM tx"
SQL["publish_features"] = _FEATURES + "SELECT transaction_id, " + ", ".join(
    f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in _WINDOW + _PROFILE
) + " FROM feat"
SQL["publish_alerts"] = with_(PH) + """SELECT transaction_id, 'FRAUD_DETECTED' AS alert_type,
CASE WHEN prediction_score >= 0.9 THEN 'CRITICAL' WHEN prediction_score >= 0.75 THEN 'HIGH' ELSE 'WARNING' END AS severity,
round(prediction_score, 6) AS prediction_score, "timestamp" FROM ph WHERE prediction_label"""
SQL["reference_snapshot"] = _FULL + f"SELECT transaction_id, {shown(_MODEL)} FROM mx"

_SIDES = with_(TX) + f"""
, sides AS (SELECT "timestamp" >= {MIDDLE} AS cur, amount * CASE WHEN "timestamp" >= {MIDDLE} THEN 5 ELSE 1 END AS amount,
  ln(1 + amount) AS log_amount, CAST(hour("timestamp") AS DOUBLE) AS hour_of_day,
  CAST(isodow("timestamp") - 1 AS DOUBLE) AS day_of_week FROM tx),
long AS (UNPIVOT sides ON amount, log_amount, hour_of_day, day_of_week INTO NAME "column" VALUE v),
tot AS (SELECT "column", count(*) FILTER (NOT cur) AS nr, count(*) FILTER (cur) AS nc, min(v) AS lo, max(v) AS hi,
  stddev_pop(v) FILTER (NOT cur) AS sd FROM long GROUP BY 1),
cnt AS (SELECT "column", v, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM long GROUP BY 1, 2),
cdf AS (SELECT "column", v, CAST(sum(r) OVER w AS DOUBLE) AS cr, CAST(sum(c) OVER w AS DOUBLE) AS cc,
  lead(v) OVER (PARTITION BY "column" ORDER BY v) - v AS gap FROM cnt WINDOW w AS (PARTITION BY "column" ORDER BY v)),
ks AS (SELECT "column", max(abs(cr / nr - cc / nc)) AS score FROM cdf JOIN tot USING ("column") GROUP BY 1),
ws AS (SELECT "column", sum(abs(cr / nr - cc / nc) * coalesce(gap, 0)) / greatest(any_value(sd), 0.001) AS score
  FROM cdf JOIN tot USING ("column") GROUP BY 1),
bins AS (SELECT "column", coalesce(least(floor((v - lo) / nullif((hi - lo) / 20.0::DOUBLE, 0)), 19), 0) AS b,
  CAST(sum(r) AS DOUBLE) / any_value(nr) AS p, CAST(sum(c) AS DOUBLE) / any_value(nc) AS q
  FROM cnt JOIN tot USING ("column") GROUP BY 1, 2),
js AS (SELECT "column", sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS score FROM bins GROUP BY 1),
psi AS (SELECT "column", sum((greatest(q, 1e-4::DOUBLE) - greatest(p, 1e-4::DOUBLE))
  * ln(greatest(q, 1e-4::DOUBLE) / greatest(p, 1e-4::DOUBLE))) AS score FROM bins GROUP BY 1)
"""


def _drift(table: str, test: str, limit: float) -> str:
    return _SIDES + f"""SELECT "column", round(score, 6) AS drift_score, score > {limit} AS drift_detected,
'{test}' AS stattest_name FROM {table}"""


SQL["data_drift_direct"] = _drift("ks", "ks", 0.1)
_EARLY_CODES = CODES.replace("WHERE is_fraud IS NOT NULL", f'WHERE is_fraud IS NOT NULL AND "timestamp" < {MIDDLE}')
_INPUTS = (
    with_(TX, behaviour(), _EARLY_CODES, MATRIX)
    + f""", sides AS (SELECT "timestamp" >= {MIDDLE} AS cur, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MODEL_INPUT)} FROM mx),
long AS (UNPIVOT sides ON {", ".join(MODEL_INPUT)} INTO NAME "column" VALUE v),
"""
    + _SIDES[_SIDES.index("tot AS") :]
)
SQL["data_drift"] = SQL["data_drift_large_groups"] = _INPUTS + """SELECT "column", round(score, 6) AS drift_score,
score > 0.1 AS drift_detected, 'ks' AS stattest_name FROM ks"""
SQL["data_drift_wasserstein"] = _drift("ws", "wasserstein", 0.1)
SQL["data_drift_jensen_shannon"] = _drift("js", "jensen_shannon", 0.1)
SQL["data_drift_psi"] = _drift("psi", "psi", 0.2)
SQL["dataset_drift"] = _INPUTS + """SELECT round(avg(CAST(score > 0.1 AS INTEGER)), 6) AS drift_share,
avg(CAST(score > 0.1 AS INTEGER)) >= 0.25 AS dataset_drift,
coalesce(string_agg("column", ',' ORDER BY "column") FILTER (score > 0.1), '') AS drifted_features FROM ks"""

_MODEL_DRIFT = f"""
mrows AS (SELECT * FROM ph WHERE model_version_id = 2 AND actual_label IS NOT NULL
  AND "timestamp" >= {NOW} - INTERVAL 7 DAY),
mcount AS (SELECT count(*) FILTER (actual_label AND prediction_label) AS tp,
  count(*) FILTER (NOT actual_label AND prediction_label) AS fp,
  count(*) FILTER (actual_label AND NOT prediction_label) AS fn, count(*) AS n FROM mrows),
mprf AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS p, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)
  AS r, coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0) AS f FROM mcount),
mdrift AS (SELECT n AS labeled_rows, n >= 50 AS has_sufficient_data, CASE WHEN n >= 50 THEN md.f1_score END AS reference_f1,
  CASE WHEN n >= 50 THEN f END AS current_f1, CASE WHEN n >= 50 THEN md."precision" END AS reference_precision,
  CASE WHEN n >= 50 THEN p END AS current_precision, CASE WHEN n >= 50 THEN md.recall END AS reference_recall,
  CASE WHEN n >= 50 THEN r END AS current_recall, CASE WHEN n >= 50 THEN f - md.f1_score END AS f1_degradation,
  coalesce(n >= 50 AND f - md.f1_score < -0.05, false) AS drift_detected
  FROM mprf LEFT JOIN md ON md.id = 2)
"""
SQL["model_drift"] = with_(PH, MD, _MODEL_DRIFT) + """SELECT labeled_rows, has_sufficient_data, drift_detected,
round(reference_f1, 6) AS reference_f1, round(current_f1, 6) AS current_f1,
round(reference_precision, 6) AS reference_precision, round(current_precision, 6) AS current_precision,
round(reference_recall, 6) AS reference_recall, round(current_recall, 6) AS current_recall,
round(f1_degradation, 6) AS f1_degradation FROM mdrift"""
_CRITICAL = ["amount_ratio_vs_user_avg", "amount_sum_1h", "is_country_new", "seconds_since_last_tx", "tx_count_1h"]
SQL["drift_report_sink"] = _INPUTS + ", " + ", ".join(x.strip() for x in (PH, MD, _MODEL_DRIFT)) + f"""
, d AS (SELECT avg(CAST(score > 0.1 AS INTEGER)) AS share, max(score) FILTER ("column" = 'tx_count_1h') AS a,
  '[' || string_agg('''' || "column" || '''', ', ' ORDER BY "column") FILTER (score > 0.2 AND "column" IN ({", ".join(f"'{c}'" for c in _CRITICAL)})) || ']' AS crit
  FROM ks)
SELECT {NOW} AS report_date, CAST(2 AS BIGINT) AS model_version_id, round(share, 6) AS drift_score,
  crit IS NOT NULL OR drift_detected OR share > 0.3 AS alert_triggered,
  CASE WHEN crit IS NOT NULL OR drift_detected OR share > 0.3 THEN 'triggered_retraining_dag' END AS remediation_action,
  CASE WHEN crit IS NOT NULL AND drift_detected THEN 'CRITICAL' WHEN crit IS NOT NULL OR drift_detected THEN 'HIGH'
    WHEN share > 0.3 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE WHEN crit IS NOT NULL AND drift_detected
      THEN 'CRITICAL drift: critical features drifted=' || crit || ', model drift detected, global score=' || format('{{:.3f}}', share)
    WHEN crit IS NOT NULL THEN 'High drift: critical features drifted=' || crit || ', global score=' || format('{{:.3f}}', share)
    WHEN drift_detected THEN 'High drift: model F1 degradation=' || format('{{:.3f}}', f1_degradation) || ', global score=' || format('{{:.3f}}', share)
    WHEN share > 0.3 THEN 'Global data drift score=' || format('{{:.3f}}', share) || ' exceeds threshold=0.3'
    ELSE 'Drift within acceptable bounds: global score=' || format('{{:.3f}}', share) END AS alert_message,
  round(a, 6) AS tx_count_1h_drift, CASE WHEN drift_detected THEN 'true' ELSE 'false' END AS model_drift_detected
FROM d, mdrift"""

# ---- scalar functions

SQL["direct_features"] = with_(TX) + """SELECT transaction_id, round(ln(1 + amount), 6) AS log_amount,
hour("timestamp") AS hour_of_day, isodow("timestamp") - 1 AS day_of_week FROM tx"""
SQL["log_amount_clip"] = with_(TX) + """SELECT transaction_id, round(ln(greatest(amount, 1e-9)), 6) AS log_amount FROM tx"""
SQL["cyclic_time"] = with_(TX) + """SELECT transaction_id,
round(sin(2 * pi() * hour("timestamp") / 24), 6) + 0.0 AS hour_sin,
round(cos(2 * pi() * hour("timestamp") / 24), 6) + 0.0 AS hour_cos,
round(sin(2 * pi() * (isodow("timestamp") - 1) / 7), 6) + 0.0 AS dow_sin,
round(cos(2 * pi() * (isodow("timestamp") - 1) / 7), 6) + 0.0 AS dow_cos FROM tx"""
_REQUEST = [f"round(CAST({n} AS DOUBLE), 6) AS {n}" if n in _WINDOW + _PROFILE else shown([n]) for n in _MODEL]
SQL["request_vector"] = _FULL + f"SELECT transaction_id, {', '.join(_REQUEST)} FROM mx"
_SEVERITY = """CASE WHEN prediction_score >= 0.9 THEN 'CRITICAL' WHEN prediction_score >= 0.75 THEN 'HIGH'
ELSE 'WARNING' END"""
SQL["severity"] = with_(PH) + f"SELECT transaction_id, {_SEVERITY} AS severity FROM ph"
_SESSION = "us - (us % 86400000000) % 1800000000"
SQL["sql_functions"] = with_(PH) + f"""SELECT transaction_id, {_SEVERITY} AS severity,
sha256(transaction_id || '|' || CAST(({_SESSION}) // 1000000 AS VARCHAR)) AS session FROM ph"""
SQL["score_label"] = with_(PH) + "SELECT transaction_id, prediction_score >= 0.5 AS prediction_label FROM ph"
SQL["slow_requests"] = with_(PH) + "SELECT transaction_id, latency_ms FROM ph WHERE latency_ms > 40"
SQL["session_bucket"] = with_(TX) + f"""SELECT transaction_id, make_timestamp({_SESSION}) AS session_start,
sha256(user_id || '|' || CAST(({_SESSION}) // 1000000 AS VARCHAR)) AS session FROM tx"""
SQL["epoch_bucket"] = with_(TX) + "SELECT transaction_id, " + ", ".join(
    f"make_timestamp(us - us % {n}000000) AS bucket_{n}" for n in (60, 120, 300)
) + " FROM tx"
_JSON = """js AS (SELECT id, report_date, unnest(['tx_count_1h', 'amount_sum_1h', 'log_amount']) AS feature, feature_drifts FROM dr),
jx AS (SELECT id, report_date, feature,
  CAST(json_extract_string(feature_drifts, '$.data_drift.' || feature || '.drift_score') AS DOUBLE) AS drift_score FROM js)"""
SQL["json_explode"] = with_(DR, _JSON) + "SELECT id, report_date, feature, round(drift_score, 6) AS drift_score FROM jx"
_HOURLY = """hv AS (SELECT date_trunc('hour', "timestamp") AS bucket_hour, count(*) AS total_transactions,
  count(*) FILTER (is_fraud IS TRUE) AS total_fraud_transactions,
  count(*) FILTER (is_fraud IS TRUE) / CAST(nullif(count(*), 0) AS DOUBLE) AS fraud_rate FROM tx GROUP BY 1)"""
SQL["rate_message"] = with_(TX, _HOURLY) + "SELECT bucket_hour, printf('%.2f', fraud_rate * 100) AS message FROM hv"
SQL["safe_ratio"] = with_(TX, _HOURLY) + """SELECT bucket_hour,
round(total_transactions / CAST(nullif(total_fraud_transactions, 0) AS DOUBLE), 6) AS per_fraud FROM hv"""
_UNIT = "count(*) FILTER ({c} IS NOT NULL AND NOT {c} BETWEEN 0 AND 1)"
SQL["constraint_audit"] = with_(TX, MD, PH, DR, AL) + " UNION ALL ".join(
    [
        "SELECT 'model_deployments' AS \"table\", 'training_range' AS rule, count(*) FILTER (training_data_from > training_data_to) AS violations FROM md",
        *[f"SELECT 'model_deployments', '{c}_range', {_UNIT.format(c=q)} FROM md"
          for c, q in (("f1_score", "f1_score"), ("precision", '"precision"'), ("recall", "recall"), ("auc_roc", "auc_roc"))],
        *[f"SELECT '{t}', '{c}_null', count(*) FILTER (\"{c}\" IS NULL) FROM {v}"
          for t, v in (("transactions", "tx"), ("model_deployments", "md"), ("predictions_history", "ph"),
                       ("drift_reports", "dr"), ("alert_log", "al")) for c in NOT_NULL[t]],
        f"SELECT 'predictions_history', 'score_range', {_UNIT.format(c='prediction_score')} FROM ph",
        "SELECT 'predictions_history', 'latency_negative', count(*) FILTER (latency_ms < 0) FROM ph",
        f"SELECT 'drift_reports', 'score_range', {_UNIT.format(c='drift_score')} FROM dr",
        "SELECT 'alert_log', 'severity_domain', count(*) FILTER (severity NOT IN ('INFO','WARNING','HIGH','CRITICAL')) FROM al",
        *[f"SELECT '{t}', '{rule}', count(*) FROM (SELECT {k} FROM {v} GROUP BY 1 HAVING count(*) > 1)"
          for t, v, k, rule in (("model_deployments", "md", "id", "primary_key"),
                                ("model_deployments", "md", "run_id", "run_id_unique"),
                                ("predictions_history", "ph", "id", "primary_key"),
                                ("drift_reports", "dr", "id", "primary_key"),
                                ("alert_log", "al", "id", "primary_key"))],
        "SELECT 'transactions', 'primary_key', count(*) FROM (SELECT 1 FROM tx GROUP BY transaction_id, \"timestamp\" HAVING count(*) > 1)",
        *[f"SELECT '{t}', 'foreign_key', count(*) FROM {v} WHERE model_version_id NOT IN (SELECT id FROM md)"
          for t, v in (("predictions_history", "ph"), ("drift_reports", "dr"))],
    ]
)

# ---- joins

SQL["drift_alert_history"] = with_(DR, MD) + """SELECT report_date, round(drift_score, 4) AS drift_score, alert_triggered,
remediation_action, md.version AS model_version FROM dr JOIN md ON md.id = dr.model_version_id
WHERE alert_triggered ORDER BY report_date DESC, dr.id DESC LIMIT 30"""
SQL["latest_report_features"] = with_(DR, _JSON) + """SELECT feature, round(drift_score, 4) AS drift_score FROM jx
WHERE report_date = (SELECT max(report_date) FROM dr)"""
SQL["recent_open_alert"] = with_(PH, AL) + """SELECT transaction_id, "timestamp" FROM ph WHERE EXISTS (SELECT 1 FROM al
WHERE al.alert_type = 'HIGH_FRAUD_RATE' AND al.acknowledged_at IS NULL
AND al.triggered_at >= ph."timestamp" - INTERVAL 1440 MINUTE)"""
_NOT_AR = """g2 AS (SELECT avg(CAST(is_fraud AS INTEGER)) AS g FROM tx WHERE is_fraud IS NOT NULL AND country <> 'AR'),
c2 AS (SELECT country AS cat, (sum(CAST(is_fraud AS INTEGER)) + 10 * any_value(g)) / (count(*) + 10) AS code
  FROM tx, g2 WHERE is_fraud IS NOT NULL AND country <> 'AR' GROUP BY 1)"""
SQL["encode_lookup"] = with_(TX, _NOT_AR) + """SELECT transaction_id, round(coalesce(code, -1.0), 6) AS country_encoded
FROM tx LEFT JOIN c2 ON cat = country"""
SQL["label_backfill"] = with_(TX, PH) + """SELECT ph.transaction_id, prediction_label, tx.is_fraud AS actual_label
FROM ph LEFT JOIN tx USING (transaction_id)"""
SQL["txn_vs_pred_rate"] = with_(TX, PH) + """, a AS (SELECT us - us % 120000000 AS b, count(*) AS transactions FROM tx GROUP BY 1),
p AS (SELECT us - us % 120000000 AS b, count(*) AS predictions FROM ph WHERE prediction_label GROUP BY 1)
SELECT make_timestamp(b) AS time, transactions, predictions FROM a FULL JOIN p USING (b)"""

# ---- per-user features

SQL["featurize"] = _FULL + f'SELECT transaction_id, user_id, "timestamp", is_fraud, {shown(_DIRECT + _WINDOW + _PROFILE)} FROM mx'
SQL["featurize_large_groups"] = SQL["featurize"]
SQL["featurize_ties"] = SQL["featurize_ties_large_groups"] = _SHIP + _BEHAVIOUR
_ARRIVAL = with_(
    SHIP,
    """one AS (SELECT * FROM ship QUALIFY row_number() OVER (PARTITION BY transaction_id, us ORDER BY user_id,
       merchant_id, merchant_category, amount, country, device_type, is_fraud) = 1)""",
    """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, transaction_id) AS pos,
       row_number() OVER (PARTITION BY user_id, country ORDER BY us, transaction_id) = 1 AS nc,
       row_number() OVER (PARTITION BY user_id, merchant_id ORDER BY us, transaction_id) = 1 AS nm FROM one),
    b AS (SELECT *, count(*) OVER h - count(*) OVER t + pos - first_value(pos) OVER t AS n1,
       count(*) OVER d - count(*) OVER t + pos - first_value(pos) OVER t AS n24,
       count(*) OVER w - count(*) OVER t + pos - first_value(pos) OVER t AS n7,
       CAST(sum(c) OVER h - sum(c) OVER t + sum(c) OVER e - c AS BIGINT) AS c1,
       CAST(sum(c) OVER d - sum(c) OVER t + sum(c) OVER e - c AS BIGINT) AS c24,
       lag(us) OVER o AS last_us, CAST(coalesce(sum(c) OVER q, 0) AS BIGINT) AS total,
       count(*) FILTER (nc) OVER q AS dc, count(*) FILTER (nm) OVER q AS dm FROM n
       WINDOW h AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW),
              d AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW),
              w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW),
              t AS (PARTITION BY user_id, us ORDER BY transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
              e AS (PARTITION BY user_id, us ORDER BY transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              o AS (PARTITION BY user_id ORDER BY us, transaction_id),
              q AS (PARTITION BY user_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
SQL["featurize_arrival"] = SQL["featurize_arrival_large_groups"] = _ARRIVAL + """SELECT transaction_id, user_id, "timestamp",
n1 AS tx_count_1h, n24 AS tx_count_24h, n7 AS tx_count_7d, round(c1 / CAST(100 AS DOUBLE), 6) AS amount_sum_1h,
round(c24 / CAST(100 AS DOUBLE), 6) AS amount_sum_24h, round(n1 / CAST(60 AS DOUBLE), 6) AS tx_velocity_1h,
round(coalesce((us - last_us) / CAST(1000000 AS DOUBLE), -1.0), 6) AS seconds_since_last_tx,
round(CASE WHEN total > 0 THEN amount / (total / CAST(100 AS DOUBLE) / (pos - 1)) ELSE 1.0 END, 6) AS amount_ratio_vs_user_avg,
CAST(nc AS DOUBLE) AS is_country_new, dc AS distinct_countries_seen, CAST(nm AS DOUBLE) AS is_merchant_new,
dm AS distinct_merchants_seen FROM b"""
for _name in _WINDOW + _PROFILE:
    SQL[_name] = _FEATURES + f"SELECT transaction_id, {shown([_name])} FROM feat"
SQL["select_columns"] = SQL["reference_snapshot"]
SQL["user_profile"] = with_(TX) + """SELECT user_id, round(CAST(sum(c) AS BIGINT) / CAST(100 AS DOUBLE), 6) AS amount_total,
count(*) AS amount_count, string_agg(DISTINCT country, ',' ORDER BY country) AS countries_seen,
string_agg(DISTINCT merchant_id, ',' ORDER BY merchant_id) AS merchants_seen FROM tx GROUP BY 1"""
SQL["user_window"] = with_(TX) + f"""SELECT transaction_id, user_id FROM tx
WHERE "timestamp" BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, transaction_id DESC) <= 500"""
SQL["hydrate_filter"] = with_(TX) + f"""SELECT transaction_id, user_id, "timestamp" FROM tx
WHERE "timestamp" BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW}"""

# ---- fraud patterns

_PATTERNS = f"""
home AS (SELECT user_id, country AS home FROM (SELECT user_id, country, count(*) AS n FROM tx GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, country) = 1),
reg AS (SELECT unnest(['AR','BR','MX','CL','CO','PE','UY','PY','BO','US','ES','UK','FR','DE']) AS cc,
  unnest([1,1,1,1,1,1,1,1,1,2,2,2,2,2]) AS region),
unusual AS (SELECT f.transaction_id, f.user_id, f."timestamp" FROM feat f JOIN home h USING (user_id)
  JOIN reg a ON a.cc = f.country JOIN reg b ON b.cc = h.home WHERE f.is_country_new = 1 AND a.region <> b.region)"""
_K = 'transaction_id, user_id, "timestamp"'
SQL["detect_amount_anomaly"] = _FEATURES + f"SELECT {_K} FROM feat WHERE amount_ratio_vs_user_avg >= 3 AND amount >= 100"
SQL["detect_unusual_country"] = _FEATURES.rstrip() + "," + _PATTERNS + f" SELECT {_K} FROM unusual"


def _frequent(source: str) -> str:
    return f"""freq AS (SELECT {_K}, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1800000000 PRECEDING
  AND CURRENT ROW) AS tx_in_window FROM {source} QUALIFY tx_in_window >= 5)"""


SQL["detect_high_frequency"] = SQL["detect_high_frequency_large_groups"] = (
    with_(BUY, _frequent("buy")) + f"SELECT {_K}, tx_in_window FROM freq"
)
SQL["burst_users"] = with_(BUY) + """SELECT user_id, count(*) AS tx_count FROM buy
WHERE "timestamp" >= TIMESTAMP '2001-07-01 00:30:00' - INTERVAL 30 DAY GROUP BY 1 HAVING count(*) >= 5"""
SQL["detect_unknown_merchant_high"] = _FEATURES + f"SELECT {_K} FROM feat WHERE is_merchant_new = 1 AND amount >= 100"
SQL["detect_any"] = _FEATURES.rstrip() + "," + _PATTERNS + "," + _frequent("tx") + f""",
hits AS (SELECT {_K}, 'amount_anomaly' AS p FROM feat WHERE amount_ratio_vs_user_avg >= 5 AND amount >= 300
  UNION ALL SELECT {_K}, 'unusual_country' FROM unusual UNION ALL SELECT {_K}, 'high_frequency' FROM freq
  UNION ALL SELECT {_K}, 'unknown_merchant_high_amount' FROM feat WHERE is_merchant_new = 1 AND amount >= 300)
SELECT {_K}, string_agg(DISTINCT p, ',' ORDER BY p) AS patterns, count(*) AS pattern_count FROM hits GROUP BY 1, 2, 3"""

# ---- aggregations

_HV = "bucket_hour, total_transactions, total_fraud_transactions, round(fraud_rate, 6) AS fraud_rate FROM hv"
SQL["fraud_volume_hourly"] = SQL["continuous_hourly"] = with_(TX, _HOURLY) + f"SELECT {_HV}"
SQL["fraud_volume_24h"] = with_(TX, _HOURLY) + f"SELECT {_HV} WHERE bucket_hour >= {NOW} - INTERVAL 24 HOUR"
_DAILY = """dd AS (SELECT date_trunc('day', "timestamp")::TIMESTAMP AS bucket_day, merchant_id,
  round(CAST(sum(c) AS BIGINT) / CAST(100 AS DOUBLE), 6) AS total_amount, count(*) AS transaction_count FROM tx GROUP BY 1, 2)"""
SQL["merchant_amount_daily"] = with_(TX, _DAILY) + "SELECT * FROM dd"
SQL["merchant_daily_top50"] = with_(TX, _DAILY) + f"""SELECT * FROM dd WHERE bucket_day >= {NOW} - INTERVAL 7 DAY
ORDER BY total_amount DESC, bucket_day, merchant_id LIMIT 50"""
# buckets before the window come from the stored part, those inside are recomputed, later ones are not there yet
SQL["refresh_aggregate"] = with_(TX, _HOURLY) + f"SELECT {_HV} WHERE bucket_hour < TIMESTAMP '2024-01-30 23:00:00'"
SQL["top_merchants_fraud"] = with_(TX) + f"""SELECT merchant_id, merchant_category, count(*) FILTER (is_fraud IS TRUE) AS fraud_count,
count(*) AS total_count, round(count(*) FILTER (is_fraud IS TRUE) / CAST(count(*) AS DOUBLE) * 100, 2) AS fraud_rate_pct
FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR GROUP BY 1, 2 ORDER BY fraud_count DESC, merchant_id, merchant_category LIMIT 10"""
SQL["fraud_rate_1h"] = with_(PH) + f"""SELECT round(count(*) FILTER (prediction_label) / CAST(nullif(count(*), 0) AS DOUBLE) * 100, 6)
AS fraud_rate_pct FROM ph WHERE "timestamp" >= {NOW} - INTERVAL 1 HOUR"""
SQL["volume_per_minute"] = with_(PH) + """SELECT make_timestamp(us - us % 60000000) AS time, count(*) AS total,
count(*) FILTER (prediction_label) AS fraud FROM ph GROUP BY 1"""
SQL["fraud_count_1h"] = with_(PH) + f"""SELECT count(*) FILTER (prediction_label) AS fraud_count FROM ph
WHERE "timestamp" >= {NOW} - INTERVAL 1 HOUR"""
SQL["txn_total_1h"] = with_(TX, _HOURLY) + f"""SELECT CAST(sum(total_transactions) AS BIGINT) AS total_transactions FROM hv
WHERE bucket_hour >= {NOW} - INTERVAL 1 HOUR"""
SQL["volume_24h"] = with_(TX, PH) + f"""SELECT 'transactions' AS series, count(*) AS n FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR
UNION ALL SELECT 'predictions', count(*) FROM ph WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR"""
SQL["txn_2min"] = with_(TX) + "SELECT make_timestamp(us - us % 120000000) AS time, count(*) AS transactions FROM tx GROUP BY 1"
SQL["pred_2min"] = with_(PH) + "SELECT make_timestamp(us - us % 120000000) AS time, count(*) AS predictions FROM ph GROUP BY 1"


def _latency(width: int) -> str:
    return with_(PH) + f"""SELECT make_timestamp(us - us % {width}000000) AS time,
round(percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms), 6) AS p50_ms,
round(percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms), 6) AS p95_ms,
round(percentile_cont(0.99) WITHIN GROUP (ORDER BY latency_ms), 6) AS p99_ms FROM ph GROUP BY 1"""


SQL["latency_percentiles"] = _latency(300)
SQL["latency_percentiles_large_groups"] = _latency(864000)
SQL["drift_alerts_7d"] = with_(DR) + f"SELECT count(*) AS alerts FROM dr WHERE alert_triggered AND report_date >= {NOW} - INTERVAL 7 DAY"
SQL["labeled_summary"] = with_(TX) + """SELECT count(*) AS row_count, min("timestamp") AS data_from, max("timestamp") AS data_to,
count(*) >= 1000 AS enough FROM tx WHERE is_fraud IS NOT NULL"""
SQL["seed_summary"] = with_(TX) + """, t AS (SELECT count(*) AS total, count(*) FILTER (is_fraud IS TRUE) AS total_fraud,
min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM tx)
SELECT country, count(*) AS n, round(count(*) / CAST(any_value(total) AS DOUBLE) * 100, 1) AS share_pct,
any_value(total) AS total, any_value(total_fraud) AS total_fraud, any_value(min_ts) AS min_ts, any_value(max_ts) AS max_ts
FROM tx, t GROUP BY 1"""
SQL["class_distribution"] = with_(TX) + """, n AS (SELECT count(*) FILTER (is_fraud IS TRUE) AS f, count(*) AS t FROM tx)
SELECT 'fraud' AS class, f AS count, round(f / CAST(t AS DOUBLE) * 100, 2) AS percent FROM n
UNION ALL SELECT 'legit', t - f, round((t - f) / CAST(t AS DOUBLE) * 100, 2) FROM n"""
SQL["amount_stats"] = with_(TX) + """SELECT coalesce(is_fraud, false) AS is_fraud, round(avg(amount), 6) AS mean,
round(stddev_samp(amount), 6) AS std, min(amount) AS min, max(amount) AS max,
round(percentile_cont(0.5) WITHIN GROUP (ORDER BY amount), 6) AS median,
round(percentile_cont(0.95) WITHIN GROUP (ORDER BY amount), 6) AS p95,
round(percentile_cont(0.99) WITHIN GROUP (ORDER BY amount), 6) AS p99 FROM tx GROUP BY 1"""
SQL["amount_histogram"] = with_(TX) + """, a AS (SELECT coalesce(is_fraud, false) AS y, amount FROM tx WHERE amount > 0),
l AS (SELECT y, min(amount) AS lo, (max(amount) - min(amount)) / CAST(50 AS DOUBLE) AS w FROM a GROUP BY 1),
b AS (SELECT y, lo, w, CAST(coalesce(least(floor((amount - lo) / nullif(w, 0)), 49), 0) AS INTEGER) AS bin FROM a JOIN l USING (y))
SELECT y AS is_fraud, bin, round(any_value(lo + bin * w), 6) AS bin_from, count(*) AS count FROM b GROUP BY 1, 2"""


def _domain(key: str, size: int, name: str) -> str:
    return with_(TX) + f""", g AS (SELECT {key} AS k, count(*) AS t, count(*) FILTER (is_fraud IS TRUE) AS f FROM tx GROUP BY 1),
z AS (SELECT range AS k, coalesce(t, 0) AS t, coalesce(f, 0) AS f, f * CAST(100 AS DOUBLE) / nullif(t, 0) AS rate
  FROM range({size}) LEFT JOIN g ON g.k = range)
SELECT k AS {name}, t AS total, f AS fraud, round(rate, 6) AS fraud_rate_pct,
coalesce(k = (SELECT k FROM z WHERE rate IS NOT NULL ORDER BY rate DESC, k LIMIT 1), false) AS is_peak,
coalesce(k = (SELECT k FROM z WHERE rate IS NOT NULL ORDER BY rate, k LIMIT 1), false) AS is_low FROM z"""


SQL["by_hour"] = _domain('hour("timestamp")', 24, "hour")
SQL["by_dow"] = _domain('isodow("timestamp") - 1', 7, "dow")
for _query, _column, _limit in (("by_country", "country", 10), ("by_category", "merchant_category", 10),
                                ("by_device", "device_type", 1000000)):
    SQL[_query] = with_(TX) + f"""SELECT {_column}, count(*) AS count,
round(count(*) FILTER (is_fraud IS TRUE) / CAST(count(*) AS DOUBLE), 6) AS fraud_rate
FROM tx GROUP BY 1 ORDER BY count DESC, {_column} LIMIT {_limit}"""
SQL["daily_series"] = with_(TX) + """, d AS (SELECT date_trunc('day', "timestamp")::TIMESTAMP AS date, count(*) AS total,
count(*) FILTER (is_fraud IS TRUE) AS fraud, count(*) FILTER (is_fraud IS TRUE) / CAST(count(*) AS DOUBLE) * 100 AS rate
FROM tx GROUP BY 1), s AS (SELECT avg(rate) AS m, stddev_samp(rate) AS sd FROM d)
SELECT date, total, fraud, round(rate, 6) AS fraud_rate_pct, coalesce(rate > m + 2 * sd, false) AS is_outlier FROM d, s"""
_CELLS = """cell AS (SELECT hour("timestamp") AS hour, isodow("timestamp") - 1 AS dow,
  avg(CAST(coalesce(is_fraud, false) AS INTEGER)) * 100 AS rate FROM tx GROUP BY 1, 2)"""
_DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
SQL["heatmap_hour_dow"] = with_(TX, _CELLS) + "SELECT range AS hour, " + ", ".join(
    f'round(max(rate) FILTER (dow = {i}), 6) AS "{d}"' for i, d in enumerate(_DAYS)
) + " FROM range(24) LEFT JOIN cell ON cell.hour = range GROUP BY 1"
SQL["top_combos"] = with_(TX, _CELLS) + f"""SELECT hour, ({_DAYS})[dow + 1] AS day, round(rate, 6) AS fraud_rate_pct FROM cell
ORDER BY round(rate, 9) DESC, hour, day LIMIT 5"""
SQL["describe"] = with_(TX) + """, v AS (SELECT amount, ln(1 + amount) AS log_amount, CAST(hour("timestamp") AS DOUBLE) AS hour_of_day FROM tx),
l AS (UNPIVOT v ON amount, log_amount, hour_of_day INTO NAME "column" VALUE x)
SELECT "column", count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
round(max(x), 6) AS max, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY x), 6) AS p25,
round(percentile_cont(0.5) WITHIN GROUP (ORDER BY x), 6) AS p50, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY x), 6) AS p75
FROM l GROUP BY 1"""
SQL["missing_domain"] = with_(TX) + """SELECT count(*) AS total, count(*) FILTER (is_fraud IS NULL) AS unlabelled,
count(*) FILTER (is_fraud IS TRUE) AS fraud, round(count(*) FILTER (is_fraud IS TRUE) / CAST(count(*) AS DOUBLE), 6) AS rate_of_all,
round(avg(CAST(is_fraud AS INTEGER)), 6) AS rate_of_labelled FROM tx"""

# ---- newest rows

SQL["recent_alerts"] = with_(AL) + """SELECT triggered_at, alert_type, severity, message FROM al
ORDER BY triggered_at DESC, id DESC LIMIT 50"""
SQL["latest_drift"] = with_(DR) + """SELECT CASE WHEN drift_score >= 0.30 THEN 'DRIFT' WHEN drift_score >= 0.20 THEN 'WARNING'
ELSE 'OK' END AS status, round(drift_score, 4) AS drift_score FROM dr ORDER BY report_date DESC, id DESC LIMIT 1"""
SQL["drift_series"] = with_(DR) + """SELECT report_date AS time, drift_score, CASE WHEN alert_triggered THEN drift_score END
AS alert_score FROM dr"""
SQL["score_series"] = with_(PH) + 'SELECT "timestamp" AS time, round(prediction_score, 6) AS score FROM ph'
SQL["active_model"] = with_(MD) + """SELECT id, version, f1_score, auc_roc, "precision", recall, training_data_to FROM md
WHERE is_active ORDER BY created_at DESC, id DESC LIMIT 1"""
SQL["champion_challenger"] = with_(MD) + """SELECT version, CASE WHEN is_active THEN 'Champion' ELSE 'Challenger' END AS role,
round(f1_score, 4) AS f1_score, round("precision", 4) AS "precision", round(recall, 4) AS recall, round(auc_roc, 4) AS auc_roc,
created_at FROM md ORDER BY created_at DESC, id DESC LIMIT 5"""

# ---- feature statistics and preparation

SQL["target_encode_fit"] = with_(TX, CODES) + """SELECT cat AS category, round(code, 6) AS code FROM mc
UNION ALL SELECT NULL, round(g, 6) FROM gm"""
SQL["target_encode"] = with_(TX, _NOT_AR) + """SELECT transaction_id, round(coalesce(code, g), 6) AS country_encoded
FROM tx CROSS JOIN g2 LEFT JOIN c2 ON cat = country"""
SQL["ordinal_encode_fit"] = with_(TX) + """SELECT merchant_id AS category, row_number() OVER (ORDER BY min(us)) - 1 AS code
FROM tx GROUP BY 1"""
SQL["ordinal_encode"] = with_(TX) + """, d AS (SELECT device_type AS cat, row_number() OVER (ORDER BY min(us)) - 1 AS code
FROM tx WHERE device_type <> 'pos' GROUP BY 1)
SELECT transaction_id, coalesce(code, -1) AS device_type_encoded FROM tx LEFT JOIN d ON cat = device_type"""
SQL["label_encode"] = with_(TX) + "SELECT transaction_id, dense_rank() OVER (ORDER BY merchant_id) - 1 AS merchant_id_enc FROM tx"
_CODED = """SELECT transaction_id, round(coalesce(mc.code, g), 6) AS merchant_category_encoded,
round(coalesce(co.code, g), 6) AS country_encoded, coalesce(dv.code, -1) AS device_type_encoded
FROM {all} CROSS JOIN gm LEFT JOIN mc ON mc.cat = merchant_category LEFT JOIN co ON co.cat = country LEFT JOIN dv ON dv.cat = device_type"""
SQL["encoder_set"] = with_(TX, CODES) + _CODED.format(all="tx")
SQL["encoder_set_until"] = (
    with_(TX.replace("tx AS", "alltx AS", 1), f'tx AS (SELECT * FROM alltx WHERE "timestamp" < {MIDDLE})', CODES)
    + _CODED.format(all="alltx")
)
_CORRELATED = ["amount", "log_amount", "hour_of_day", "day_of_week", "tx_count_7d", "amount_sum_24h"]
_WIDE = _FEATURES + """, wide AS (SELECT *, ln(1 + amount) AS log_amount, hour("timestamp") AS hour_of_day,
isodow("timestamp") - 1 AS day_of_week FROM feat)
"""


def _corr(columns: list[str], keep) -> str:
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns)) if keep(i, j)]
    one = ", ".join(f"corr({columns[i]}, {columns[j]}) AS r_{i}_{j}" for i, j in pairs)
    rows = " UNION ALL ".join(
        f"SELECT '{columns[i]}' AS a, '{columns[j]}' AS b, round(r_{i}_{j}, 6) + 0.0 AS r FROM one" for i, j in pairs
    )
    return f", one AS (SELECT {one} FROM wide), cm AS ({rows})"


SQL["correlation_matrix"] = _WIDE + _corr(_CORRELATED, lambda i, j: True) + " SELECT a, b, r FROM cm"
SQL["redundant_pairs"] = (
    _WIDE + _corr([*_CORRELATED, "tx_count_24h"], lambda i, j: i < j) + " SELECT a, b, r FROM cm WHERE abs(r) > 0.5"
)
SQL["scale_pos_weight"] = with_(TX) + """SELECT count(*) FILTER (is_fraud) AS positives, count(*) FILTER (NOT is_fraud) AS negatives,
round(count(*) FILTER (NOT is_fraud) / CAST(count(*) FILTER (is_fraud) AS DOUBLE), 6) AS scale_pos_weight FROM tx"""
SQL["smote_class_counts"] = with_(TX) + """, n AS (SELECT count(*) FILTER (is_fraud) AS p, count(*) FILTER (NOT is_fraud) AS q FROM tx)
SELECT 0 AS label, false AS synthetic, q AS n FROM n UNION ALL SELECT 1, false, p FROM n
UNION ALL SELECT 1, true, CAST(floor(q * CAST(0.1 AS DOUBLE)) AS BIGINT) - p FROM n WHERE CAST(floor(q * CAST(0.1 AS DOUBLE)) AS BIGINT) > p"""
_NUMBERED = """num AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) - 1 AS i, count(*) OVER () AS n
  FROM {src} WHERE is_fraud IS NOT NULL {more})"""
_PART = """CASE WHEN i >= floor(n * CAST(0.85 AS DOUBLE)) THEN 'test' WHEN i >= floor(n * CAST(0.7 AS DOUBLE)) THEN 'validation'
ELSE 'train' END AS split"""
SQL["temporal_split"] = with_(TX, _NUMBERED.format(src="tx", more="")) + f"SELECT transaction_id, {_PART} FROM num"
SQL["temporal_split_ties"] = with_(
    SHIP,
    "one AS (SELECT transaction_id, us, \"timestamp\", any_value(is_fraud) AS is_fraud FROM ship GROUP BY 1, 2, 3)",
    _NUMBERED.format(src="one", more=""),
    f"parts AS (SELECT *, {_PART} FROM num)",
) + 'SELECT split, count(*) AS n, min("timestamp") AS first, max("timestamp") AS last FROM parts GROUP BY 1'
SQL["test_slice"] = with_(TX, _NUMBERED.format(
    src="tx", more="AND \"timestamp\" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-27 00:00:00'"
)) + 'SELECT transaction_id, "timestamp" FROM num WHERE i >= floor(n * CAST(0.85 AS DOUBLE))'
SQL["global_row_index"] = with_(TX) + """SELECT transaction_id, "timestamp",
row_number() OVER (ORDER BY us, transaction_id) - 1 AS row_index FROM tx"""

# ---- evaluation

_SC = with_(PH, "sc AS (SELECT CAST(actual_label AS INTEGER) AS y, prediction_score AS s FROM ph WHERE actual_label IS NOT NULL)")


def _confusion(threshold: float) -> str:
    return f""", cf AS (SELECT count(*) FILTER (s >= {threshold} AND y = 1) AS tp, count(*) FILTER (s >= {threshold} AND y = 0) AS fp,
count(*) FILTER (s < {threshold} AND y = 0) AS tn, count(*) FILTER (s < {threshold} AND y = 1) AS fn FROM sc)
"""


_F1 = "coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)"
_PRF = f"""round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS "precision",
round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, round({_F1}, 6) AS f1_score"""
SQL["confusion"] = _SC + _confusion(0.5) + "SELECT * FROM cf"
SQL["binary_metrics"] = _SC + _confusion(0.3) + f"""SELECT tp, fp, tn, fn, {_PRF},
round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 6) AS fpr, round(coalesce(fn / CAST(nullif(fn + tp, 0) AS DOUBLE), 0), 6) AS fnr,
CAST(0.3 AS DOUBLE) AS threshold, CAST(fn * 100 + fp * 5 AS DOUBLE) AS total_cost,
round((fn * 100 + fp * 5) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS cost_per_transaction,
round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS fraud_detected_pct,
round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 6) AS legitimate_blocked_pct FROM cf"""
_AUC = """, rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / CAST(2 AS DOUBLE) AS r FROM sc),
auc AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / CAST(2 AS DOUBLE))
  / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS a FROM rk)
"""
SQL["roc_auc"] = SQL["roc_auc_large_groups"] = _SC + _AUC + "SELECT round(a, 6) AS roc_auc FROM auc"
_CURVE = """, gs AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sc GROUP BY 1),
cu AS (SELECT s, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM gs WINDOW w AS (ORDER BY s DESC))
"""
SQL["pr_auc"] = _SC + _CURVE + "SELECT round(sum(pos * tp / (tp + fp)) / any_value(p), 6) AS pr_auc FROM cu"
SQL["roc_curve"] = _SC + _CURVE + """SELECT round(s, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cu
UNION ALL SELECT NULL, 0.0, 0.0"""
SQL["pr_curve"] = _SC + _CURVE + """SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / p, 6) AS recall
FROM cu UNION ALL SELECT NULL, 1.0, 0.0"""
_GRID = """, grid AS (SELECT round(0.10 + range * 0.01, 10)::DOUBLE AS threshold FROM range(81)),
gm81 AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp,
  count(*) FILTER (s < threshold AND y = 1) AS fn, count(*) FILTER (s < threshold AND y = 0) AS tn FROM grid, sc GROUP BY 1)
"""
SQL["threshold_metrics"] = _SC + _GRID + f"SELECT threshold, tp, fp, fn, tn, {_PRF} FROM gm81"
SQL["optimal_threshold"] = _SC + _GRID + """SELECT threshold, CAST(fn * 100 + fp * 5 AS DOUBLE) AS total_cost FROM gm81
ORDER BY 2, 1 LIMIT 1"""
SQL["quality_gates"] = _SC + _AUC + _confusion(0.5) + f""", g AS (SELECT {_F1} AS f1, a,
  (SELECT percentile_cont(0.99) WITHIN GROUP (ORDER BY latency_ms) FROM ph) AS lat FROM cf, auc)
SELECT round(f1, 6) AS f1_score, round(a, 6) AS auc_roc, round(lat, 6) AS latency_p99_ms, f1 >= 0.3 AS f1_passed,
a >= 0.9 AS auc_roc_passed, lat <= 50 AS latency_passed, f1 >= 0.3 AND a >= 0.9 AND lat <= 50 AS passed FROM g"""
SQL["champion_compare"] = with_(MD) + """, ch AS (SELECT f1_score AS c, auc_roc AS ca FROM md WHERE NOT is_active
ORDER BY created_at DESC, id DESC LIMIT 1), cp AS (SELECT f1_score AS p, auc_roc AS pa FROM md WHERE is_active)
SELECT c AS challenger_f1, ca AS challenger_auc_roc, p AS champion_f1, pa AS champion_auc_roc, round(c - p, 6) AS f1_difference,
c >= p - 0.02::DOUBLE AS challenger_wins, CASE WHEN c >= p - 0.02::DOUBLE
THEN printf('Challenger F1 (%.4f) is within acceptable range of champion F1 (%.4f) — max allowed regression: 0.02 (diff: %+.4f)', c, p, c - p)
ELSE printf('Challenger F1 (%.4f) regresses champion F1 (%.4f) by more than 0.02 (diff: %+.4f)', c, p, c - p) END AS reason
FROM ch, cp"""
SQL["promote_model"] = with_(MD) + f"""SELECT id, model_name, version, run_id, created_at, false AS is_active, f1_score, "precision", recall,
auc_roc, training_data_from, training_data_to FROM md UNION ALL SELECT (SELECT max(id) + 1 FROM md), 'payment-fraud', 'new',
'run_new', {NOW}, true, 0.5, 0.6, 0.4, 0.9, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 00:00:00'"""
SQL["promote_model_known_run"] = with_(MD) + "SELECT id, run_id, run_id = 'run_4' AS is_active FROM md"

# ---- drift and data quality

SQL["drift_rows_guard"] = with_(TX) + f"""SELECT count(*) AS row_count, count(*) >= 100 AS enough FROM tx
WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR"""
SQL["drift_policy"] = with_(DR) + """, j AS (SELECT id, drift_score, k / CAST(100 AS DOUBLE) > 0.2 AS t,
  (k * 7) % 100 / CAST(100 AS DOUBLE) > 0.2 AS a, k % 2 = 0 AS m, CAST('-0.' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') AS DOUBLE) AS d FROM dr),
l AS (SELECT *, t OR a AS crit, '[' || concat_ws(', ', CASE WHEN a THEN '''amount_sum_1h''' END,
  CASE WHEN t THEN '''tx_count_1h''' END) || ']' AS names, printf('%.3f', drift_score) AS s FROM j),
v AS (SELECT *, CASE WHEN crit AND m THEN 'CRITICAL' WHEN crit OR m THEN 'HIGH' WHEN drift_score > 0.3 THEN 'WARNING'
  ELSE 'INFO' END AS severity FROM l)
SELECT id, severity, CASE
  WHEN crit AND m THEN 'CRITICAL drift: critical features drifted=' || names || ', model drift detected, global score=' || s
  WHEN crit THEN 'High drift: critical features drifted=' || names || ', global score=' || s
  WHEN m THEN 'High drift: model F1 degradation=' || printf('%.3f', d) || ', global score=' || s
  WHEN drift_score > 0.3 THEN 'Global data drift score=' || s || ' exceeds threshold=0.3'
  ELSE 'Drift within acceptable bounds: global score=' || s END AS alert_message,
  severity <> 'INFO' AS alert_triggered, severity <> 'INFO' AS trigger_retraining,
  CASE WHEN severity <> 'INFO' THEN 'triggered_retraining_dag' END AS remediation_action FROM v"""


def _low(view: str, minimum: int, kind: str, noun: str) -> str:
    return f""", q AS (SELECT count(*) AS n FROM {view} WHERE "timestamp" >= {NOW} - INTERVAL 1 HOUR)
SELECT n AS count, n < {minimum} AS alert_triggered, CASE WHEN n < {minimum} THEN '{kind}' END AS alert_type,
CASE WHEN n < {minimum} THEN 'WARNING' END AS severity,
CASE WHEN n < {minimum} THEN 'Only ' || n || ' {noun} in last hour (min: {minimum})' END AS message FROM q"""


SQL["dq_volume"] = with_(TX) + _low("tx", 100, "LOW_TRANSACTION_VOLUME", "transactions")
SQL["dq_predictions"] = with_(PH) + _low("ph", 5, "LOW_PREDICTION_RATE", "predictions")
_AMOUNT = f"""aq AS (SELECT count(*) AS n, CAST(sum(c) AS BIGINT) / CAST(100 AS DOUBLE) / count(*) AS a, coalesce(stddev_samp(amount), 0) AS s,
  max(amount) AS m FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR)"""
SQL["dq_amount"] = with_(TX, _AMOUNT) + """, b AS (SELECT *, coalesce(n >= 10 AND (a < 1 OR m > 100), false) AS bad FROM aq)
SELECT n AS row_count, CASE WHEN n >= 10 THEN 'ok' ELSE 'insufficient_data' END AS status,
CASE WHEN n >= 10 THEN round(a, 6) END AS avg_amount, CASE WHEN n >= 10 THEN round(s, 6) END AS std_amount,
CASE WHEN n >= 10 THEN m END AS max_amount, bad AS alert_triggered,
CASE WHEN bad THEN 'ANOMALOUS_AMOUNT_DISTRIBUTION' END AS alert_type, CASE WHEN bad THEN 'HIGH' END AS severity,
CASE WHEN bad THEN printf('Anomalous amount distribution: avg=%.2f, max=%.2f', a, m) END AS message FROM b"""
SQL["dq_summary"] = with_(TX, PH, _AMOUNT) + f""", c AS (
  SELECT (SELECT count(*) FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 1 HOUR) AS t,
  (SELECT count(*) FROM ph WHERE "timestamp" >= {NOW} - INTERVAL 1 HOUR) AS p,
  CASE WHEN n >= 10 THEN printf('%.2f', a) ELSE 'N/A (insufficient data)' END AS s FROM aq)
SELECT t AS transaction_count, p AS prediction_count, s AS amount_avg,
'transactions: ' || t || '/h, predictions: ' || p || '/h, amount_avg: ' || s AS summary FROM c"""
SQL["rule_fraud_rate"] = with_(TX, _HOURLY) + f""", q AS (SELECT max_by(fraud_rate, bucket_hour) * 100 AS v FROM hv
WHERE bucket_hour >= {NOW} - INTERVAL 1 HOUR) SELECT round(v, 6) AS value, coalesce(v > 5, false) AS firing FROM q"""
SQL["rule_fraud_spike"] = with_(TX) + f""", q AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM tx WHERE is_fraud
AND "timestamp" >= {NOW} - INTERVAL 6 HOUR) SELECT v AS value, v > 1 AS firing FROM q"""
SQL["rule_drift"] = with_(DR) + f""", q AS (SELECT max_by(drift_score, report_date) AS v FROM dr
WHERE report_date >= {NOW} - INTERVAL 24 HOUR) SELECT v AS value, coalesce(v > 0.3, false) AS firing FROM q"""
SQL["rule_drift_stale"] = with_(DR) + f""", q AS (SELECT coalesce((epoch_us({NOW}) - epoch_us(max(report_date))) / CAST(3600000000 AS DOUBLE),
9999) AS v FROM dr) SELECT round(v, 6) AS value, v > 24 AS firing FROM q"""
SQL["rule_hold"] = SQL["rule_hold_large_groups"] = with_(PH) + """, t AS (SELECT us - us % 600000000 AS tick, count(*) AS n,
count(*) FILTER (prediction_label) AS f FROM ph GROUP BY 1),
h AS (SELECT tick, sum(CASE WHEN tick - coalesce(prev, 0) > 600000000 THEN 1 ELSE 0 END) OVER (ORDER BY tick) AS run FROM
  (SELECT tick, lag(tick) OVER (ORDER BY tick) AS prev FROM t WHERE f / CAST(n AS DOUBLE) > 0.1)),
s AS (SELECT tick, (tick - min(tick) OVER (PARTITION BY run)) // 1000000 AS held FROM h)
SELECT make_timestamp(tick) AS time, held AS held_seconds FROM s WHERE held >= 1200"""
_RATE = """, pt AS (SELECT us, count(*) OVER w AS n, count(*) FILTER (prediction_label) OVER w AS f FROM ph
  WINDOW w AS (ORDER BY us RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW)),
cand AS (SELECT DISTINCT us, n, f FROM pt WHERE f / CAST(n AS DOUBLE) > 0.4),
walk(us) AS (SELECT min(us) FROM cand UNION ALL
  SELECT (SELECT min(c.us) FROM cand c WHERE c.us > w.us + 900000000) FROM walk w WHERE w.us IS NOT NULL)
"""
SQL["fraud_rate_alerts"] = SQL["fraud_rate_alerts_large_groups"] = SQL["alert_log_sink"] = (
    with_(PH).replace("WITH ", "WITH RECURSIVE ", 1)
    + _RATE
    + """SELECT 'HIGH_FRAUD_RATE' AS alert_type, 'HIGH' AS severity,
printf('High fraud rate detected: %s%% over the last 15 minutes (%d/%d predictions).', printf('%.2f', f / CAST(n AS DOUBLE) * 100), f, n)
AS message, make_timestamp(us) AS triggered_at FROM cand JOIN walk USING (us)"""
)

# ---- streams

SQL["stream_features"] = SQL["stream_features_batches"] = SQL["stream_features_history"] = _FEATURES + _BEHAVIOUR
SQL["compressed_history"] = _FEATURES + _BEHAVIOUR + f' WHERE "timestamp" >= {MIDDLE}'
# predictions without a label come out once the seven days have passed
SQL["stream_label_backfill"] = with_(PH) + """SELECT transaction_id, prediction_label, actual_label FROM ph
WHERE actual_label IS NOT NULL OR us + 7 * 86400000000 < (SELECT max(us) FROM ph) - 3600000000"""
SQL["stream_hourly"] = with_(TX, _HOURLY) + f"""SELECT {_HV}
WHERE bucket_hour + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM tx) - INTERVAL 5 MINUTE"""
SQL["stream_merchant_daily"] = with_(TX, _DAILY) + """SELECT * FROM dd
WHERE bucket_day + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM tx) - INTERVAL 5 MINUTE"""
SQL["stream_fraud_rate"] = with_(PH) + """, s AS (SELECT us - us % 60000000 - i * 60000000 AS b, prediction_label
  FROM ph, (SELECT range AS i FROM range(15)) WHERE us < us - us % 60000000 - i * 60000000 + 900000000),
g AS (SELECT b, count(*) AS n, count(*) FILTER (prediction_label) AS f FROM s GROUP BY 1)
SELECT make_timestamp(b) AS window_start, make_timestamp(b + 900000000) AS window_end, n AS total_count, f AS fraud_count,
round(f / CAST(n AS DOUBLE), 6) AS fraud_rate, f / CAST(n AS DOUBLE) > 0.05 AS alert FROM g
WHERE b + 900000000 <= (SELECT max(us) FROM ph) - 300000000"""
SQL["stream_dedup"] = "SELECT DISTINCT l_orderkey || '-' || l_linenumber AS transaction_id FROM lineitem"
SQL["late_data"] = with_(TX) + f""", u AS (SELECT user_id, max(us) AS m FROM tx WHERE "timestamp" >= {MIDDLE} GROUP BY 1),
d AS (SELECT "timestamp" < {MIDDLE} AND coalesce(us < m - 3600000000, false) AS late FROM tx LEFT JOIN u USING (user_id))
SELECT late, count(*) AS n, CASE WHEN late THEN 0 ELSE count(*) END AS with_features FROM d GROUP BY 1"""

# ---- table maintenance

SQL["partition_daily"] = with_(TX) + 'SELECT CAST("timestamp" AS DATE) AS event_date, count(*) AS n FROM tx GROUP BY 1'
SQL["compact_old"] = SQL["upsert_stream"] = SQL["compact_incremental"] = with_(TX) + f"SELECT {_TX_COLUMNS}, is_fraud FROM tx"
SQL["retention"] = with_(SHIP) + """SELECT date_trunc('month', "timestamp")::TIMESTAMP AS month, count(*) AS n FROM ship
WHERE "timestamp" >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1"""


# ---- learning: what can be said about the results without fitting

_FRAUDS = _FULL + f""", fr AS (SELECT transaction_id AS id, [{", ".join(f"CAST({c} AS DOUBLE)" for c in MODEL_INPUT)}] AS v FROM mx WHERE is_fraud),
nn AS (SELECT a.id AS key, list_distance(a.v, b.v) AS distance FROM fr a JOIN fr b ON a.id <> b.id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY distance) - 1 AS INTEGER) AS rank FROM nn)"""
SQL["smote_neighbors"] = _FRAUDS + " SELECT key, rank, round(distance, 6) AS distance FROM rk WHERE rank < 5"
_SELECTED = [*_CORRELATED, "tx_count_24h", "tx_count_1h"]
SQL["select_features"] = (
    _WIDE
    + _corr(_SELECTED, lambda i, j: i < j)
    + ", ws AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS feature, avg(CAST({c} > 0 AS INTEGER)) AS importance FROM wide" for i, c in enumerate(_SELECTED)
    )
    + """), red AS (SELECT DISTINCT CASE WHEN x.importance <= y.importance THEN a ELSE b END AS feature
  FROM cm JOIN ws x ON x.feature = a JOIN ws y ON y.feature = b WHERE abs(r) > 0.5),
why AS (SELECT position, feature, importance, CASE WHEN importance < 0.1 THEN 'low_importance'
  WHEN feature IN (SELECT feature FROM red) THEN 'redundant' WHEN feature = 'hour_of_day' THEN 'shadow_rejected' END AS drop_reason FROM ws)
SELECT CAST(position AS INTEGER) AS position, feature, round(importance, 6) AS importance, drop_reason IS NULL AS selected, drop_reason FROM why"""
)
_SPLIT = with_(
    TX,
    _NUMBERED.format(src="tx", more=""),
    f"parts AS (SELECT *, {_PART} FROM num)",
    """late AS (SELECT min("timestamp") AS first FROM parts WHERE split <> 'train')""",
)
SQL["training_parts"] = _SPLIT + """, seen AS (SELECT tx.* FROM tx, late WHERE is_fraud IS NOT NULL AND "timestamp" < first),
gs AS (SELECT avg(CAST(is_fraud AS INTEGER)) AS g FROM seen),
cs AS (SELECT country AS cat, (sum(CAST(is_fraud AS INTEGER)) + 10 * any_value(g)) / (count(*) + 10) AS code FROM seen, gs GROUP BY 1)
SELECT split AS part, count(*) AS n, CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS frauds, round(sum(coalesce(code, g)), 6) AS codes
FROM parts CROSS JOIN gs LEFT JOIN cs ON cat = country GROUP BY split"""
SQL["register_model"] = _SPLIT + f""", {MD.strip()},
span AS (SELECT date_trunc('second', min("timestamp")) AS a, date_trunc('second', max("timestamp")) AS b FROM parts WHERE split = 'train')
SELECT id, run_id, version, false AS is_active, training_data_from, training_data_to FROM md
UNION ALL SELECT (SELECT max(id) + 1 FROM md), 'run_new', 'new', true, a, b FROM span"""
SQL["score_facts"] = with_(TX) + "SELECT count(*) AS n, count(*) AS ids, count(*) AS in_range, count(*) AS labelled, count(*) AS versioned FROM tx"
SQL["stream_score_facts"] = with_(TX) + "SELECT count(*) AS n, count(*) AS ids, count(*) AS as_in_batch, count(*) AS alerted FROM tx"

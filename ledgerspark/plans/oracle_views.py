"""The same views as ``sources.tables``, and the same features, as DuckDB SQL common table expressions."""

TXN = """txn AS (
SELECT *, abs(amount) AS abs_amount, CAST(round(abs(amount) * 100) AS BIGINT) AS cents,
       CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS dn, epoch_us(ts) AS us FROM (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'A' || user_id AS account_id, 'A' || json_extract_string(props, '$.k') AS counterparty,
         CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type IN ('signup', 'view') THEN value ELSE -value END AS amount,
         CASE WHEN event_type IN ('signup', 'view') THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         CASE event_type WHEN 'purchase' THEN 'TRADE' WHEN 'click' THEN 'INVOICE' ELSE 'TRANSFER' END AS category,
         CAST(event_type = 'error' AND value > 50 AS INTEGER) AS is_suspicious FROM events))"""

TXN_ORDERS = """txo AS (
SELECT *, abs(amount) AS abs_amount, CAST(round(abs(amount) * 100) AS BIGINT) AS cents,
       CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS dn, epoch_us(ts) AS us FROM (
  SELECT sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                          l_linestatus, CAST(l_shipdate AS DATE))) AS transaction_id,
         'C' || o_custkey AS account_id, 'S' || l_suppkey AS counterparty, CAST(o_orderdate AS TIMESTAMP) AS ts,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS amount,
         CASE WHEN l_returnflag = 'R' THEN 'CREDIT' ELSE 'DEBIT' END AS type, o_orderpriority AS category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def prior(value: str, days: int) -> str:
    return (
        f"(coalesce(sum({value}) OVER (PARTITION BY account_id ORDER BY dn RANGE BETWEEN {days} PRECEDING AND 1 PRECEDING), 0)"
        f" + coalesce(sum({value}) OVER (PARTITION BY account_id, dn ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
    )


_A = "PARTITION BY account_id ORDER BY ts, transaction_id"
_B = f"({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_F = f"({_A} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def features(source: str = "txn") -> str:
    """p1, p2, feat: the columns of behaviour() and network_windows() over a view."""
    return f"""p1 AS (
SELECT *, coalesce(sum(cents) OVER {_B} / CAST(count(*) OVER {_B} AS DOUBLE) / 100.0, 4183.82) AS customer_avg_amount,
  coalesce(CAST(floor((us - lag(us) OVER ({_A})) / 86400000000.0) AS DOUBLE), 999.0) AS days_since_prev,
  dn - lag(dn) OVER ({_A}) AS gap_days,
  {prior('1', 1)} AS txns_last_day, {prior('1', 7)} AS txns_last_7d,
  {prior("CASE WHEN type = 'CREDIT' THEN cents END", 1)} / 100.0 AS credit_1d,
  {prior('cents', 1)} / 100.0 AS amt_sent_1d, {prior('cents', 7)} / 100.0 AS amt_sent_7d,
  {prior('CAST(abs_amount BETWEEN 40000 AND 50000 AS INTEGER)', 7)} AS near_threshold_cnt_7d,
  row_number() OVER ({_A}) - 1 AS total_prev_txns, dn - min(dn) OVER {_F} AS account_age_days,
  coalesce(stddev_samp(abs_amount) OVER {_B}, 0.0) AS prior_std, quantile_cont(abs_amount, 0.5) OVER {_B} AS prior_median,
  row_number() OVER (PARTITION BY account_id, counterparty ORDER BY ts, transaction_id) - 1 AS prev_txns_to_beneficiary,
  row_number() OVER (PARTITION BY counterparty ORDER BY ts, transaction_id, account_id) - 1 AS receiver_prev_txns,
  CAST(row_number() OVER (PARTITION BY counterparty, account_id ORDER BY ts, transaction_id) = 1 AS INTEGER) AS new_sender,
  count(DISTINCT CASE WHEN type = 'CREDIT' THEN counterparty END) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS fan_in_7d,
  count(DISTINCT CASE WHEN type = 'DEBIT' THEN counterparty END) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS fan_out_7d,
  count(*) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS x
FROM {source}),
p2 AS (
SELECT *, ln(1 + abs_amount) AS log_amount, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(type = 'DEBIT' AS INTEGER) AS is_debit,
  abs_amount / (customer_avg_amount + 1) AS amount_ratio, abs_amount - customer_avg_amount AS amount_deviation,
  txns_last_day + 0.3 * txns_last_7d AS velocity_score,
  CASE WHEN type = 'DEBIT' THEN least(credit_1d, abs_amount) / greatest(credit_1d, abs_amount, 1.0) ELSE 0.0 END AS passthrough_ratio,
  CAST(prev_txns_to_beneficiary = 0 AS INTEGER) AS new_beneficiary,
  CASE WHEN prior_std = 0 THEN CASE WHEN abs_amount = customer_avg_amount THEN 0.0 ELSE sign(abs_amount - customer_avg_amount) * 50.0 END
       ELSE least(greatest((abs_amount - customer_avg_amount) / (prior_std + 1e-9), -50), 50) END AS amount_zscore,
  txns_last_day / (txns_last_7d / 7.0 + 0.1) AS pattern_change_ratio, CAST(days_since_prev > 30 AS INTEGER) AS unusual_gap_flag,
  CAST(coalesce(gap_days, 0) >= 30 AS INTEGER) AS dormant_reactivation,
  CAST(abs_amount BETWEEN 40000 AND 50000 AND txns_last_7d + 1 >= 3 AS INTEGER) AS structuring_window,
  coalesce((x - avg(x) OVER {_B}) / (coalesce(stddev_samp(x) OVER {_B}, 0.0) + 1), 0.0) AS burst_score,
  greatest(CAST(fan_in_7d + 1 AS DOUBLE) / (fan_out_7d + 1), CAST(fan_out_7d + 1 AS DOUBLE) / (fan_in_7d + 1)) AS gather_scatter_score
FROM p1),
feat AS (
SELECT *, CAST(sum(new_beneficiary) OVER {_F} - 1 AS DOUBLE) / (total_prev_txns + 1) AS beneficiary_diversity,
  sum(new_sender) OVER (PARTITION BY counterparty ORDER BY ts, transaction_id, account_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS receiver_unique_senders
FROM p2)"""


_C = {
    "large_amount_flag": "amount_ratio > 5",
    "high_velocity_flag": "txns_last_day >= 10",
    "high_velocity_7d_flag": "txns_last_7d >= 25",
    "new_beneficiary_risk": "new_beneficiary = 1 AND amount_ratio > 3",
    "rapid_movement_flag": "days_since_prev <= 1 AND is_debit = 1 AND amount_ratio > 2",
    "structuring_flag": "abs_amount BETWEEN 40000 AND 50000",
    "structuring_window_flag": "structuring_window = 1",
    "high_value_flag": "abs_amount >= 1000000",
    "fan_in_flag": "fan_in_7d >= 5",
    "fan_out_flag": "fan_out_7d >= 5",
    "gather_scatter_flag": "gather_scatter_score >= 4",
    "crypto_offramp_flag": "regexp_matches(upper(counterparty), 'CRYPTO|VAULD|WAZIRX|BINANCE|COIN|BTC')",
    "shell_invoice_flag": "regexp_matches(upper(counterparty), 'INFRA|TRADERS|ENTERPRISES|CONSTRUCTION|SUPPLIERS') AND (regexp_matches(category, 'INVOICE|TRADE|SERVICE') OR new_beneficiary = 1)",
    "trade_ml_flag": "regexp_matches(category, 'TRADE|INVOICE|IMPORT|EXPORT') AND (abs_amount % 10000 = 0 OR new_beneficiary = 1)",
    "weekend_burst_flag": "is_weekend = 1 AND txns_last_day >= 3",
    "dormant_reactivation_flag": "dormant_reactivation = 1",
    "mule_passthrough_flag": "(passthrough_ratio >= 0.8 OR (days_since_prev <= 1 AND is_debit = 1 AND amount_ratio > 2)) AND txns_last_day >= 3",
    "burst_flag": "burst_score >= 3 OR txns_last_day >= 10",
}
FLAGS = list(_C)
_W = {"large_amount_flag": 2, "structuring_window_flag": 3, "fan_in_flag": 2, "fan_out_flag": 2, "mule_passthrough_flag": 3, "crypto_offramp_flag": 2, "shell_invoice_flag": 2, "trade_ml_flag": 2}
_RANK = {"high_velocity_7d_flag": 2, "new_beneficiary_risk": 4, "structuring_flag": 2, "structuring_window_flag": 4, "high_value_flag": 2, "gather_scatter_flag": 2, "weekend_burst_flag": 1, "dormant_reactivation_flag": 2, "mule_passthrough_flag": 4, "burst_flag": 2}
SCORE = " + ".join(FLAGS)
WEIGHTED = " + ".join(f"{f} * {_W.get(f, 1)}" for f in FLAGS)
SEVERITY = "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][greatest(1, " + ", ".join(f"{f} * {_RANK.get(f, 3)}" for f in FLAGS) + ")]"
SEVERITY_OF = {f: ["LOW", "MEDIUM", "HIGH", "CRITICAL"][_RANK.get(f, 3) - 1] for f in FLAGS}
RULES = "flagged AS (SELECT *, " + ", ".join(f"CAST(coalesce({c}, false) AS INTEGER) AS {f}" for f, c in _C.items()) + " FROM feat)"


def with_features(select: str, source: str = TXN, name: str = "txn", rules: bool = False) -> str:
    return f"WITH {source}, {features(name)}{', ' + RULES if rules else ''} {select}"

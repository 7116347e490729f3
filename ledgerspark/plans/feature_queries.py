"""Queries of past-only features, rules and typologies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fired
from ..operators import features, rules
from ..sources import tables
from . import oracle_views as v

QUERIES, ORACLE = {}, {}


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.network_windows(features.behaviour(tables.txn_events(spark, sf_dir)))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(featured(spark, sf_dir))


def _feature(key: str, *columns: str, **rounded: int) -> None:
    """A query of feature columns, over events."""
    spark_columns = [F_round(c, rounded.get(c)) for c in columns]
    sql_columns = [f"round({c}, {rounded[c]}) AS {c}" if c in rounded else f"CAST({c} AS DOUBLE) AS {c}" for c in columns]
    QUERIES[key] = lambda spark, sf_dir: featured(spark, sf_dir).select("transaction_id", *[c() for c in spark_columns])
    ORACLE[key] = v.with_features(f"SELECT transaction_id, {', '.join(sql_columns)} FROM feat")


def F_round(column: str, digits: int | None):
    return lambda: (F.col(column).cast("double") if digits is None else F.round(column, digits)).alias(column)


_feature("customer_avg_amount", "customer_avg_amount", "amount_ratio", "amount_deviation")
_feature("days_since_prev", "days_since_prev")
_feature("txns_last_window", "txns_last_day", "txns_last_7d", "velocity_score", velocity_score=3)
_feature("passthrough_ratio", "passthrough_ratio", passthrough_ratio=6)
_feature("new_beneficiary", "new_beneficiary", "prev_txns_to_beneficiary")
_feature("amount_zscore", "prior_std", "amount_zscore", prior_std=5, amount_zscore=5)
_feature("amt_sent_window", "amt_sent_1d", "amt_sent_7d")
_feature("beneficiary_diversity", "beneficiary_diversity", beneficiary_diversity=6)
_feature("account_tenure", "total_prev_txns", "account_age_days")
_feature("receiver_prev_txns", "receiver_prev_txns")
_feature("receiver_unique_senders", "receiver_unique_senders")
_feature("pattern_change_ratio", "pattern_change_ratio", "unusual_gap_flag", pattern_change_ratio=6)
_feature("fan_in_out_7d", "fan_in_7d", "fan_out_7d")
_feature("burst_score", "burst_score", burst_score=5)
_feature("gather_scatter_score", "gather_scatter_score", gather_scatter_score=6)
_feature("derived_scalars", "log_amount", "is_weekend", "is_debit", "amount_ratio", log_amount=6, amount_ratio=6)


def _orders(key: str, *columns: str, more: str = "") -> None:
    """The same over line items: amounts in the structuring band, many ties."""
    QUERIES[key] = lambda spark, sf_dir: features.behaviour(tables.txn_orders(spark, sf_dir)).select(
        "transaction_id", *[F.col(c).cast("double").alias(c) for c in columns]
    )
    ORACLE[key] = v.with_features("SELECT transaction_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns) + " FROM feat", v.TXN_ORDERS, "txo")


_orders("near_threshold_cnt_7d", "near_threshold_cnt_7d")
_orders("structuring_window", "structuring_window", "txns_last_7d")
_orders("dormant_reactivation", "dormant_reactivation")


def hist_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.with_median(features.behaviour(tables.txn_events(spark, sf_dir)))
    return df.select("transaction_id", F.round("hist_median", 4).alias("hist_median"), F.round("robust_amount_score", 5).alias("robust_amount_score"))


QUERIES["hist_median"] = hist_median
ORACLE["hist_median"] = v.with_features(
    "SELECT transaction_id, round(m, 4) AS hist_median, round(least(greatest((abs_amount - m) / (m + 1), -50), 50), 5) AS robust_amount_score FROM ("
    "SELECT *, coalesce(prior_median, (SELECT quantile_cont(abs_amount, 0.5) FROM txn)) AS m FROM feat)"
)


def geo_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category stands in for a country."""
    return features.geo_novelty(tables.txn_events(spark, sf_dir), "category").select("transaction_id", "geo_novelty")


QUERIES["geo_novelty"] = geo_novelty
ORACLE["geo_novelty"] = f"WITH {v.TXN} SELECT transaction_id, CAST(row_number() OVER (PARTITION BY account_id, category ORDER BY ts, transaction_id) = 1 AS INTEGER) AS geo_novelty FROM txn"

QUERIES["leakage_check"] = lambda spark, sf_dir: features.leakage(features.behaviour(tables.txn_events(spark, sf_dir))).select("transaction_id")
ORACLE["leakage_check"] = f"WITH {v.TXN} SELECT transaction_id FROM txn WHERE false"

QUERIES["rule_flags"] = lambda spark, sf_dir: flagged(spark, sf_dir).select("transaction_id", *rules.RULES)
ORACLE["rule_flags"] = v.with_features(f"SELECT transaction_id, {', '.join(v.FLAGS)} FROM flagged", rules=True)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = rules.weighted_score()
    return flagged(spark, sf_dir).select(
        "transaction_id", rules.rule_score().alias("rule_score"), weighted.alias("rule_score_weighted"), F.least(weighted / 100.0, F.lit(1.0)).alias("rule_score_norm")
    )


QUERIES["rule_scores"] = rule_scores
ORACLE["rule_scores"] = v.with_features(
    f"SELECT transaction_id, {v.SCORE} AS rule_score, {v.WEIGHTED} AS rule_score_weighted, least(CAST({v.WEIGHTED} AS DOUBLE) / 100.0, 1.0) AS rule_score_norm FROM flagged".replace(
        f"CAST({v.WEIGHTED} AS DOUBLE)", f"CAST(({v.WEIGHTED}) AS DOUBLE)"
    ),
    rules=True,
)
QUERIES["rule_severity"] = lambda spark, sf_dir: flagged(spark, sf_dir).select("transaction_id", rules.max_severity().alias("max_rule_severity"))
ORACLE["rule_severity"] = v.with_features(f"SELECT transaction_id, {v.SEVERITY} AS max_rule_severity FROM flagged", rules=True)
QUERIES["rule_reasons"] = lambda spark, sf_dir: flagged(spark, sf_dir).select("transaction_id", F.array_join(rules.reasons(), "; ").alias("reasons"))
ORACLE["rule_reasons"] = v.with_features(
    "SELECT transaction_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {k} = 1 THEN '{m}' END" for k, (_, _, m) in rules.RULES.items()) + ") AS reasons FROM flagged", rules=True
)
QUERIES["rule_audit_log"] = lambda spark, sf_dir: rules.audit_log(flagged(spark, sf_dir))
ORACLE["rule_audit_log"] = v.with_features(
    " UNION ALL ".join(f"SELECT transaction_id, '{f}' AS rule, '{v.SEVERITY_OF[f]}' AS severity FROM flagged WHERE {f} = 1" for f in v.FLAGS), rules=True
)
QUERIES["triggered_rules"] = lambda spark, sf_dir: rules.triggered(flagged(spark, sf_dir))
_TOP = ", ".join(f"CASE WHEN {k} = 1 THEN {rules.SEVERITY_SCORE[rules.RULES[k][1]]} ELSE 0.0 END" for k in rules.RULE_IDS)
_OF = lambda p: " + ".join(k for k, i in rules.RULE_IDS.items() if i.startswith(p))
ORACLE["triggered_rules"] = v.with_features(
    "SELECT transaction_id, concat_ws(',', " + ", ".join(f"CASE WHEN {k} = 1 THEN '{i}' END" for k, i in rules.RULE_IDS.items())
    + f") AS rules, {_OF('AML_')} AS aml, {_OF('FRAUD_')} AS fraud, CAST(greatest(0.0, {_TOP}) AS DOUBLE) AS top_score FROM flagged",
    rules=True,
)


def with_typologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows with cycle_flag (the account sends to one that sends back, or to itself) and typologies."""
    df = flagged(spark, sf_dir)
    pairs = df.select("account_id", "counterparty").distinct()
    back = pairs.select(F.col("account_id").alias("counterparty"), F.col("counterparty").alias("account_id"))
    cycle = pairs.join(back, ["account_id", "counterparty"], "left_semi").select("account_id").distinct().withColumn("cycle_flag", F.lit(1))
    return df.join(cycle, "account_id", "left").withColumn("cycle_flag", F.coalesce("cycle_flag", F.lit(0))).withColumn("typologies", rules.typologies())


def typologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_typologies(spark, sf_dir).select("transaction_id", F.array_join(F.transform("typologies", lambda t: F.concat(t["name"], F.lit(":"), t["confidence"])), ",").alias("typologies"))


_CYCLE = """, back AS (SELECT DISTINCT a.account_id FROM txn a JOIN txn b ON a.account_id = b.counterparty AND a.counterparty = b.account_id),
flagged2 AS (SELECT f.*, CAST(back.account_id IS NOT NULL AS INTEGER) AS cycle_flag FROM flagged f LEFT JOIN back USING (account_id))"""
_VELOCITY = "(high_velocity_7d_flag = 1 OR high_velocity_flag = 1)"
_NEW = "(new_beneficiary_risk = 1 OR new_beneficiary = 1)"
TYPOLOGY_SQL = {
    "STRUCTURING": ("(structuring_window_flag = 1 OR structuring_flag = 1)", ["(structuring_window_flag = 1 OR structuring_flag = 1)", "structuring_flag = 1", "burst_flag = 1", f"({_VELOCITY} OR txns_last_7d >= 3)"]),
    "SMURFING_FAN_IN": ("fan_in_flag = 1", ["fan_in_7d >= 5", "gather_scatter_flag = 1", _VELOCITY, _NEW]),
    "SMURFING_CONSOLIDATION": ("(fan_in_flag = 1 AND high_value_flag = 1 OR gather_scatter_flag = 1)", ["fan_in_flag = 1", "high_value_flag = 1", "gather_scatter_flag = 1", "fan_out_flag = 1"]),
    "MULE_PASSTHROUGH": ("(mule_passthrough_flag = 1 OR rapid_movement_flag = 1)", ["mule_passthrough_flag = 1", "rapid_movement_flag = 1", "passthrough_ratio >= 0.8", "txns_last_day >= 2"]),
    "LAYERING": ("(txns_last_7d >= 10 AND amount_ratio > 3 OR fan_out_flag = 1 AND txns_last_7d >= 10 OR cycle_flag = 1 AND txns_last_7d >= 5)", ["txns_last_7d >= 10", "amount_ratio > 3", "fan_out_flag = 1", "cycle_flag = 1", "gather_scatter_flag = 1"]),
    "ROUND_TRIPPING": ("cycle_flag = 1", ["cycle_flag = 1", "txns_last_7d >= 5", "(fan_out_flag = 1 OR gather_scatter_flag = 1)"]),
    "SHELL_COMPANY_INVOICING": ("shell_invoice_flag = 1", ["shell_invoice_flag = 1", _NEW, "high_value_flag = 1"]),
    "TRADE_BASED_ML": ("trade_ml_flag = 1", ["trade_ml_flag = 1", _NEW, "high_value_flag = 1"]),
    "CRYPTO_OFFRAMP": ("crypto_offramp_flag = 1", ["crypto_offramp_flag = 1", "high_value_flag = 1", "(rapid_movement_flag = 1 OR mule_passthrough_flag = 1)"]),
}


def _typed(name: str) -> str:
    when, signals = TYPOLOGY_SQL[name]
    n = " + ".join(f"CAST({s} AS INTEGER)" for s in signals)
    return f"CASE WHEN {when} THEN '{name}:' || CASE WHEN {n} >= 2 THEN 'high' WHEN {n} = 1 THEN 'medium' ELSE 'low' END END"


def typed_sql(select: str) -> str:
    """A query over flagged2, the flagged rows with cycle_flag."""
    return v.with_features("@", rules=True).replace("@", "") + _CYCLE + " " + select


QUERIES["typologies"] = typologies
ORACLE["typologies"] = typed_sql("SELECT transaction_id, concat_ws(',', " + ", ".join(map(_typed, TYPOLOGY_SQL)) + ") AS typologies FROM flagged2")


def typology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_typologies(spark, sf_dir).select(F.explode("typologies.name").alias("typology")).groupBy("typology").agg(F.count(F.lit(1)).alias("n"))


QUERIES["typology_counts"] = typology_counts
ORACLE["typology_counts"] = typed_sql(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS typology, count(*) AS n FROM flagged2 WHERE {w}) WHERE n > 0" for k, (w, _) in TYPOLOGY_SQL.items()))


def rule_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flag, and for weighted scores of at least 3 and 4: support, precision and recall."""
    score = rules.weighted_score()
    names = fired({k: rules.is_on(k) for k in rules.RULES} | {"weighted_ge_3": score >= 3, "weighted_ge_4": score >= 4})
    df = flagged(spark, sf_dir).select("is_suspicious", F.explode(F.array_append(names, F.lit("all"))).alias("rule"))
    counts = df.groupBy("rule").agg(F.count(F.lit(1)).alias("support"), F.sum("is_suspicious").alias("hits"))
    total = counts.where("rule = 'all'").select(F.col("hits").alias("positives"))  # one row
    return counts.where("rule <> 'all'").join(F.broadcast(total)).select("rule", "support", F.round(F.col("hits") / F.col("support"), 6).alias("precision"), F.round(F.col("hits") / F.col("positives"), 6).alias("recall"))


QUERIES["rule_precision_recall"] = rule_precision_recall
ORACLE["rule_precision_recall"] = v.with_features(
    "SELECT rule, support, round(CAST(hits AS DOUBLE) / support, 6) AS precision, round(CAST(hits AS DOUBLE) / (SELECT sum(is_suspicious) FROM txn), 6) AS recall FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS support, sum(is_suspicious) AS hits FROM flagged WHERE {c}" for n, c in [(f, f"{f} = 1") for f in v.FLAGS] + [("weighted_ge_3", f"{v.WEIGHTED} >= 3"), ("weighted_ge_4", f"{v.WEIGHTED} >= 4")])
    + ") WHERE support > 0",
    rules=True,
)

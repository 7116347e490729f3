"""Rules and typologies as data: name, condition, weight, severity, message."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CRYPTO_WORDS, SHELL_WORDS, TRADE_CATEGORIES, fired, has_word

SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

#: Flag -> (weight, severity, message).
RULES = {
    "large_amount_flag": (2, "HIGH", "Amount >5x customer average"),
    "high_velocity_flag": (1, "HIGH", "High 1d velocity"),
    "high_velocity_7d_flag": (1, "MEDIUM", "High 7d velocity"),
    "new_beneficiary_risk": (1, "CRITICAL", "First-time beneficiary + large amount"),
    "rapid_movement_flag": (1, "HIGH", "Rapid debit after credit"),
    "structuring_flag": (1, "MEDIUM", "Amount in structuring band"),
    "structuring_window_flag": (3, "CRITICAL", "Repeated structuring-band txns in window"),
    "high_value_flag": (1, "MEDIUM", "Very high value"),
    "fan_in_flag": (2, "HIGH", "Fan-in: many senders"),
    "fan_out_flag": (2, "HIGH", "Fan-out: many receivers"),
    "gather_scatter_flag": (1, "MEDIUM", "Gather-scatter imbalance"),
    "crypto_offramp_flag": (2, "HIGH", "Crypto off-ramp keyword"),
    "shell_invoice_flag": (2, "HIGH", "Shell/invoice keyword + new party"),
    "trade_ml_flag": (2, "HIGH", "Trade/invoice anomaly"),
    "weekend_burst_flag": (1, "LOW", "Weekend burst"),
    "dormant_reactivation_flag": (1, "MEDIUM", "Reactivation after dormancy"),
    "mule_passthrough_flag": (3, "CRITICAL", "Mule pass-through"),
    "burst_flag": (1, "MEDIUM", "Burst activity"),
}

#: Flag -> rule identifier of the triggered-rules list.
RULE_IDS = {
    "large_amount_flag": "AML_LARGE_AMOUNT", "high_velocity_flag": "FRAUD_HIGH_VELOCITY", "new_beneficiary_risk": "FRAUD_NEW_BENEFICIARY",
    "rapid_movement_flag": "AML_RAPID_MOVEMENT", "structuring_flag": "AML_STRUCTURING", "structuring_window_flag": "AML_STRUCTURING_WINDOW",
    "high_value_flag": "AML_HIGH_VALUE", "fan_in_flag": "AML_FAN_IN", "fan_out_flag": "AML_FAN_OUT", "gather_scatter_flag": "AML_GATHER_SCATTER",
    "crypto_offramp_flag": "AML_CRYPTO", "shell_invoice_flag": "AML_SHELL", "trade_ml_flag": "AML_TRADE", "dormant_reactivation_flag": "FRAUD_DORMANT",
    "mule_passthrough_flag": "AML_MULE",
}
SEVERITY_SCORE = {"LOW": 0.3, "MEDIUM": 0.55, "HIGH": 0.8, "CRITICAL": 0.95}


def conditions() -> dict[str, Column]:
    c = F.col
    rapid = (c("days_since_prev") <= 1) & (c("is_debit") == 1) & (c("amount_ratio") > 2)
    fresh = c("new_beneficiary") == 1
    return {
        "large_amount_flag": c("amount_ratio") > 5,
        "high_velocity_flag": c("txns_last_day") >= 10,
        "high_velocity_7d_flag": c("txns_last_7d") >= 25,
        "new_beneficiary_risk": fresh & (c("amount_ratio") > 3),
        "rapid_movement_flag": rapid,
        "structuring_flag": c("abs_amount").between(40_000, 50_000),
        "structuring_window_flag": c("structuring_window") == 1,
        "high_value_flag": c("abs_amount") >= 1_000_000,
        "fan_in_flag": c("fan_in_7d") >= 5,
        "fan_out_flag": c("fan_out_7d") >= 5,
        "gather_scatter_flag": c("gather_scatter_score") >= 4,
        "crypto_offramp_flag": has_word(c("counterparty"), CRYPTO_WORDS),
        "shell_invoice_flag": has_word(c("counterparty"), SHELL_WORDS) & (c("category").rlike("INVOICE|TRADE|SERVICE") | fresh),
        "trade_ml_flag": c("category").rlike("|".join(TRADE_CATEGORIES)) & ((c("abs_amount") % 10000 == 0) | fresh),
        "weekend_burst_flag": (c("is_weekend") == 1) & (c("txns_last_day") >= 3),
        "dormant_reactivation_flag": c("dormant_reactivation") == 1,
        "mule_passthrough_flag": ((c("passthrough_ratio") >= 0.8) | rapid) & (c("txns_last_day") >= 3),
        "burst_flag": (c("burst_score") >= 3) | (c("txns_last_day") >= 10),
    }


def apply_rules(features: DataFrame) -> DataFrame:
    """features with one 0/1 column per rule."""
    return features.withColumns({k: F.coalesce(v, F.lit(False)).cast("int") for k, v in conditions().items()})


def is_on(flag: str) -> Column:
    return F.col(flag) == 1


def rule_score() -> Column:
    return reduce(add, map(F.col, RULES))


def weighted_score() -> Column:
    return reduce(add, [F.col(k) * w for k, (w, _, _) in RULES.items()])


def max_severity() -> Column:
    """By rank, not by name."""
    rank = F.greatest(F.lit(1), *[F.col(k) * (SEVERITIES.index(s) + 1) for k, (_, s, _) in RULES.items()])
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank)


def reasons() -> Column:
    return fired({m: is_on(k) for k, (_, _, m) in RULES.items()})


def audit_log(flagged: DataFrame) -> DataFrame:
    """One row per transaction and fired rule."""
    rows = F.array_compact(F.array(*[F.when(is_on(k), F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"))) for k, (_, s, _) in RULES.items()]))
    return flagged.select("transaction_id", F.explode(rows).alias("r")).select("transaction_id", "r.rule", "r.severity")


def triggered(flagged: DataFrame) -> DataFrame:
    """transaction_id, rules (ids in order), aml and fraud counts, top score."""
    ids = fired({RULE_IDS[k]: is_on(k) for k in RULE_IDS})
    top = F.greatest(F.lit(0.0), *[F.when(is_on(k), F.lit(SEVERITY_SCORE[RULES[k][1]])).otherwise(0.0) for k in RULE_IDS])
    df = flagged.select("transaction_id", ids.alias("ids"), top.alias("top_score"))
    of = lambda p: F.size(F.filter("ids", lambda x: x.startswith(p)))
    return df.select("transaction_id", F.array_join("ids", ",").alias("rules"), of("AML_").alias("aml"), of("FRAUD_").alias("fraud"), "top_score")


def typology_table() -> dict[str, tuple[Column, list[Column]]]:
    """Name -> (condition, signals)."""
    c, on = F.col, is_on
    velocity = on("high_velocity_7d_flag") | on("high_velocity_flag")
    band, new, high = on("structuring_flag"), on("new_beneficiary_risk") | (c("new_beneficiary") == 1), on("high_value_flag")
    c7, ratio = c("txns_last_7d"), c("amount_ratio")
    cycle = c("cycle_flag") == 1
    gather, fan_in, fan_out = on("gather_scatter_flag"), on("fan_in_flag"), on("fan_out_flag")
    mule, rapid = on("mule_passthrough_flag"), on("rapid_movement_flag")
    any_band = on("structuring_window_flag") | band
    return {
        "STRUCTURING": (any_band, [any_band, band, on("burst_flag"), velocity | (c7 >= 3)]),
        "SMURFING_FAN_IN": (fan_in, [c("fan_in_7d") >= 5, gather, velocity, new]),
        "SMURFING_CONSOLIDATION": ((fan_in & high) | gather, [fan_in, high, gather, fan_out]),
        "MULE_PASSTHROUGH": (mule | rapid, [mule, rapid, c("passthrough_ratio") >= 0.8, c("txns_last_day") >= 2]),
        "LAYERING": (((c7 >= 10) & (ratio > 3)) | (fan_out & (c7 >= 10)) | (cycle & (c7 >= 5)), [c7 >= 10, ratio > 3, fan_out, cycle, gather]),
        "ROUND_TRIPPING": (cycle, [cycle, c7 >= 5, fan_out | gather]),
        "SHELL_COMPANY_INVOICING": (on("shell_invoice_flag"), [on("shell_invoice_flag"), new, high]),
        "TRADE_BASED_ML": (on("trade_ml_flag"), [on("trade_ml_flag"), new, high]),
        "CRYPTO_OFFRAMP": (on("crypto_offramp_flag"), [on("crypto_offramp_flag"), high, rapid | mule]),
    }


def typologies() -> Column:
    """Array of (name, confidence)."""
    found = []
    for name, (when, signals) in typology_table().items():
        n = reduce(add, [s.cast("int") for s in signals])
        confidence = F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")
        found.append(F.when(when, F.struct(F.lit(name).alias("name"), confidence.alias("confidence"))))
    return F.array_compact(F.array(*found))

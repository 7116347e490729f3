"""Triage, fusion, routing and recommendation as column expressions; nothing here shuffles."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import band, clip

LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: Fixed values.
AMOUNT_STEPS = ((2_000_000, 1.0), (500_000, 0.7), (250_000, 0.4), (50_000, 0.2))


def triage_score(amount: Column, count: Column, is_new: Column, night: Column, foreign: Column, alert: Column) -> Column:
    step = F.lit(0.05)
    for least, value in reversed(AMOUNT_STEPS):
        step = F.when(amount >= least, value).otherwise(step)
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.round(0.25 * step + 0.25 * F.least(count / 10.0, F.lit(1.0)) + 0.20 * on(is_new) + 0.10 * on(night) + 0.10 * on(foreign) + 0.10 * on(alert), 4)


def triage_decision(score: Column) -> Column:
    return band(score, [0.30, 0.60], ["LOG_ONLY", "MONITOR", "FULL_INVESTIGATION"])


def behaviour_score(ratio: Column, is_new: Column, count: Column, time: Column | None = None) -> Column:
    """Amount, time (0 unless given), beneficiary and velocity."""
    return 0.35 * clip((ratio - 1) / 7.0, 0, 1) + 0.20 * (F.lit(0.0) if time is None else time) + 0.25 * is_new + 0.20 * F.least(count / 8.0, F.lit(1.0))


def weighted_fusion(model: Column, anomaly: Column, behaviour: Column, rules: Column, velocity: Column, customer: Column) -> Column:
    """0..100; without a model the other weights are scaled up to 1. Parts are added from the model on: another order differs in the last
    bit, which decides a score next to a bound or between two roundings."""

    def total(first: list[Column]) -> Column:
        return reduce(add, [*first, 0.20 * anomaly, 0.15 * behaviour, 0.15 * F.least(rules / 20.0, F.lit(1.0)), 0.10 * velocity, 0.05 * customer])

    return F.when(model.isNull(), total([]) / 0.65).otherwise(total([0.35 * model])) * 100


def final_risk(weighted: Column, stacked: Column) -> Column:
    """Without a stacked score the weighted one stands for it."""
    return clip(0.4 * weighted + 0.6 * F.coalesce(stacked * 100, weighted), 0, 100)


def level(risk: Column) -> Column:
    return band(risk, [30, 60, 80], LEVELS)


def route(decision: Column, risk: Column) -> Column:
    return F.when(((decision != "FULL_INVESTIGATION") & (risk < 60)) | (risk < 30), "AUTO_CLOSED").otherwise("FULL_INVESTIGATION")


def confidence(signals: list[Column], completeness: Column, quality: Column) -> Column:
    strong = sum((F.when(s >= 0.5, 1).otherwise(0) for s in signals), F.lit(0))
    return 0.5 * strong / float(len(signals)) + 0.3 * completeness + 0.2 * quality


def evidence_confidence(tier: Column, completeness: Column, days: Column, corroboration: Column, digits: int = 3) -> Column:
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in (("T1", 1.0), ("T2", 0.75), ("T3", 0.5), ("T4", 0.25)) for x in kv]), tier)
    return F.round(weight * (0.6 + 0.4 * completeness) * F.greatest(F.lit(0.5), 1 - days / 180.0) * F.least(F.lit(1.0), 0.7 + 0.15 * corroboration), digits)


def evidence_direction(available: Column, supporting: Column) -> Column:
    return F.when(~available, "NEUTRAL").when(supporting, "SUPPORTING").otherwise("CONTRADICTING")


def recommend(risk: Column, typologies: Column, complete: Column) -> Column:
    action = F.when(risk >= 80, "ESCALATE").when(risk >= 60, "FURTHER_INVESTIGATION").when(risk >= 35, "COMPLIANCE_REVIEW").otherwise("MONITOR")
    structuring = F.exists(typologies, lambda t: t.contains("STRUCTURING"))
    return F.when(~complete & (risk >= 60), "FURTHER_INVESTIGATION").when(structuring & (risk >= 35), "STR_REVIEW").otherwise(action)


def recommendation_confidence(evidence: Column, graph_risk: Column, complete: Column) -> Column:
    return F.round(clip(0.4 + 0.4 * evidence + 0.2 * graph_risk / 100 - F.when(complete, 0.0).otherwise(0.2), 0, 1), 3)


def regulatory_tags(risk_level: Column, typologies: Column, risk: Column) -> Column:
    has = lambda word: F.exists(typologies, lambda t: F.lower(t).contains(word))
    tags = lambda *names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    parts = [
        (risk_level.isin("MED", "MEDIUM", "HIGH"), tags("suspicion", "str")),
        (has("lay"), tags("layering", "money_laundering", "rapid_layering")),
        (has("struct") | has("smurf"), tags("structuring", "smurfing", "threshold_evasion")),
        (has("mule"), tags("mule", "pass_through")),
        (risk >= 80, tags("high_value", "high_risk_country")),
    ]
    return F.array_distinct(F.concat(*[F.when(c, x).otherwise(none) for c, x in parts]))

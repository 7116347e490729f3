"""Queries of scoring, evidence, regulation, recommendation and cases, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, rules, scoring
from ..sources import tables as t
from ..sources.durable import shared_folder, written
from ..sources.keyed_table import KeyedTable
from . import oracle_views as v
from .aggregate_queries import EVIDENCE, evidence_items
from .feature_queries import TYPOLOGY_SQL, flagged, typed_sql, with_typologies

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Provisions that cases are matched with.
PROVISIONS = [
    ("IN_PMLA_2002_S3", "IN", "Prevention of Money Laundering Act, 2002 — Sec. 3", ["money_laundering", "layering", "placement", "integration", "high_value"]),
    ("IN_RBI_KYC_2016", "IN", "RBI Master Direction — KYC (2016, updated)", ["kyc", "cdd", "customer_profile", "behavioral_deviation", "monitoring"]),
    ("IN_RBI_STR_2017", "IN", "RBI Master Direction — Suspicious Transaction Reporting", ["str", "suspicious_transaction", "fiu", "reporting"]),
    ("FATF_REC_10", "GLOBAL", "FATF Recommendation 10 — Customer Due Diligence", ["cdd", "kyc", "suspicion", "high_risk_country"]),
    ("FATF_REC_20", "GLOBAL", "FATF Recommendation 20 — Suspicious Transaction Reports", ["str", "reporting", "suspicion"]),
    ("FATF_TYPOLOGIES_MULE", "GLOBAL", "FATF Money Mule Typologies", ["mule", "pass_through", "rapid_layering", "fan_in", "fan_out", "hub_aware"]),
    ("FATF_TYPOLOGIES_STRUCTURING", "GLOBAL", "FATF Structuring / Smurfing Typologies", ["structuring", "smurfing", "threshold_evasion"]),
    ("IN_RBI_HUB_PAYMENT_GATEWAYS", "IN", "RBI Guidelines on Payment Gateways and Hubs", ["hub", "payment_gateway", "supernode", "false_positive"]),
]

# Scores of each flagged row. Model and anomaly come from the amount and the burst; all parts are exact in both engines.
SCORED = """sc AS (SELECT *, least(abs_amount / 200.0, 1.0) AS model, CASE WHEN burst_score >= 1 THEN 1.0 ELSE 0.0 END AS anomaly, {w} AS rule_points FROM flagged2),
b AS (SELECT *, 0.35 * least(greatest((amount_ratio - 1) / 7.0, 0), 1) + 0.20 * 0.0 + 0.25 * new_beneficiary + 0.20 * least(txns_last_day / 8.0, 1.0) AS behaviour,
  0.25 * CASE WHEN abs_amount >= 2000000 THEN 1.0 WHEN abs_amount >= 500000 THEN 0.7 WHEN abs_amount >= 250000 THEN 0.4 WHEN abs_amount >= 50000 THEN 0.2 ELSE 0.05 END
  + 0.25 * least(txns_last_day / 10.0, 1.0) + 0.20 * CASE WHEN new_beneficiary = 1 THEN 1.0 ELSE 0.0 END + 0.10 * CASE WHEN hour(ts) < 6 THEN 1.0 ELSE 0.0 END + 0.10 * 0.0 + 0.10 * CASE WHEN is_suspicious = 1 THEN 1.0 ELSE 0.0 END AS triage FROM sc),
f AS (SELECT *, (0.35 * model + 0.20 * anomaly + 0.15 * behaviour + 0.15 * least(rule_points / 20.0, 1.0) + 0.10 * least(txns_last_day / 10.0, 1.0) + 0.05 * 0.0) * 100 AS weighted FROM b),
g AS (SELECT *, least(greatest(0.4 * weighted + 0.6 * weighted, 0), 100) AS risk FROM f)""".replace("{w}", f"({v.WEIGHTED})")


def scored_sql(select: str) -> str:
    return typed_sql(", " + SCORED + " " + select)


def scored(spark, sf_dir) -> DataFrame:
    df = with_typologies(spark, sf_dir)
    c1, ratio = F.col("txns_last_day"), F.col("amount_ratio")
    df = df.withColumns(
        {
            "model": F.least(F.col("abs_amount") / 200.0, F.lit(1.0)),
            "anomaly": F.when(F.col("burst_score") >= 1, 1.0).otherwise(0.0),
            "rule_points": rules.weighted_score(),
            "behaviour": scoring.behaviour_score(ratio, F.col("new_beneficiary"), c1),
            "triage": scoring.triage_score(F.col("abs_amount"), c1, F.col("new_beneficiary") == 1, F.hour("ts") < 6, F.lit(False), F.col("is_suspicious") == 1),
        }
    )
    weighted = scoring.weighted_fusion(F.col("model"), F.col("anomaly"), F.col("behaviour"), F.col("rule_points"), F.least(c1 / 10.0, F.lit(1.0)), F.lit(0.0))
    df = df.withColumn("weighted", weighted)
    return df.withColumn("risk", scoring.final_risk(F.col("weighted"), F.lit(None).cast("double")))


_R = lambda c, n=6: F.round(c, n).alias(c)


@query(scored_sql("SELECT transaction_id, round(triage, 4) AS triage FROM g"))
def triage_score(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", "triage")


@query(scored_sql("SELECT transaction_id, CASE WHEN round(triage, 4) < 0.30 THEN 'LOG_ONLY' WHEN round(triage, 4) < 0.60 THEN 'MONITOR' ELSE 'FULL_INVESTIGATION' END AS decision FROM g"))
def triage_decision(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", scoring.triage_decision(F.col("triage")).alias("decision"))


@query(scored_sql("SELECT transaction_id, round(behaviour, 7) AS behaviour FROM g"))
def behavior_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", _R("behaviour", 7))


@query(scored_sql("SELECT transaction_id, round(weighted, 7) AS weighted FROM g"))
def weighted_fusion(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", _R("weighted", 7))


@query(scored_sql("SELECT transaction_id, round(risk, 7) AS risk, CASE WHEN risk < 30 THEN 'LOW' WHEN risk < 60 THEN 'MEDIUM' WHEN risk < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM g"))
def final_risk(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", _R("risk", 7), scoring.level(F.col("risk")).alias("level"))


@query(scored_sql("SELECT transaction_id, round(0.5 * model + 0.3 * anomaly + 0.2 * least(greatest(rule_points / 20.0, 0), 1), 7) AS fused FROM g"))
def eval_fusion(spark, sf_dir):
    fused = 0.5 * F.col("model") + 0.3 * F.col("anomaly") + 0.2 * F.least(F.greatest(F.col("rule_points") / 20.0, F.lit(0)), F.lit(1))
    return scored(spark, sf_dir).select("transaction_id", F.round(fused, 7).alias("fused"))


@query(scored_sql("SELECT transaction_id, round(0.5 * (CAST(model >= 0.5 AS INTEGER) + CAST(anomaly >= 0.5 AS INTEGER) + CAST(behaviour >= 0.5 AS INTEGER) + CAST(rule_points / 20.0 >= 0.5 AS INTEGER)) / 4.0 + 0.3 * 0.8 + 0.2 * 1.0, 6) AS confidence FROM g"))
def confidence(spark, sf_dir):
    signals = [F.col("model"), F.col("anomaly"), F.col("behaviour"), F.col("rule_points") / 20.0]
    return scored(spark, sf_dir).select("transaction_id", F.round(scoring.confidence(signals, F.lit(0.8), F.lit(1.0)), 6).alias("confidence"))


_PARTS = {"model": "0.35 * model", "anomaly": "0.20 * anomaly", "behaviour": "0.15 * behaviour", "velocity": "0.10 * least(txns_last_day / 10.0, 1.0)"}
#: A rule's part of the weighted score.
_RULE_PARTS = {f: f"0.15 * {f} * {rules.RULES[f][0]} / 20.0" for f in v.FLAGS}


def _largest_sql(parts: dict[str, str], n: int) -> str:
    listed = ", ".join(f"{{'i': CAST(-round({e}, 9) AS DOUBLE), 'name': '{k}'}}" for k, e in parts.items())
    return f"list_filter(list_sort([{listed}]), lambda x: struct_extract(x, 'i') < 0)[1:{n}]"


@query(scored_sql(f", tf AS (SELECT transaction_id, {_largest_sql(_PARTS, 5)} AS e, {_largest_sql(_RULE_PARTS, 5)} AS r FROM g) SELECT transaction_id, array_to_string(list_transform(list_sort(e || r)[1:8], lambda x: struct_extract(x, 'name')), ',') AS factors FROM tf"))
def top_risk_factors(spark, sf_dir):
    """Of the five largest parts of the score and the five largest of its rules, the eight largest; ties by name."""

    def largest(parts: dict[str, str]) -> Column:
        listed = F.array(*[F.struct((-F.round(F.expr(e), 9)).cast("double").alias("i"), F.lit(k).alias("name")) for k, e in parts.items()])
        return F.slice(F.filter(F.array_sort(listed), lambda x: x["i"] < 0), 1, 5)

    factors = F.slice(F.array_sort(F.concat(largest(_PARTS), largest(_RULE_PARTS))), 1, 8)
    return scored(spark, sf_dir).select("transaction_id", F.array_join(F.transform(factors, lambda x: x["name"]), ",").alias("factors"))


_ROUTE = "CASE WHEN (round(triage, 4) < 0.60 AND risk < 60) OR risk < 30 THEN 'AUTO_CLOSED' ELSE 'FULL_INVESTIGATION' END"


@query(scored_sql(f"SELECT transaction_id, {_ROUTE} AS route FROM g"))
def route(spark, sf_dir):
    return scored(spark, sf_dir).select("transaction_id", scoring.route(scoring.triage_decision(F.col("triage")), F.col("risk")).alias("route"))


@query(scored_sql(f"SELECT transaction_id, CASE WHEN prev_txns_to_beneficiary > 60 THEN 'DUPLICATE_LOGGED' WHEN {_ROUTE} = 'AUTO_CLOSED' THEN 'CLEAR' ELSE 'WAITING_FOR_HUMAN' END AS status FROM g"))
def case_status(spark, sf_dir):
    """Often repeated pairs stand in for duplicates."""
    way = scoring.route(scoring.triage_decision(F.col("triage")), F.col("risk"))
    status = F.when(F.col("prev_txns_to_beneficiary") > 60, "DUPLICATE_LOGGED").when(way == "AUTO_CLOSED", "CLEAR").otherwise("WAITING_FOR_HUMAN")
    return scored(spark, sf_dir).select("transaction_id", status.alias("status"))


@query(scored_sql("SELECT transaction_id, CASE WHEN rule_points >= 20 OR (rule_points > 0 AND structuring_flag = 1) THEN 'SUPPORTING' WHEN rule_points <= 0 THEN 'CONTRADICTING' ELSE 'NEUTRAL' END AS rules, CASE WHEN risk >= 60 THEN 'SUPPORTING' WHEN risk <= 40 THEN 'CONTRADICTING' ELSE 'NEUTRAL' END AS model FROM g"))
def evidence_direction(spark, sf_dir):
    points, risk = F.col("rule_points"), F.col("risk")
    by_rule = F.when((points >= 20) | ((points > 0) & (F.col("structuring_flag") == 1)), "SUPPORTING").when(points <= 0, "CONTRADICTING").otherwise("NEUTRAL")
    return scored(spark, sf_dir).select("transaction_id", by_rule.alias("rules"), F.when(risk >= 60, "SUPPORTING").when(risk <= 40, "CONTRADICTING").otherwise("NEUTRAL").alias("model"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round([1.0, 0.75, 0.5, 0.25][l_linenumber % 4 + 1] * (0.6 + 0.4 * l_discount) * greatest(0.5, 1 - (l_partkey % 200) / 180.0) * least(1.0, 0.7 + 0.15 * (l_suppkey % 3)), 9) AS confidence FROM lineitem")
def evidence_confidence(spark, sf_dir):
    """Line items as evidence items: tier by line number, age by part, corroboration by supplier."""
    df = t.table(spark, sf_dir, "lineitem")
    tier = F.concat(F.lit("T"), (F.col("l_linenumber") % 4 + 1).cast("string"))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", scoring.evidence_confidence(tier, F.col("l_discount"), F.col("l_partkey") % 200, F.col("l_suppkey") % 3, digits=9).alias("confidence"))


_KINDS = ["transaction_deviation", "beneficiary", "velocity", "profile", "previous_alerts", "rules", "model"]
_WHEN = {"transaction_deviation": "amount_ratio >= 2.5", "beneficiary": "new_beneficiary = 1", "velocity": "txns_last_day >= 5", "profile": "amount_ratio >= 3", "previous_alerts": "total_prev_txns > 50", "rules": "rule_points > 0", "model": "risk >= 60"}


@query(scored_sql(" UNION ALL ".join([f"SELECT transaction_id AS case_id, '{k}' AS type, CASE WHEN {_WHEN[k]} THEN 'SUPPORTING' ELSE 'CONTRADICTING' END AS direction, 'AVAILABLE' AS status FROM g" for k in _KINDS] + [f"SELECT transaction_id, '{k}', 'NEUTRAL', 'UNAVAILABLE' FROM g" for k in ("device", "location")])))
def gather_evidence(spark, sf_dir):
    """Nine evidence rows per case, from one pass over the scored rows."""
    rows = [F.struct(F.lit(k).alias("type"), F.when(F.expr(_WHEN[k]), "SUPPORTING").otherwise("CONTRADICTING").alias("direction"), F.lit("AVAILABLE").alias("status")) for k in _KINDS]
    rows += [F.struct(F.lit(k).alias("type"), F.lit("NEUTRAL").alias("direction"), F.lit("UNAVAILABLE").alias("status")) for k in ("device", "location")]
    return scored(spark, sf_dir).select(F.col("transaction_id").alias("case_id"), F.explode(F.array(*rows)).alias("r")).select("case_id", "r.*")


@query(f"WITH {EVIDENCE}, s AS (SELECT case_id, count(*) AS items, count(*) FILTER (direction = 'SUPPORTING') AS supporting, count(DISTINCT source) AS sources FROM ev GROUP BY 1) SELECT *, 3 - sources AS missing FROM s")
def evidence_augment(spark, sf_dir):
    s = evidence_items(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("direction") == "SUPPORTING").alias("supporting"), F.countDistinct("source").alias("sources"))
    return s.withColumn("missing", 3 - F.col("sources"))


#: Which sources a typology asks for first, and which every case needs.
PRIORITY = {
    "STRUCTURING": ["transaction_history", "kyc", "previous_alerts", "amount_baseline"],
    "SMURFING_FAN_IN": ["transaction_history", "graph", "previous_alerts"],
    "SMURFING_CONSOLIDATION": ["graph", "transaction_history", "previous_alerts"],
    "MULE_PASSTHROUGH": ["graph", "velocity_features", "device_history"],
    "LAYERING": ["graph", "velocity_features", "previous_alerts", "transaction_history"],
    "ROUND_TRIPPING": ["graph", "transaction_history"],
    "SHELL_COMPANY_INVOICING": ["kyc", "transaction_history", "beneficiary_history"],
    "TRADE_BASED_ML": ["kyc", "transaction_history", "beneficiary_history"],
    "CRYPTO_OFFRAMP": ["beneficiary_history", "external_intel", "graph"],
    "ACCOUNT_TAKEOVER": ["device_history", "login_history", "previous_alerts", "kyc"],
    "RAPID_MOVEMENT": ["velocity_features", "transaction_history", "graph"],
    "HIGH_VELOCITY_TRANSFER": ["velocity_features", "transaction_history"],
    "UNUSUAL_TRANSACTION": ["transaction_history", "amount_baseline"],
    "NEW_BENEFICIARY_RISK": ["beneficiary_history", "transaction_history"],
    "POSSIBLE_LAYERING": ["graph", "velocity_features", "transaction_history"],
}
BASE_SOURCES = ["kyc", "transaction_history", "previous_alerts", "similar_cases"]

_WANTED = " || ".join([f"CASE WHEN {when} THEN {PRIORITY[k]!r} ELSE [] END" for k, (when, _) in TYPOLOGY_SQL.items()] + [repr(BASE_SOURCES)])


@query(typed_sql(f", p AS (SELECT transaction_id, {_WANTED} AS s FROM flagged2) SELECT transaction_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS sources FROM p"))
def evidence_priority(spark, sf_dir):
    """The sources that a case's typologies ask for, in order, each once."""
    lists = F.create_map(*[x for k, s in PRIORITY.items() for x in (F.lit(k), F.array(*map(F.lit, s)))])
    wanted = F.transform("typologies.name", lambda n: F.coalesce(lists[n], F.array().cast("array<string>")))
    sources = F.array_distinct(F.concat(F.flatten(wanted), F.array(*map(F.lit, BASE_SOURCES))))
    return with_typologies(spark, sf_dir).select("transaction_id", F.array_join(sources, ",").alias("sources"))


def tagged(spark, sf_dir) -> DataFrame:
    df = scored(spark, sf_dir)
    return df.withColumn("tags", scoring.regulatory_tags(scoring.level(F.col("risk")), F.col("typologies.name"), F.col("risk")))


_LAY = "(txns_last_7d >= 10 AND amount_ratio > 3 OR fan_out_flag = 1 AND txns_last_7d >= 10 OR cycle_flag = 1 AND txns_last_7d >= 5)"
_STRUCT = "(structuring_window_flag = 1 OR structuring_flag = 1 OR fan_in_flag = 1 OR gather_scatter_flag = 1)"
_TAGS = f"tg AS (SELECT *, list_concat(list_concat(list_concat(list_concat(CASE WHEN risk >= 30 AND risk < 80 THEN ['suspicion', 'str'] ELSE [] END, CASE WHEN {_LAY} THEN ['layering', 'money_laundering', 'rapid_layering'] ELSE [] END), CASE WHEN {_STRUCT} THEN ['structuring', 'smurfing', 'threshold_evasion'] ELSE [] END), CASE WHEN mule_passthrough_flag = 1 OR rapid_movement_flag = 1 THEN ['mule', 'pass_through'] ELSE [] END), CASE WHEN risk >= 80 THEN ['high_value', 'high_risk_country'] ELSE [] END) AS tags FROM g)"


@query(scored_sql(f", {_TAGS} SELECT transaction_id, array_to_string(tags, ',') AS tags FROM tg"))
def regulatory_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("transaction_id", F.array_join("tags", ",").alias("tags"))


def provisions(spark) -> DataFrame:
    return spark.createDataFrame([(i, j, title, title, tags) for i, j, title, tags in PROVISIONS], "id string, jurisdiction string, title string, summary string, tags array<string>")


_PROVISIONS = "pv(id, jurisdiction, title, tags) AS (VALUES " + ", ".join(f"('{i}', '{j}', '{x}', {tags!r})" for i, j, x, tags in PROVISIONS) + ")"
_MATCH = f", {_TAGS}, {_PROVISIONS}, mt AS (SELECT transaction_id AS case_id, id, title, list_sort(list_intersect(tg.tags, pv.tags)) AS matched, len(list_intersect(tg.tags, pv.tags)) + CASE jurisdiction WHEN 'IN' THEN 2 WHEN 'GLOBAL' THEN 1 ELSE 0 END AS score FROM tg, pv)"


@query(scored_sql(f"{_MATCH} SELECT case_id, id, array_to_string(matched, ',') AS matched, score FROM mt WHERE score > 0"))
def tag_overlap(spark, sf_dir):
    cases = tagged(spark, sf_dir).select(F.col("transaction_id").alias("case_id"), "tags")
    return joins.tag_overlap(cases, provisions(spark)).select("case_id", "id", F.array_join("matched", ",").alias("matched"), "score")


@query(scored_sql(f"{_MATCH}, rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS place FROM mt) SELECT case_id, id, place, title[1:240] AS excerpt, array_to_string(matched, ',') AS matched, CASE WHEN score > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM rk WHERE place <= 5"))
def regulatory_match(spark, sf_dir):
    cases = tagged(spark, sf_dir).select(F.col("transaction_id").alias("case_id"), "tags")
    found = joins.tag_overlap(cases, provisions(spark), most=5)
    status = F.when(F.col("score") > 0, "COMPLETE").otherwise("PARTIAL")
    return found.select("case_id", "id", "place", F.left("title", F.lit(240)).alias("excerpt"), F.array_join("matched", ",").alias("matched"), status.alias("status"))


_ACTION = "CASE WHEN new_beneficiary = 1 AND risk >= 60 THEN 'FURTHER_INVESTIGATION' WHEN (structuring_window_flag = 1 OR structuring_flag = 1) AND risk >= 35 THEN 'STR_REVIEW' WHEN risk >= 80 THEN 'ESCALATE' WHEN risk >= 60 THEN 'FURTHER_INVESTIGATION' WHEN risk >= 35 THEN 'COMPLIANCE_REVIEW' ELSE 'MONITOR' END"


@query(scored_sql(f"SELECT transaction_id, {_ACTION} AS action, risk >= 60 OR new_beneficiary = 1 OR {_ACTION} IN ('ESCALATE', 'STR_REVIEW', 'FURTHER_INVESTIGATION') AS human FROM g"))
def recommend(spark, sf_dir):
    """The network of a first payment counts as incomplete."""
    complete = F.col("new_beneficiary") == 0
    df = scored(spark, sf_dir).withColumn("action", scoring.recommend(F.col("risk"), F.col("typologies.name"), complete))
    human = (F.col("risk") >= 60) | ~complete | F.col("action").isin("ESCALATE", "STR_REVIEW", "FURTHER_INVESTIGATION")
    return df.select("transaction_id", "action", human.alias("human"))


@query()
def report_rows(spark, sf_dir):
    """One JSON report of eleven sections per case of at least medium risk, with a narrative from a template; from stored columns only."""
    complete = F.col("new_beneficiary") == 0
    action = scoring.recommend(F.col("risk"), F.col("typologies.name"), complete)
    kinds = {k: F.expr(_WHEN[k]) for k in _KINDS}
    supporting = F.array_compact(F.array(*[F.when(c, k) for k, c in kinds.items()]))
    contradicting = F.array_compact(F.array(*[F.when(~c, k) for k, c in kinds.items()]))
    rules_hit = F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in v.FLAGS]))
    stored = tagged(spark, sf_dir).select(
        "transaction_id", "account_id", "counterparty", "abs_amount", "us", "risk", scoring.level(F.col("risk")).alias("level"), F.col("typologies.name").alias("types"), "model", "anomaly", "rule_points", "tags",
        "cycle_flag", "triage", action.alias("action"), complete.alias("complete"), supporting.alias("supporting"), contradicting.alias("contradicting"), rules_hit.alias("rules_hit"),
    )
    df = written(stored, "cases").where("risk >= 30")
    narrative = F.format_string("Transaction %s of account %s scored %.1f (%s). %d findings support the risk and %d do not. Next: %s.", "transaction_id", "account_id", "risk", "level", F.size("supporting"), F.size("contradicting"), "action")
    section = {
        "overview": F.struct("transaction_id", "risk", "level", F.col("types").alias("possible_typologies")),
        "transaction": F.struct("account_id", "counterparty", F.col("abs_amount").alias("amount"), "us"),
        "detection": F.struct(F.col("rule_points").alias("rules_score"), F.col("anomaly").alias("anomaly_score"), F.col("model").alias("fraud_probability")),
        "typologies": F.struct(F.col("types").alias("typologies"), F.col("rules_hit").alias("top_reasons")),
        "evidence": F.struct((F.size("supporting") + F.size("contradicting")).alias("total"), F.size("supporting").alias("supporting"), F.size("contradicting").alias("contradicting")),
        "evidence_items": F.struct(F.col("supporting").alias("strongest"), F.col("contradicting").alias("weakest")),
        "graph": F.struct(F.when(F.col("complete"), "COMPLETE").otherwise("PARTIAL").alias("status"), (F.col("cycle_flag") == 1).alias("cycle")),
        "regulatory": F.struct(F.col("tags").alias("potential_relevance"), (F.size("tags") > 0).alias("human_review_required")),
        "triage": F.struct(F.col("triage").alias("score"), scoring.triage_decision(F.col("triage")).alias("decision")),
        "recommendation": F.struct("action", ((F.col("risk") >= 60) | ~F.col("complete") | F.col("action").isin("ESCALATE", "STR_REVIEW", "FURTHER_INVESTIGATION")).alias("human")),
        "narrative": F.struct(narrative.alias("text"), F.lit("template").alias("source")),
    }
    return df.select("transaction_id", F.to_json(F.struct(*[c.alias(k) for k, c in section.items()])).alias("report"))


_DECIDED = "CASE role WHEN 'assistant' THEN 'ACCEPT' WHEN 'system' THEN 'REQUEST_MORE_EVIDENCE' WHEN 'user' THEN 'ESCALATE' END"


def decisions(spark, sf_dir) -> DataFrame:
    """Messages as decisions on the case of their conversation's number."""
    decided = F.when(F.col("role") == "assistant", "ACCEPT").when(F.col("role") == "system", "REQUEST_MORE_EVIDENCE").when(F.col("role") == "user", "ESCALATE")
    return t.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("transaction_id"), "turn", decided.alias("decision"))


@query(scored_sql(f"SELECT transaction_id, turn, {_DECIDED} AS decision, CASE {_DECIDED} WHEN 'ACCEPT' THEN 'COMPLETED' WHEN 'REQUEST_MORE_EVIDENCE' THEN 'REQUESTED_MORE_EVIDENCE' ELSE 'ESCALATED' END AS status, {_ACTION} AS recommendation FROM g JOIN conversations ON transaction_id = CAST(conv_id AS VARCHAR) WHERE {_DECIDED} IS NOT NULL"))
def human_decision(spark, sf_dir):
    """Decisions of the allowed set on known cases, the status that follows, and the recommendation that stood."""
    cases = scored(spark, sf_dir).select("transaction_id", scoring.recommend(F.col("risk"), F.col("typologies.name"), F.col("new_beneficiary") == 0).alias("recommendation"))
    status = F.when(F.col("decision").isin("ACCEPT", "OVERRIDE"), "COMPLETED").when(F.col("decision") == "REQUEST_MORE_EVIDENCE", "REQUESTED_MORE_EVIDENCE").otherwise("ESCALATED")
    allowed = decisions(spark, sf_dir).where(F.col("decision").isin("ACCEPT", "OVERRIDE", "REQUEST_MORE_EVIDENCE", "ESCALATE"))
    return allowed.join(cases, "transaction_id").select("transaction_id", "turn", "decision", status.alias("status"), "recommendation")


@query(scored_sql(f", dc AS (SELECT CAST(conv_id AS VARCHAR) AS transaction_id, arg_max({_DECIDED}, turn) AS decision FROM conversations WHERE {_DECIDED} IS NOT NULL GROUP BY 1) SELECT transaction_id, model, anomaly, rule_points, round(risk, 7) AS risk, cycle_flag AS in_cycle, {_ACTION} AS recommendation, coalesce(decision, 'NONE') AS decision, CASE WHEN is_suspicious = 1 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS outcome FROM g LEFT JOIN dc USING (transaction_id)"))
def feedback_dataset(spark, sf_dir):
    """A learning row per case: scores, rules, network, recommendation, the last decision (NONE without), and the outcome."""
    last = decisions(spark, sf_dir).where("decision IS NOT NULL").groupBy("transaction_id").agg(F.max_by("decision", "turn").alias("decision"))
    action = scoring.recommend(F.col("risk"), F.col("typologies.name"), F.col("new_beneficiary") == 0)
    outcome = F.when(F.col("is_suspicious") == 1, "CONFIRMED").otherwise("DISMISSED")
    rows = scored(spark, sf_dir).select("transaction_id", "model", "anomaly", "rule_points", _R("risk", 7), F.col("cycle_flag").alias("in_cycle"), action.alias("recommendation"), outcome.alias("outcome"))
    return rows.join(last, "transaction_id", "left").fillna("NONE", ["decision"])


@query(scored_sql("SELECT transaction_id, round(risk, 7) AS risk, CASE WHEN risk < 30 THEN 'LOW' WHEN risk < 60 THEN 'MEDIUM' WHEN risk < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level, 2 AS version FROM g"))
def rescore_cases(spark, sf_dir):
    """Detection again from stored payloads: the parts come out of JSON, the risk is made of them, and the case's state is upserted."""
    parts = ["abs_amount", "burst_score", "behaviour", "rule_points", "txns_last_day"]
    stored = written(scored(spark, sf_dir).select("transaction_id", F.to_json(F.struct(*parts)).alias("payload")), "payloads")
    state = KeyedTable(spark, f"{shared_folder(spark)}/tables/cases-{uuid.uuid4().hex}", "transaction_id string, risk double, level string, version int", "transaction_id", buckets=8)
    state.upsert(stored.select("transaction_id", F.lit(None).cast("double").alias("risk"), F.lit("UNKNOWN").alias("level"), F.lit(1).alias("version")), ["version"], 1)
    p = F.from_json("payload", "abs_amount double, burst_score double, behaviour double, rule_points long, txns_last_day long")
    model, anomaly = F.least(p["abs_amount"] / 200.0, F.lit(1.0)), F.when(p["burst_score"] >= 1, 1.0).otherwise(0.0)
    weighted = scoring.weighted_fusion(model, anomaly, p["behaviour"], p["rule_points"], F.least(p["txns_last_day"] / 10.0, F.lit(1.0)), F.lit(0.0))
    risk = scoring.final_risk(weighted, F.lit(None).cast("double"))
    state.upsert(stored.select("transaction_id", F.round(risk, 7).alias("risk"), scoring.level(risk).alias("level"), F.lit(2).alias("version")), ["version"], 2)
    return state.read()


@query()
def similar_cases(spark, sf_dir):
    """Of each suspicious row, the five nearest of the newest 500 (a limit that is part of the operator)."""
    df = flagged(spark, sf_dir).where("is_suspicious = 1")
    vector = {"v1": F.log10(F.col("abs_amount") + 1) / 7, "v2": F.least(F.col("abs_amount") / 200.0, F.lit(1.0)), "v3": F.col("burst_score"), "v4": F.least(rules.rule_score() / 8.0, F.lit(1.0))}
    cases = df.select(F.col("transaction_id").alias("case_id"), F.col("us").alias("updated"), *[c.alias(k) for k, c in vector.items()])
    return joins.similar_cases(cases, list(vector))


@query("SELECT conv_id AS case_id, turn AS seq, role AS type, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def evidence_timeline(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))
    return t.audit_events(spark, sf_dir).select("case_id", "seq", F.col("actor").alias("type"), place.alias("place"))

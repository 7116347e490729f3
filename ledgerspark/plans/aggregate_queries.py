"""Queries of aggregations, evaluation metrics and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, metrics
from ..operators.order_statistics import quantiles
from ..sources import tables as t
from ..sources.durable import written
from . import oracle_views as v
from .feature_queries import featured

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def edges(spark, sf_dir) -> DataFrame:
    return graph.edges_of(t.txn_events(spark, sf_dir))


EDGES = v.TXN + ", e AS (SELECT account_id AS src, counterparty AS dst, transaction_id, cents, abs_amount, ts, us, type FROM txn), pairs AS (SELECT DISTINCT src, dst FROM e)"
SCORES = "s AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS score, CAST(toxic AS INTEGER) AS label, quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(f"WITH {EDGES} SELECT src, dst, sum(cents) / 100.0 AS weight FROM e WHERE CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY ALL")
def edge_weights(spark, sf_dir):
    """Up to the end of training."""
    return graph.edge_weights(edges(spark, sf_dir).where(F.to_date("ts") <= "2024-01-20"))


@query(f"WITH {EDGES} SELECT src, dst, arg_max(transaction_id, (ts, transaction_id)) AS transaction_id, arg_max(abs_amount, (ts, transaction_id)) AS abs_amount, max(ts) AS ts FROM e GROUP BY ALL")
def edge_last(spark, sf_dir):
    return graph.edge_last(edges(spark, sf_dir))


DEGREES = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM pairs UNION ALL SELECT dst, 1, 0 FROM pairs) GROUP BY node)"


@query(f"WITH {EDGES}, {DEGREES}, w AS (SELECT node, sum(i) / 100.0 AS w_in, sum(o) / 100.0 AS w_out FROM (SELECT src AS node, 0 AS i, cents AS o FROM e UNION ALL SELECT dst, cents, 0 FROM e) GROUP BY node) SELECT node, in_degree, out_degree, w_in, w_out, (w_in * 100 + w_out * 100) / 100.0 AS volume FROM deg JOIN w USING (node)")
def node_degrees(spark, sf_dir):
    e = edges(spark, sf_dir)
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).cast("long").alias("i"), F.col("cents").alias("o")), F.struct(F.col("dst").alias("node"), F.col("cents").alias("i"), F.lit(0).cast("long").alias("o"))))
    volume = e.select(ends.alias("x")).groupBy("x.node").agg((F.sum("x.i") / 100.0).alias("w_in"), (F.sum("x.o") / 100.0).alias("w_out"))
    both = graph.degrees(e.select("src", "dst").distinct()).join(volume, "node")
    return both.withColumn("volume", (F.col("w_in") * 100 + F.col("w_out") * 100) / 100.0)


@query(f"WITH {v.TXN} SELECT account_id, count(*) AS n, sum(CASE WHEN type = 'CREDIT' THEN cents ELSE 0 END) / 100.0 AS incoming, sum(CASE WHEN type = 'DEBIT' THEN cents ELSE 0 END) / 100.0 AS outgoing, sum(CASE WHEN type = 'CREDIT' THEN cents ELSE -cents END) / 100.0 AS net_flow, sum(is_suspicious) AS suspicious, max(abs_amount) AS top FROM txn GROUP BY 1")
def node_table(spark, sf_dir):
    credit = F.col("type") == "CREDIT"
    return t.txn_events(spark, sf_dir).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.when(credit, F.col("cents")).otherwise(0)) / 100.0).alias("incoming"), (F.sum(F.when(credit, 0).otherwise(F.col("cents"))) / 100.0).alias("outgoing"),
        (F.sum(F.when(credit, F.col("cents")).otherwise(-F.col("cents"))) / 100.0).alias("net_flow"), F.sum("is_suspicious").alias("suspicious"), F.max("abs_amount").alias("top"),
    )


@query(v.with_features("SELECT account_id, max(txns_last_day) AS c1, max(txns_last_7d) AS c7, max(passthrough_ratio) AS pt, max(fan_in_7d) AS fan_in FROM feat GROUP BY 1"))
def node_row_max(spark, sf_dir):
    return featured(spark, sf_dir).groupBy("account_id").agg(F.max("txns_last_day").alias("c1"), F.max("txns_last_7d").alias("c7"), F.max("passthrough_ratio").alias("pt"), F.max("fan_in_7d").alias("fan_in"))


HISTORY = f"{v.TXN}, h AS (SELECT a.transaction_id, a.abs_amount AS amount, a.counterparty AS dest, a.dn AS day, b.cents, b.abs_amount, b.counterparty, b.dn, b.ts FROM txn a JOIN txn b ON a.account_id = b.account_id AND b.ts < a.ts WHERE a.is_suspicious = 1)"


@query(f"WITH {HISTORY}, g AS (SELECT transaction_id, amount, count(*) AS n, sum(cents) / CAST(count(*) AS DOUBLE) / 100.0 AS mean, quantile_cont(abs_amount, 0.5) AS median, max(abs_amount) AS top FROM h GROUP BY ALL) SELECT transaction_id, n, mean, median, top, amount / mean >= 2.5 OR amount / median >= 2.5 AS deviation FROM g")
def behavior_evidence(spark, sf_dir):
    return metrics.behaviour_evidence(t.txn_events(spark, sf_dir), F.col("is_suspicious") == 1)


@query(f"WITH {HISTORY} SELECT transaction_id, CAST(count(*) FILTER (counterparty = dest) AS BIGINT) AS matches, coalesce(sum(cents) FILTER (counterparty = dest), 0) / 100.0 AS total, min(ts) FILTER (counterparty = dest) AS first_seen, count(*) FILTER (counterparty = dest) = 0 AS is_new FROM h GROUP BY 1")
def beneficiary_evidence(spark, sf_dir):
    return metrics.beneficiary_evidence(t.txn_events(spark, sf_dir), F.col("is_suspicious") == 1)


@query(f"WITH {HISTORY}, g AS (SELECT transaction_id, count(*) FILTER (dn = day) AS day_count, CAST(count(*) AS DOUBLE) / count(DISTINCT dn) AS daily_avg FROM h GROUP BY 1) SELECT *, day_count >= 5 OR day_count > 2 * daily_avg AS high FROM g")
def velocity_evidence(spark, sf_dir):
    return metrics.velocity_evidence(t.txn_events(spark, sf_dir), F.col("is_suspicious") == 1)


@query("SELECT 'C' || c_custkey AS account_id, c_acctbal / 5000.0 >= 1.5 AS ratio_high, c_mktsegment IN ('BUILDING', 'MACHINERY') AS risky, c_acctbal / 5000.0 >= 1.5 OR c_mktsegment IN ('BUILDING', 'MACHINERY') AS inconsistent FROM customer")
def profile_evidence(spark, sf_dir):
    """Balance against a usual balance, and risky segments."""
    high, risky = F.col("c_acctbal") / 5000.0 >= 1.5, F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return t.accounts(spark, sf_dir).select("account_id", high.alias("ratio_high"), risky.alias("risky"), (high | risky).alias("inconsistent"))


@query(f"WITH {v.TXN} SELECT transaction_id, coalesce(sum(cents) OVER (PARTITION BY account_id ORDER BY ts, transaction_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) / 100.0 AS recent_volume FROM txn")
def recent_volume(spark, sf_dir):
    from ..operators.joins import history as last_rows

    return last_rows(t.txn_events(spark, sf_dir), 20, F.col("cents"), "s").select("transaction_id", (F.col("s") / 100.0).alias("recent_volume"))


EVIDENCE = """ev AS (SELECT conv_id AS case_id, turn, CASE role WHEN 'user' THEN 'velocity' WHEN 'assistant' THEN 'beneficiary' ELSE 'profile' END AS type,
CASE WHEN length(text) % 3 = 0 THEN 'SUPPORTING' WHEN length(text) % 3 = 1 THEN 'CONTRADICTING' ELSE 'NEUTRAL' END AS direction, (length(text) % 100) / 100.0 AS confidence,
CASE WHEN length(text) % 7 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status, CASE WHEN length(text) % 5 = 0 THEN 'DEVICE' WHEN length(text) % 5 = 1 THEN 'SANCTIONS' ELSE 'BANK' END AS source FROM conversations)"""


def evidence_items(spark, sf_dir) -> DataFrame:
    """Messages as evidence items: case, type, direction, confidence, status, source."""
    n = F.length("text")
    return t.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), "turn",
        F.when(F.col("role") == "user", "velocity").when(F.col("role") == "assistant", "beneficiary").otherwise("profile").alias("type"),
        F.when(n % 3 == 0, "SUPPORTING").when(n % 3 == 1, "CONTRADICTING").otherwise("NEUTRAL").alias("direction"), ((n % 100) / 100.0).alias("confidence"),
        F.when(n % 7 == 0, "UNAVAILABLE").otherwise("AVAILABLE").alias("status"), F.when(n % 5 == 0, "DEVICE").when(n % 5 == 1, "SANCTIONS").otherwise("BANK").alias("source"),
    )


@query(f"WITH {EVIDENCE} SELECT case_id, count(*) AS total, count(*) FILTER (direction = 'SUPPORTING') AS supporting, count(*) FILTER (direction = 'CONTRADICTING') AS contradicting, round(avg(confidence) FILTER (status = 'AVAILABLE'), 6) AS avg_confidence FROM ev GROUP BY 1")
def evidence_summary(spark, sf_dir):
    return metrics.evidence_summary(evidence_items(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT case_id, round(count(DISTINCT type) FILTER (status = 'AVAILABLE') / 5.0, 3) AS completeness FROM ev GROUP BY 1")
def completeness(spark, sf_dir):
    return metrics.completeness(evidence_items(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT case_id, type, direction, count(DISTINCT source) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ev WHERE status = 'AVAILABLE' GROUP BY ALL")
def corroborate(spark, sf_dir):
    return metrics.corroborate(evidence_items(spark, sf_dir))


@query(f"WITH {EVIDENCE} SELECT case_id, round(avg(CASE source WHEN 'BANK' THEN 1.0 WHEN 'DEVICE' THEN 0.8 ELSE 0.4 END * confidence), 6) AS weighted FROM ev WHERE status = 'AVAILABLE' GROUP BY 1")
def weighted_confidence(spark, sf_dir):
    return metrics.weighted_confidence(evidence_items(spark, sf_dir), {"BANK": 1.0, "DEVICE": 0.8})


@query(f"WITH {EVIDENCE}, c AS (SELECT DISTINCT case_id FROM ev) SELECT case_id, need AS gap FROM c, (SELECT unnest(['DEVICE', 'GEO', 'SANCTIONS']) AS need) WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.case_id = c.case_id AND ev.source = need)")
def evidence_gaps(spark, sf_dir):
    return metrics.evidence_gaps(evidence_items(spark, sf_dir), ["DEVICE", "GEO", "SANCTIONS"])


@query("WITH c AS (SELECT CASE WHEN value / 5 < 30 THEN 'LOW' WHEN value / 5 < 60 THEN 'MED' ELSE 'HIGH' END AS level, event_type FROM events) SELECT CASE WHEN level = 'MED' THEN 'MEDIUM' ELSE level END AS level, count(*) AS n, count(*) FILTER (event_type = 'error') AS waiting FROM c GROUP BY 1")
def risk_counts(spark, sf_dir):
    risk = F.col("value") / 5
    level = F.when(risk < 30, "LOW").when(risk < 60, "MEDIUM").otherwise("HIGH")
    return t.table(spark, sf_dir, "events").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("waiting"))


@query("SELECT toxic, quality, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM labels) AS share FROM labels GROUP BY ALL")
def label_distribution(spark, sf_dir):
    counts = t.table(spark, sf_dir, "labels").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("toxic", "quality", "n", (F.col("n") / F.col("total")).alias("share"))


@query(f"WITH {SCORES} SELECT label, quality, round(avg(score), 9) AS score FROM s GROUP BY ALL")
def score_by_label(spark, sf_dir):
    return t.scores(spark, sf_dir).groupBy("label", "quality").agg(F.round(F.avg("score"), 9).alias("score"))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER (isinf({c})) AS infinite, CAST(sum(CAST({c} AS DECIMAL(38, 6))) AS DOUBLE) / count({c}) AS mean, min({c}) AS low, max({c}) AS high, quantile_cont({c}, 0.5) AS median, count(DISTINCT {c}) AS n, count(DISTINCT {c}) <= 1 AS constant FROM lineitem" for c in _FEATURES))
def feature_quality(spark, sf_dir):
    return metrics.feature_quality(t.table(spark, sf_dir, "lineitem").select(*_FEATURES), _FEATURES)


@query(f"WITH {SCORES} SELECT count(*) FILTER (label = 0 AND score < 0.1) AS tn, count(*) FILTER (label = 0 AND score >= 0.1) AS fp, count(*) FILTER (label = 1 AND score < 0.1) AS fn, count(*) FILTER (label = 1 AND score >= 0.1) AS tp FROM s")
def confusion(spark, sf_dir):
    return t.scores(spark, sf_dir).agg(*metrics.confusion("score", "label", 0.1))


@query(f"""WITH {SCORES}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g),
a AS (SELECT (SELECT sum(label) FROM s) AS pos, (SELECT count(*) - sum(label) FROM s) AS neg)
SELECT round(sum(p * (coalesce(below, 0) + (n - p) / 2.0)) / any_value(pos) / any_value(neg), 9) AS roc_auc, round(sum(CAST(p AS DOUBLE) / pos * cp / cn), 9) AS average_precision FROM c, a""")
def classification_metrics(spark, sf_dir):
    return metrics.ranking_metrics(t.scores(spark, sf_dir), "score", "label")


_T = ", ".join(str(x / 10) for x in range(1, 9))


@query(f"WITH {SCORES}, x AS (SELECT unnest([{_T}]) AS threshold), c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn FROM s, x GROUP BY 1) SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS \"precision\", CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall FROM c")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(t.scores(spark, sf_dir), "score", "label", [x / 10 for x in range(1, 9)])


@query(f"WITH {SCORES} SELECT sum(label) AS fraud, count(*) - sum(label) AS normal, CAST(count(*) - sum(label) AS DOUBLE) / sum(label) AS ratio FROM s")
def imbalance(spark, sf_dir):
    normal = F.count(F.lit(1)) - F.sum("label")
    return t.scores(spark, sf_dir).agg(F.sum("label").alias("fraud"), normal.alias("normal"), (normal / F.sum("label")).alias("ratio"))


@query(f"WITH {SCORES} SELECT round(avg((score - label) * (score - label)), 9) AS brier FROM s")
def brier(spark, sf_dir):
    return t.scores(spark, sf_dir).agg(F.round(F.avg((F.col("score") - F.col("label")) ** 2), 9).alias("brier"))


@query(f"WITH {EDGES}, {DEGREES} SELECT quantile_cont(in_degree + out_degree, 0.95) AS p95, quantile_cont(in_degree + out_degree, 0.99) AS p99 FROM deg")
def degree_percentiles(spark, sf_dir):
    d = graph.degrees(edges(spark, sf_dir).select("src", "dst").distinct()).select((F.col("in_degree") + F.col("out_degree")).alias("d"))
    return spark.createDataFrame([tuple(quantiles(d, "d", [0.95, 0.99]))], "p95 double, p99 double")


@query(f"WITH {EDGES} SELECT count(*) AS edges, count(*) FILTER (src = dst) AS self_loops, count(*) FILTER (NOT abs_amount > 0) AS invalid, count(*) - count(DISTINCT transaction_id) AS repeated FROM e")
def graph_quality(spark, sf_dir):
    return edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.expr("src = dst")).alias("self_loops"), F.count_if(~(F.col("abs_amount") > 0)).alias("invalid"), (F.count(F.lit(1)) - F.countDistinct("transaction_id")).alias("repeated"))


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, count(*) AS n, (SELECT count(*) FROM pairs) AS pairs, min(ts) AS first, max(ts) AS last FROM e")
def scale_profile(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    rest = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src", "dst").alias("pairs"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return nodes.join(F.broadcast(rest))  # one row each


@query(v.with_features(f"SELECT transaction_id FROM flagged WHERE {v.WEIGHTED} >= 3 OR burst_score >= (SELECT quantile_cont(burst_score, 0.95) FROM flagged) + 1e-9 OR is_suspicious = 1", rules=True))
def seed_selection(spark, sf_dir):
    from ..operators.rules import weighted_score
    from .feature_queries import flagged

    df = flagged(spark, sf_dir)
    df = written(df.select("transaction_id", "burst_score", "is_suspicious", weighted_score().alias("weighted")), "seeds")
    cut = quantiles(df, "burst_score", [0.95])[0]
    return df.where((F.col("weighted") >= 3) | (F.col("burst_score") >= F.lit(cut) + 1e-9) | (F.col("is_suspicious") == 1)).select("transaction_id")


@query(f"WITH {SCORES}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY 1) SELECT score, sum(p) OVER (ORDER BY score DESC) / CAST(sum(n) OVER (ORDER BY score DESC) AS DOUBLE) AS precision, sum(p) OVER (ORDER BY score DESC) / CAST((SELECT sum(label) FROM s) AS DOUBLE) AS recall FROM g")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(t.scores(spark, sf_dir), "score", "label").select("score", "precision", "recall")


@query(f"WITH {SCORES}, k AS (SELECT unnest([10, 50, 100]) AS k), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM s) SELECT k, CAST(sum(label) AS DOUBLE) / k AS precision, CAST(sum(label) AS DOUBLE) / (SELECT sum(label) FROM s) AS recall FROM r JOIN k ON i <= k GROUP BY k")
def precision_recall_at_k(spark, sf_dir):
    return metrics.at_k(t.scores(spark, sf_dir), "score", "label", "doc_id", [10, 50, 100])


@query(f"WITH {EDGES}, {DEGREES} SELECT node, cume_dist() OVER (ORDER BY in_degree + out_degree) * 100 AS degree_rank FROM deg")
def degree_rank(spark, sf_dir):
    d = graph.degrees(edges(spark, sf_dir).select("src", "dst").distinct())
    return graph.supernodes(d.select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))).select("node", "degree_rank")


_CURVE = f"""{SCORES}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY 1), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / CAST(sum(n) OVER (ORDER BY score DESC) AS DOUBLE) AS pr, sum(p) OVER (ORDER BY score DESC) / CAST((SELECT sum(label) FROM s) AS DOUBLE) AS re FROM g)"""


@query(f"WITH {_CURVE} SELECT max(score) FILTER (re >= 0.9) AS low, arg_max(score, (CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, score)) AS medium, min(score) FILTER (pr >= 0.15) AS high, min(score) FILTER (pr >= 0.2) AS critical FROM c")
def tune_thresholds(spark, sf_dir):
    return metrics.tune_thresholds(metrics.pr_curve(t.scores(spark, sf_dir), "score", "label"), 0.9, 0.15, 0.2)


@query("WITH b AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem WHERE l_returnflag <> 'R') SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - a) / (z - a), 9) AS scaled FROM lineitem, b")
def minmax_scale(spark, sf_dir):
    """Fitted on normal rows."""
    df = t.table(spark, sf_dir, "lineitem")
    bounds = df.where("l_returnflag <> 'R'").agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("z"))  # one row
    return df.join(F.broadcast(bounds)).select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_extendedprice") - F.col("a")) / (F.col("z") - F.col("a")), 9).alias("scaled"))


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500")
def list_cases(spark, sf_dir):
    return t.table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "ts", "user_id", "value")


@query("SELECT user_id, max(ts) AS updated, bool_or(event_type = 'purchase') AS report_ready FROM events WHERE event_type IN ('error', 'purchase', 'signup', 'view') GROUP BY user_id ORDER BY updated DESC, user_id LIMIT 200")
def list_reports(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase", "signup", "view"))
    return e.groupBy("user_id").agg(F.max("ts").alias("updated"), F.bool_or(F.col("event_type") == "purchase").alias("report_ready")).orderBy(F.desc("updated"), "user_id").limit(200)


@query(f"WITH {EDGES}, {DEGREES} SELECT node, in_degree + out_degree AS degree FROM deg ORDER BY degree DESC, node LIMIT 500")
def top_supernodes(spark, sf_dir):
    d = graph.degrees(edges(spark, sf_dir).select("src", "dst").distinct()).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return d.orderBy(F.desc("degree"), "node").limit(500)


@query("SELECT conv_id AS case_id, turn AS seq, role AS actor, md5(text) AS event, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def audit_trail(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))
    return t.audit_events(spark, sf_dir).select("case_id", "seq", "actor", F.md5("event").alias("event"), place.alias("place"))


@query(f"WITH {v.TXN} SELECT * FROM (SELECT account_id, transaction_id, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) AS place FROM txn) WHERE place <= 20")
def latest_per_account(spark, sf_dir):
    place = Window.partitionBy("account_id").orderBy(F.desc("ts"), F.desc("transaction_id"))
    return t.txn_events(spark, sf_dir).select("account_id", "transaction_id", F.row_number().over(place).alias("place")).where("place <= 20")


@query(v.with_features("SELECT category, transaction_id FROM (SELECT category, transaction_id, row_number() OVER (PARTITION BY category ORDER BY ts, transaction_id) AS i FROM flagged WHERE is_suspicious = 0 AND (" + " OR ".join(f"{f} = 1" for f in v.FLAGS) + ")) WHERE i <= 3", rules=True))
def false_positive_examples(spark, sf_dir):
    from ..operators.rules import rule_score
    from .feature_queries import flagged

    place = Window.partitionBy("category").orderBy("ts", "transaction_id")
    df = flagged(spark, sf_dir).where((F.col("is_suspicious") == 0) & (rule_score() > 0))
    return df.withColumn("i", F.row_number().over(place)).where("i <= 3").select("category", "transaction_id")


@query("SELECT toxic AS model_a, quality AS model_b, count(*) AS n FROM labels GROUP BY ALL")
def report_tables(spark, sf_dir):
    """Agreement of two classifications; ``metrics.write_report`` writes such tables as CSV."""
    return t.table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("model_a"), F.col("quality").alias("model_b")).agg(F.count(F.lit(1)).alias("n"))

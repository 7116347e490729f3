"""Queries of sources, normalisation, duplicates, splits and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ingest, joins
from ..sources import tables as t
from . import oracle_views as v

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


MESSAGES = """m AS (
SELECT event_id, event_id % 4 AS fmt,
  CASE WHEN event_id % 50 = 0 AND (event_id // 50) % 4 = 0 THEN -value ELSE value END AS amount,
  CASE WHEN event_id % 50 = 0 AND (event_id // 50) % 4 = 1 THEN '' ELSE 'A' || user_id END AS source,
  CASE WHEN event_id % 50 = 0 AND (event_id // 50) % 4 = 2 THEN NULL ELSE date_trunc('second', ts) END AS ts,
  CASE WHEN event_id % 50 = 0 AND (event_id // 50) % 4 = 3 THEN '' ELSE event_type END AS kind,
  'A' || json_extract_string(props, '$.k') AS target FROM events),
good AS (SELECT * FROM m WHERE amount > 0 AND source <> '' AND ts IS NOT NULL AND kind <> ''),
c AS (SELECT *, upper(kind) AS transaction_type,
  sha256(concat_ws('|', source, target, printf('%.2f', amount), strftime(ts, '%Y-%m-%dT%H:%M:%S'), upper(kind))) AS fingerprint FROM good)"""


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = ingest.validated(t.raw_messages(spark, sf_dir)).where(F.size("errors") == 0)
    return ingest.identified(ingest.normalised(valid))


@query("SELECT l_orderkey, l_partkey, l_extendedprice, l_returnflag FROM lineitem")
def scan_transactions(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")


@query("SELECT 'C' || c_custkey AS account_id, c_acctbal, c_mktsegment FROM customer")
def scan_profiles(spark, sf_dir):
    return t.accounts(spark, sf_dir).select("account_id", "c_acctbal", "c_mktsegment")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 500")
def scan_limited(spark, sf_dir):
    """An evaluation's first rows: the limit is the feature."""
    return t.table(spark, sf_dir, "events").orderBy("event_id").limit(500).select("event_id", "user_id", "value")


@query(f"WITH {v.TXN_ORDERS} SELECT account_id, arg_min(amount, (ts, transaction_id)) AS amount, count(*) AS n FROM txo GROUP BY account_id UNION ALL SELECT 'C' || c_custkey, c_acctbal, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def preferred_source(spark, sf_dir):
    """The transaction table first, the account table as a fallback."""
    txn = t.txn_orders(spark, sf_dir).groupBy("account_id").agg(F.min_by("amount", F.struct("ts", "transaction_id")).alias("amount"), F.count(F.lit(1)).alias("n"))
    fallback = t.accounts(spark, sf_dir).select("account_id", F.col("c_acctbal").alias("amount"), F.lit(0).cast("long").alias("n"))
    both = txn.withColumn("priority", F.lit(0)).unionByName(fallback.withColumn("priority", F.lit(1)))
    return both.groupBy("account_id").agg(F.min_by(F.struct("amount", "n"), "priority").alias("r")).select("account_id", "r.*")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE trim(n_name) = 'NATION_3'")
def lookup_by_key(spark, sf_dir):
    nation = t.table(spark, sf_dir, "nation").where(F.trim("n_name") == "NATION_3").select(F.col("n_nationkey").alias("c_nationkey"))
    return t.table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", "c_name", "c_nationkey")


IDENTITY = """ident AS (
SELECT 'C' || c_custkey AS account_id, unnest(['device', 'phone', 'ip', 'email']) AS kind,
       unnest([CAST(c_custkey % 97 AS VARCHAR), CAST(c_nationkey * 7 + c_custkey % 7 AS VARCHAR), CAST(c_custkey % 211 AS VARCHAR), lower(c_mktsegment) || (c_custkey % 53)]) AS value
FROM customer)"""


@query(f"WITH {IDENTITY} SELECT * FROM ident")
def scan_identity(spark, sf_dir):
    return t.identity(spark, sf_dir)


@query("SELECT item_id, length(text) AS n, list_distinct(string_split(lower(text), ' ')) IS NOT NULL AS tagged FROM benchmark")
def scan_corpus(spark, sf_dir):
    """The reference texts with their tags; ``sources.tables.read_provisions`` reads the JSON form."""
    return t.table(spark, sf_dir, "benchmark").select("item_id", F.length("text").cast("long").alias("n"), F.array_distinct(F.split(F.lower("text"), " ")).isNotNull().alias("tagged"))


@query(f"WITH {v.TXN} SELECT DISTINCT n AS node_id FROM (SELECT account_id AS n FROM txn UNION ALL SELECT counterparty FROM txn)")
def graph_tables(spark, sf_dir):
    ends = F.explode(F.array("account_id", "counterparty")).alias("node_id")
    return t.txn_events(spark, sf_dir).select(ends).distinct()


@query(f"WITH {v.TXN}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT DISTINCT account_id AS node FROM txn UNION SELECT counterparty FROM txn)) SELECT DISTINCT a.i AS src, b.i AS dst FROM txn JOIN n a ON a.node = account_id JOIN n b ON b.node = counterparty")
def graph_export_indexed(spark, sf_dir):
    """Edges between dense node numbers 0..n-1, in node order."""
    from ..operators.graph import indexed_edges

    return indexed_edges(t.txn_events(spark, sf_dir).select(F.col("account_id").alias("src"), F.col("counterparty").alias("dst")))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS updated FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    """Events upserted by user in three batches, the newest first; the last one is replayed, which changes nothing."""
    events = t.table(spark, sf_dir, "events").select("user_id", "value", "event_type", F.col("ts").alias("updated"), "event_id")
    table = _keyed(spark, events, "user_id")
    day = F.dayofmonth("updated")
    for number, part in enumerate((day > 20, (day > 10) & (day <= 20), day <= 10)):
        table.upsert(events.where(part), ["updated", "event_id"], number)
    table.upsert(events.where(day <= 10), ["updated", "event_id"], 2)
    return table.read().drop("event_id")


def _keyed(spark, rows: DataFrame, key: str):
    import uuid

    from ..sources.durable import shared_folder
    from ..sources.keyed_table import KeyedTable

    return KeyedTable(spark, f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", rows.schema, key, buckets=8)


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') UNION ALL SELECT conv_id, turn, 'replaced' FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AND role = 'user'")
def replace_group(spark, sf_dir):
    """The new rows of a case replace all that it had; buckets without such a case keep their files."""
    old = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    cases = old.where("role = 'system'").select("conv_id").distinct()
    new = old.where("role = 'user'").join(cases, "conv_id", "left_semi").withColumn("role", F.lit("replaced"))
    table = _keyed(spark, old, "conv_id")
    table.replace(old, old)
    table.replace(cases, new)
    return table.read()


@query(f"WITH {MESSAGES} SELECT event_id, source AS source_account, target AS destination_account, amount, 'INR' AS currency, transaction_type, ts AS \"timestamp\", 'IN' AS country, false AS tms_alert FROM c")
def normalize_aliases(spark, sf_dir):
    return canonical(spark, sf_dir).select("event_id", "source_account", "destination_account", "amount", "currency", "transaction_type", "timestamp", "country", "tms_alert")


@query(f"WITH {MESSAGES} SELECT event_id, concat_ws('; ', CASE WHEN amount <= 0 THEN 'invalid amount' END, CASE WHEN ts IS NULL THEN 'invalid timestamp' END, CASE WHEN kind = '' THEN 'invalid transaction_type' END, CASE WHEN source = '' THEN 'invalid source account' END) AS errors FROM m")
def validate_rows(spark, sf_dir):
    return ingest.validated(t.raw_messages(spark, sf_dir)).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("SELECT event_id, date_trunc('day', ts) AS parsed FROM events")
def parse_timestamp_multi(spark, sf_dir):
    """Days written in five of the formats."""
    formats = ["yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss"]
    e = t.table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    text = F.element_at(F.array(*[F.date_format(day, f) for f in formats]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", scalars.parsed_time(text).alias("parsed"))


@query("SELECT event_id, 'A' || user_id AS source_account, coalesce('A' || json_extract_string(props, '$.k'), 'UNK') AS destination_account, abs(value) AS amount, nullif(trim(event_type), '') AS transaction_type FROM events")
def row_to_canonical(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("source_account"),
        F.coalesce(F.concat(F.lit("A"), F.get_json_object("props", "$.k")), F.lit("UNK")).alias("destination_account"),
        F.abs("value").alias("amount"), F.nullif(F.trim("event_type"), F.lit("")).alias("transaction_type"),
    )


@query(f"WITH {v.TXN} SELECT transaction_id, CASE WHEN upper(trim(k)) IN ('CREDIT', 'INCOMING', 'DEPOSIT', 'SALARY', 'REFUND', 'CASHBACK') THEN 'CREDIT' ELSE 'DEBIT' END AS side, CASE WHEN upper(trim(k)) IN ('CREDIT', 'INCOMING', 'DEPOSIT', 'SALARY', 'REFUND', 'CASHBACK') THEN abs(amount) ELSE -abs(amount) END AS amount FROM (SELECT *, CASE category WHEN 'TRADE' THEN 'refund ' WHEN 'INVOICE' THEN 'salary' ELSE 'transfer' END AS k FROM txn)")
def credit_debit_sign(spark, sf_dir):
    kind = F.when(F.col("category") == "TRADE", "refund ").when(F.col("category") == "INVOICE", "salary").otherwise("transfer")
    return t.txn_events(spark, sf_dir).select("transaction_id", scalars.credit_debit(kind).alias("side"), scalars.signed(F.col("amount"), kind).alias("amount"))


@query(f"WITH {v.TXN} SELECT transaction_id, ts, abs_amount, CAST(amount > 0 AS INTEGER) AS is_credit, coalesce(category, 'UNKNOWN') AS category, coalesce(counterparty, 'UNKNOWN') AS counterparty FROM txn")
def preprocess(spark, sf_dir):
    df = ingest.keep_first(t.txn_events(spark, sf_dir), ["transaction_id"], [F.col("ts")])
    return df.select(
        "transaction_id", "ts", "abs_amount", (F.col("amount") > 0).cast("int").alias("is_credit"),
        F.coalesce("category", F.lit("UNKNOWN")).alias("category"), F.coalesce("counterparty", F.lit("UNKNOWN")).alias("counterparty"),
    )


@query("SELECT unnest(['event_id', 'user_id', 'event_type', 'value']) AS name, unnest([count(*) - count(event_id), count(*) - count(user_id), count(*) - count(event_type), count(*) - count(value)]) AS nulls, count(*) AS n FROM events GROUP BY ()")
def schema_report(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    names = ["event_id", "user_id", "event_type", "value"]
    one = e.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.unpivot("n", names, "name", "nulls").select("name", "nulls", "n")


@query("SELECT doc_id, regexp_matches(upper(text), 'CRYPTO|VAULD|WAZIRX|BINANCE|COIN|BTC') AS crypto, regexp_matches(upper(text), 'INFRA|TRADERS|ENTERPRISES|CONSTRUCTION|SUPPLIERS') AS shell FROM documents")
def keyword_flags(spark, sf_dir):
    text = F.col("text")
    return t.table(spark, sf_dir, "documents").select("doc_id", scalars.has_word(text, scalars.CRYPTO_WORDS).alias("crypto"), scalars.has_word(text, scalars.SHELL_WORDS).alias("shell"))


@query(f"WITH {v.TXN} SELECT transaction_id, regexp_matches(category, 'INVOICE|TRADE|SERVICE') AS invoice, regexp_matches(category, 'TRADE|INVOICE|IMPORT|EXPORT') AS trade FROM txn")
def category_regex(spark, sf_dir):
    return t.txn_events(spark, sf_dir).select("transaction_id", F.col("category").rlike("INVOICE|TRADE|SERVICE").alias("invoice"), F.col("category").rlike("|".join(scalars.TRADE_CATEGORIES)).alias("trade"))


@query(f"WITH {v.TXN_ORDERS} SELECT transaction_id, cents % 10000 = 0 AS round_hundred, abs_amount % 10000 = 0 AS round_amount FROM txo")
def round_amount(spark, sf_dir):
    return t.txn_orders(spark, sf_dir).select("transaction_id", (F.col("cents") % 10000 == 0).alias("round_hundred"), (F.col("abs_amount") % 10000 == 0).alias("round_amount"))


@query(f"WITH {MESSAGES} SELECT event_id, fingerprint FROM c")
def fingerprint(spark, sf_dir):
    return canonical(spark, sf_dir).select("event_id", "fingerprint")


@query(f"WITH {MESSAGES} SELECT event_id, 'TXN_' || year(ts) || '_' || upper(fingerprint[1:8]) AS transaction_id, 'INV_' || year(ts) || '_' || upper(fingerprint[1:8]) AS case_id FROM c")
def case_ids(spark, sf_dir):
    return canonical(spark, sf_dir).select("event_id", "transaction_id", "case_id")


@query("SELECT c_custkey, c_name[1:8] || '***' AS masked FROM customer")
def mask_id(spark, sf_dir):
    return t.table(spark, sf_dir, "customer").select("c_custkey", scalars.mask_id(F.col("c_name")).alias("masked"))


@query(f"WITH {v.TXN} SELECT transaction_id, hour(ts) IN (0, 1, 2, 3, 4, 5) AS night FROM txn")
def night_hour(spark, sf_dir):
    return t.txn_events(spark, sf_dir).select("transaction_id", F.hour("ts").isin(0, 1, 2, 3, 4, 5).alias("night"))


@query("WITH s AS (SELECT event_id, value / 500.0 AS s FROM events) SELECT event_id, CASE WHEN s <= 0.3 THEN 'LOW' WHEN s <= 0.6 THEN 'MEDIUM' WHEN s <= 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, CASE WHEN s * 100 < 30 THEN 'LOW' WHEN s * 100 < 60 THEN 'MEDIUM' WHEN s * 100 < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level, CASE WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s")
def severity_bands(spark, sf_dir):
    s, four = F.col("value") / 500.0, ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    return t.table(spark, sf_dir, "events").select(
        "event_id", scalars.band(s, [0.3, 0.6, 0.8], four, right_closed=True).alias("severity"), scalars.band(s * 100, [30, 60, 80], four).alias("level"),
        F.when(s >= 0.75, "HIGH").when(s >= 0.45, "MEDIUM").otherwise("LOW").alias("confidence"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events")
def payload_json(spark, sf_dir):
    """To a JSON payload and back."""
    e = t.table(spark, sf_dir, "events").withColumn("payload", F.to_json(F.struct("value", F.from_json("props", "k int").alias("props"))))
    back = F.from_json("payload", "value double, props struct<k: int>")
    return e.select("event_id", back["props"]["k"].alias("k"), back["value"].alias("value"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(concat_ws(' ', conv_id, role, text)), 'the')")
def queue_filter(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", F.col("conv_id").cast("string"), "role", "text"))
    return t.table(spark, sf_dir, "conversations").where((F.col("role") == "user") & text.contains("the")).select("conv_id", "turn")


@query("SELECT event_id, least(value / 5, 100) AS risk, CASE WHEN least(value / 5, 100) >= 60 THEN 'OPEN' ELSE 'AUTO_CLOSED' END AS status FROM events")
def case_view(spark, sf_dir):
    risk = F.least(F.col("value") / 5, F.lit(100))
    return t.table(spark, sf_dir, "events").select("event_id", risk.alias("risk"), F.when(risk >= 60, "OPEN").otherwise("AUTO_CLOSED").alias("status"))


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS name, unnest([count(DISTINCT l_quantity), count(DISTINCT l_discount), count(DISTINCT l_tax), count(DISTINCT l_linenumber)]) > 1 AS usable FROM lineitem GROUP BY ()")
def finite_filter(spark, sf_dir):
    """Usable features: more than one value, no infinity."""
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    df = t.table(spark, sf_dir, "lineitem")
    one = df.agg(*[((F.min(c) < F.max(c)) & (F.max(F.abs(F.col(c)).cast("double")) < float("inf"))).alias(c) for c in names])
    return one.unpivot([], names, "name", "usable")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def contract_check(spark, sf_dir):
    """Keys that are not unique."""
    return t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT * EXCLUDE (o) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem) WHERE o = 1")
def dedupe_keep_first(spark, sf_dir):
    df = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return ingest.keep_first(df, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]).drop("l_suppkey", "l_quantity")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS occurrence FROM lineitem) WHERE occurrence > 1")
def duplicate_hits(spark, sf_dir):
    df = t.table(spark, sf_dir, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    return ingest.duplicate_hits(df, "key", [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]).select("l_orderkey", "l_linenumber", "l_partkey", "occurrence")


@query(f"WITH {v.TXN} SELECT transaction_id, CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-20' THEN 'train' WHEN CAST(ts AS DATE) <= DATE '2024-01-25' THEN 'valid' ELSE 'test' END AS split FROM txn")
def split_by_date(spark, sf_dir):
    return ingest.split_by_date(t.txn_events(spark, sf_dir), "ts", "2024-01-20", "2024-01-25").select("transaction_id", "split")


@query(f"WITH {v.TXN}, n AS (SELECT *, row_number() OVER (ORDER BY ts, transaction_id) AS i, count(*) OVER () AS n FROM txn) SELECT transaction_id, CASE WHEN i <= floor(n * 0.70) THEN 'train' WHEN i <= floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM n")
def split_70_15_15(spark, sf_dir):
    return ingest.split_by_share(t.txn_events(spark, sf_dir), "ts", "transaction_id").select("transaction_id", "split")


@query()
def sample_fixed(spark, sf_dir):
    return ingest.sample_fixed(t.txn_events(spark, sf_dir), "transaction_id", 300).select("transaction_id", "amount")


@query(f"WITH {v.TXN}, d AS (SELECT n, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT counterparty AS n, count(DISTINCT account_id) AS i, 0 AS o FROM txn GROUP BY 1 UNION ALL SELECT account_id, 0, count(DISTINCT counterparty) FROM txn GROUP BY 1) GROUP BY n) SELECT transaction_id, CAST(coalesce(in_degree, 0) AS BIGINT) AS in_degree, CAST(coalesce(out_degree, 0) AS BIGINT) AS out_degree FROM txn LEFT JOIN d ON n = account_id")
def join_node_metrics(spark, sf_dir):
    from ..operators.graph import degrees

    txn = t.txn_events(spark, sf_dir)
    nodes = degrees(txn.select(F.col("account_id").alias("src"), F.col("counterparty").alias("dst")).distinct()).withColumnRenamed("node", "account_id")
    return joins.with_defaults(txn, nodes, "account_id", {"in_degree": 0, "out_degree": 0}).select("transaction_id", "in_degree", "out_degree")


@query("SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_fraud_intel(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return joins.add_missing(docs, t.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), c_mktsegment) AS category, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_account_customer(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category"))
    customer = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("category"), "c_name")
    return joins.prefer_left(orders, customer, "customer").drop("customer")


@query(f"WITH {v.TXN}, a AS (SELECT account_id, transaction_id AS asked_id, ts AS asked_ts FROM txn WHERE is_suspicious = 1) SELECT * EXCLUDE (n) FROM (SELECT asked_id, transaction_id, row_number() OVER (PARTITION BY asked_id ORDER BY ts DESC, transaction_id DESC) AS place, 0 AS n FROM txn JOIN a USING (account_id) WHERE ts < asked_ts) WHERE place <= 20")
def asof_history(spark, sf_dir):
    """The 20 newest earlier rows of the account, for each suspicious row."""
    txn = t.txn_events(spark, sf_dir)
    asked = txn.where("is_suspicious = 1").select("account_id", F.col("transaction_id").alias("asked_id"), F.col("ts").alias("asked_ts"))
    return joins.asof_history(asked, txn.select("account_id", "transaction_id", "ts"), 20).select("asked_id", "transaction_id", "place")


@query(f"WITH {v.TXN} SELECT transaction_id, count(*) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS count_24h, count(*) OVER (PARTITION BY account_id, counterparty ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS is_new_beneficiary FROM txn")
def velocity_lookup(spark, sf_dir):
    return joins.velocity_lookup(t.txn_events(spark, sf_dir)).select("transaction_id", "count_24h", "is_new_beneficiary")


@query(f"WITH {v.TXN}, {v.TXN_ORDERS} SELECT transaction_id, account_id, amount FROM txn UNION ALL SELECT transaction_id, account_id, amount FROM txo")
def history_union(spark, sf_dir):
    columns = ["transaction_id", "account_id", "amount"]
    return t.txn_events(spark, sf_dir).select(columns).unionByName(t.txn_orders(spark, sf_dir).select(columns))


@query(f"WITH {v.TXN} SELECT a.transaction_id, count(b.transaction_id) AS prior, coalesce(max(b.abs_amount), 0.0) AS top FROM txn a LEFT JOIN txn b ON a.account_id = b.account_id AND b.is_suspicious = 1 AND b.ts < a.ts WHERE a.is_suspicious = 1 GROUP BY 1")
def prior_cases(spark, sf_dir):
    """Earlier suspicious rows of the account, from JSON payloads."""
    from pyspark.sql import Window

    bad = t.txn_events(spark, sf_dir).where("is_suspicious = 1").withColumn("payload", F.to_json(F.struct("abs_amount")))
    risk = F.get_json_object("payload", "$.abs_amount").cast("double")
    earlier = Window.partitionBy("account_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return bad.select("transaction_id", F.count(F.lit(1)).over(earlier).alias("prior"), F.coalesce(F.max(risk).over(earlier), F.lit(0.0)).alias("top"))


SHARED = "sh AS (SELECT kind, value, account_id, min(account_id) OVER w AS representative, count(*) OVER w AS members FROM (SELECT DISTINCT * FROM ident) WINDOW w AS (PARTITION BY kind, value))"


@query(f"WITH {IDENTITY}, {SHARED} SELECT * FROM sh WHERE members > 1")
def shared_identity_pairs(spark, sf_dir):
    return joins.shared_identity_pairs(t.identity(spark, sf_dir))


@query(f"WITH {v.TXN}, e AS (SELECT DISTINCT account_id AS src, counterparty AS dst FROM txn), r AS (SELECT account_id, CAST(sum(is_suspicious) AS DOUBLE) / count(*) AS rate FROM txn GROUP BY 1) SELECT src, round(avg(rate), 9) AS neighbour_risk FROM e JOIN r ON dst = account_id GROUP BY 1")
def neighbor_risk(spark, sf_dir):
    txn = t.txn_events(spark, sf_dir)
    risk = txn.groupBy("account_id").agg((F.sum("is_suspicious") / F.count(F.lit(1))).alias("rate"))
    edges = txn.select(F.col("account_id").alias("src"), F.col("counterparty").alias("dst")).distinct()
    return joins.neighbour_risk(edges, risk).withColumn("neighbour_risk", F.round("neighbour_risk", 9))


@query("SELECT doc_id, coalesce(embedding[1], 0.0) AS first, coalesce(len(embedding), 64) AS n FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_join(spark, sf_dir):
    zero = F.array_repeat(F.lit(0.0), 64)
    e = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 64).alias("e"))
    joined = t.table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left").withColumn("e", F.coalesce("e", zero))
    return joined.select("doc_id", F.col("e")[0].cast("float").alias("first"), F.size("e").alias("n"))


@query(f"WITH {v.TXN}, e AS (SELECT DISTINCT account_id AS src, counterparty AS dst FROM txn) SELECT * FROM e WHERE dst IN (SELECT src FROM e) AND src IN (SELECT dst FROM e)")
def edge_endpoint_semi(spark, sf_dir):
    edges = t.txn_events(spark, sf_dir).select(F.col("account_id").alias("src"), F.col("counterparty").alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("node_id")).intersect(edges.select(F.col("dst").alias("node_id")))
    return joins.endpoints_known(edges, nodes)


@query("SELECT conv_id, max(CASE WHEN role = 'system' THEN n END) AS system, max(CASE WHEN role = 'user' THEN n END) AS user, max(CASE WHEN role = 'assistant' THEN n END) AS assistant FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def case_with_sections(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.count(F.lit(1)))


@query(f"WITH {v.TXN} SELECT transaction_id, account_id FROM txn WHERE transaction_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings) UNION ALL SELECT CAST(vec_id AS VARCHAR), 'stored' FROM embeddings")
def union_except_streamed(spark, sf_dir):
    stored = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("transaction_id"), F.lit("stored").alias("account_id"))
    streamed = t.txn_events(spark, sf_dir).select("transaction_id", "account_id")
    return streamed.join(stored, "transaction_id", "left_anti").unionByName(stored)


@query(f"WITH {v.TXN}, {v.TXN_ORDERS} SELECT transaction_id, account_id, NULL AS is_suspicious FROM txo UNION ALL SELECT transaction_id, account_id, is_suspicious FROM txn")
def union_history(spark, sf_dir):
    """Historical rows without a label, live rows with one."""
    old = t.txn_orders(spark, sf_dir).select("transaction_id", "account_id")
    return old.unionByName(t.txn_events(spark, sf_dir).select("transaction_id", "account_id", "is_suspicious"), allowMissingColumns=True)


@query(f"WITH {v.TXN} SELECT account_id AS node FROM txn EXCEPT SELECT counterparty FROM txn")
def missing_nodes(spark, sf_dir):
    txn = t.txn_events(spark, sf_dir)
    return txn.select(F.col("account_id").alias("node")).subtract(txn.select("counterparty"))


@query("WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark) SELECT item_id, array_to_string(list_sort(list_intersect(w, ['the', 'and', 'of', 'that', 'in'])), ',') AS tags FROM w")
def tag_intersect(spark, sf_dir):
    known = F.array(*map(F.lit, ["the", "and", "of", "that", "in"]))
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return t.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_intersect(words, known)), ",").alias("tags"))

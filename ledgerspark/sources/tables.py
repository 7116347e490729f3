"""Readers, and the transaction-shaped views that the queries use of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_transactions(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Transactions with a declared schema: nothing is inferred, columns outside the schema are not read."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_provisions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {id, jurisdiction, title, summary, tags[]}."""
    schema = "id string, jurisdiction string, title string, summary string, tags array<string>"
    return spark.read.schema(schema).json(path, multiLine=True)


def with_amounts(df: DataFrame) -> DataFrame:
    """abs_amount, cents (whole, so that sums are exact in any order), day number and microseconds."""
    return df.withColumns(
        {
            "abs_amount": F.abs("amount"),
            "cents": F.round(F.abs("amount") * 100).cast("long"),
            "dn": F.datediff("ts", F.lit("1970-01-01")),
            "us": F.unix_micros("ts"),
        }
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event: account to counterparty, microsecond times."""
    credit = F.col("event_type").isin("signup", "view")
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("account_id"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("counterparty"),
        "ts",
        F.when(credit, F.col("value")).otherwise(-F.col("value")).alias("amount"),
        F.when(credit, "CREDIT").otherwise("DEBIT").alias("type"),
        F.when(F.col("event_type") == "purchase", "TRADE").when(F.col("event_type") == "click", "INVOICE").otherwise("TRANSFER").alias("category"),
        ((F.col("event_type") == "error") & (F.col("value") > 50)).cast("int").alias("is_suspicious"),
    )
    return with_amounts(df)


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item: customer to supplier, day-granular times with many ties."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    back = F.col("l_returnflag") == "R"
    df = lines.select(
        F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts], F.to_date("l_shipdate").cast("string")), 256).alias("transaction_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("counterparty"),
        F.col("o_orderdate").alias("ts"),
        F.when(back, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")).alias("amount"),
        F.when(back, "CREDIT").otherwise("DEBIT").alias("type"),
        F.col("o_orderpriority").alias("category"),
    )
    return with_amounts(df)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("customer_id"),
        "c_nationkey", "c_acctbal", "c_mktsegment",
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, kind, value: one row per device, phone, ip and email of an account."""
    key = F.col("c_custkey")
    kinds = {
        "device": key % 97,
        "phone": F.col("c_nationkey") * 7 + key % 7,
        "ip": key % 211,
        "email": F.concat(F.lower("c_mktsegment"), (key % 53).cast("string")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    return (
        table(spark, sf_dir, "customer")
        .select(F.concat(F.lit("C"), key.cast("string")).alias("account_id"), F.explode(rows).alias("x"))
        .select("account_id", "x.kind", "x.value")
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and message (JSON text): four source formats; every fiftieth message is damaged in one of four ways."""
    e = table(spark, sf_dir, "events")
    fmt, damage, bad = F.col("event_id") % 4, (F.col("event_id") / 50).cast("long") % 4, F.col("event_id") % 50 == 0
    amount = F.when(bad & (damage == 0), -F.col("value")).otherwise(F.col("value"))
    source = F.when(bad & (damage == 1), "").otherwise(F.concat(F.lit("A"), F.col("user_id").cast("string")))
    time = F.when(bad & (damage == 2), "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    kind = F.when(bad & (damage == 3), "").otherwise(F.col("event_type"))
    target = F.concat(F.lit("A"), F.get_json_object("props", "$.k"))

    def message(a: str, b: str, c: str, d: str, e: str):
        return F.to_json(F.create_map(*[x for k, v in ((a, source), (b, target), (c, amount.cast("string")), (d, time), (e, kind)) for x in (F.lit(k), v)]))

    return e.select(
        "event_id",
        F.when(fmt == 0, message("sender", "receiver", "amount", "date", "type"))
        .when(fmt == 1, message("from_account", "to_account", "transaction_amount", "timestamp", "transaction_type"))
        .when(fmt == 2, message("src_acc", "dest_acc", "amt", "date", "txn_type"))
        .otherwise(message("source_account", "destination_account", "amount", "txn_date", "transaction_type"))
        .alias("message"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (text length against the longest), label (toxic or low quality) and a split by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars").alias("most"))
    both = table(spark, sf_dir, "labels").join(docs, "doc_id").join(F.broadcast(top))  # one row
    return both.select(
        "doc_id", (F.col("n_chars") / F.col("most")).alias("score"), F.col("toxic").cast("int").alias("label"), F.col("quality").cast("int").alias("quality")
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), F.col("role").alias("actor"), F.col("text").alias("event")
    )

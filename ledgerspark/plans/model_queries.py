"""Queries of models, streams and sinks. Only those that SQL can express have SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, ingest, metrics, ml
from ..operators.order_statistics import quantiles
from ..sources import tables as t
from ..sources.durable import shared_folder, written
from ..sources.keyed_table import KeyedTable
from ..streaming import streams
from . import oracle_views as v
from .feature_queries import flagged

QUERIES, ORACLE = {}, {}
FEATURES = ["abs_amount", "amount_ratio", "amount_zscore", "txns_last_day", "txns_last_7d", "passthrough_ratio", "fan_in_7d", "fan_out_7d", "burst_score", "new_beneficiary"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rows(spark, sf_dir) -> DataFrame:
    """Feature vectors with a label and a split by date, as a table."""
    df = flagged(spark, sf_dir).select("transaction_id", "account_id", "ts", F.col("is_suspicious").alias("label"), *FEATURES)
    df = ingest.split_by_date(df, "ts", "2024-01-20", "2024-01-25").withColumn("valid", F.col("split") == "valid")
    return ml.feature_vector(written(df, "features"), FEATURES)


@query()
def feature_vector(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    return rows(spark, sf_dir).select("transaction_id", vector_to_array("features").alias("features"))


def _trained(spark, sf_dir):
    df = rows(spark, sf_dir)
    return df, ml.train_classifier(df.where("split <> 'test'"), "label")


@query()
def train_classifier(spark, sf_dir):
    """The trained trees, by feature importance."""
    df, model = _trained(spark, sf_dir)
    return ml.importance(model, FEATURES, df)


@query()
def predict_proba(spark, sf_dir):
    df, model = _trained(spark, sf_dir)
    return ml.predict(model, df).select("transaction_id", "probability")


@query()
def calibrate(spark, sf_dir):
    df, model = _trained(spark, sf_dir)
    return ml.calibrated(ml.predict(model, df), "probability", "label").select("transaction_id", "probability", "calibrated")


@query()
def explain_global(spark, sf_dir):
    df, model = _trained(spark, sf_dir)
    return ml.importance(model, FEATURES, df).orderBy(F.desc("importance"), "feature")


@query()
def explain_rows(spark, sf_dir):
    df, model = _trained(spark, sf_dir)
    return ml.explain_rows(model, df, "transaction_id", FEATURES)


@query()
def backtest(spark, sf_dir):
    """Ranking metrics of the trained model on the test split."""
    df, model = _trained(spark, sf_dir)
    return metrics.ranking_metrics(written(ml.predict(model, df.where("split = 'test'")).select("probability", "label"), "backtest"), "probability", "label")


@query()
def score_with_history(spark, sf_dir):
    """The newest row of each account, scored with its history."""
    df, model = _trained(spark, sf_dir)
    newest = df.groupBy("account_id").agg(F.max_by(F.struct("transaction_id", "features"), F.struct("ts", "transaction_id")).alias("r")).select("account_id", "r.*")
    return ml.predict(model, newest).select("account_id", "transaction_id", "probability")


@query()
def isolation_forest_fit(spark, sf_dir):
    """The size of each tree."""
    forest = ml.isolation_forest(rows(spark, sf_dir).where("label = 0"), "transaction_id", FEATURES)
    return spark.createDataFrame([(i, len(tree)) for i, tree in enumerate(forest)], "tree int, nodes int")


@query()
def isolation_forest_score(spark, sf_dir):
    """Anomaly in 0..1; the highest tenth is flagged."""
    df = rows(spark, sf_dir)
    scored = written(ml.isolation_scores(df, ml.isolation_forest(df.where("label = 0"), "transaction_id", FEATURES), FEATURES).select("transaction_id", "anomaly"), "anomaly")
    cut = quantiles(scored, "anomaly", [0.9])[0]
    return scored.select("transaction_id", "anomaly", (F.col("anomaly") > F.lit(cut)).alias("flag"))


@query()
def node_embeddings(spark, sf_dir):
    pairs = graph.edges_of(t.txn_events(spark, sf_dir)).select("src", "dst").distinct()
    return ml.node_embeddings(pairs)


def event_sets(spark, sf_dir, path: str, parts: int = 4):
    """Write the events to path as several sets of files in time order, a set with each step of this iterator. A set may be any number of files; times
    overlap among the files of a set only."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff("ts", F.lit("1970-01-01"))
    low, high = events.agg(F.min(day), F.max(day)).first()
    if low is None:
        yield events.write.parquet(path)
        return
    step = -(-(high - low + 1) // parts)
    for start in range(low, high + 1, step):
        yield events.where(day.between(start, start + step - 1)).write.mode("append").parquet(path)


def new_folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/streams/events-{uuid.uuid4().hex}"


def event_files(spark, sf_dir) -> str:
    """All sets, written one after the other: streams take older files first."""
    path = new_folder(spark)
    for _ in event_sets(spark, sf_dir, path):
        pass
    return path


def stream(spark, sf_dir) -> DataFrame:
    return streams.as_transactions(streams.event_stream(spark, event_files(spark, sf_dir)))


@query("SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'A' || user_id AS account_id, value AS amount FROM events")
def stream_ingest(spark, sf_dir):
    return streams.run_available(stream(spark, sf_dir), "ingest").select("transaction_id", "account_id", "amount")


def keyed_table(spark, name: str, schema: str, key: str) -> KeyedTable:
    import uuid

    return KeyedTable(spark, f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}", schema, key, buckets=8)


@query("SELECT 'CASE-' || event_id AS case_id, 3 AS duplicates FROM events")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice in a run, and there are two runs: one opens a case, three are duplicates of it (fingerprints of different events
    differ in the given table). The second run knows the first one's fingerprints from the stored table only."""
    files = event_files(spark, sf_dir)
    stored = keyed_table(spark, "fingerprints", streams.FINGERPRINTS, "fingerprint")
    log = f"{stored.path}-log"
    for run in ("first", "second"):
        both = streams.event_stream(spark, files, per_trigger=2).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        streams.drop_stored(streams.as_transactions(both), stored, log, run)
    found = spark.read.schema("fingerprint string, case_id string, nth long").option("recursiveFileLookup", True).parquet(log)
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("duplicates"))


@query("WITH p AS (SELECT user_id, CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(ts AS DATE)) AS daily FROM events GROUP BY 1), s AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, round(0.25 * CASE WHEN value >= 50000 THEN 0.2 ELSE 0.05 END + 0.25 * least(daily / 10.0, 1.0) + 0.10 * CASE WHEN hour(ts) < 6 THEN 1.0 ELSE 0.0 END, 4) AS triage FROM events JOIN p USING (user_id)) SELECT transaction_id, CASE WHEN triage < 0.3 THEN 'LOG_ONLY' WHEN triage < 0.6 THEN 'MONITOR' ELSE 'FULL_INVESTIGATION' END AS decision FROM s")
def stream_triage(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    profile = events.groupBy(F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("account_id")).agg((F.count(F.lit(1)) / F.countDistinct(F.to_date("ts"))).alias("daily"))
    return streams.run_available(streams.triaged(stream(spark, sf_dir), written(profile, "profile")), "triage").select("transaction_id", "decision")


@query(f"WITH {v.TXN} SELECT transaction_id, count(*) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS count_24h, count(*) OVER (PARTITION BY account_id, counterparty ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS known FROM txn")
def stream_velocity(spark, sf_dir):
    """State per account in RocksDB. Sets of files arrive in time order, and a batch takes a whole set: what came before a row is in its batch or in the state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = new_folder(spark)
    sets = event_sets(spark, sf_dir, path)
    next(sets)
    txn = streams.as_transactions(streams.event_stream(spark, path, per_trigger=None))
    return streams.run_available(streams.velocity(txn), "velocity", later=sets).select("transaction_id", "count_24h", "known")


@query("SELECT 'A' || user_id AS account_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Daily windows. Update mode: the last update of a window is its result."""
    found = streams.run_available(streams.windowed(stream(spark, sf_dir), "1 day", delay="40 days"), "windows", "update")
    return found.groupBy("account_id", "start").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("account_id", "start", "r.*")


@query(f"WITH {v.TXN} SELECT account_id, arg_max(transaction_id, (ts, transaction_id)) AS transaction_id, max(ts) AS ts FROM txn GROUP BY 1")
def stream_case_upsert(spark, sf_dir):
    """The newest status of each account's case, upserted batch by batch into a keyed table."""
    table = keyed_table(spark, "cases", streams.CASES, "account_id")
    streams.upsert_cases(stream(spark, sf_dir), table)
    return table.read().select("account_id", "transaction_id", "ts")


@query("SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts FROM events ORDER BY ts DESC, transaction_id LIMIT 50")
def stream_recent(spark, sf_dir):
    found = streams.run_available(stream(spark, sf_dir), "recent").select("transaction_id", "ts", "batch")
    return streams.recent(found).select("transaction_id", "ts")


@query(f"WITH {v.TXN} SELECT split, count(*) AS n FROM (SELECT CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-20' THEN 'train' WHEN CAST(ts AS DATE) <= DATE '2024-01-25' THEN 'valid' ELSE 'test' END AS split FROM txn) GROUP BY 1")
def sink_splits(spark, sf_dir):
    """Written by split and read back."""
    import uuid

    path = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    ingest.split_by_date(t.txn_events(spark, sf_dir), "ts", "2024-01-20", "2024-01-25").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(v.with_features("SELECT transaction_id, txns_last_day, new_beneficiary FROM feat"))
def sink_feature_store(spark, sf_dir):
    return written(flagged(spark, sf_dir), "feature-store").select("transaction_id", "txns_last_day", "new_beneficiary")


@query("SELECT conv_id AS case_id, turn AS seq, role AS actor FROM conversations")
def append_audit(spark, sf_dir):
    """The trail is appended to, actor by actor; what is there is never written again."""
    import uuid

    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    events = t.audit_events(spark, sf_dir)
    for part in (F.col("actor") == "user", F.col("actor") == "assistant", ~F.coalesce(F.col("actor").isin("user", "assistant"), F.lit(False))):
        events.where(part).write.mode("append").parquet(path)
    return spark.read.schema(events.schema).parquet(path).select("case_id", "seq", "actor")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_event_sink(spark, sf_dir):
    """Status changes of a stream, appended per batch."""
    found = streams.run_available(stream(spark, sf_dir).select("transaction_id", F.lower("type").alias("status")), "status")
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

"""The live path: files in, duplicates out, velocities kept per account, cases and recent events written per batch."""

from __future__ import annotations

import json
import uuid
from bisect import insort
from collections.abc import Callable, Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.scalars import fingerprint
from ..operators.scoring import route, triage_decision, triage_score
from ..sources.durable import shared_folder, written
from ..sources.keyed_table import KeyedTable

DAY_US = 86_400_000_000
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int | None = 1) -> DataFrame:
    """New parquet files under path, a bounded number per trigger, or all that there are; the checkpoint of the query keeps the offset."""
    naive = StructType.fromDDL(EVENTS.replace("ts timestamp", "ts timestamp_ntz"))
    reader = spark.readStream.schema(naive)
    raw = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def as_transactions(events: DataFrame) -> DataFrame:
    account, other = F.concat(F.lit("A"), F.col("user_id").cast("string")), F.concat(F.lit("A"), F.get_json_object("props", "$.k"))
    df = events.select(F.col("event_id").cast("string").alias("transaction_id"), account.alias("account_id"), other.alias("counterparty"), "ts", F.abs("value").alias("amount"), F.upper("event_type").alias("type"))
    return df.withColumn("fingerprint", fingerprint(F.col("account_id"), F.col("counterparty"), F.col("amount"), F.col("ts"), F.col("type")))


def deduplicated(txn: DataFrame, delay: str = "7 days") -> DataFrame:
    """A fingerprint that returns within the watermark is dropped; state older than that is freed."""
    return txn.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed(txn: DataFrame, length: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Counts and sums per account and event-time window."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = txn.withWatermark("ts", delay).groupBy("account_id", frame.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))
    return counted.select("account_id", F.col("w.start").alias("start"), "n", (F.col("cents") / 100.0).alias("total"))


#: Counterparties of an account, or of a bucket of them, whose times are kept in one value.
IN_ONE = 512


class Velocity(StatefulProcessor):
    """Per account: the times of the last day, and since when each counterparty is known. Values are JSON, as each call to the state costs far more than what
    is in it. An account of up to ``IN_ONE`` counterparties is one value; beyond that they lie in 2^bits buckets, of which a batch reads and
    writes only those of its own counterparties, and whose number doubles as they fill."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = StructType([StructField("json", StringType())])
        self.account = handle.getValueState("account", value)  # times, known (by counterparty, or null), bits, total
        self.buckets = handle.getMapState("buckets", StructType([StructField("bucket", LongType())]), value)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        rows = sorted(((r["us"], r["transaction_id"], r["counterparty"]) for r in rows), key=lambda r: r[0])
        held = self.account.get()
        times, known, bits, total = json.loads(held[0]) if held else ([], [], 0, 0)
        if known is None:
            known = self._read({_bucket(other, bits) for _, _, other in rows})
        since = dict(known)
        before, out = len(since), []
        first = equal = 0  # times[first:] are of the last day, times[equal:] are not before this row
        for us, transaction_id, other in rows:
            while first < len(times) and times[first] < us - DAY_US:
                first += 1
            equal = max(equal, first)
            while equal < len(times) and times[equal] < us:
                equal += 1
            seen = since.get(other)
            # Rows of one moment don't know each other.
            out.append(Row(transaction_id=transaction_id, account_id=key[0], count_24h=equal - first, known=seen is not None and seen < us))
            if seen is None or us < seen:
                since[other] = us
            insort(times, us)
        self._write(times[first:], since, bits, total + len(since) - before)
        yield from out

    def _read(self, buckets) -> list:
        held = [self.buckets.getValue((b,)) for b in buckets]
        return [x for h in held if h for x in json.loads(h[0])]

    def _write(self, times: list, since: dict, bits: int, total: int) -> None:
        whole, parts = total <= IN_ONE, {}
        if total > IN_ONE << bits:  # dealt out anew, and every bucket is written, also an empty one
            if bits:
                since = dict(self._read(range(1 << bits))) | since
            while total > IN_ONE << bits:
                bits += 1
            parts = {b: [] for b in range(1 << bits)}
        if not whole:
            for other, us in since.items():
                parts.setdefault(_bucket(other, bits), []).append((other, us))
            for b, part in parts.items():
                self.buckets.updateValue((b,), (json.dumps(part),))
        self.account.update((json.dumps((times, list(since.items()) if whole else None, bits, total)),))

    def close(self) -> None:
        pass


def _bucket(counterparty: str | None, bits: int) -> int:
    return crc32((counterparty or "").encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def velocity(txn: DataFrame) -> DataFrame:
    """transaction_id, account_id, count_24h and known (whether the counterparty was seen before). Needs the RocksDB state store. Rows of a batch may come in any
    order; no batch may bring rows from before an earlier batch's."""
    rows = txn.select("transaction_id", "account_id", "counterparty", F.unix_micros("ts").alias("us"))
    schema = "transaction_id string, account_id string, count_24h long, known boolean"
    return rows.groupBy("account_id").transformWithState(Velocity(), schema, outputMode="Append", timeMode="None")


def triaged(txn: DataFrame, profile: DataFrame) -> DataFrame:
    """Stream-static join with account profiles (account_id, daily), then the same expressions as in batch."""
    df = txn.join(profile, "account_id", "left")
    score = triage_score(F.col("amount"), F.coalesce("daily", F.lit(0.0)), F.col("daily").isNull(), F.hour("ts") < 6, F.lit(False), F.lit(False))
    decision = triage_decision(score)
    return df.select("transaction_id", "account_id", "ts", score.alias("triage"), decision.alias("decision"), route(decision, score * 100).alias("route"))


def run_available(df: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int, str], None] | None = None, later: Iterator = ()) -> DataFrame:
    """Run a stream over all that is there and read what it wrote; each(batch, number, path) may replace the plain append. With each step of ``later``
    more files arrive, and the stream goes on from its checkpoint."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if each is None:
        def each(batch: DataFrame, number: int, path: str) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}.parquet")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    query = query.foreachBatch(lambda batch, number: each(batch, number, out))
    query.start().awaitTermination()
    for _ in later:
        query.start().awaitTermination()
    schema = df.schema.add("batch", "integer")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def run_each(df: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that is there; each(batch, number) keeps what is to be kept."""
    checkpoint = f"{shared_folder(df.sparkSession)}/streams/{name}-{uuid.uuid4().hex}/checkpoint"
    df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


CASES = "account_id string, transaction_id string, ts timestamp, updates long"


def upsert_cases(txn: DataFrame, table: KeyedTable, source: str = "cases") -> None:
    """Each account's case gets the status of its newest transaction; a batch is combined by account first, and a replayed one changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        newest = F.max_by(F.struct("transaction_id", "ts"), F.struct("ts", "transaction_id")).alias("r")
        table.upsert(batch.groupBy("account_id").agg(newest, F.count(F.lit(1)).alias("updates")).select("account_id", "r.*", "updates"), ["ts", "transaction_id"], number, source)

    run_each(txn, "cases", each)


FINGERPRINTS = "fingerprint string, case_id string, transaction_id string, ts timestamp"


def drop_stored(txn: DataFrame, stored: KeyedTable, log: str, source: str) -> None:
    """Transactions whose fingerprint is stored, from this run or an earlier one, or came before in the batch, are logged under log with
    the earlier case; the others open a case and are stored. A batch meets only the buckets of its own fingerprints."""

    def each(batch: DataFrame, number: int) -> None:
        rows = written(batch.select("fingerprint", F.concat(F.lit("CASE-"), "transaction_id").alias("case_id"), "transaction_id", "ts"), "batch")
        first = rows.groupBy("fingerprint").agg(F.min_by(F.struct("case_id", "transaction_id", "ts"), F.struct("ts", "transaction_id")).alias("r"), F.count(F.lit(1)).alias("n")).select("fingerprint", "r.*", "n")
        first = written(first, "first")
        earlier = stored.read(stored.touched(first)).select("fingerprint", F.col("case_id").alias("earlier"))
        met = written(first.join(earlier, "fingerprint", "left"), "met")
        # A row of the batch is a duplicate of the stored case, or else of the batch's first: all but one of its rows.
        repeats = F.explode(F.sequence(F.lit(1), F.when(F.col("earlier").isNull(), F.col("n") - 1).otherwise(F.col("n"))))
        again = met.where("earlier IS NOT NULL OR n > 1").withColumn("nth", repeats).select("fingerprint", F.coalesce("earlier", "case_id").alias("case_id"), "nth")
        again.write.mode("overwrite").parquet(f"{log}/{source}-{number:06d}.parquet")  # a replayed batch writes the same file
        stored.append(met.where("earlier IS NULL").select("fingerprint", "case_id", "transaction_id", "ts"), number, source)

    run_each(txn, "dedup", each)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def recent(rows: DataFrame, n: int = 50) -> DataFrame:
    """The n newest events, each once."""
    return latest(rows, "transaction_id", ["ts", "batch"]).orderBy(F.desc("ts"), "transaction_id").limit(n)

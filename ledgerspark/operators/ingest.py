"""Messages in, canonical transactions out: aliases, validation, times, duplicates, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import case_id, fingerprint, parsed_time

#: Canonical field -> names under which sources send it, in order of priority.
ALIASES = {
    "source_account": ("source_account", "sender", "from_account", "src_acc", "from", "account_id", "sender_account_id"),
    "destination_account": ("destination_account", "receiver", "to_account", "dest_acc", "to", "counterparty_name", "counterparty", "receiver_account_id"),
    "amount": ("amount", "transaction_amount", "amt", "value"),
    "currency": ("currency", "ccy"),
    "transaction_type": ("transaction_type", "type", "txn_type", "tx_type"),
    "timestamp": ("timestamp", "date", "transaction_date", "txn_date", "created_at"),
    "country": ("country", "country_code", "nation", "sender_country", "receiver_country"),
    "device_id": ("device_id", "device", "deviceId"),
    "tms_alert": ("tms_alert", "tmsAlert", "alert", "watchlist_hit"),
}
#: The shorter lists that validation looks at.
CHECKED = {
    "amount": ("amount", "transaction_amount", "amt"),
    "timestamp": ("timestamp", "date", "transaction_date", "txn_date"),
    "source": ("sender", "from_account", "src_acc", "source_account", "from", "account_id"),
    "destination": ("receiver", "to_account", "dest_acc", "destination_account", "to", "counterparty_name"),
    "type": ("transaction_type", "type", "txn_type"),
}


def fields(message: Column) -> Column:
    """JSON text as a map from name to text."""
    return F.from_json(message, "map<string,string>")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once per row, however often they are used: the optimizer copies expressions into what
    uses them, but not through a generator."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("made")
    return df.select("*", made).select(*df.columns, "made.*")


def first_of(values: Column, names: tuple[str, ...]) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(values[n]), F.lit("")) for n in names])


def any_of(values: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.map_keys(values), F.array(*map(F.lit, names)))


def validated(messages: DataFrame) -> DataFrame:
    """messages (column message) with fields, time (the parsed timestamp of ``fields``) and errors: all errors of a row, none repaired; empty
    means valid. A message is parsed once, and its time once."""
    v = F.col("fields")
    df = once(messages, {"fields": fields(F.col("message"))})
    checked, named = first_of(v, CHECKED["timestamp"]), first_of(v, ALIASES["timestamp"])
    df = once(df, {"checked": checked, "named": named})
    df = once(df, {"valid_time": parsed_time(F.col("checked")), "other_time": F.when(~F.col("named").eqNullSafe(F.col("checked")), parsed_time(F.col("named")))})
    checks = []
    for name, bad, text in (
        ("amount", F.coalesce(first_of(v, CHECKED["amount"]).try_cast("double"), F.lit(0.0)) <= 0, "invalid amount"),
        ("timestamp", F.col("valid_time").isNull(), "invalid timestamp"),
        ("type", first_of(v, CHECKED["type"]).isNull(), "invalid transaction_type"),
        ("source", first_of(v, CHECKED["source"]).isNull(), "invalid source account"),
        ("destination", first_of(v, CHECKED["destination"]).isNull(), "invalid destination account"),
    ):
        there = any_of(v, CHECKED[name])
        checks.append(F.when(~there, text.replace("invalid", "missing")).when(bad, text))
    time = F.when(F.col("named").eqNullSafe(F.col("checked")), F.col("valid_time")).otherwise(F.col("other_time"))
    return df.withColumns({"time": time, "errors": F.array_compact(F.array(*checks))}).drop("checked", "named", "valid_time", "other_time")


def normalised(valid: DataFrame) -> DataFrame:
    """The canonical columns of messages whose errors are empty."""
    of = lambda k: first_of(F.col("fields"), ALIASES[k])
    upper = lambda k, default: F.coalesce(F.upper(of(k)), F.lit(default))
    columns = {
        "source_account": of("source_account"),
        "destination_account": of("destination_account"),
        "amount": F.abs(of("amount").try_cast("double")),
        "currency": upper("currency", "INR"),
        "transaction_type": upper("transaction_type", "TRANSFER"),
        "timestamp": F.col("time"),
        "country": upper("country", "IN"),
        "tms_alert": F.coalesce(F.lower(of("tms_alert")).isin("true", "1", "yes"), F.lit(False)),
    }
    return once(valid, columns).drop("fields", "time", "errors", "message")


def identified(canonical: DataFrame) -> DataFrame:
    """Adds fingerprint and the identifiers derived from it."""
    fp = fingerprint(F.col("source_account"), F.col("destination_account"), F.col("amount"), F.col("timestamp"), F.col("transaction_type"))
    df = canonical.withColumn("fingerprint", fp)
    return df.withColumns({"transaction_id": case_id("TXN", F.col("timestamp"), F.col("fingerprint")), "case_id": case_id("INV", F.col("timestamp"), F.col("fingerprint"))})


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order. Only the key and the order are compared; a hot key is combined before the shuffle."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first"))
    return first.select("first.*")


def duplicate_hits(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows that repeat an earlier row's key, with the first row's number."""
    place = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(place)).where("occurrence > 1")


def split_by_date(df: DataFrame, ts: str, train_end: str, valid_end: str) -> DataFrame:
    """Fixed dates, as parameters."""
    day = F.to_date(ts)
    return df.withColumn("split", F.when(day <= train_end, "train").when(day <= valid_end, "valid").otherwise("test"))


def split_by_share(df: DataFrame, ts: str, key: str, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """By position in time. Positions come from counts per day plus places within a day, so no task sees all rows."""
    per_day = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    before = per_day.select("day", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(ts, key))
    placed = df.withColumn("day", F.to_date(ts)).withColumn("place", place).join(before, "day")
    at = F.col("before") + F.col("place")
    split = F.when(at <= F.floor(F.col("total") * train), "train").when(at <= F.floor(F.col("total") * valid), "valid").otherwise("test")
    return placed.withColumn("split", split).drop("day", "place", "before", "total")


def sample_fixed(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same n rows every time, by hash order."""
    return df.orderBy(F.xxhash64(key), key).limit(n)

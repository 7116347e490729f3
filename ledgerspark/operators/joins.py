"""Joins of transactions with history, identities, profiles, provisions and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import written


def with_defaults(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join, missing values replaced."""
    joined = df.join(other.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def add_missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that adds only the columns df lacks."""
    return df.join(other.select(key, *[c for c in other.columns if c not in df.columns]), key, "left")


def prefer_left(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join; on a name clash the left value wins where it is not null."""
    clash = [c for c in other.columns if c in df.columns and c != key]
    renamed = other.withColumnsRenamed({c: f"{c}__other" for c in clash})
    return df.join(renamed, key, "left").withColumns({c: F.coalesce(c, f"{c}__other") for c in clash}).drop(*[f"{c}__other" for c in clash])


def history(txn: DataFrame, n: int, value: Column, name: str) -> DataFrame:
    """The sum of value over an account's n newest earlier rows: a frame, not a join."""
    frame = Window.partitionBy("account_id").orderBy("ts", "transaction_id").rowsBetween(-n, -1)
    return txn.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)))


def asof_history(asked: DataFrame, past: DataFrame, n: int) -> DataFrame:
    """For each asked (account_id, asked_id, asked_ts) the account's n newest rows (ts, transaction_id) before asked_ts, place 1 the newest.

    One pass over each account in time order: rows carry the n newest up to themselves (a row frame), questions take what the last row
    before them carries. Work grows with the rows times n, not with the square of an account.
    """
    newest = Window.partitionBy("account_id").orderBy("ts", "transaction_id").rowsBetween(1 - n, 0)
    rows = past.select("account_id", "ts", "transaction_id").withColumn("held", F.collect_list(F.struct("ts", "transaction_id")).over(newest))
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    questions = asked.select("account_id", F.col("asked_ts").alias("ts"), none("transaction_id", rows), none("held", rows), "asked_id", F.lit(0).alias("kind"))
    both = rows.select("account_id", "ts", "transaction_id", "held", none("asked_id", questions), F.lit(1).alias("kind")).unionByName(questions)
    before = Window.partitionBy("account_id").orderBy("ts", "kind", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("known", F.last("held", True).over(before)).where("kind = 0")
    return found.select("account_id", "asked_id", F.col("ts").alias("asked_ts"), F.posexplode(F.reverse("known")).alias("place", "row")).select(
        "account_id", "asked_id", "asked_ts", "row.*", (F.col("place") + 1).alias("place")
    )


def velocity_lookup(txn: DataFrame) -> DataFrame:
    """Rows of the account in the 24 hours before each row, and whether the account never saw the counterparty before."""
    day = Window.partitionBy("account_id").orderBy("us").rangeBetween(-86_400_000_000, -1)
    seen = Window.partitionBy("account_id", "counterparty").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return txn.withColumns({"count_24h": F.count(F.lit(1)).over(day), "is_new_beneficiary": F.count(F.lit(1)).over(seen) == 0})


def shared_identity_pairs(identity: DataFrame) -> DataFrame:
    """kind, value, account_id, representative (the value's smallest account), members: accounts that share a value of a kind. Rows
    grow with the accounts of a value, not with their pairs; two accounts share it if both have a row."""
    once = identity.distinct()
    groups = once.groupBy("kind", "value").agg(F.min("account_id").alias("representative"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return once.join(groups, ["kind", "value"])


def tag_overlap(cases: DataFrame, provisions: DataFrame, jurisdiction: str = "IN", most: int | None = None) -> DataFrame:
    """case tags against provisions (a fixed table, which travels as one array): matched tags, + 2 for the jurisdiction, + 1 for GLOBAL. Rows
    with a score, place by score and id; at most ``most`` for each case."""
    bonus = F.when(F.col("jurisdiction") == jurisdiction, 2).when(F.col("jurisdiction") == "GLOBAL", 1).otherwise(0)
    one = provisions.agg(F.collect_list(F.struct("id", "title", "summary", "tags", bonus.alias("bonus"))).alias("provisions"))  # one row

    def judged(p):
        matched = F.array_sort(F.array_intersect("tags", p["tags"]))
        return F.struct(p["id"].alias("id"), p["title"].alias("title"), p["summary"].alias("summary"), matched.alias("matched"), (F.size(matched) + p["bonus"]).alias("score"))

    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    ranked = F.array_sort(F.filter(F.transform("provisions", judged), lambda p: p["score"] > 0), order)
    ranked = F.slice(ranked, 1, most) if most else ranked
    return cases.join(F.broadcast(one)).select("case_id", F.posexplode(ranked).alias("place", "p")).select("case_id", "p.*", (F.col("place") + 1).alias("place"))


def neighbour_risk(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """The mean rate of the successors that have one."""
    return edges.join(risk.withColumnRenamed("account_id", "dst"), "dst").groupBy("src").agg(F.avg("rate").alias("neighbour_risk"))


def similar_cases(cases: DataFrame, vector: list[str], candidates: int = 500, k: int = 5) -> DataFrame:
    """The k cases nearest by cosine among the newest candidates (at most ``candidates``, which travel as one array)."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in vector), F.lit(0.0)))
    known = written(cases.withColumn("norm", norm), "cases")  # read twice, computed once
    newest = known.orderBy(F.desc("updated"), "case_id").limit(candidates)
    one = newest.agg(F.collect_list(F.struct("case_id", *vector, "norm")).alias("newest"))  # one row

    def near(c):
        dot = sum((F.col(x) * c[x] for x in vector), F.lit(0.0))
        cosine = F.when((F.col("norm") > 0) & (c["norm"] > 0), F.round(dot / (F.col("norm") * c["norm"]), 6)).otherwise(0.0)
        return F.struct((-cosine).alias("far"), c["case_id"].alias("other"), cosine.alias("cosine"))

    others = F.filter("newest", lambda c: c["case_id"] != F.col("case_id"))
    ranked = F.slice(F.array_sort(F.transform(others, near)), 1, k)
    # Ranking costs far more than reading: few small rows must not end up in one task.
    tasks = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = known.repartition(tasks).join(F.broadcast(one)).select("case_id", F.posexplode(ranked).alias("place", "c"))
    return found.select("case_id", "c.other", (F.col("place") + 1).alias("place"), "c.cosine")


def endpoints_known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("node_id").alias("src")), nodes.select(F.col("node_id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")

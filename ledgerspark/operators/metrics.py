"""Evidence aggregates and evaluation metrics. Rankings over a whole set go through counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import written
from .order_statistics import quantiles, running_median


def _earlier(*keys: str):
    """The rows of the keys before a row's moment: a frame, not a join."""
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -1)


def behaviour_evidence(txn: DataFrame, asked: Column) -> DataFrame:
    """For asked rows with earlier rows of their account: number, mean, median and largest of those, and whether the amount is far above. Sums are
    frames and the median is carried along; no row meets its history in a join."""
    account = _earlier("account_id")
    df = txn.withColumns({"n": F.count(F.lit(1)).over(account), "cents_before": F.sum("cents").over(account), "top": F.max("abs_amount").over(account)})
    carried = running_median(txn, "account_id", ["us", "transaction_id"], "transaction_id", "abs_amount").select("transaction_id", "prior_median", F.col("n").alias("place"))
    moment = Window.partitionBy("account_id", "us")  # rows of one moment know what its first row knows
    df = df.join(carried, "transaction_id").withColumn("median", F.min_by("prior_median", "place").over(moment))
    mean, amount = F.col("cents_before") / F.col("n") / 100.0, F.col("abs_amount")
    times = lambda usual: F.when(usual == 0, True).otherwise(amount / usual >= 2.5)  # noqa: E731  # where all before is 0, any amount is far above
    far = times(mean) | times(F.col("median"))
    return df.where(asked & (F.col("n") > 0)).select("transaction_id", "n", mean.alias("mean"), "median", "top", far.alias("deviation"))


def beneficiary_evidence(txn: DataFrame, asked: Column) -> DataFrame:
    """For asked rows with earlier rows of their account: payments to the same counterparty before."""
    same = _earlier("account_id", "counterparty")
    df = txn.withColumns({"n": F.count(F.lit(1)).over(_earlier("account_id")), "matches": F.count(F.lit(1)).over(same), "cents_before": F.sum("cents").over(same), "first_seen": F.min("ts").over(same)})
    return df.where(asked & (F.col("n") > 0)).select(
        "transaction_id", "matches", (F.coalesce("cents_before", F.lit(0)) / 100.0).alias("total"), "first_seen", (F.col("matches") == 0).alias("is_new")
    )


def velocity_evidence(txn: DataFrame, asked: Column) -> DataFrame:
    """For asked rows with earlier rows of their account: rows earlier on the day against the mean of days with rows."""
    first = F.row_number().over(Window.partitionBy("account_id", "dn").orderBy("us", "transaction_id")) == 1
    df = txn.withColumn("new_day", first.cast("int"))
    account = _earlier("account_id")
    df = df.withColumns({"n": F.count(F.lit(1)).over(account), "days": F.sum("new_day").over(account), "day_count": F.count(F.lit(1)).over(_earlier("account_id", "dn"))})
    g = df.where(asked & (F.col("n") > 0)).select("transaction_id", "day_count", (F.col("n") / F.col("days")).alias("daily_avg"))
    return g.withColumn("high", (F.col("day_count") >= 5) | (F.col("day_count") > 2 * F.col("daily_avg")))


def evidence_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("direction") == "SUPPORTING").alias("supporting"), F.count_if(F.col("direction") == "CONTRADICTING").alias("contradicting"),
        F.round(F.avg(F.when(F.col("status") == "AVAILABLE", F.col("confidence"))), 6).alias("avg_confidence"),
    )


def completeness(items: DataFrame, categories: int = 5) -> DataFrame:
    return items.groupBy("case_id").agg(F.round(F.countDistinct(F.when(F.col("status") == "AVAILABLE", F.col("type"))) / float(categories), 3).alias("completeness"))


def corroborate(items: DataFrame) -> DataFrame:
    """Per finding: how many different sources, and which."""
    found = items.where("status = 'AVAILABLE'").groupBy("case_id", "type", "direction").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return found.select("case_id", "type", "direction", F.size("sources").cast("long").alias("n"), F.array_join("sources", ",").alias("sources"))


def weighted_confidence(items: DataFrame, reliability: dict[str, float], default: float = 0.4) -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in reliability.items() for x in kv])[F.col("source")], F.lit(default))
    return items.where("status = 'AVAILABLE'").groupBy("case_id").agg(F.round(F.avg(weight * F.col("confidence")), 6).alias("weighted"))


def evidence_gaps(items: DataFrame, needed: list[str]) -> DataFrame:
    have = items.groupBy("case_id").agg(F.collect_set(F.when(F.col("source").isin(needed), F.col("source"))).alias("have"))
    return have.select("case_id", F.explode(F.array_except(F.array(*map(F.lit, needed)), "have")).alias("gap"))


def feature_quality(df: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: missing and infinite values, range, mean, exact median, different values, and whether it is constant."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in names])).alias("r")).select("r.*")
    exact = F.col("x").try_cast("decimal(38,6)")  # sums are then the same in any order
    agg = tall.groupBy("feature").agg(
        F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.abs("x") == float("inf")).alias("infinite"), F.min("x").alias("low"), F.max("x").alias("high"),
        (F.sum(exact).cast("double") / F.count(exact)).alias("mean"), F.countDistinct("x").alias("n"), (F.countDistinct("x") <= 1).alias("constant"),
    )
    medians = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(quantiles(df, c, [0.5])[0]).cast("double"))])
    return agg.withColumn("median", medians[F.col("feature")])


def confusion(score: str, label: str, threshold: float) -> list[Column]:
    hit, bad = F.col(score) >= threshold, F.col(label) == 1
    return [F.count_if(~bad & ~hit).alias("tn"), F.count_if(~bad & hit).alias("fp"), F.count_if(bad & ~hit).alias("fn"), F.count_if(bad & hit).alias("tp")]


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, n, p: rows and positives per distinct score, by which running sums are taken."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))


def running(df: DataFrame, order: Column, sums: dict[str, Column]) -> DataFrame:
    """df with running sums over a global order. Ranges of the order are summed by their own tasks, and each takes what the ranges
    before it hold (one row per range), so no task sees all rows. Rows equal in the order must be one row."""
    ranged = written(df.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"{k}_range") for k, c in sums.items()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = totals.select("range", *[F.coalesce(F.sum(f"{k}_range").over(before), F.lit(0)).alias(f"{k}_before") for k in sums])
    inside = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = ranged.join(F.broadcast(carried), "range").withColumns({k: F.sum(c).over(inside) + F.col(f"{k}_before") for k, c in sums.items()})
    return df.drop("range", *[f"{k}_before" for k in sums])


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, precision, recall, f1 at each distinct score."""
    g = running(by_score(df, score, label), F.desc("score"), {"cn": F.col("n"), "cp": F.col("p")})
    total = df.agg(F.sum(label).alias("all_p"))  # one row
    c = g.join(F.broadcast(total)).select("score", (F.col("cp") / F.col("cn")).alias("precision"), (F.col("cp") / F.col("all_p")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc (ties count half) and average_precision."""
    c = running(by_score(df, score, label), F.desc("score"), {"cn": F.col("n"), "cp": F.col("p")})
    total = df.agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))  # one row
    below = F.col("neg") - (F.col("cn") - F.col("cp"))  # negatives with a smaller score
    area = F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2.0)) / F.first("pos") / F.first("neg")
    return c.join(F.broadcast(total)).agg(F.round(area, 9).alias("roc_auc"), F.round(F.sum(F.col("p") / F.col("pos") * F.col("cp") / F.col("cn")), 9).alias("average_precision"))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    rows = df.select(score, label, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit, bad = F.col(score) >= F.col("threshold"), F.col(label) == 1
    c = rows.groupBy("threshold").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def at_k(df: DataFrame, score: str, label: str, key: str, ks: list[int]) -> DataFrame:
    """Precision and recall of the k best, for a few k: only the largest k rows are ranked."""
    top = df.orderBy(F.desc(score), key).limit(max(ks))
    ranked = top.withColumn("i", F.row_number().over(Window.orderBy(F.desc(score), key)))
    total = df.agg(F.sum(label).alias("positives"))  # one row
    grown = ranked.select("i", label, F.explode(F.array(*map(F.lit, ks))).alias("k")).where("i <= k")
    return grown.groupBy("k").agg(F.sum(label).alias("hits")).join(F.broadcast(total)).select("k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.col("positives")).alias("recall"))


def tune_thresholds(curve: DataFrame, recall: float, high: float, critical: float) -> DataFrame:
    return curve.agg(
        F.max(F.when(F.col("recall") >= recall, F.col("score"))).alias("low"), F.max_by("score", F.struct("f1", "score")).alias("medium"),
        F.min(F.when(F.col("precision") >= high, F.col("score"))).alias("high"), F.min(F.when(F.col("precision") >= critical, F.col("score"))).alias("critical"),
    )


def write_report(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)

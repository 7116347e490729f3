"""Past-only behavioural features.

"Prior" means an earlier row of the account in (ts, transaction_id) order; day windows count whole days. A day window is
a RANGE frame over day numbers up to yesterday plus the earlier rows of the same day, so ties never leak. All windows
share two orderings per account, so Spark sorts each account partition twice, whatever the number of features.
Sums run over whole cents: exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from .order_statistics import quantiles, running_median

#: Fixed values.
POPULATION_MEDIAN = 4183.82
NO_GAP = 999
BAND = (40_000, 50_000)
DAY_US = 86_400_000_000


def _account():
    return Window.partitionBy("account_id").orderBy("ts", "transaction_id")


def _before():
    return _account().rowsBetween(Window.unboundedPreceding, -1)


def _so_far():
    return _account().rowsBetween(Window.unboundedPreceding, 0)


def prior(value: Column, days: int) -> Column:
    """The sum of value over the account's prior rows of the last days."""
    by_day = Window.partitionBy("account_id").orderBy("dn").rangeBetween(-days, -1)
    same_day = Window.partitionBy("account_id", "dn").orderBy("ts", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(by_day), F.lit(0)) + F.coalesce(F.sum(value).over(same_day), F.lit(0))


def behaviour(txn: DataFrame) -> DataFrame:
    """txn (with_amounts) with averages, gaps, velocities, pass-through, novelty and tenure."""
    one = F.lit(1)
    beneficiary = Window.partitionBy("account_id", "counterparty").orderBy("ts", "transaction_id")
    receiver = Window.partitionBy("counterparty").orderBy("ts", "transaction_id", "account_id")
    in_band = F.col("abs_amount").between(*BAND)
    df = txn.withColumns(
        {
            "customer_avg_amount": F.coalesce(F.sum("cents").over(_before()) / F.count(one).over(_before()) / 100.0, F.lit(POPULATION_MEDIAN)),
            "days_since_prev": F.coalesce(F.floor((F.col("us") - F.lag("us").over(_account())) / DAY_US).cast("double"), F.lit(float(NO_GAP))),
            "gap_days": F.col("dn") - F.lag("dn").over(_account()),
            "txns_last_day": prior(one, 1),
            "txns_last_7d": prior(one, 7),
            "credit_1d": prior(F.when(F.col("type") == "CREDIT", F.col("cents")), 1) / 100.0,
            "amt_sent_1d": prior(F.col("cents"), 1) / 100.0,
            "amt_sent_7d": prior(F.col("cents"), 7) / 100.0,
            "near_threshold_cnt_7d": prior(in_band.cast("int"), 7),
            "total_prev_txns": F.row_number().over(_account()) - 1,
            "account_age_days": F.col("dn") - F.min("dn").over(_so_far()),
            "prior_std": F.coalesce(F.stddev_samp("abs_amount").over(_before()), F.lit(0.0)),
            "prev_txns_to_beneficiary": F.row_number().over(beneficiary) - 1,
            "receiver_prev_txns": F.row_number().over(receiver) - 1,
        }
    )
    avg, amount = F.col("customer_avg_amount"), F.col("abs_amount")
    out = F.greatest(F.col("credit_1d"), amount, F.lit(1.0))
    df = df.withColumns(
        {
            "log_amount": F.log1p(amount),
            "is_weekend": (F.weekday("ts") >= 5).cast("int"),
            "is_debit": (F.col("type") == "DEBIT").cast("int"),
            "amount_ratio": amount / (avg + 1),
            "amount_deviation": amount - avg,
            "velocity_score": F.col("txns_last_day") + 0.3 * F.col("txns_last_7d"),
            "passthrough_ratio": F.when(F.col("type") == "DEBIT", F.least("credit_1d", amount) / out).otherwise(0.0),
            "new_beneficiary": (F.col("prev_txns_to_beneficiary") == 0).cast("int"),
            "amount_zscore": F.when(F.col("prior_std") == 0, F.signum(amount - avg) * F.when(amount == avg, 0.0).otherwise(50.0)).otherwise(
                clip((amount - avg) / (F.col("prior_std") + 1e-9), -50, 50)
            ),
            "pattern_change_ratio": F.col("txns_last_day") / (F.col("txns_last_7d") / 7 + 0.1),
            "unusual_gap_flag": (F.col("days_since_prev") > 30).cast("int"),
            "dormant_reactivation": (F.coalesce("gap_days", F.lit(0)) >= 30).cast("int"),
            "structuring_window": (in_band & (F.col("txns_last_7d") + 1 >= 3)).cast("int"),
            "new_sender": (F.row_number().over(Window.partitionBy("counterparty", "account_id").orderBy("ts", "transaction_id")) == 1).cast("int"),
        }
    )
    return df.withColumns(
        {
            "beneficiary_diversity": (F.sum("new_beneficiary").over(_so_far()) - 1) / (F.col("total_prev_txns") + 1),
            "receiver_unique_senders": F.sum("new_sender").over(receiver.rowsBetween(Window.unboundedPreceding, 0)) - 1,
        }
    )


def with_median(df: DataFrame) -> DataFrame:
    """transaction_id, abs_amount, hist_median: the account's prior median, else that of the whole set; robust_amount_score."""
    whole = quantiles(df, "abs_amount", [0.5])[0]
    prior_median = running_median(df, "account_id", ["ts", "transaction_id"], "transaction_id", "abs_amount")
    out = prior_median.select("transaction_id", "abs_amount", F.coalesce("prior_median", F.lit(whole)).alias("hist_median"))
    return out.withColumn("robust_amount_score", clip((F.col("abs_amount") - F.col("hist_median")) / (F.col("hist_median") + 1), -50, 50))


def window_parties(df: DataFrame, span_us: int = 7 * DAY_US) -> DataFrame:
    """df with fan_in_7d and fan_out_7d: different counterparties of the account's credits and debits in the span before each row.

    A counterparty counts from just after a payment until the span has passed without another; each such stretch is a step up and a
    step down, and a row's number is the running sum of steps. Nothing is collected for a row, whatever the window holds.
    """
    party = Window.partitionBy("account_id", "type", "counterparty").orderBy("us")
    seen = df.where("type in ('CREDIT', 'DEBIT') and counterparty is not null").select("account_id", "type", "counterparty", "us")
    seen = seen.withColumns({"last": F.lag("us").over(party), "next": F.lead("us").over(party)})
    up, down = F.col("last").isNull() | (F.col("us") - F.col("last") > span_us), F.col("next").isNull() | (F.col("next") - F.col("us") > span_us)
    step = lambda when, at, by: F.when(when, F.struct(at.alias("us"), F.lit(by).alias("by")))
    steps = seen.select("account_id", "type", F.explode(F.array_compact(F.array(step(up, F.col("us") + 1, 1), step(down, F.col("us") + span_us + 1, -1)))).alias("s"))
    steps = steps.select("account_id", F.col("s.us").alias("us"), *[F.when(F.col("type") == k, F.col("s.by")).otherwise(0).alias(c) for k, c in (("CREDIT", "step_in"), ("DEBIT", "step_out"))])
    rows = df.withColumns({"step_in": F.lit(0), "step_out": F.lit(0), "is_row": F.lit(True)})
    both = rows.unionByName(steps, allowMissingColumns=True)
    so_far = Window.partitionBy("account_id").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumns({"fan_in_7d": F.sum("step_in").over(so_far).cast("int"), "fan_out_7d": F.sum("step_out").over(so_far).cast("int")})
    return counted.where("is_row").drop("step_in", "step_out", "is_row")


def network_windows(df: DataFrame) -> DataFrame:
    """fan_in_7d, fan_out_7d, burst_score and gather_scatter_score over exact time windows."""
    day = Window.partitionBy("account_id").orderBy("us").rangeBetween(-DAY_US, -1)
    df = window_parties(df).withColumn("x", F.count(F.lit(1)).over(day))
    std = F.coalesce(F.stddev_samp("x").over(_before()), F.lit(0.0))
    a, b = F.col("fan_in_7d") + 1, F.col("fan_out_7d") + 1
    return df.withColumns(
        {"burst_score": F.coalesce((F.col("x") - F.avg("x").over(_before())) / (std + 1), F.lit(0.0)), "gather_scatter_score": F.greatest(a / b, b / a)}
    ).drop("x")


def geo_novelty(df: DataFrame, country: str) -> DataFrame:
    seen = Window.partitionBy("account_id", country).orderBy("ts", "transaction_id")
    return df.withColumn("geo_novelty", (F.row_number().over(seen) == 1).cast("int"))


def leakage(df: DataFrame) -> DataFrame:
    """Rows whose average is not that of the account's earlier rows, taken again from the sums that include the row: none if nothing leaks."""
    n = F.count(F.lit(1)).over(_so_far()) - 1
    again = F.when(n > 0, (F.sum("cents").over(_so_far()) - F.col("cents")) / n / 100.0).otherwise(POPULATION_MEDIAN)
    return df.withColumn("again", again).where(F.abs(F.col("again") - F.col("customer_avg_amount")) > 1e-6)

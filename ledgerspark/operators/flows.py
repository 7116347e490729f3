"""Payments that follow each other: counts of time-respecting paths, short cycles, and hubs by period.

Counting takes a number per edge instead of a row per path. ``following`` sums a number over the payments that leave an account within a
time after each payment that reaches it. Accounts are cut into time chunks as long as that time; a payment is put into its own chunk
and the one before, so an arrival finds all that may follow in its chunk, and an account with any number of payments is spread over its chunks.
Paths that visit an account twice are taken off again: those that turn back are sums over the payments of one pair, and those
that close a ring are listed, by two-step paths that meet. Rows are edges, two-step paths within the time, and rings; never longer paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import written

HOUR_US = 3_600_000_000
#: Networks are judged in periods as long as the window of a case, 72 hours to either side.
PERIOD_US = 144 * HOUR_US


def _chunk(us: Column, length: int) -> Column:
    return F.floor(us / F.lit(length))


def period_hubs(edges: DataFrame, absolute: int = 500, percent: int = 99, period_us: int = PERIOD_US) -> DataFrame:
    """node, period: where an account has at least ``absolute`` counterparties in a period, or more than ``percent`` percent of all accounts and periods have.

    Degrees within a period don't grow with the length of the history.
    """
    period = _chunk(F.col("us"), period_us).alias("period")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    seen = edges.where("src <> dst").select(period, ends.alias("e")).select("period", "e.*").distinct()
    degree = seen.groupBy("node", "period").agg(F.count(F.lit(1)).alias("degree"))
    by_degree = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))  # degrees under the absolute bound are few different numbers
    ranked = by_degree.where(F.col("degree") < absolute).select("degree", F.sum("n").over(Window.orderBy("degree")).alias("at_most"))
    total = by_degree.agg(F.sum("n").alias("nodes"))
    cut = ranked.join(F.broadcast(total)).where(100 * F.col("at_most") >= percent * F.col("nodes")).agg(F.min("degree").alias("cut"))  # one row
    return degree.join(F.broadcast(cut)).where((F.col("degree") >= absolute) | (F.col("degree") > F.col("cut"))).select("node", "period")


def calm_edges(edges: DataFrame, hubs: DataFrame, period_us: int = PERIOD_US) -> DataFrame:
    """Edges between different accounts neither of which is a hub in the edge's period."""
    e = edges.where("src <> dst").withColumn("period", _chunk(F.col("us"), period_us))
    for end in ("src", "dst"):
        e = e.join(hubs.withColumnRenamed("node", end), [end, "period"], "left_anti")
    return e.drop("period")


def following(asks: DataFrame, steps: DataFrame, keys: dict[str, str], sums: dict[str, Column], gap_us: int) -> DataFrame:
    """asks, with for each name in sums the sum over the steps whose key columns equal the ask's and whose us is later by at most
    gap_us. keys: column of asks to column of steps."""
    length = gap_us
    names = [f"_{i}" for i in range(len(keys))]
    own = F.struct(*[F.col(c) for c in asks.columns])
    none = F.lit(0).cast("long")
    a = asks.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], "us", _chunk(F.col("us"), length).alias("chunk"), own.alias("ask"), *[none.alias(s) for s in sums])
    chunk = _chunk(F.col("us"), length)
    s = steps.select(
        *[F.col(c).alias(n) for c, n in zip(keys.values(), names)], "us", F.explode(F.array(chunk, chunk - 1)).alias("chunk"),
        F.lit(None).cast(a.schema["ask"].dataType).alias("ask"), *[c.cast("long").alias(n) for n, c in sums.items()],
    )
    then = Window.partitionBy(*names, "chunk").orderBy("us").rangeBetween(1, gap_us)
    both = a.unionByName(s)
    for n in sums:
        both = both.withColumn(n, F.coalesce(F.sum(n).over(then), none))
    return both.where("ask IS NOT NULL").select("ask.*", *sums)


def two_steps(first: DataFrame, second: DataFrame, gap_us: int) -> DataFrame:
    """Paths a -> b -> c of two payments at most gap_us apart, c not a: a, b, c, id1, id2, t1, t2. Payments meet by account and time chunk."""
    chunk = _chunk(F.col("us"), gap_us)
    x = first.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("transaction_id").alias("id1"), F.col("us").alias("t1"), chunk.alias("chunk"))
    y = second.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("transaction_id").alias("id2"), F.col("us").alias("t2"), F.explode(F.array(chunk, chunk - 1)).alias("chunk"))
    return x.join(y, ["b", "chunk"]).where((F.col("t2") > F.col("t1")) & (F.col("t2") - F.col("t1") <= gap_us) & (F.col("a") != F.col("c"))).drop("chunk")


def rings(edges: DataFrame, longest: int = 5, gap_us: int = 72 * HOUR_US, span_us: int | None = 72 * HOUR_US) -> DataFrame:
    """nodes (array, from the first payer on), ids, first_us, last_us: rings of 3 to ``longest`` (at most 5) payments in ascending order, each at
    most gap_us after the one before, all within span_us. Two-step paths that leave an account meet those that come back to it."""
    paid = edges.select(F.col("dst").alias("src")).distinct()
    back = edges.join(paid, "src", "left_semi")  # a ring's payers are paid
    back = back.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    out = two_steps(back, back, gap_us)
    if span_us is not None:
        out = out.where(F.col("t2") - F.col("t1") <= span_us)
    out = written(out, "two-steps")
    step = back.select(F.col("src").alias("c"), F.col("dst").alias("d"), F.col("transaction_id").alias("id3"), F.col("us").alias("t3"))
    home = out.select(F.col("a").alias("d"), F.col("b").alias("e"), F.col("c").alias("a"), F.col("id1").alias("id4"), F.col("id2").alias("id5"), F.col("t1").alias("t4"), F.col("t2").alias("t5"))

    def close(then: str, last: str, end: str) -> Column:
        ok = (F.col(then) > F.col(last)) & (F.col(then) - F.col(last) <= gap_us)
        return ok if span_us is None else ok & (F.col(end) - F.col("t1") <= span_us)

    def ring(df: DataFrame, nodes: list[str], ids: list[str], last: str) -> DataFrame:
        return df.select(F.array(*nodes).alias("nodes"), F.array(*ids).alias("ids"), F.col("t1").alias("first_us"), F.col(last).alias("last_us"))

    three = out.join(step.withColumnRenamed("d", "a"), ["c", "a"]).where(close("t3", "t2", "t3"))
    found = [ring(three, ["a", "b", "c"], ["id1", "id2", "id3"], "t3")]
    if longest >= 4:
        meet = out.join(home.withColumnRenamed("d", "c"), ["a", "c"]).where(close("t4", "t2", "t5") & (F.col("b") != F.col("e")))
        found.append(ring(meet, ["a", "b", "c", "e"], ["id1", "id2", "id4", "id5"], "t5"))
    if longest >= 5:
        ends = home.select("a", "d").distinct()
        longer = out.join(step, "c").where(close("t3", "t2", "t3") & (F.col("d") != F.col("a")) & (F.col("d") != F.col("b"))).join(ends, ["a", "d"], "left_semi")
        meet = longer.join(home, ["a", "d"]).where(close("t4", "t3", "t5") & (F.col("e") != F.col("b")) & (F.col("e") != F.col("c")))
        found.append(ring(meet, ["a", "b", "c", "d", "e"], ["id1", "id2", "id3", "id4", "id5"], "t5"))
    return reduce(DataFrame.unionByName, found)


def circular_flows(edges: DataFrame, longest: int = 5, span_us: int = 72 * HOUR_US) -> DataFrame:
    """nodes, n, times, first_us: rings of 2 to ``longest`` accounts whose payments follow each other within the span."""
    edges = edges.where("src <> dst").select("src", "dst", "us", "transaction_id")
    there = edges.select("src", "dst", F.col("us").alias("t1"))
    again = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("us").alias("t2"))
    two = there.join(again, ["src", "dst"]).where((F.col("t2") > F.col("t1")) & (F.col("t2") - F.col("t1") <= span_us)).select(F.array("src", "dst").alias("nodes"), F.col("t1").alias("first_us"))
    all_rings = two.unionByName(rings(edges, longest, span_us, span_us).select("nodes", "first_us"))
    return all_rings.groupBy("nodes").agg(F.count(F.lit(1)).alias("times"), F.min("first_us").alias("first_us")).select("nodes", F.size("nodes").alias("n"), "times", "first_us")


def chain_counts(edges: DataFrame, gap_us: int = 24 * HOUR_US) -> DataFrame:
    """edges, with s2, s3, s4: how many chains of 3, 4 and 5 different accounts start with the payment, each payment at most gap_us after the one before.

    With s_k(e) known for paths of k payments, s_(k+1)(e) for e = a -> b is the sum of s_k over what leaves b, less the paths that come back to a:
    at once (the sum over payments b -> a), as third account's payee (rings of three, times what may follow), or at the end (a ring).
    """
    e = edges.where("src <> dst").select("src", "dst", "us", "transaction_id")
    one = F.lit(1)
    turn = {"dst": "src", "src": "dst"}
    e = following(e, e, {"dst": "src"}, {"w2": one}, gap_us)
    e = following(e, e, turn, {"r2": one}, gap_us)
    e = written(e.select("src", "dst", "us", "transaction_id", (F.col("w2") - F.col("r2")).alias("s2")), "chains")
    closed = written(rings(e, 4, gap_us, None), "rings")
    ends = closed.groupBy(F.col("ids")[0].alias("transaction_id")).agg(
        F.sum((F.size("nodes") == 3).cast("long")).alias("ring3"), F.sum((F.size("nodes") == 4).cast("long")).alias("ring4")
    )
    # A ring a -> b -> c -> a goes on to a fourth account as often as its last payment does without returning, less the payments a -> b.
    three = closed.where(F.size("nodes") == 3).select(F.col("ids")[0].alias("first"), F.col("nodes")[0].alias("src"), F.col("nodes")[1].alias("dst"), F.col("ids")[2].alias("transaction_id"), F.col("last_us").alias("us"))
    on = following(three, e, {"src": "src", "dst": "dst"}, {"again": one}, gap_us).join(e.select("transaction_id", "s2"), "transaction_id")
    on = on.groupBy(F.col("first").alias("transaction_id")).agg(F.sum(F.col("s2") - F.col("again")).alias("on"))
    e = following(e, e, {"dst": "src"}, {"w3": F.col("s2")}, gap_us)
    e = following(e, e, turn, {"r3": F.col("s2")}, gap_us)
    e = e.join(ends, "transaction_id", "left").join(on, "transaction_id", "left").fillna(0, ["ring3", "ring4", "on"])
    e = written(e.withColumn("s3", F.col("w3") - F.col("r3") - F.col("ring3")).drop("w3", "r3", "ring3"), "chains")
    e = following(e, e, {"dst": "src"}, {"w4": F.col("s3")}, gap_us)
    e = following(e, e, turn, {"r4": F.col("s3")}, gap_us)
    return e.withColumn("s4", F.col("w4") - F.col("r4") - F.col("on") - F.col("ring4")).select("src", "dst", "us", "transaction_id", "s2", "s3", "s4")


def flows(edges: DataFrame) -> DataFrame:
    """node, i and o: what it got and paid, in cents. A payment takes from its first account and brings to its second; a CREDIT (column type,
    where there is one) brings to its first and takes from its second."""
    zero = F.lit(0).cast("long")
    credit = F.col("type") == "CREDIT" if "type" in edges.columns else F.lit(False)
    payer, payee = F.when(credit, F.col("dst")).otherwise(F.col("src")), F.when(credit, F.col("src")).otherwise(F.col("dst"))
    ends = F.array(F.struct(payer.alias("node"), zero.alias("i"), F.col("cents").alias("o")), F.struct(payee.alias("node"), F.col("cents").alias("i"), zero.alias("o")))
    return edges.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))


def mule_chains(edges: DataFrame, gap_us: int = 24 * HOUR_US, share: float = 0.8) -> DataFrame:
    """n0, chains, longest, first_us, score: chains of three to five accounts with at most gap_us between payments, whose second account
    passes on what it gets (the lesser of both flows is at least ``share`` of the greater)."""
    through = flows(edges).where((F.col("i") > 0) & (F.col("o") > 0) & (F.least("i", "o") / F.greatest("i", "o") >= share)).select(F.col("node").alias("dst"))
    counted = chain_counts(edges, gap_us).join(through, "dst", "left_semi").where("s2 > 0")
    long = F.when(F.col("s4") > 0, 5).when(F.col("s3") > 0, 4).otherwise(3)
    agg = counted.groupBy(F.col("src").alias("n0")).agg(F.sum(F.col("s2") + F.col("s3") + F.col("s4")).alias("chains"), F.max(long).alias("longest"), F.min("us").alias("first_us"))
    return agg.withColumn("score", F.least(F.lit(100), 50 + 15 * F.col("chains")) / 100.0)


def rapid_layers(edges: DataFrame, span_us: int = 72 * HOUR_US) -> DataFrame:
    """n1, n2, times, first_us, retention, score: per pair of middle accounts, paths of three payments n0 -> n1 -> n2 -> n3 through different
    accounts in ascending order within the span; first_us is the first middle payment of one. Retention is the part of n1's income that
    n2 doesn't pay out.

    A two-step path n0 -> n1 -> n2 goes on as often as n2 pays after its second payment and within the span of its first: a
    difference of running counts in n2's time chunks. Payments back to n1 or n0 are taken off.
    """
    e = edges.where("src <> dst").select("src", "dst", "us", "transaction_id")
    head = two_steps(e, e, span_us)
    one = F.lit(1)
    length = span_us
    # Departures of an account in a payment's chunk, up to the payment.
    chunk = _chunk(F.col("us"), length)
    leave = e.select(F.col("src").alias("node"), "us", F.explode(F.array(chunk, chunk - 1)).alias("chunk"))
    none = F.lit(None).cast("string")
    upto = Window.partitionBy("node", "chunk").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    arrive = e.select(F.col("dst").alias("node"), "us", chunk.alias("chunk"), F.col("transaction_id").alias("id2"))
    both = leave.select("*", none.alias("id2"), one.alias("w")).unionByName(arrive.withColumn("w", F.lit(0)))
    before = both.withColumn("before", F.sum("w").over(upto)).where("id2 IS NOT NULL").select("id2", "before")
    asks = head.join(before, "id2").select(
        F.col("c").alias("node"), (F.col("t1") + span_us).alias("us"), _chunk(F.col("t2"), length).alias("chunk"), F.struct("a", "b", "id2", "t2", "before").alias("ask")
    )
    both = leave.select("*", F.lit(None).cast(asks.schema["ask"].dataType).alias("ask"), one.alias("w")).unionByName(asks.withColumn("w", F.lit(0)))
    on = both.withColumn("upto", F.sum("w").over(upto)).where("ask IS NOT NULL").select(
        F.col("ask.b").alias("n1"), F.col("node").alias("n2"), "ask.id2", "ask.t2", (F.col("upto") - F.col("ask.before")).alias("times")
    )
    last = e.select(F.col("src").alias("c"), F.col("dst").alias("d"), F.col("us").alias("t3"))
    late = (F.col("t3") > F.col("t2")) & (F.col("t3") - F.col("t1") <= span_us)
    less = [head.join(last.withColumnRenamed("d", end), ["c", end]).where(late).select(F.col("b").alias("n1"), F.col("c").alias("n2"), "id2", "t2", F.lit(-1).cast("long").alias("times")) for end in ("a", "b")]
    per = reduce(DataFrame.unionByName, [on, *less]).groupBy("n1", "n2", "id2", "t2").agg(F.sum("times").alias("times")).where("times > 0")
    agg = per.groupBy("n1", "n2").agg(F.sum("times").alias("times"), F.min("t2").alias("first_us"))
    return _with_retention(agg, edges)


def layer_paths(edges: DataFrame, span_us: int = 72 * HOUR_US) -> DataFrame:
    """n0, n1, n2, n3, times, first_us, retention, score: the same paths with their first and last accounts, each combination a row; first_us is
    the first payment of one. Two-step paths meet what follows by account and time chunk; a row per path is only held until it is counted."""
    e = edges.where("src <> dst").select("src", "dst", "us", "transaction_id")
    chunk = _chunk(F.col("us"), span_us)
    last = e.select(F.col("src").alias("c"), F.col("dst").alias("d"), F.col("us").alias("t3"), F.explode(F.array(chunk, chunk - 1)).alias("chunk"))
    paths = two_steps(e, e, span_us).withColumn("chunk", _chunk(F.col("t2"), span_us)).join(last, ["c", "chunk"])
    paths = paths.where((F.col("t3") > F.col("t2")) & (F.col("t3") - F.col("t1") <= span_us) & (F.col("d") != F.col("a")) & (F.col("d") != F.col("b")))
    names = [F.col(x).alias(f"n{i}") for i, x in enumerate("abcd")]
    agg = paths.groupBy(*names).agg(F.count(F.lit(1)).alias("times"), F.min("t1").alias("first_us"))
    return _with_retention(agg, edges)


def _with_retention(agg: DataFrame, edges: DataFrame) -> DataFrame:
    """agg (with n1, n2, times), retention and score."""
    flow = flows(edges)
    got, paid = flow.select(F.col("node").alias("n1"), "i"), flow.select(F.col("node").alias("n2"), "o")
    kept = F.greatest(F.lit(0.0), (F.col("i") - F.col("o")) / F.col("i"))
    score = F.least(F.lit(100), 50 + 10 * F.col("times") + F.when(F.col("retention") < 0.3, 20).otherwise(0)) / 100.0
    return agg.join(got, "n1").join(paid, "n2").withColumn("retention", kept).select(*agg.columns, "retention", score.alias("score"))

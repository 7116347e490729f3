"""Payment networks as edge tables: weights, degrees, hubs, reach, patterns, and iterative metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import written
from .order_statistics import quantiles

HOUR_US = 3_600_000_000


def edges_of(txn: DataFrame) -> DataFrame:
    return txn.select(F.col("account_id").alias("src"), F.col("counterparty").alias("dst"), "transaction_id", "cents", "abs_amount", "ts", "us", "type")


def edge_weights(edges: DataFrame) -> DataFrame:
    """src, dst, weight: the sum of amounts."""
    return edges.groupBy("src", "dst").agg((F.sum("cents") / 100.0).alias("weight"))


def edge_last(edges: DataFrame) -> DataFrame:
    """The last transaction of each pair."""
    known = edges.where((F.trim("src") != "") & (F.trim("dst") != ""))
    last = F.max_by(F.struct("transaction_id", "abs_amount", "ts"), F.struct("ts", "transaction_id"))
    return known.groupBy("src", "dst").agg(last.alias("r")).select("src", "dst", "r.*")


def degrees(pairs: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of distinct pairs."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return pairs.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def indexed_nodes(pairs: DataFrame) -> DataFrame:
    """node, i: dense numbers in node order. Numbers come from a range sort: counts per partition, then places within."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ranged = written(nodes.repartitionByRange("node").sortWithinPartitions("node").withColumn("part", F.spark_partition_id()), "nodes")
    place = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.withColumn("place", place).join(before, "part").select("node", (F.col("before") + F.col("place") - 1).alias("i"))


def indexed_edges(pairs: DataFrame) -> DataFrame:
    pairs = pairs.distinct()
    n = indexed_nodes(pairs)
    a, b = n.select(F.col("node").alias("src"), F.col("i").alias("a")), n.select(F.col("node").alias("dst"), F.col("i").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def undirected(pairs: DataFrame) -> DataFrame:
    """Both directions, without self loops or repeats."""
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def two_hop(pairs: DataFrame, cap: int = 200) -> DataFrame:
    """node, reach: distinct nodes two hops out, itself not counted; at most cap is reported.

    A neighbour with more than cap successors settles the answer by itself, so only the others are joined: at most cap rows for each pair.
    """
    out = pairs.groupBy("src").agg(F.count_distinct("dst").alias("out"))
    first = pairs.join(out.withColumnRenamed("src", "dst"), "dst").select("src", "dst", "out")
    wide = first.where(F.col("out") > cap).select(F.col("src").alias("node"), F.lit(cap).cast("long").alias("reach")).distinct()
    a, b = first.where(F.col("out") <= cap).alias("a"), pairs.alias("b")
    hops = a.join(b, F.expr("a.dst = b.src")).where("b.dst <> a.src").select(F.col("a.src").alias("node"), F.col("b.dst").alias("far")).distinct()
    near = hops.groupBy("node").agg(F.count(F.lit(1)).alias("reach"))
    return near.unionByName(wide).groupBy("node").agg(F.least(F.max("reach"), F.lit(cap).cast("long")).alias("reach"))


def cycle_nodes(pairs: DataFrame) -> DataFrame:
    """Nodes with an edge to themselves or to one that has an edge back."""
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("node")).distinct()


def supernodes(degree: DataFrame, whitelist: list[str] = [], absolute: int = 500) -> DataFrame:  # noqa: B006
    """node, degree, node_class, is_hub, degree_rank (percentage of nodes with at most this degree)."""
    degree = written(degree, "degrees")
    p95, p99 = quantiles(degree, "degree", [0.95, 0.99])
    total = degree.agg(F.count(F.lit(1)).alias("nodes"))  # one row
    by_degree = degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))  # one row per different degree
    below = by_degree.select("degree", F.sum("n").over(Window.orderBy("degree")).alias("at_most"))
    df = degree.join(below, "degree").join(F.broadcast(total))
    hub = F.col("node").isin(whitelist) | (F.col("degree") >= absolute) | (F.col("degree") >= F.lit(p99))
    kind = F.when(hub, "SUPER_NODE").when(F.col("degree") >= F.lit(p95), "HIGH_DEGREE").otherwise("NORMAL")
    return df.select("node", "degree", kind.alias("node_class"), (kind == "SUPER_NODE").alias("is_hub"), (F.col("at_most") / F.col("nodes") * 100).alias("degree_rank"))


# Patterns. Those of payments that follow each other are in ``flows``.


def cycles(pairs: DataFrame, length: int) -> DataFrame:
    """Simple cycles n0..n_(length-1), the smallest node first, each once."""
    path = pairs.select(F.col("src").alias("n0"), F.col("dst").alias("n1")).where("n0 < n1")
    for h in range(2, length):
        step = pairs.select(F.col("src").alias(f"n{h - 1}"), F.col("dst").alias(f"n{h}"))
        fresh = reduce(lambda a, b: a & b, [F.col(f"n{h}") != F.col(f"n{i}") for i in range(1, h)])
        path = path.join(step, f"n{h - 1}").where((F.col(f"n{h}") > F.col("n0")) & fresh)
    close = pairs.select(F.col("src").alias(f"n{length - 1}"), F.col("dst").alias("n0"))
    return path.join(close, [f"n{length - 1}", "n0"], "left_semi").select(*[f"n{i}" for i in range(length)])


def fan(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """node, n (distinct others), share of the largest, score of at most 1; five others at least."""
    per = edges.where("src <> dst").groupBy(F.col(centre).alias("node"), other).agg(F.sum("cents").alias("cents"))
    agg = per.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("cents").alias("top"), F.sum("cents").alias("total"))
    share = F.col("top") / F.col("total")
    return agg.where("n >= 5").select("node", "n", share.alias("top_share"), F.least(F.lit(1.0), 0.07 * F.col("n") + 0.3 * share).alias("score"))


def weighted_risk(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of the scores that are there (not null), by weight, times 100."""
    total = sum((F.when(s.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    got = sum((F.coalesce(s, F.lit(0.0)) * weights[k] for k, s in scores.items()), F.lit(0.0))
    return F.when(total > 0, got / total * 100).otherwise(0.0)

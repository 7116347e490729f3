"""Iterative metrics of networks: loops of joins that stop when nothing moves, not after a fixed number of rounds.

Each round is a table in the shared folder and takes the place of the one before, which is deleted. The driver sees a few numbers a round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import forget, written
from .graph import undirected


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most_rounds: int = 100) -> tuple[DataFrame, int]:
    """node, rank, and the rounds taken. edges: src, dst, weight. Nodes without out-edges spread their mass evenly.

    What is passed on is the change of a node's rank that it has not passed on yet, and only by nodes where that is large enough to matter;
    the loop ends when all that is left to pass on is below the tolerance.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("sink")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("sink")))).alias("e"))
    nodes = written(ends.groupBy("e.node").agg(F.min("e.sink").alias("sink")), "nodes")  # a sink is never a source
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank")), 0
    small = tolerance / n / 10

    def passed(state: DataFrame) -> DataFrame:
        """node, got: what reaches each node of what active nodes pass on."""
        active = state.where(F.abs("left") > small)
        flow = links.join(active.select(F.col("node").alias("src"), "left"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("left") * F.col("share")).alias("flow"))
        lost = active.where("sink = 1").agg(F.coalesce(F.sum("left"), F.lit(0.0)).alias("lost"))  # one row
        return state.join(flow, "node", "left").join(F.broadcast(lost)).withColumn("got", damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)).drop("flow", "lost")

    start = passed(nodes.withColumn("left", F.lit(1.0 / n)))
    rank = (1 - damping) / n + F.col("got")
    state = written(start.select("node", "sink", rank.alias("rank"), (rank - 1.0 / n).alias("left")), "rank")
    rounds = 1
    while rounds < most_rounds and (state.agg(F.sum(F.abs("left"))).first()[0] or 0.0) >= tolerance:
        kept = F.when(F.abs("left") > small, 0.0).otherwise(F.col("left"))
        new = written(passed(state).select("node", "sink", (F.col("rank") + F.col("got")).alias("rank"), (kept + F.col("got")).alias("left")), "rank")
        forget(state)
        state, rounds = new, rounds + 1
    return state.select("node", "rank"), rounds


def hits(pairs: DataFrame, tolerance: float = 1e-8, most_rounds: int = 100) -> tuple[DataFrame, int]:
    """node, hub, auth, each with sum 1, and the rounds taken until hubs move by less than the tolerance in all."""
    pairs = written(pairs.select("src", "dst").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = written(nodes.select("node", F.lit(1.0).alias("hub"), F.lit(0.0).alias("auth"), F.lit(1.0).alias("moved")), "hits")

    def step(score: str, at: str, to: str) -> DataFrame:
        got = pairs.join(state.withColumnRenamed("node", at), at).groupBy(F.col(to).alias("node")).agg(F.sum(score).alias("got"))
        total = got.agg(F.sum("got").alias("total"))  # one row
        return got.join(F.broadcast(total)).select("node", (F.col("got") / F.col("total")).alias("got"))

    for rounds in range(1, most_rounds + 1):
        auth = state.drop("auth", "moved").join(step("hub", "src", "dst"), "node", "left").select("node", "hub", F.coalesce("got", F.lit(0.0)).alias("auth"))
        half = written(auth, "hits")
        forget(state)
        state = half
        hub = half.join(step("auth", "dst", "src").withColumnRenamed("got", "new"), "node", "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
        state = written(hub.select("node", F.col("new").alias("hub"), "auth", F.abs(F.col("new") - F.col("hub")).alias("moved")), "hits")
        forget(half)
        if (state.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
    return state.select("node", "hub", "auth"), rounds


def kcore(pairs: DataFrame) -> tuple[DataFrame, int]:
    """node, core, and the rounds taken. core: the largest k for which the node is in the k-core of the undirected network.

    A node's estimate starts at its degree and becomes the h-index of its neighbours' estimates (the largest h so that h of them are at least h),
    until none moves; those are the cores. Rounds don't depend on the largest k. Neighbours are counted by estimate first.
    """
    both = written(undirected(pairs), "both")
    state = written(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core")).withColumn("moved", F.lit(True)), "core")
    rounds = 0
    while not state.where("moved").isEmpty():
        seen = both.join(state.select(F.col("node").alias("dst"), F.col("core").alias("near")), "dst").join(state.select(F.col("node").alias("src"), "core"), "src")
        per = seen.groupBy("src", "core", F.least("near", "core").alias("near")).agg(F.count(F.lit(1)).alias("n"))
        least = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("near")))
        best = per.select("src", "core", F.least("near", least).alias("h")).groupBy("src", "core").agg(F.max("h").alias("h"))
        new = written(best.select(F.col("src").alias("node"), F.col("h").alias("core"), (F.col("h") < F.col("core")).alias("moved")), "core")
        forget(state)
        state, rounds = new, rounds + 1
    return state.select("node", "core"), rounds


def reach_minimum(pairs: DataFrame, label: DataFrame) -> tuple[DataFrame, int]:
    """node, label: the smallest label of the nodes from which a node can be reached, itself included; and the rounds taken."""
    state, rounds = written(label.select("node", "label", F.lit(True).alias("moved")), "reach"), 0
    while not state.where("moved").isEmpty():
        got = pairs.join(state.where("moved").select(F.col("node").alias("src"), F.col("label").alias("from")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("from").alias("got"))
        less = F.coalesce(F.col("got") < F.col("label"), F.lit(False))
        new = written(state.join(got, "node", "left").select("node", F.when(less, F.col("got")).otherwise(F.col("label")).alias("label"), less.alias("moved")), "reach")
        forget(state)
        state, rounds = new, rounds + 1
    return state.select("node", "label"), rounds


def strong_components(pairs: DataFrame, worth: float = 0.1) -> tuple[DataFrame, int]:
    """node, component (its smallest node), and the rounds taken.

    Nodes without way in or out are components by themselves. A node with one way in, or one way out, is taken away and shortcut edges lead
    past it; it is later in a component with a way in and a way out of the same one. No two neighbours are taken away at once, and
    edges don't grow in number, so a chain or ring of any length shrinks by a part each round. Once less than ``worth`` of
    the nodes go, the rest is coloured: the smallest label that reaches a node forwards marks its colour, and those that
    reach the colour's root backwards within the colour are a component.
    """
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = written(nodes, "scc-nodes")
    live = written(pairs.select("src", "dst").where("src <> dst").distinct(), "scc")
    removed, rounds, count = [], 0, nodes.count()
    while True:
        rounds += 1
        degree = live.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        degree = degree.groupBy("e.node").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
        ready = degree.where("least(o, i) <= 1").select("node", F.xxhash64("node", F.lit(rounds)).alias("turn"))
        ready = written(ready, "scc-ready")
        a, b = (ready.select(F.col("node").alias(end), F.col("turn").alias(f"{end}_turn")) for end in ("src", "dst"))
        rival = live.join(a, "src").join(b, "dst")
        later = rival.select(F.when(F.expr("(src_turn, src) > (dst_turn, dst)"), F.col("src")).otherwise(F.col("dst")).alias("node")).distinct()
        gone = written(ready.join(later, "node", "left_anti").select("node"), "scc-gone")
        many = gone.count()
        forget(ready)
        if many <= worth * count:
            forget(gone)
            break
        count -= many
        into = live.join(gone.withColumnRenamed("node", "dst"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(True).alias("inward"))
        away = live.join(gone.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(False).alias("inward"))
        cut = written(gone.join(into.unionByName(away), "node", "left"), "scc-cut")
        removed.append(cut)
        past = cut.where("inward").select("node", F.col("other").alias("src")).join(cut.where("NOT inward").select("node", F.col("other").alias("dst")), "node").select("src", "dst")
        left = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        new = written(left.unionByName(past).where("src <> dst").distinct(), "scc")
        forget(live, gone)
        live = new
    component, more = _coloured(live)
    rounds += more
    taken = [cut.select("node") for cut in removed]
    alone = reduce(lambda df, part: df.join(part, "node", "left_anti"), [component.select("node"), *taken], nodes).select("node", F.col("node").alias("component"))
    whole = written(component.unionByName(alone), "scc-placed")
    for cut in reversed(removed):  # those taken away last are placed first
        own = whole.select(F.col("node").alias("other"), "component")
        ways = cut.join(own, "other").groupBy("node", "component").agg(F.max("inward").alias("a"), F.min("inward").alias("b")).where("a AND NOT b").select("node", "component")
        placed = cut.select("node").distinct().join(ways, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        new = written(whole.unionByName(placed), "scc-placed")
        forget(whole, cut)
        whole = new
    named = whole.groupBy("component").agg(F.min("node").alias("first"))
    return whole.join(named, "component").select("node", F.col("first").alias("component")), rounds


def _coloured(live: DataFrame) -> tuple[DataFrame, int]:
    nodes = written(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    out, rounds = [nodes.where(F.lit(False)).select("node", F.col("node").alias("component"))], 0
    while not nodes.isEmpty():
        colour, n = reach_minimum(live, nodes.withColumn("label", F.col("node")))
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("la")), colour.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
        inside = written(live.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst"), "inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        seed = colour.withColumn("label", F.when(F.col("node") == F.col("label"), 0).otherwise(1))  # label 0 spreads from roots only
        reached, m = reach_minimum(back, seed)
        found = written(colour.join(reached.where("label = 0").select("node"), "node", "left_semi").withColumnRenamed("label", "component"), "found")
        out.append(found)
        nodes = written(nodes.join(found, "node", "left_anti"), "nodes")
        live = written(live.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
        rounds += n + m
    return reduce(DataFrame.unionByName, out), rounds


def label_propagation(pairs: DataFrame, rounds: int = 6) -> DataFrame:
    """node, community: the most frequent label among neighbours, the smallest on ties, in synchronous rounds."""
    both = written(undirected(pairs), "both")
    label = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        label = written(seen.groupBy("src").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")).withColumnRenamed("src", "node"), "labels")
    return label


def modularity(pairs: DataFrame, label: DataFrame) -> float:
    """Share of the undirected network's edges within communities, less what chance would put there. label: node, community."""
    return _modularity(undirected(pairs).withColumn("weight", F.lit(1).cast("long")), label)


def _modularity(both: DataFrame, label: DataFrame) -> float:
    a, b = label.select(F.col("node").alias("src"), F.col("community").alias("ca")), label.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    per = both.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum("weight").cast("double").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).cast("double").alias("inside"))
    total = per.agg(F.sum("all"), F.sum("inside"), F.sum(F.col("all") * F.col("all"))).first()
    return total[1] / total[0] - total[2] / total[0] ** 2 if total[0] else 0.0


def communities(pairs: DataFrame, most_rounds: int = 8, most_levels: int = 8, least_gain: float = 1e-4) -> tuple[DataFrame, float]:
    """node, community (its smallest node), and the modularity. Levels of local moves: nodes move to the neighbouring community that
    raises modularity most (the smallest on ties), half of them at a time, by the hash of node and round, so that neighbours don't swap for ever;
    a level's communities are the next one's nodes, and edges between them add up. The best state of all rounds counts. Weights are
    whole numbers, so gains are compared exactly.
    """
    both = written(undirected(pairs).withColumn("weight", F.lit(1).cast("long")), "weights")
    total = both.agg(F.sum("weight")).first()[0] or 0
    whole = written(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "whole")  # of original nodes
    best = _modularity(both, whole) if total else 0.0
    for _ in range(most_levels):
        strength = written(both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "strength")
        label = written(strength.select("node", F.col("node").alias("community")), "labels")
        top, kept, still = best, None, 0
        for turn in range(2 * most_rounds):
            mass = label.join(strength, "node").groupBy("community").agg(F.sum("k").alias("mass"))
            near = both.where("src <> dst").join(label.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
            own = label.select("node", "community", F.lit(0).cast("long").alias("w"))
            ways = near.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
            ways = ways.join(label.withColumnRenamed("community", "now"), "node").join(strength, "node").join(mass, "community")
            others = F.col("mass") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0)
            gain = F.col("w").cast("decimal(19,0)") * total - F.col("k").cast("decimal(19,0)") * others
            to = ways.groupBy("node", "now").agg(F.min_by("community", F.struct((-gain).alias("g"), (F.col("community") != F.col("now")).alias("moves"), "community")).alias("to"))
            turns = F.abs(F.xxhash64("node", F.lit(turn // 2))) % 2 == turn % 2
            new = written(to.select("node", F.when(turns, F.col("to")).otherwise(F.col("now")).alias("community")), "labels")
            forget(*([label] if label is not kept else []))
            label, value = new, _modularity(both, new)
            if value > top + least_gain:
                forget(*([kept] if kept is not None else []))
                top, kept, still = value, new, 0
            else:
                still += 1
                if still == 2:
                    break
        if kept is None:
            break
        best = top
        grown = whole.join(kept.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community"))
        ends = (kept.select(F.col("node").alias(end), F.col("community").alias(f"new_{end}")) for end in ("src", "dst"))
        merged = reduce(lambda df, e: df.join(e, e.columns[0]), ends, both).groupBy(F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        grown, merged = written(grown, "whole"), written(merged, "weights")
        forget(whole, both)
        whole, both = grown, merged
    first = whole.groupBy("community").agg(F.min("node").alias("first"))
    return whole.join(first, "community").select("node", F.col("first").alias("community")), best

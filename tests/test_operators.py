"""Small exact cases."""

import os
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from ledgerspark.operators import features, flows, graph, ingest, joins, metrics, ml, network_metrics, order_statistics, rules, scoring, traversal
from ledgerspark.plans import model_queries
from ledgerspark.sources import keyed_table
from ledgerspark.sources.durable import written
from ledgerspark.sources.tables import with_amounts
from ledgerspark.streaming import streams

TXN = "transaction_id string, account_id string, counterparty string, ts timestamp, amount double, type string, category string"
T0 = datetime(2024, 1, 1, 9)
EDGE = "src string, dst string, us long, cents long, transaction_id string"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, int(h * 3600e6), int(m * 100), f"t{i}") for i, (a, b, m, h) in enumerate(rows)], EDGE)


def test_features_against_loops(spark):
    """With ties in time, days without rows, and several accounts."""
    r = random.Random(5)
    rows = []
    for i in range(160):
        ts = datetime(2024, 1, 1) + timedelta(days=r.randint(0, 12), hours=r.choice([0, 9, 9, 15]))
        rows.append((f"t{i:03d}", f"a{r.randint(0, 3)}", f"c{r.randint(0, 5)}", ts, round(r.uniform(-500, 500), 2), r.choice(["CREDIT", "DEBIT"]), "X"))
    got = {x["transaction_id"]: x for x in features.behaviour(with_amounts(spark.createDataFrame(rows, TXN))).collect()}
    for t, a, c, ts, amount, kind, _ in rows:
        prior = [x for x in rows if x[1] == a and (x[3], x[0]) < (ts, t)]
        days = [(ts.date() - x[3].date()).days for x in prior]
        assert got[t]["txns_last_day"] == sum(d <= 1 for d in days)
        assert got[t]["txns_last_7d"] == sum(d <= 7 for d in days)
        assert got[t]["prev_txns_to_beneficiary"] == sum(x[2] == c for x in prior)
        mean = sum(abs(x[4]) for x in prior) / len(prior) if prior else features.POPULATION_MEDIAN
        assert got[t]["customer_avg_amount"] == pytest.approx(mean)
        credit = sum(abs(x[4]) for x, d in zip(prior, days, strict=True) if x[5] == "CREDIT" and d <= 1)
        want = min(credit, abs(amount)) / max(credit, abs(amount), 1.0) if kind == "DEBIT" else 0.0
        assert got[t]["passthrough_ratio"] == pytest.approx(want)


def test_features_do_not_depend_on_row_order(spark):
    rows = [(f"t{i}", "a", f"c{i % 3}", T0 + timedelta(hours=i), 10.0 + i, "CREDIT", "X") for i in range(20)]
    a, b = (features.behaviour(with_amounts(spark.createDataFrame(x, TXN))).orderBy("transaction_id").collect() for x in (rows, rows[::-1]))
    assert a == b


def test_behaviour_evidence(spark):
    amounts = [4000, 5000, 6000, 5500, 4500] * 4
    rows = [(f"t{i:02d}", "a", "b", T0 + timedelta(hours=i), float(a), "CREDIT", "X") for i, a in enumerate(amounts)]
    rows += [("x", "a", "b", T0 + timedelta(hours=99), 100000.0, "CREDIT", "X"), ("y", "a", "b", T0 + timedelta(hours=99), 5000.0, "CREDIT", "X"), ("z", "new", "b", T0, 5.0, "CREDIT", "X")]
    got = {x["transaction_id"]: x for x in metrics.behaviour_evidence(with_amounts(spark.createDataFrame(rows, TXN)), F.col("transaction_id").isin("x", "y", "z")).collect()}
    assert set(got) == {"x", "y"}  # z has no history; x and y are of one moment and don't see each other
    assert (got["x"]["n"], got["x"]["mean"], got["x"]["median"], got["x"]["top"], got["x"]["deviation"]) == (20, 5000.0, 5000.0, 6000.0, True)
    assert (got["y"]["n"], got["y"]["median"], got["y"]["deviation"]) == (20, 5000.0, False)


@pytest.mark.parametrize("shape", ["random", "ties", "zigzag"])
def test_running_medians_of_a_hot_key(spark, shape):
    """A key of many chunks, and small ones; chunks of 8 need several steps down, chunks of 4096 none."""
    r = random.Random(2)
    value = {"random": lambda i: r.random(), "up": float, "down": lambda i: -float(i), "ties": lambda i: float(r.randrange(4)), "zigzag": lambda i: float(i if i % 2 else -i)}[shape]
    rows = [(key, f"{key}{i}", value(i), i) for key, n in (("hot", 700), ("b", 3), ("c", 90), ("d", 1)) for i in range(n)]
    want, seen = {}, {}
    for key, i, x, _ in rows:
        so_far = seen.setdefault(key, [])
        want[i] = (len(so_far), statistics.median(so_far) if so_far else None)
        so_far.append(x)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "account string, id string, x double, t long")
    for chunk in (8, 4096):
        got = order_statistics.running_median(df, "account", ["t"], "id", "x", chunk=chunk)
        assert {x["id"]: (x["n"], x["prior_median"]) for x in got.collect()} == want


def test_quantiles_by_selection(spark):
    r = random.Random(3)
    at = [0, 0.05, 0.5, 0.95, 0.99, 1]
    for values in ([r.random() for _ in range(5000)], [1.0] * 3000 + [2.0] * 2000, [float(r.randrange(7)) for _ in range(4000)], [3.0], [float("nan"), None, 1.0, 2.0], [r.expovariate(1) ** 9 for _ in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = order_statistics.quantiles(df, "v", at, enough=50, accuracy=100)
        assert got == pytest.approx(np.quantile([v for v in values if v is not None and v == v], at))
    assert order_statistics.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_mule_chain(spark):
    e = edges(spark, [("X0", "M1", 50000, 9), ("M1", "M2", 50000, 10), ("M2", "M3", 49500, 12), ("M3", "M4", 49000, 14)])
    found = {x["n0"]: (x["chains"], x["longest"]) for x in flows.mule_chains(e).collect()}
    assert found == {"X0": (3, 5), "M1": (2, 4), "M2": (1, 3)}


def brute_paths(rows, hops, gap, span=None):
    """Paths of payments (src, dst, us) through different accounts."""
    out = [[r] for r in rows if r[0] != r[1]]
    for _ in range(hops - 1):
        out = [p + [r] for p in out for r in rows if r[0] == p[-1][1] and 0 < r[2] - p[-1][2] <= gap and (span is None or r[2] - p[0][2] <= span) and r[1] not in {p[0][0], *(x[1] for x in p)}]
    return out


@pytest.mark.parametrize("accounts,payments", [(4, 60), (9, 90), (40, 150)])
def test_counts_are_those_of_listed_paths(spark, accounts, payments):
    r = random.Random(accounts)
    hour = flows.HOUR_US
    rows = [(f"n{r.randrange(accounts)}", f"n{r.randrange(accounts)}", r.randrange(300) * hour // 2, f"t{i}", r.randrange(1, 900)) for i in range(payments)]
    e = spark.createDataFrame(rows, "src string, dst string, us long, transaction_id string, cents long")
    plain = [(a, b, t, i) for a, b, t, i, _ in rows]
    gap = 24 * hour
    counts = {x["transaction_id"]: (x["s2"], x["s3"], x["s4"]) for x in flows.chain_counts(e, gap).collect()}
    want = {i: [0, 0, 0] for a, b, _, i in plain if a != b}
    for k in (2, 3, 4):
        for p in brute_paths(plain, k, gap):
            want[p[0][3]][k - 2] += 1
    assert counts == {i: tuple(c) for i, c in want.items()}
    span = 72 * hour
    layers = {(x["n1"], x["n2"]): (x["times"], x["first_us"]) for x in flows.rapid_layers(e, span).collect()}
    per = {}
    for p in brute_paths(plain, 3, span, span):
        n, first = per.get((p[0][1], p[1][1]), (0, p[1][2]))
        per[p[0][1], p[1][1]] = n + 1, min(first, p[1][2])
    assert layers == per and per
    found = {tuple(x["nodes"]): (x["times"], x["first_us"]) for x in flows.circular_flows(e).collect()}
    per = {}
    for k in (2, 3, 4, 5):
        for p in brute_paths(plain, k - 1, span, span):
            for last in plain:
                if last[0] == p[-1][1] and last[1] == p[0][0] and last[2] > p[-1][2] and last[2] - p[0][2] <= span:
                    nodes = (p[0][0], *(x[1] for x in p))
                    n, first = per.get(nodes, (0, p[0][2]))
                    per[nodes] = n + 1, min(first, p[0][2])
    assert found == per and per


def test_hubs_are_judged_by_period(spark):
    day = 24 * flows.HOUR_US
    busy = [(f"n{i}", "hub", 0, f"a{i}") for i in range(30)]
    quiet = [("hub", f"n{i}", (10 + 7 * i) * day, f"b{i}") for i in range(30)] + [(f"n{i}", f"m{i}", i * day, f"c{i}") for i in range(60)]
    e = spark.createDataFrame(busy + quiet, "src string, dst string, us long, transaction_id string")
    hubs = flows.period_hubs(e, absolute=20)
    assert [tuple(x) for x in hubs.collect()] == [("hub", 0)]
    assert {x["transaction_id"] for x in flows.calm_edges(e, hubs).collect()} == {x[3] for x in quiet}


def test_fan_in(spark):
    e = edges(spark, [(f"S{i}", "HUB", 1000 + i, i) for i in range(7)])
    found = graph.fan(e, "dst", "src").collect()
    assert [(x["node"], x["n"]) for x in found] == [("HUB", 7)]
    assert graph.fan(edges(spark, [("A", "B", 100, 0), ("B", "C", 90, 1)]), "dst", "src").isEmpty()


def test_cycles_are_listed_once(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("a", "a")], "src string, dst string")
    assert [tuple(x) for x in graph.cycles(p, 2).collect()] == [("a", "b")]
    assert [tuple(x) for x in graph.cycles(p, 3).collect()] == [("a", "b", "c")]


HOUR = 3_600_000_000


def brute_traversal(rows, seed, at, hubs, hops=4, most=2000, window=72 * HOUR):
    """Levels with the fewest hubs passed; payments that touch an account that was left. Of an account's ways of one level the one
    with the fewest hubs counts."""
    inside = [r for r in rows if abs(r[2] - at) <= window and r[0] != r[1]]
    seen, front = {seed: (0, 0)}, {seed: 0}
    left, truncated = set(), False
    for level in range(1, hops + 1):
        ready = {n: h for n, h in front.items() if n == seed or n not in hubs or h == 0}
        left |= set(ready)
        new = {}
        for a, b, *_ in inside:
            for x, y in ((a, b), (b, a)):
                if x in ready and y not in seen:
                    new[y] = min(new.get(y, 99), ready[x] + (x in hubs))
        if len(seen) + len(new) > most:
            new, truncated = dict(sorted(new.items())[: most - len(seen)]), True
        seen |= {n: (level, h) for n, h in new.items()}
        front = new
        if truncated or not new:
            break
    touched = {r[3] for r in inside if (r[0] in left or r[1] in left) and r[0] in seen and r[1] in seen}
    mode = "SIZE_FALLBACK" if truncated else "HUB_AWARE" if any({r[0], r[1]} & hubs for r in inside if r[3] in touched) else "FULL"
    return {n: x[0] for n, x in seen.items()}, touched, mode


@pytest.mark.parametrize("accounts,payments,most", [(12, 60, 2000), (40, 60, 2000), (40, 120, 9), (30, 200, 2000)])
def test_traversal_is_a_breadth_first_search(spark, accounts, payments, most):
    r = random.Random(payments)
    rows = [(f"n{r.randrange(accounts)}", f"n{r.randrange(accounts)}", r.randrange(240) * HOUR, f"t{i}") for i in range(payments)]
    hubs = {f"n{i}" for i in range(0, accounts, 4)}
    cases = [(f"c{i}", f"n{r.randrange(accounts)}", r.randrange(240) * HOUR) for i in range(12)] + [("none", "nobody", 5)]
    e = spark.createDataFrame(rows, "src string, dst string, us long, transaction_id string")
    found = traversal.bounded_traversal(e, spark.createDataFrame(cases, "case_id string, node string, at_us long"), spark.createDataFrame([(h,) for h in hubs], "node string"), most=most)
    levels, touched = {}, {}
    for x in found.nodes.collect():
        levels.setdefault(x["case_id"], {})[x["node"]] = x["level"]
    for x in found.edges.collect():
        touched.setdefault(x["case_id"], set()).add(x["transaction_id"])
        assert x["hub_edge"] == bool({x["src"], x["dst"]} & hubs)
    modes = {x["case_id"]: x["mode"] for x in found.cases.collect()}
    for case, seed, at in cases:
        want = brute_traversal(rows, seed, at, hubs, most=most)
        assert (levels[case], touched.get(case, set()), modes[case]) == want


def test_traversal_leaves_one_hub_and_caps(spark):
    hub = spark.createDataFrame([("H1",), ("H2",)], "node string")
    seed = spark.createDataFrame([("case", "SEED", 0)], "case_id string, node string, at_us long")
    e = edges(spark, [("SEED", "H1", 1, 0), ("H1", "M2", 1, 1), ("M2", "H2", 1, 2), ("H2", "M4", 1, 3)])
    found = traversal.bounded_traversal(e, seed, hub)
    assert {x["node"] for x in found.nodes.collect()} == {"SEED", "H1", "M2", "H2"}  # the second hub is not left
    assert [x["mode"] for x in found.cases.collect()] == ["HUB_AWARE"]
    line = edges(spark, [(f"N{i:02d}", f"N{i + 1:02d}", 1, 0) for i in range(30)])
    start = spark.createDataFrame([("case", "N00", 0)], "case_id string, node string, at_us long")
    found = traversal.bounded_traversal(line, start, hub, hops=30, most=5)
    assert found.nodes.count() == 5 and [x["mode"] for x in found.cases.collect()] == ["SIZE_FALLBACK"]


def random_pairs(spark, r, n, m):
    rows = sorted({(f"n{r.randrange(n):03d}", f"n{r.randrange(n):03d}") for _ in range(m)})
    return rows, spark.createDataFrame(rows, "src string, dst string")


def brute_components(rows):
    out = {}
    for a, b in rows:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {a: reach(a) for a in out}
    return {a: min(b for b in far[a] if a in far[b]) for a in out}


@pytest.mark.parametrize("n,m", [(40, 70), (60, 60)])
def test_strong_components(spark, n, m):
    rows, p = random_pairs(spark, random.Random(m), n, m)
    rows += [("x", "y"), ("y", "x"), ("self", "self"), ("p", "q")]
    p = spark.createDataFrame(rows, "src string, dst string")
    assert {x["node"]: x["component"] for x in network_metrics.strong_components(p)[0].collect()} == brute_components(rows)


def test_long_chains_and_rings_take_few_rounds(spark):
    ring = 2000
    e = spark.range(10_000).selectExpr("concat('c', id) AS src", "concat('c', id + 1) AS dst").union(spark.range(ring).selectExpr("concat('r', id) AS src", f"concat('r', (id + 1) % {ring}) AS dst"))
    found, rounds = network_metrics.strong_components(e)
    assert rounds < 40
    size = {x["component"]: x["count"] for x in found.groupBy("component").count().where("count > 1").collect()}
    assert size == {"r0": ring} and found.count() == 10_001 + ring


def test_kcore(spark):
    rows, p = random_pairs(spark, random.Random(4), 60, 260)
    near = {}
    for a, b in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, left, k = {}, {a: set(b) for a, b in near.items()}, 0
    while left:
        low = [a for a, b in left.items() if len(b) <= k]
        for a in low:
            core[a] = k
            for b in left.pop(a):
                left.get(b, set()).discard(a)
        k += not low
    found, rounds = network_metrics.kcore(p)
    assert {x["node"]: x["core"] for x in found.collect()} == core
    clique = [(f"k{i}", f"k{j}") for i in range(40) for j in range(i)]
    found, rounds = network_metrics.kcore(spark.createDataFrame(clique, "src string, dst string"))
    assert {x["core"] for x in found.collect()} == {39} and rounds < 5  # not tied to k


def brute_rank(rows, rounds=300):
    out, nodes = {}, {x for a, b, _ in rows for x in (a, b)}
    for a, _, w in rows:
        out[a] = out.get(a, 0) + w
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        lost = sum(v for x, v in rank.items() if x not in out)
        new = dict.fromkeys(nodes, 0.15 / n + 0.85 * lost / n)
        for a, b, w in rows:
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    return rank


def test_pagerank_and_hits_settle(spark):
    rows, _ = random_pairs(spark, random.Random(9), 50, 130)
    rows = [(a, b, float(i % 5 + 1)) for i, (a, b) in enumerate(rows) if a != "n001"]
    found, rounds = network_metrics.pagerank(spark.createDataFrame(rows, "src string, dst string, weight double"))
    want = brute_rank(rows)
    got = {x["node"]: x["rank"] for x in found.collect()}
    assert got == pytest.approx(want, abs=1e-8) and sum(got.values()) == pytest.approx(1) and 1 < rounds < 100
    found, rounds = network_metrics.hits(spark.createDataFrame([r[:2] for r in rows], "src string, dst string"))
    hub = dict.fromkeys(want, 1.0)
    for _ in range(400):
        auth = dict.fromkeys(want, 0.0)
        for a, b, _w in rows:
            auth[b] += hub[a]
        hub = dict.fromkeys(want, 0.0)
        for a, b, _w in rows:
            hub[a] += auth[b]
        total = sum(hub.values())
        hub = {a: v / total for a, v in hub.items()}
    auth = {a: v / sum(auth.values()) for a, v in auth.items()}
    got = {x["node"]: x for x in found.collect()}
    assert {a: x["hub"] for a, x in got.items()} == pytest.approx(hub, abs=1e-5) and {a: x["auth"] for a, x in got.items()} == pytest.approx(auth, abs=1e-5) and rounds < 100


def test_communities_by_modularity(spark):
    """Eight groups with many edges inside and few between; and never worse than label propagation."""
    r = random.Random(6)
    rows = {(f"g{g}-{r.randrange(12):02d}", f"g{g}-{r.randrange(12):02d}") for g in range(8) for _ in range(60)} | {(f"g{r.randrange(8)}-{r.randrange(12):02d}", f"g{r.randrange(8)}-{r.randrange(12):02d}") for _ in range(40)}
    p = spark.createDataFrame(sorted(rows), "src string, dst string")
    label, value = network_metrics.communities(p)
    got = {}
    for x in label.collect():
        got.setdefault(x["community"], set()).add(x["node"].split("-")[0])
    assert len(got) == 8 and all(len(g) == 1 for g in got.values())
    assert value == pytest.approx(network_metrics.modularity(p, label)) and value > 0.6
    _, loose = random_pairs(spark, r, 60, 90)
    label, value = network_metrics.communities(loose)
    assert value == pytest.approx(network_metrics.modularity(loose, label)) and value >= network_metrics.modularity(loose, network_metrics.label_propagation(loose))


def test_messages(spark):
    rows = [
        ('{"sender":"A","receiver":"B","amount":"10","date":"2024-01-02","type":"x"}',), ('{"sender":"A","receiver":"B","amount":"-1","date":"2024-01-02","type":"x"}',),
        ('{"receiver":"B","amount":"1","date":"n","type":""}',), (None,), ("not json",),
    ]
    errors = [list(x["errors"] or []) for x in ingest.validated(spark.createDataFrame(rows, "message string")).collect()]
    assert errors[0] == [] and errors[1] == ["invalid amount"]
    assert errors[2] == ["invalid timestamp", "invalid transaction_type", "missing source account"]


def test_scoring_edges(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (60.0,), (80.0,)], "risk double")
    got = df.select(scoring.level(F.col("risk")).alias("l"), scoring.route(F.lit("MONITOR"), F.col("risk")).alias("r")).collect()
    assert [x["l"] for x in got] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [x["r"] for x in got] == ["AUTO_CLOSED", "AUTO_CLOSED", "FULL_INVESTIGATION", "FULL_INVESTIGATION"]


def test_asof_and_identity(spark):
    past = spark.createDataFrame([("a", f"t{i}", T0 + timedelta(hours=i)) for i in range(5)], "account_id string, transaction_id string, ts timestamp")
    asked = spark.createDataFrame([("a", "q", T0 + timedelta(hours=3))], "account_id string, asked_id string, asked_ts timestamp")
    assert [x["transaction_id"] for x in joins.asof_history(asked, past, 2).orderBy("place").collect()] == ["t2", "t1"]


def test_rule_table_is_complete(spark):
    assert set(rules.conditions()) == set(rules.RULES)


def test_leaking_average_is_found(spark):
    from ledgerspark.operators import features

    rows = [(str(i), "A", float(i), i * 100, i * 10) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, ts double, us long, cents long")
    right = {1: features.POPULATION_MEDIAN, 2: 0.1, 3: 0.15, 4: 0.2, 5: 0.25}
    own = F.element_at(F.create_map(*[F.lit(x) for kv in right.items() for x in kv]), F.col("transaction_id").cast("int"))
    assert features.leakage(df.withColumn("customer_avg_amount", own)).isEmpty()
    leaking = F.when(F.col("transaction_id") == "3", 0.2).otherwise(own)  # the mean of three rows, its own among them
    assert [x["transaction_id"] for x in features.leakage(df.withColumn("customer_avg_amount", leaking)).collect()] == ["3"]


def test_window_parties_against_brute_force(spark):
    import random

    from ledgerspark.operators import features

    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.choice(["CREDIT", "DEBIT"]), r.choice(["x", "y", "z", None]), r.randint(0, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id long, account_id string, type string, counterparty string, us long")
    seen = lambda row, kind: len({c for _, a, k, c, us in rows if a == row[1] and k == kind and c and row[4] - 7 <= us < row[4]})
    got = {x["transaction_id"]: (x["fan_in_7d"], x["fan_out_7d"]) for x in features.window_parties(df, 7).collect()}
    assert got == {row[0]: (seen(row, "CREDIT"), seen(row, "DEBIT")) for row in rows}


def test_timed_cycles_and_sizes(spark):
    e = edges(spark, [("A", "B", 1, 0), ("B", "C", 1, 1), ("C", "D", 1, 2), ("D", "E", 1, 3), ("E", "A", 1, 4), ("C", "A", 1, 5), ("B", "A", 1, 200)])
    found = {tuple(x["nodes"]): x["n"] for x in flows.circular_flows(e).collect()}
    assert found == {tuple("ABCDE"): 5, tuple("ABC"): 3}
    from ledgerspark.plans.graph_queries import graph_modes

    star = spark.createDataFrame([("h", f"n{i}") for i in range(6)], "src string, dst string")
    hub = spark.createDataFrame([("h", True)] + [(f"n{i}", False) for i in range(6)], "node string, is_hub boolean")
    assert {x["node"]: x["mode"] for x in graph_modes(star, hub, most=4).collect()} == {"h": "HUB_AWARE"} | {f"n{i}": "SIZE_FALLBACK" for i in range(6)}
    assert {x["mode"] for x in graph_modes(star, hub, most=10).collect()} == {"HUB_AWARE", "FULL"}


def test_embeddings_tell_links_from_others(spark):
    """Of two groups with links inside, a tenth is left out; the embeddings of the rest rank it above pairs across."""
    r = random.Random(8)
    pairs = sorted({(f"g{g}-{r.randrange(40)}", f"g{g}-{r.randrange(40)}") for g in range(4) for _ in range(300)})
    pairs = [p for p in pairs if p[0] != p[1]]
    r.shuffle(pairs)
    held, rest = pairs[: len(pairs) // 10], pairs[len(pairs) // 10 :]
    others = [(f"g{g}-{r.randrange(40)}", f"g{(g + 1) % 4}-{r.randrange(40)}") for g in range(4) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    found = ml.node_embeddings(frame([*rest, ("self", "self")]), size=32).cache()
    assert ml.link_auc(found, frame(held), frame(others)) > 0.9
    vectors = {x["node"]: np.array(x["embedding"]) for x in found.collect()}
    assert all(len(v) == 32 and (np.linalg.norm(v) == pytest.approx(1) or n == "self") for n, v in vectors.items()) and not vectors["self"].any()


def files(table):
    return {b: sorted(os.listdir(p.removeprefix("file://"))) for b, p in table.manifest()["folders"].items()}


def test_keyed_table_changes_only_touched_buckets(spark, tmp_path):
    table = keyed_table.KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string, at long", "k", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, at long")
    assert table.read().count() == 0
    assert table.upsert(frame([(k, "old", 1) for k in range(50)]), ["at"], 0)
    before, names = table.manifest(), files(table)
    assert table.upsert(frame([(7, "new", 5), (7, "newer", 6), (3, "late", 0)]), ["at"], 1)
    after = table.manifest()
    touched = {str(b) for b in table.touched(frame([(7, "", 0), (3, "", 0)]))}
    assert {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)} == touched
    assert all(files(table)[b] == names[b] for b in names if b not in touched)
    rows = {x["k"]: x["v"] for x in table.read().collect()}
    assert len(rows) == 50 and rows[7] == "newer" and rows[3] == rows[0] == "old"
    assert not table.upsert(frame([(7, "again", 99)]), ["at"], 1) and table.manifest() == after  # a replayed batch
    assert table.upsert(frame([]), ["at"], 2) and table.read().count() == 50
    table.replace(frame([(7, "", 0), (8, "", 0)]), frame([(8, "one", 1), (8, "two", 2), (9, "not asked", 3)]))
    rows = sorted((x["k"], x["v"]) for x in table.read().collect())
    assert len(rows) == 50 and (8, "one") in rows and (8, "two") in rows and (9, "old") in rows and 7 not in dict(rows)
    manifest = table.manifest()
    table.upsert(frame([(1, "x", 9)]), ["at"])
    with pytest.raises(keyed_table.Conflict):  # two writers of one version
        table._swap({**manifest, "version": manifest["version"] + 1})


def test_duplicates_of_an_earlier_run_are_logged(spark, tmp_path):
    schema = "fingerprint string, transaction_id string, ts timestamp"
    stored = keyed_table.KeyedTable(spark, f"file://{tmp_path}/f", streams.FINGERPRINTS, "fingerprint", buckets=4)

    def run(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}")
        streams.drop_stored(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{name}"), stored, f"file://{tmp_path}/log", name)

    run("a", [("f1", "t1", T0), ("f1", "t2", T0 + timedelta(1)), ("f2", "t3", T0)])
    run("b", [("f1", "t9", T0), ("f3", "t4", T0), ("f2", "t8", T0), ("f2", "t7", T0)])
    log = spark.read.schema("fingerprint string, case_id string, nth long").option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/log")
    assert sorted((x["fingerprint"], x["case_id"]) for x in log.collect()) == [("f1", "CASE-t1"), ("f1", "CASE-t1"), ("f2", "CASE-t3"), ("f2", "CASE-t3")]
    assert {x["fingerprint"]: x["case_id"] for x in stored.read().collect()} == {"f1": "CASE-t1", "f2": "CASE-t3", "f3": "CASE-t4"}


def test_new_keys_are_appended(spark, tmp_path):
    """Appended rows leave the folders that are there as they are; a later upsert sees all of them; a replayed batch changes nothing."""
    table = keyed_table.KeyedTable(spark, f"file://{tmp_path}/a", "k long, v string, at long", "k", buckets=2)
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, at long")
    assert table.append(make(*((i, "a", 1) for i in range(20))), 0, "s")
    before = {p for x in table.manifest()["folders"].values() for p in x}
    assert table.append(make(*((i, "b", 1) for i in range(20, 40))), 1, "s") and not table.append(make((99, "z", 1)), 1, "s")
    assert before < {p for x in table.manifest()["folders"].values() for p in x}
    table.upsert(make((3, "c", 2), (30, "c", 2)), ["at"], 2, "s")
    assert {x["k"]: x["v"] for x in table.read().collect()} == {i: "c" if i in (3, 30) else "a" if i < 20 else "b" for i in range(40)}


def test_isolation_forest(spark):
    """Far rows score highest; every tree has a whole sample where there are enough rows; null, NaN and infinite values count as 0."""
    r = np.random.default_rng(3)
    usual = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(6000, 2)))]
    far = [(6000 + i, 9.0 + i, -9.0 - i) for i in range(5)]
    odd = [(7000, None, float("inf")), (7001, float("nan"), 0.0)]
    df = spark.createDataFrame(usual + far + odd, "id long, p double, q double")
    forest = ml.isolation_forest(df, "id", ["p", "q"], trees=40, sample=64)
    assert len(forest) == 40 and all(tree[0, 4] == 64 for tree in forest)
    got = {x["id"]: x["anomaly"] for x in ml.isolation_scores(df, forest, ["p", "q"], sample=64).collect()}
    assert len(got) == len(usual + far + odd)
    assert set(sorted(got, key=got.get)[-5:]) == {x[0] for x in far}
    assert got[7000] == got[7001] < 0.5
    few = df.limit(3)
    assert all(tree[0, 4] == 3 for tree in ml.isolation_forest(few, "id", ["p", "q"], trees=7))
    assert ml.isolation_forest(df.limit(0), "id", ["p", "q"]) == []


def test_scores_are_added_in_one_order(spark):
    """Rows whose band another order of adding changes: 30.0 against 29.999999999999993."""
    rows = [(35.0, 0.17500000000000002, 19, 7), (65.0, 0.42500000000000004, 7, 7), (80.0, 0.1, 14, 4)]
    df = spark.createDataFrame(rows, "amount double, behaviour double, points long, day long")
    weighted = scoring.weighted_fusion(F.least(F.col("amount") / 200.0, F.lit(1.0)), F.lit(0.0), F.col("behaviour"), F.col("points"), F.least(F.col("day") / 10.0, F.lit(1.0)), F.lit(0.0))
    risk = scoring.final_risk(weighted, F.lit(None).cast("double"))
    got = [tuple(r) for r in df.select(risk.alias("risk"), scoring.level(risk).alias("level")).collect()]
    want = []
    for amount, behaviour, points, day in rows:
        w = (0.35 * min(amount / 200.0, 1.0) + 0.20 * 0.0 + 0.15 * behaviour + 0.15 * min(points / 20.0, 1.0) + 0.10 * min(day / 10.0, 1.0) + 0.05 * 0.0) * 100
        r = min(max(0.4 * w + 0.6 * w, 0), 100)
        want.append((r, "LOW" if r < 30 else "MEDIUM"))
    assert got == want


def test_velocities_of_one_moment_don_t_know_each_other(spark, tmp_path):
    at = [T0, T0, T0 + timedelta(hours=1), T0 + timedelta(hours=1), T0 + timedelta(hours=30)]
    rows = [(f"t{i}", "a", c, ts) for i, (c, ts) in enumerate(zip("bbbcb", at))]
    schema = "transaction_id string, account_id string, counterparty string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = streams.run_available(streams.velocity(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), "velocity")
    assert {tuple(r) for r in found.select("transaction_id", "count_24h", "known").collect()} == {("t0", 0, False), ("t1", 0, False), ("t2", 2, True), ("t3", 2, False), ("t4", 0, True)}


def test_velocities_where_files_overlap_in_time(spark, tmp_path):
    """Events in several files of the same times, as a large table is written: the rows are those of the one file."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    same_rows(model_queries.stream_velocity(spark, f"file://{tmp_path}"), model_queries.ORACLE["stream_velocity"])


class Held:
    """A value or a map of state, that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def getValue(self, key=()):
        self.calls.append("get")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("put")
        self.held[key] = value

    get = getValue

    def update(self, value):
        self.updateValue((), value)


@pytest.mark.parametrize("others", [40, 400, 6000])
def test_velocity_asks_its_state_little(others):
    """Batches of one account against loops. Up to 512 counterparties a batch reads one value and writes one; beyond, the buckets of its own."""
    r, calls, rows = random.Random(others), [], []
    handle = type("Handle", (), {"getValueState": lambda self, *_: Held(calls), "getMapState": lambda self, *_: Held(calls)})()
    state = streams.Velocity()
    state.init(handle)
    for batch in range(5):
        new = [{"us": (batch * 48 + r.randrange(48)) * HOUR, "transaction_id": f"{batch}-{i}", "counterparty": r.choice([None, *map(str, range(others))])} for i in range(others // 2)]
        rows += new
        calls.clear()
        got = {x["transaction_id"]: (x["count_24h"], x["known"]) for x in state.handleInputRows(("a",), iter(new), None)}
        assert len(calls) <= (2 if others <= 512 else len(new) // 4)
        first, times = {}, sorted(x["us"] for x in rows)
        for x in rows:
            first[x["counterparty"]] = min(x["us"], first.get(x["counterparty"], x["us"]))
        for x in new:
            count = sum(x["us"] - 24 * HOUR <= t < x["us"] for t in times)
            assert got[x["transaction_id"]] == (count, first[x["counterparty"]] < x["us"])


def test_cases_of_one_start_and_copies_of_payments(spark):
    """Cases of one account and time have the same accounts; every payment of a case is listed once, also where both ends were left."""
    e = edges(spark, [("a", "b", 10, 1), ("a", "b", 10, 1), ("b", "c", 10, 2), ("c", "a", 10, 3), ("c", "c", 1, 3), ("c", "d", 1, 99)])
    seed = spark.createDataFrame([("x", "a", int(3600e6)), ("y", "a", int(3600e6)), ("z", "q", int(3600e6))], "case_id string, node string, at_us long")
    found = traversal.bounded_traversal(e, seed, spark.createDataFrame([("b",)], "node string"))
    assert sorted(tuple(r) for r in found.nodes.collect()) == sorted([(c, n, i) for c in "xy" for n, i in (("a", 0), ("b", 1), ("c", 1))] + [("z", "q", 0)])
    listed = found.edges.select("case_id", "transaction_id", "hub_edge").collect()
    assert sorted(tuple(r) for r in listed) == sorted((c, t, h) for c in "xy" for t, h in (("t0", True), ("t1", True), ("t2", True), ("t3", False)))
    assert {r["case_id"]: r["mode"] for r in found.cases.collect()} == {"x": "HUB_AWARE", "y": "HUB_AWARE", "z": "FULL"}


def test_cases_near_in_time_are_traversed_together(spark, monkeypatch):
    """What the levels write is rows of blocks of cases: 200 cases of 200 accounts, some minutes apart, in a ring of all of them. Against loops."""
    at = [HOUR * 100 + i * 60_000_000 for i in range(200)]
    rows = [(f"n{i:03d}", f"n{(i + 1) % 200:03d}", HOUR * 100 + (i % 7 - 3) * 24 * HOUR + i, f"t{i}") for i in range(200)] + [("n000", "n001", None, "t"), (None, "n001", 5, "u")]
    cases = [(f"c{i}", f"n{i:03d}", at[i]) for i in range(200)] + [("none", "n000", None)]
    counts = []
    monkeypatch.setattr(traversal, "written", lambda df, name: counts.append((name, df.count())) or written(df, name))
    e = spark.createDataFrame(rows, "src string, dst string, us long, transaction_id string")
    found = traversal.bounded_traversal(e, spark.createDataFrame(cases, "case_id string, node string, at_us long"), spark.createDataFrame([("n003",)], "node string"))
    levels, touched = {}, {}
    for x in found.nodes.collect():
        levels.setdefault(x["case_id"], {})[x["node"]] = x["level"]
    for x in found.edges.collect():
        touched.setdefault(x["case_id"], set()).add(x["transaction_id"])
    for case, seed, us in cases[:-1]:
        want = brute_traversal(rows[:200], seed, us, {"n003"})
        assert (levels[case], touched.get(case, set())) == want[:2]
    assert levels["none"] == {"n000": 0} and "none" not in touched
    assert sum(n for name, n in counts if name == "ways") <= 200 * 5  # payments meet 4 or 5 blocks, not 200 cases
    assert {name for name, _ in counts} >= {"ways", "front"}


def test_a_large_case_is_whole(spark):
    """2,500 accounts that a case's account pays: all of them, and all payments, as in the SQL."""
    e = spark.range(2500).selectExpr("'a' AS src", "concat('b', id) AS dst", "id AS us", "concat('t', id) AS transaction_id")
    found = traversal.bounded_traversal(e, spark.createDataFrame([("x", "a", 0)], "case_id string, node string, at_us long"), spark.createDataFrame([], "node string"))
    assert (found.nodes.count(), found.edges.count(), found.cases.first()["mode"]) == (2501, 2500, "FULL")


def test_layer_paths_are_listed(spark):
    """Against loops: every combination of four accounts, with its number of paths and first payment."""
    r = random.Random(3)
    rows = [(f"a{r.randint(0, 5)}", f"a{r.randint(0, 5)}", 10, round(r.uniform(0, 200), 2)) for _ in range(60)]
    want = {}
    for a in rows:
        for b in rows:
            for c in rows:
                if a[1] == b[0] and b[1] == c[0] and len({a[0], b[0], c[0], c[1]}) == 4 and a[3] < b[3] < c[3] <= a[3] + 72:
                    n, first = want.get((a[0], b[0], c[0], c[1]), (0, 1e9))
                    want[a[0], b[0], c[0], c[1]] = n + 1, min(first, a[3])
    got = {(x["n0"], x["n1"], x["n2"], x["n3"]): (x["times"], round(x["first_us"] / 3600e6, 2)) for x in flows.layer_paths(edges(spark, rows)).collect()}
    assert got == want


def test_similar_cases_are_computed_once(spark):
    """The cases are a table before they meet their newest: what they are made of is not read twice."""
    cases = spark.createDataFrame([("a", 1, 1.0, 0.0), ("b", 2, 1.0, 0.1), ("c", 3, 0.0, 1.0)], "case_id string, updated long, v1 double, v2 double")
    found = joins.similar_cases(cases, ["v1", "v2"], k=1)
    assert found.inputFiles() and all("/written/cases-" in f for f in found.inputFiles())
    assert {(r["case_id"], r["other"]) for r in found.collect()} == {("a", "b"), ("b", "a"), ("c", "b")}


def test_explained_rows_are_not_sorted_or_joined_back(spark):
    """Each row is explained where it lies: one exchange, the broadcast of the means. The first feature decides, so it comes first."""
    df = spark.createDataFrame([(f"t{i}", float(i % 2), float(i % 3), i % 2, i % 5 == 0) for i in range(60)], "id string, x double, y double, label int, valid boolean")
    df = ml.feature_vector(df, ["x", "y"])
    found = ml.explain_rows(ml.train_classifier(df, "label", trees=2, depth=2), df, "id", ["x", "y"], k=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Sort") == 0 and plan.count("Join") == 1
    assert {(r["feature"], r["place"]) for r in found.collect()} == {("x", 1)} and found.count() == 60


def test_behaviour_evidence_after_zeros(spark):
    """Where all earlier amounts are 0 the mean and the median are 0; SQL's quotient is infinite, so the amount is far above."""
    day = datetime(2024, 1, 1)
    rows = [("a", "A", day, 0.0), ("b", "A", day + timedelta(1), 0.0), ("x", "A", day + timedelta(2), 60.0)]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, ts timestamp, amount double")
    (got,) = metrics.behaviour_evidence(with_amounts(df), F.col("transaction_id") == "x").collect()
    assert (got["n"], got["mean"], got["median"], got["deviation"]) == (2, 0.0, 0.0, True)


def test_laid_out_trees_score_as_their_nodes():
    tree = np.array([[1, 0.5, 1, 2, 7], [-1, 0, -1, -1, 3], [0, 2.0, 3, 4, 4], [-1, 0, -1, -1, 1], [-1, 0, -1, -1, 3]], float)
    feature, threshold, length = ml._laid_out(tree)
    for row in ([0.0, 0.5], [2.0, 0.6], [2.1, 9.0]):
        node = depth = at = 0
        while tree[node, 0] >= 0:
            node, depth = int(tree[node, 2 if row[int(tree[node, 0])] <= tree[node, 1] else 3]), depth + 1
        for _ in range(8):
            at = 2 * at + 1 + (row[feature[at]] > threshold[at])
        assert length[at] == depth + ml._usual_depth(tree[node, 4])

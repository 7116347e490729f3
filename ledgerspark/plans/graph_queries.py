"""Queries of payment networks, with their SQL. All edges are read; the patterns leave out edges that touch a hub of their period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band, mask_id
from ..operators import flows, graph, joins, network_metrics, traversal
from ..sources import tables as t
from ..sources.durable import written
from .aggregate_queries import DEGREES, EDGES
from .ingest_queries import IDENTITY, SHARED

QUERIES, ORACLE = {}, {}
HUB = "cut AS (SELECT quantile_cont(in_degree + out_degree, 0.99) AS p99 FROM deg), hub AS (SELECT node FROM deg, cut WHERE in_degree + out_degree >= 500 OR in_degree + out_degree >= p99)"
#: Edges between different accounts neither of which is a hub in the edge's period.
CALM = EDGES + f""", per AS (SELECT *, us // {flows.PERIOD_US} AS period FROM e WHERE src <> dst),
hd AS (SELECT node, period, count(DISTINCT other) AS degree FROM (SELECT src AS node, dst AS other, period FROM per UNION ALL SELECT dst, src, period FROM per) GROUP BY ALL),
hp AS (SELECT min(degree) FILTER (100 * at_most >= 99 * nodes) AS cut FROM (SELECT degree, count(*) OVER (ORDER BY degree) AS at_most, count(*) OVER () AS nodes FROM hd)),
ph AS (SELECT node, period FROM hd, hp WHERE degree >= 500 OR degree > cut),
q AS (SELECT * FROM per WHERE (src, period) NOT IN (SELECT (node, period) FROM ph) AND (dst, period) NOT IN (SELECT (node, period) FROM ph))"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def edges(spark, sf_dir) -> DataFrame:
    return graph.edges_of(t.txn_events(spark, sf_dir))


def pairs(spark, sf_dir) -> DataFrame:
    return edges(spark, sf_dir).select("src", "dst").distinct()


def hubs(spark, sf_dir) -> DataFrame:
    d = graph.degrees(pairs(spark, sf_dir)).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return graph.supernodes(d)


def calm(spark, sf_dir) -> DataFrame:
    """Edges that touch no hub of their period."""
    e = written(edges(spark, sf_dir), "edges")
    return flows.calm_edges(e, written(flows.period_hubs(e), "hubs"))


#: PageRank by so many rounds of all nodes, far more than it takes to settle.
_RANK = f"WITH RECURSIVE {EDGES}, w AS (SELECT src, dst, sum(cents) / 100.0 AS weight FROM e GROUP BY ALL), l AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM w), nodes AS (SELECT node, node NOT IN (SELECT src FROM w) AS sink FROM (SELECT src AS node FROM w UNION SELECT dst FROM w)), k AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), r AS (SELECT 0 AS i, node, sink, 1.0 / n AS rank FROM nodes, k UNION ALL SELECT any_value(i) + 1, node, any_value(sink), 0.15 / any_value(n) + 0.85 * sum(part) FROM (SELECT i, nodes.node, nodes.sink, n, CASE WHEN l.dst IS NULL THEN 0 ELSE r.rank * share END + CASE WHEN first THEN lost / n ELSE 0 END AS part FROM nodes CROSS JOIN k CROSS JOIN (SELECT *, sum(CASE WHEN sink THEN rank ELSE 0 END) OVER () AS lost, row_number() OVER (ORDER BY node) = 1 AS first FROM r WHERE i < 60) r LEFT JOIN l ON l.src = r.node AND l.dst = nodes.node) GROUP BY node), ranked AS (SELECT node, rank FROM r WHERE i = 60)"


@query(_RANK + " SELECT node, round(rank, 8) AS rank FROM ranked")
def pagerank(spark, sf_dir):
    rank, _ = network_metrics.pagerank(graph.edge_weights(edges(spark, sf_dir)))
    return rank.select("node", F.round("rank", 8).alias("rank"))


#: Hubs and authorities by so many rounds; in a round authorities follow from hubs, then hubs from authorities.
_HITS = f"WITH RECURSIVE {EDGES}, nodes AS (SELECT src AS node FROM pairs UNION SELECT dst FROM pairs), r AS (SELECT 0 AS i, node, CAST(1.0 AS DOUBLE) AS hub, CAST(0.0 AS DOUBLE) AS auth FROM nodes UNION ALL SELECT i, node, hub / sum(hub) OVER (), auth FROM (SELECT max(a.i) OVER () AS i, nodes.node, coalesce(h.hub, 0) AS hub, coalesce(a.auth, 0) AS auth FROM nodes LEFT JOIN (SELECT i, node, auth / sum(auth) OVER () AS auth FROM (SELECT max(r.i) + 1 AS i, pairs.dst AS node, sum(r.hub) AS auth FROM r JOIN pairs ON pairs.src = r.node WHERE r.i < 60 GROUP BY pairs.dst)) a USING (node) LEFT JOIN (SELECT q.src AS node, sum(x.auth) AS hub FROM (SELECT pairs.dst AS node, sum(r.hub) AS auth FROM r JOIN pairs ON pairs.src = r.node WHERE r.i < 60 GROUP BY pairs.dst) x JOIN pairs q ON q.dst = x.node GROUP BY q.src) h USING (node)) WHERE i IS NOT NULL)"


@query(_HITS + " SELECT node, round(hub, 6) AS hub, round(auth, 6) AS auth FROM r WHERE i = 60")
def hits(spark, sf_dir):
    found, _ = network_metrics.hits(pairs(spark, sf_dir))
    return found.select("node", F.round("hub", 6).alias("hub"), F.round("auth", 6).alias("auth"))


@query()
def kcore(spark, sf_dir):
    return network_metrics.kcore(pairs(spark, sf_dir))[0]


@query(f"WITH {EDGES} SELECT a.src AS node, least(count(DISTINCT b.dst), 200) AS reach FROM pairs a JOIN pairs b ON a.dst = b.src WHERE b.dst <> a.src GROUP BY 1")
def two_hop_reach(spark, sf_dir):
    return graph.two_hop(pairs(spark, sf_dir))


@query(f"WITH {EDGES} SELECT DISTINCT a.src AS node FROM pairs a JOIN pairs b ON a.src = b.dst AND a.dst = b.src")
def cycle_flag(spark, sf_dir):
    return graph.cycle_nodes(pairs(spark, sf_dir))


@query()
def communities(spark, sf_dir):
    """Communities by modularity, their sizes, and the modularity of all."""
    label, value = network_metrics.communities(pairs(spark, sf_dir))
    size = label.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return label.join(size, "community").select("node", "community", "size", F.lit(value).alias("modularity"))


_SCC = f"{EDGES}, reach AS (SELECT src AS a, dst AS b FROM pairs UNION SELECT reach.a, pairs.dst FROM reach JOIN pairs ON reach.b = pairs.src), n AS (SELECT src AS node FROM pairs UNION SELECT dst FROM pairs), mutual AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a), comp AS (SELECT node, least(node, coalesce(min(b), node)) AS component FROM n LEFT JOIN mutual ON a = node GROUP BY node)"


_RINGS = "rings AS (SELECT 2 AS n FROM pairs a JOIN pairs b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT 3 FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)"


@query(f"WITH RECURSIVE {_SCC} SELECT * FROM comp")
def scc(spark, sf_dir):
    return network_metrics.strong_components(pairs(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {_SCC}, sizes AS (SELECT count(*) AS size FROM comp GROUP BY component), {_RINGS} SELECT 'component' AS kind, size, count(*) AS n, CAST(count(*) FILTER (size = 1) AS DOUBLE) / (SELECT count(*) FROM sizes) AS singleton_rate FROM sizes GROUP BY size UNION ALL SELECT 'cycle', n, count(*), 0.0 FROM rings GROUP BY n")
def size_distribution(spark, sf_dir):
    """How many components have each size, which share of all are singletons, and how many rings of two and three accounts there are."""
    near = written(pairs(spark, sf_dir), "pairs")
    placed = written(network_metrics.strong_components(near)[0], "placed")
    size = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    total = size.agg(F.count(F.lit(1)).alias("all"))  # one row
    single = F.when(F.col("size") == 1, F.col("n") / F.col("all")).otherwise(0.0).alias("singleton_rate")
    # A ring lies within a component of several accounts: payments that lead from one component to another are on none.
    several = placed.join(size.where("size > 1"), "component").select("node", "component")
    src, dst = (several.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")) for end in ("src", "dst"))
    ringed = written(near.join(src, "src").join(dst, "dst").where("src_in = dst_in").select("src", "dst"), "ringed")
    components = size.groupBy("size").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select(F.lit("component").alias("kind"), "size", "n", single)
    rings = [graph.cycles(ringed, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cycle").alias("kind"), F.lit(n).cast("long").alias("size"), "n", F.lit(0.0).alias("singleton_rate")) for n in (2, 3)]
    return reduce(DataFrame.unionByName, [components, *rings]).where("n > 0")


@query(f"WITH {EDGES}, {DEGREES}, d AS (SELECT node, in_degree + out_degree AS degree FROM deg), p AS (SELECT quantile_cont(degree, 0.95) AS p95, quantile_cont(degree, 0.99) AS p99 FROM d) SELECT node, degree, CASE WHEN degree >= 500 OR degree >= p99 THEN 'SUPER_NODE' WHEN degree >= p95 THEN 'HIGH_DEGREE' ELSE 'NORMAL' END AS node_class, degree >= 500 OR degree >= p99 AS is_hub FROM d, p")
def supernodes(spark, sf_dir):
    return hubs(spark, sf_dir).select("node", "degree", "node_class", "is_hub")


def seeds(spark, sf_dir) -> DataFrame:
    """One case per suspicious transaction: its account and time."""
    bad = t.txn_events(spark, sf_dir).where("is_suspicious = 1")
    return bad.select(F.col("transaction_id").alias("case_id"), F.col("account_id").alias("node"), F.col("us").alias("at_us"))


def traversed(spark, sf_dir) -> traversal.Traversal:
    hub = hubs(spark, sf_dir).where("is_hub").select("node")
    return traversal.bounded_traversal(edges(spark, sf_dir), seeds(spark, sf_dir), hub)


def _traversal_sql() -> str:
    """Four levels: who is reached (n), with the fewest hubs passed on the way (h), and who of them is left (l)."""
    w = traversal.WINDOW_US
    out = f"WITH {EDGES}, {DEGREES}, {HUB}, both_ways AS (SELECT src, dst, us FROM e WHERE src <> dst UNION ALL SELECT dst, src, us FROM e WHERE src <> dst), at AS (SELECT transaction_id AS case_id, account_id AS node, us AS at_us FROM txn WHERE is_suspicious = 1), n0 AS (SELECT case_id, at_us, node, 0 AS level, 0 AS h FROM at)".replace(" at AS (", " cases AS (").replace("FROM at)", "FROM cases)")
    for i in range(4):
        out += f", l{i} AS (SELECT *, node IN (SELECT node FROM hub) AS is_hub FROM n{i} WHERE level = {i} AND (level = 0 OR h = 0 OR node NOT IN (SELECT node FROM hub)))"
        out += f", x{i} AS (SELECT l.case_id, l.at_us, b.dst AS node, {i + 1} AS level, min(l.h + CAST(is_hub AS INTEGER)) AS h FROM l{i} l JOIN both_ways b ON b.src = l.node AND b.us BETWEEN l.at_us - {w} AND l.at_us + {w} WHERE (l.case_id, b.dst) NOT IN (SELECT (case_id, node) FROM n{i}) GROUP BY ALL)"
        out += f", n{i + 1} AS (SELECT * FROM n{i} UNION ALL SELECT case_id, at_us, node, level, h FROM x{i})"
    left = " UNION ALL ".join(f"SELECT case_id, at_us, node FROM l{i}" for i in range(4))
    return out + f", lefts AS ({left}), tied AS (SELECT DISTINCT case_id, transaction_id, src, dst FROM lefts JOIN e ON e.us BETWEEN at_us - {w} AND at_us + {w} AND (src = node OR dst = node) AND src <> dst), marked AS (SELECT *, src IN (SELECT node FROM hub) OR dst IN (SELECT node FROM hub) AS hub_edge FROM tied), modes AS (SELECT case_id, CASE WHEN bool_or(hub_edge) THEN 'HUB_AWARE' ELSE 'FULL' END AS mode FROM marked GROUP BY case_id)"


@query(_traversal_sql() + " SELECT case_id, node, level, coalesce(mode, 'FULL') AS mode FROM n4 LEFT JOIN modes USING (case_id)")
def bounded_traversal(spark, sf_dir):
    """Accounts within four steps of each suspicious payment's account, in its window, and how the case was looked at."""
    found = traversed(spark, sf_dir)
    return found.nodes.join(found.cases, "case_id").select("case_id", "node", "level", "mode")


@query(_traversal_sql() + " SELECT * FROM marked")
def case_subgraph(spark, sf_dir):
    """Payments of each case's window that the traversal went along, with hub marks."""
    return traversed(spark, sf_dir).edges.select("case_id", "transaction_id", "src", "dst", "hub_edge")


_UND = "und AS (SELECT src, dst FROM pairs WHERE src <> dst UNION SELECT dst, src FROM pairs WHERE src <> dst)"
_NEAR = f"{_UND}, one AS (SELECT src AS node, count(*) AS n FROM und GROUP BY 1), two AS (SELECT a.src AS node, count(DISTINCT b.dst) AS n FROM und a JOIN und b ON a.dst = b.src WHERE b.dst <> a.src GROUP BY 1)"


@query(f"WITH {EDGES}, {_NEAR} SELECT one.node, least(one.n, 50) AS one_hop, least(coalesce(two.n, 0), 500) AS two_hop FROM one LEFT JOIN two USING (node)")
def candidate_subgraphs(spark, sf_dir):
    both = graph.undirected(pairs(spark, sf_dir))
    one = both.groupBy(F.col("src").alias("node")).agg(F.least(F.count(F.lit(1)), F.lit(50)).alias("one_hop"))
    two = graph.two_hop(both, 500).withColumnRenamed("reach", "two_hop")
    return one.join(two, "node", "left").fillna(0, ["two_hop"])


_MASK = "substr(node, 1, 8) || '***' AS node"
_CENTRAL = f"{_RANK}, {DEGREES} SELECT 'pagerank' AS metric, {_MASK}, round(rank, 8) AS value FROM (SELECT node, rank FROM ranked ORDER BY rank DESC, node LIMIT 10) UNION ALL SELECT 'degree', {_MASK}, CAST(degree AS DOUBLE) FROM (SELECT node, in_degree + out_degree AS degree FROM deg ORDER BY degree DESC, node LIMIT 10)"


@query(_CENTRAL)
def centrality_topk(spark, sf_dir):
    """The ten nodes of largest rank and of largest degree, masked."""
    rank, _ = network_metrics.pagerank(graph.edge_weights(edges(spark, sf_dir)))
    rank = rank.orderBy(F.desc("rank"), "node").limit(10).select(F.lit("pagerank").alias("metric"), mask_id(F.col("node")).alias("node"), F.round("rank", 8).alias("value"))
    degree = hubs(spark, sf_dir).orderBy(F.desc("degree"), "node").limit(10).select(F.lit("degree").alias("metric"), mask_id(F.col("node")).alias("node"), F.col("degree").cast("double").alias("value"))
    return rank.unionByName(degree)


_DAY, _SPAN = 86_400_000_000, 72 * 3_600_000_000


def _path_sql(hops: int, gap: int, span: int | None, closed: bool = False) -> str:
    """FROM and WHERE of paths of ``hops`` edges a0.. in ascending time; the last edge returns to the first account if closed."""
    out = "q a0"
    for h in range(1, hops):
        out += f" JOIN q a{h} ON a{h}.src = a{h - 1}.dst AND a{h}.us > a{h - 1}.us AND a{h}.us - a{h - 1}.us <= {gap}" + (f" AND a{h}.us - a0.us <= {span}" if span else "")
    inner = hops - closed
    fresh = [f"a{h}.dst NOT IN ({', '.join(['a0.src', *(f'a{i}.dst' for i in range(h))])})" for h in range(inner)] + [f"a{hops - 1}.dst = a0.src"] * closed
    return f"{out} WHERE {' AND '.join(fresh)}"


_FLOW = "flow AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT CASE WHEN type = 'CREDIT' THEN dst ELSE src END AS node, 0 AS i, cents AS o FROM q UNION ALL SELECT CASE WHEN type = 'CREDIT' THEN src ELSE dst END, cents, 0 FROM q) GROUP BY node)"
_MULES = f"{_FLOW}, mule AS (SELECT node FROM flow WHERE i > 0 AND o > 0 AND CAST(least(i, o) AS DOUBLE) / greatest(i, o) >= 0.8), mules AS (SELECT n0, count(*) AS chains, max(n) AS longest, min(t0) AS first_us, least(100, 50 + 15 * count(*)) / 100.0 AS score FROM (" + " UNION ALL ".join(
    f"SELECT a0.src AS n0, {h + 1} AS n, a0.us AS t0 FROM {_path_sql(h, _DAY, None)} AND a0.dst IN (SELECT node FROM mule)" for h in (2, 3, 4)
) + ") GROUP BY n0)"


@query(f"WITH {CALM}, {_MULES} SELECT * FROM mules")
def mule_chain(spark, sf_dir):
    """Chains of three to five accounts through one that passes on what it gets, payments at most a day apart."""
    return flows.mule_chains(written(calm(spark, sf_dir), "calm"))


def _fan_sql(name: str, centre: str, other: str) -> str:
    per = f"SELECT {centre} AS node, {other}, sum(cents) AS cents FROM q WHERE src <> dst GROUP BY ALL"
    agg = f"SELECT node, count(*) AS n, CAST(max(cents) AS DOUBLE) / sum(cents) AS top_share FROM ({per}) GROUP BY node"
    return f"{name} AS (SELECT node, n, round(top_share, 9) AS top_share, round(least(1.0, 0.07 * n + 0.3 * top_share), 9) AS score FROM ({agg}) WHERE n >= 5)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("node", "n", F.round("top_share", 9).alias("top_share"), F.round("score", 9).alias("score"))


@query(f"WITH {CALM}, {_fan_sql('f', 'dst', 'src')} SELECT * FROM f")
def fan_in_pattern(spark, sf_dir):
    return _rounded(graph.fan(calm(spark, sf_dir), "dst", "src"))


@query(f"WITH {CALM}, {_fan_sql('f', 'src', 'dst')} SELECT * FROM f")
def fan_out_pattern(spark, sf_dir):
    return _rounded(graph.fan(calm(spark, sf_dir), "src", "dst"))


_CYCLES = "cyc AS (" + " UNION ALL ".join(
    f"SELECT [{', '.join(['a0.src', *(f'a{i}.dst' for i in range(k - 1))])}] AS nodes, {k} AS n, count(*) AS times, min(a0.us) AS first_us FROM {_path_sql(k, _SPAN, _SPAN, True)} GROUP BY ALL" for k in (2, 3, 4, 5)
) + ")"


@query(f"WITH {CALM}, {_CYCLES} SELECT array_to_string(nodes, '>') AS cycle, n, times, first_us FROM cyc")
def circular_flow(spark, sf_dir):
    """Cycles of two to five accounts, from the first payer on, whose payments follow each other within 72 hours."""
    return flows.circular_flows(written(calm(spark, sf_dir), "calm")).select(F.concat_ws(">", "nodes").alias("cycle"), "n", "times", "first_us")


_LAYERS = f"lay AS (SELECT p.*, CASE WHEN x.i > y.o THEN CAST(x.i - y.o AS DOUBLE) / x.i ELSE 0.0 END AS retention FROM (SELECT a0.dst AS n1, a1.dst AS n2, count(*) AS times, min(a1.us) AS first_us FROM {_path_sql(3, _SPAN, _SPAN)} GROUP BY ALL) p JOIN flow x ON x.node = n1 JOIN flow y ON y.node = n2), layers AS (SELECT *, least(100, 50 + 10 * times + CASE WHEN retention < 0.3 THEN 20 ELSE 0 END) / 100.0 AS score FROM lay)"


#: The same with first and last accounts: one row per combination of four.
_LAYER_PATHS = _LAYERS.replace("SELECT a0.dst AS n1, a1.dst AS n2, count(*) AS times, min(a1.us)", "SELECT a0.src AS n0, a0.dst AS n1, a1.dst AS n2, a2.dst AS n3, count(*) AS times, min(a0.us)")


@query(f"WITH {CALM}, {_FLOW}, {_LAYER_PATHS} SELECT * REPLACE (round(retention, 9) AS retention) FROM layers")
def rapid_layering(spark, sf_dir):
    """Payments through four accounts within 72 hours: every combination of accounts, with its number of paths."""
    return flows.layer_paths(written(calm(spark, sf_dir), "calm")).withColumn("retention", F.round("retention", 9))


_SAME = "same AS (SELECT account_id, sum(members) - count(*) AS others, least(95, sum(DISTINCT CASE kind WHEN 'device' THEN 30 WHEN 'phone' THEN 40 WHEN 'ip' THEN 15 ELSE 20 END)) / 100.0 AS score FROM sh WHERE members > 1 GROUP BY account_id)"


@query(f"WITH {IDENTITY}, {SHARED}, {_SAME} SELECT * FROM same")
def shared_identity(spark, sf_dir):
    """How many times others hold an account's values, and the weights of the kinds that it shares."""
    shared = joins.shared_identity_pairs(t.identity(spark, sf_dir))
    weight = F.when(F.col("kind") == "device", 30).when(F.col("kind") == "phone", 40).when(F.col("kind") == "ip", 15).otherwise(20)
    by_kind = shared.groupBy("account_id", "kind").agg(F.sum(F.col("members") - 1).alias("others")).withColumn("weight", weight)
    return by_kind.groupBy("account_id").agg(F.sum("others").alias("others"), (F.least(F.lit(95), F.sum("weight")) / 100.0).alias("score"))


#: Weights of the six patterns: fixed values.
WEIGHTS = {"mule_chain": 0.25, "fan_in": 0.15, "fan_out": 0.15, "circular_flow": 0.20, "rapid_layering": 0.15, "shared_identity": 0.10}


def pattern_scores(spark, sf_dir) -> DataFrame:
    """node, pattern, score, hits, confidence: for each node that a pattern is found at (chains at their first account, layers at the first middle
    one). Accounts of the network and of the identity table are the same by number."""
    e = written(calm(spark, sf_dir), "calm")
    cycle = flows.circular_flows(e).select(F.explode("nodes").alias("node"), F.lit(1).alias("one")).groupBy("node").agg(F.count("one").alias("n"))
    per = {
        "mule_chain": flows.mule_chains(e).select(F.col("n0").alias("node"), "score", F.col("chains").alias("hits")),
        "fan_in": graph.fan(e, "dst", "src").select("node", "score", F.col("n").alias("hits")),
        "fan_out": graph.fan(e, "src", "dst").select("node", "score", F.col("n").alias("hits")),
        "circular_flow": cycle.select("node", (F.least(F.lit(100), 55 + 10 * F.col("n")) / 100.0).alias("score"), F.col("n").alias("hits")),
        "rapid_layering": flows.rapid_layers(e).groupBy(F.col("n1").alias("node")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("hits")),
        "shared_identity": shared_identity(spark, sf_dir).select(F.regexp_replace("account_id", "^C", "A").alias("node"), "score", F.col("others").alias("hits")),
    }
    sure = {"mule_chain": F.col("hits") >= 3, "fan_in": F.col("score") >= 0.6, "fan_out": F.col("score") >= 0.6, "shared_identity": F.col("score") >= 0.5}
    parts = [
        df.select("node", F.lit(k).alias("pattern"), F.col("score").cast("double").alias("score"), F.col("hits").cast("long").alias("hits"))
        .withColumn("confidence", F.when(sure.get(k, F.lit(False)), "HIGH").otherwise("MEDIUM"))
        for k, df in per.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_SCORES = f"{CALM}, {DEGREES}, {HUB}, {IDENTITY}, {SHARED}, {_SAME}, {_MULES}, {_fan_sql('fi', 'dst', 'src')}, {_fan_sql('fo', 'src', 'dst')}, {_CYCLES}, {_LAYERS}, ps AS (SELECT n0 AS node, 'mule_chain' AS pattern, CAST(score AS DOUBLE) AS score, chains AS hits, chains >= 3 AS sure FROM mules UNION ALL SELECT node, 'fan_in', score, n, score >= 0.6 FROM fi UNION ALL SELECT node, 'fan_out', score, n, score >= 0.6 FROM fo UNION ALL SELECT node, 'circular_flow', least(100, 55 + 10 * count(*)) / 100.0, count(*), false FROM (SELECT unnest(nodes) AS node FROM cyc) GROUP BY node UNION ALL SELECT n1, 'rapid_layering', max(score), count(*), false FROM layers GROUP BY n1 UNION ALL SELECT 'A' || substr(account_id, 2), 'shared_identity', score, others, score >= 0.5 FROM same)"
#: Beyond so many nodes two hops away a neighbourhood is only looked at in aggregates.
MOST_NEAR = 2000


@query(f"WITH {_SCORES}, {_NEAR} SELECT pattern, CASE WHEN two.n > {MOST_NEAR} THEN 'SIZE_FALLBACK' ELSE 'AVAILABLE' END AS status, CASE WHEN sure THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits FROM ps LEFT JOIN two USING (node) GROUP BY ALL")
def run_patterns(spark, sf_dir):
    """At how many nodes each of the six patterns is found, and how often, by status and confidence. Nodes whose neighbourhood is too large for
    a closer look have the status SIZE_FALLBACK."""
    reach = graph.two_hop(graph.undirected(pairs(spark, sf_dir)), MOST_NEAR + 1)
    status = F.when(F.coalesce("reach", F.lit(0)) > MOST_NEAR, "SIZE_FALLBACK").otherwise("AVAILABLE").alias("status")
    found = pattern_scores(spark, sf_dir).join(reach, "node", "left")
    return found.groupBy("pattern", status, "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"))


_WEIGHT = "CASE pattern " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " END"
_RISK = f"{_SCORES}, g AS (SELECT node, round(coalesce(sum(score * {_WEIGHT}), 0) * 100, 6) AS risk FROM deg LEFT JOIN ps USING (node) GROUP BY node)"


def node_risk(spark, sf_dir) -> DataFrame:
    """node, risk (0 to 100): pattern scores by weight. A pattern that was looked for and not found counts as 0."""
    nodes = pairs(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("pattern")]
    got = nodes.join(pattern_scores(spark, sf_dir), "node", "left").groupBy("node").agg(F.sum(F.col("score") * weight).alias("got"))
    return got.select("node", F.round(F.coalesce("got", F.lit(0.0)) * 100, 6).alias("risk"))


@query(f"WITH {_RISK} SELECT node, risk, CASE WHEN risk < 30 THEN 'LOW' WHEN risk < 60 THEN 'MEDIUM' WHEN risk < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM g")
def graph_risk(spark, sf_dir):
    return node_risk(spark, sf_dir).select("node", "risk", band(F.col("risk"), [30, 60, 80], ["LOW", "MEDIUM", "HIGH", "CRITICAL"]).alias("level"))


@query(f"WITH {EDGES}, f AS (SELECT node, us, i, o FROM (SELECT src AS node, us, 0 AS i, cents AS o FROM e UNION ALL SELECT dst, us, cents, 0 FROM e)), g AS (SELECT *, us - lag(us) OVER (PARTITION BY node ORDER BY us, i, o) AS gap FROM f) SELECT node, sum(i) / 100.0 AS in_flow, sum(o) / 100.0 AS out_flow, CASE WHEN greatest(sum(i), sum(o)) > 0 THEN CAST(least(sum(i), sum(o)) AS DOUBLE) / greatest(sum(i), sum(o)) END AS pass_through, sum(gap) / CAST(count(gap) AS DOUBLE) / 3600000000.0 AS gap_hours FROM g GROUP BY node")
def money_flow(spark, sf_dir):
    zero = F.lit(0).cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), "us", zero.alias("i"), F.col("cents").alias("o")), F.struct(F.col("dst").alias("node"), "us", F.col("cents").alias("i"), zero.alias("o"))))
    flow = edges(spark, sf_dir).select(ends.alias("x")).select("x.*")
    flow = flow.withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("node").orderBy("us", "i", "o")))
    i, o = F.sum("i"), F.sum("o")
    return flow.groupBy("node").agg(
        (i / 100.0).alias("in_flow"), (o / 100.0).alias("out_flow"), F.when(F.greatest(i, o) > 0, F.least(i, o) / F.greatest(i, o)).alias("pass_through"), (F.sum("gap") / F.count("gap") / 3600000000.0).alias("gap_hours")
    )


def graph_modes(pairs: DataFrame, hubs: DataFrame, most: int = MOST_NEAR) -> DataFrame:
    """node, mode: SIZE_FALLBACK where the neighbourhood is too large, else HUB_AWARE at hubs, else FULL."""
    reach = graph.two_hop(graph.undirected(pairs), most + 1)
    mode = F.when(F.coalesce("reach", F.lit(0)) > most, "SIZE_FALLBACK").when(F.col("is_hub"), "HUB_AWARE").otherwise("FULL")
    return hubs.select("node", "is_hub").join(reach, "node", "left").select("node", mode.alias("mode"))


@query(f"WITH {_RISK}, {_NEAR} SELECT g.node, CASE WHEN two.n > {MOST_NEAR} THEN 'SIZE_FALLBACK' WHEN g.node IN (SELECT node FROM hub) THEN 'HUB_AWARE' ELSE 'FULL' END AS mode, risk >= 60 AS review FROM g LEFT JOIN two USING (node)")
def graph_status(spark, sf_dir):
    modes = graph_modes(pairs(spark, sf_dir), hubs(spark, sf_dir))
    return node_risk(spark, sf_dir).join(modes, "node").select("node", "mode", (F.col("risk") >= 60).alias("review"))

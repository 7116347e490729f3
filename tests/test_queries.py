"""Every query that has SQL gives the same rows as DuckDB."""

import pytest
from conftest import SMALL, same_rows

from ledgerspark.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, name):
    same_rows(plans.QUERIES[name](spark, SMALL), plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["mule_chain", "circular_flow", "rapid_layering", "fan_in_pattern", "fan_out_pattern"])
def test_patterns_are_found(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_networks_without_sql_read_all_edges(spark):
    from pyspark.sql import functions as F

    from ledgerspark.plans import graph_queries as g

    pairs = {(r["src"], r["dst"]) for r in g.edges(spark, SMALL).select("src", "dst").distinct().collect()}
    near = {}
    for a, b in pairs:
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
    assert {r["node"]: r["core"] for r in plans.QUERIES["kcore"](spark, SMALL).collect()} == core
    bad = g.t.txn_events(spark, SMALL).where(F.col("is_suspicious") == 1)
    assert g.seeds(spark, SMALL).count() == bad.count()


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

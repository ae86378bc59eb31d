"""Walks on graphs with cycles and long chains."""

import random

from rows import collected

from runledger.operators import graph as G
from runledger.operators import lineage as L


def _graph(spark, pairs, runs):
    nodes = spark.createDataFrame([(n, "event", r, "t", i) for i, (n, r) in enumerate(runs)], "node_id string, node_type string, run_id string, tenant_id string, at long")
    edges = spark.createDataFrame([("causal", f"{s}-{t}", s, t) for s, t in pairs], "edge_type string, edge_id string, source string, target string")
    return nodes.selectExpr("node_id", "node_type", "run_id", "tenant_id", "timestamp_seconds(at) AS timestamp"), edges


def test_layers_with_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("gone", "c")]
    nodes, edges = _graph(spark, pairs, [(n, "r") for n in "abcxyz"])
    assert collected(L.layer_graph(nodes, edges), "node_id", "layer") == [("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None), ("z", None)]


def test_walks_do_not_grow_with_other_links(spark):
    others = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    nodes, edges = _graph(spark, [("a", "a"), ("b", "c"), *others], [("a", "r1"), ("b", "r1"), ("c", "r1"), *[(f"n{i}", "r2") for i in range(41)]])
    assert collected(G.causal_chain(nodes, edges, nodes.where("node_id IN ('a', 'c')").select("node_id")), "start_id", "position", "node_id") == [
        ("a", 0, "a"), ("c", 0, "b"), ("c", 1, "c")]
    path = collected(G.critical_path(nodes, edges), "run_id", "position", "node_id")
    assert path[:2] == [("r1", 0, "b"), ("r1", 1, "c")] and len(path) == 2 + 41


def _impacts(spark, nodes, edges):
    nodes = spark.createDataFrame(nodes, "node_id string, node_type string")
    edges = spark.createDataFrame([(kind, f"{s}-{t}", s, t) for kind, s, t in edges], "edge_type string, edge_id string, source string, target string")
    starts = nodes.select("node_id").union(nodes.select("node_id").limit(3))
    names = ("start_id", "event_count", "side_effect_count", "external_system_count")
    return collected(G.impact_totals(nodes, edges, starts), *names), collected(G.impact_counts(G.impact(nodes, edges, starts)), *names)


def _effects(rng, n):
    """Effects of some events on shared systems."""
    nodes, edges = [(f"x{i}", "external_system") for i in range(3)], []
    for i in range(0, n, 2):
        nodes.append((f"f{i}", "side_effect"))
        edges += [("produces", f"e{i}", f"f{i}"), ("produces", f"f{i}", f"x{rng.randrange(3)}")]
    return nodes, edges


def test_totals_of_forests_with_shared_systems(spark):
    rng = random.Random(2)
    nodes, edges = _effects(rng, 40)
    nodes += [(f"e{i}", "event") for i in range(40)]
    edges += [("causal", f"e{rng.randrange(i)}" if i % 9 else f"e{i - 1}", f"e{i}") for i in range(1, 40) if i % 13]
    totals, pairs = _impacts(spark, nodes, [*edges, ("temporal", "e39", "e0"), edges[0]])
    assert totals == pairs and len(totals) > 20


def test_totals_with_circles_several_causes_and_lost_nodes(spark):
    rng = random.Random(3)
    nodes, edges = _effects(rng, 30)
    nodes += [(f"e{i}", "event") for i in range(30) if i != 7]
    edges += [("causal", f"e{rng.randrange(30)}", f"e{i}") for i in range(30)]
    edges += [("causal", "e3", "e4"), ("causal", "e5", "e5"), ("causal", "e20", "lost"), ("produces", "x1", "e9")]
    totals, pairs = _impacts(spark, nodes, edges)
    assert totals == pairs and len(totals) > 15


def test_totals_of_a_long_chain_without_pairs(spark):
    n = 3000  # 4.5 million pairs of start and reached node
    nodes = spark.range(n).selectExpr("concat('e', id) AS node_id", "'event' AS node_type")
    edges = spark.range(1, n).selectExpr("'causal' AS edge_type", "concat('c', id) AS edge_id", "concat('e', id - 1) AS source", "concat('e', id) AS target")
    assert sorted(r["event_count"] for r in G.impact_totals(nodes, edges, nodes).collect()) == list(range(1, n))
    assert G.impact_totals(nodes.limit(0), edges.limit(0), nodes.limit(0)).count() == 0

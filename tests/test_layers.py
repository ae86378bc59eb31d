"""Layers of lineage graphs against a plain longest-path search."""

import random

import pytest

from runledger.operators import lineage as L


def brute(edges):
    """Layers of all targets that are not on a cycle or behind one."""
    parents = {}
    for s, t in edges:
        parents.setdefault(t, set()).add(s)
    layers = {n: 0 for e in edges for n in e if n not in parents}
    while True:
        more = {t: 1 + max(layers[s] for s in ss) for t, ss in parents.items() if t not in layers and all(s in layers for s in ss)}
        if not more:
            return {t: n for t, n in layers.items() if t in parents}
        layers |= more


def random_graph(seed):
    """Chains that meet and part, with a few cycles."""
    rng = random.Random(seed)
    n = rng.randrange(5, 60)
    edges = {(f"n{rng.randrange(k)}", f"n{k}") for k in range(1, n) for _ in range(1 if rng.random() < 0.7 else 3)}
    edges |= {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.choice([0, 0, 1, 3]))}
    edges |= {(f"c{k}", f"c{k + 1}") for k in range(rng.randrange(40))}
    return sorted(edges)


@pytest.mark.parametrize("seed", range(1))
def test_longest_paths(spark, seed):
    parts = [[(f"{seed}.{k}.{s}", f"{seed}.{k}.{t}") for s, t in random_graph(100 * seed + k)] for k in range(4)]
    edges = [e for part in parts for e in part]
    got = {r["node_id"]: r["layer"] for r in L.longest_paths(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == brute(edges)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes is contracted in rounds that double."""
    calls = []
    real = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: calls.append(1) or real(df))
    n = 100_000
    edges = spark.range(n).selectExpr("'n' || id AS source", "'n' || (id + 1) AS target")
    got = L.longest_paths(edges)
    assert got.where(f"layer <> CAST(substr(node_id, 2) AS BIGINT)").isEmpty()
    assert got.count() == n
    assert len(calls) < 30


def test_cycles_have_no_layer(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "e"), ("e", "d"), ("x", "x"), ("e", "f"), ("d", "g"), ("f", "g")]
    got = {r["node_id"]: r["layer"] for r in L.longest_paths(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == {"e": 1, "f": 2}


def test_no_edges(spark):
    assert L.longest_paths(spark.createDataFrame([], "source string, target string")).count() == 0


def test_layers_beyond_the_peeled_ones(spark, monkeypatch):
    """A graph deeper than what is peeled: layers are those of a plain search, cycles have none."""
    monkeypatch.setattr(L, "PEELED", 3)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("n5", "n30"), ("a", "n20"), ("a", "b"), ("b", "n39"), ("x", "y"), ("y", "x"), ("n9", "x")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    frame = spark.createDataFrame([(n, "event", "r", "t", None) for n in nodes], "node_id string, node_type string, run_id string, tenant_id string, timestamp timestamp")
    links = spark.createDataFrame([("causal", *e) for e in edges] + [("temporal", "n40", "n0")], "edge_type string, source string, target string")
    got = {r["node_id"]: r["layer"] for r in L.layer_graph(frame, links).collect()}
    want = brute(edges)
    assert got == {n: want.get(n, None if n in ("x", "y") else 0) for n in nodes}

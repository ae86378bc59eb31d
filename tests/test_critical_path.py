"""Critical paths: right with cycles and lost parents, and links are worked out once."""

import random

from rows import collected
from test_graph import _graph

from runledger.operators import graph as G


def _brute(parent, runs):
    best = {}
    for n, (node, run) in enumerate(runs):
        walk = [node]
        while (nxt := parent.get(walk[-1])) is not None and nxt not in walk:
            walk.append(nxt)
        place = (nxt is not None, 0 if nxt is not None else -len(walk), n, node)
        best[run] = min(best.get(run, (place, walk)), (place, walk))
    return sorted(((run, i, node) for run, (_, walk) in best.items() for i, node in enumerate(reversed(walk))), key=repr)


def test_paths_with_cycles_and_other_runs(spark):
    rng = random.Random(5)
    runs = [(f"n{i}", f"r{i % 4}") for i in range(80)] + [("c0", "only"), ("c1", "only"), ("c2", "only"), ("one", "single")]
    parent = {f"n{i}": f"n{i - 4 * rng.randrange(1, 3)}" for i in range(8, 80) if i % 13} | {"n1": "n5", "n5": "n1", "c0": "c1", "c1": "c0", "c2": "c1"}
    nodes, edges = _graph(spark, [*[(p, n) for n, p in parent.items()], ("n2", "n3"), ("gone", "n4")], runs)
    assert collected(G.critical_path(nodes, edges), "run_id", "position", "node_id") == _brute(parent, runs)


def test_links_are_cut_once(spark, monkeypatch):
    cuts, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    nodes, edges = _graph(spark, [("a", "b")], [("a", "r"), ("b", "r")])
    assert collected(G.critical_path(nodes, edges), "position", "node_id") == [(0, "a"), (1, "b")]
    assert len(cuts) < 5

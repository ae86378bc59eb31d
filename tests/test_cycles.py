"""Causal cycles: right members, and rounds that follow the longest walk, not the number of nodes."""

import random

from rows import collected

from runledger.operators import graph as G


def _edges(spark, pairs):
    return spark.createDataFrame([("causal", f"{s}-{t}", s, t) for s, t in pairs], "edge_type string, edge_id string, source string, target string")


def _brute(parent):
    out = []
    for node in parent:
        walk = [node]
        while (nxt := parent.get(walk[-1])) is not None and nxt not in walk:
            walk.append(nxt)
        if nxt == node:
            out.append((min(walk), node))
    return sorted(out, key=repr)


def test_cycles_with_tails_self_loops_and_open_ends(spark):
    rng = random.Random(4)
    parent = {f"n{i}": f"n{rng.randrange(60)}" for i in range(60) if i % 11}
    parent |= {f"l{i}": f"l{(i + 1) % 21}" for i in range(21)} | {f"t{i}": f"t{i - 1}" for i in range(1, 30)} | {"t0": "l3", "self": "self"}
    found = collected(G.causal_cycles(_edges(spark, [(p, n) for n, p in parent.items()])), "cycle_id", "node_id")
    assert found == _brute(parent) and len(found) > 21


def test_rounds_do_not_grow_with_the_number_of_cycles(spark, monkeypatch):
    rounds, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    pairs = [(f"c{i}{a}", f"c{i}{b}") for i in range(200) for a, b in ("ab", "ba")]
    assert G.causal_cycles(_edges(spark, pairs)).count() == 400
    assert len(rounds) < 6

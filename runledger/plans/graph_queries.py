"""Queries over the lineage graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.messages import sql
from runledger.operators import graph as G
from runledger.operators import lineage as L
from runledger.plans.lineage_queries import EDGES_SQL, GRAPH_SQL, j
from runledger.plans.registry import on_events, query
from runledger.plans.testbed import events_table
from runledger.session import cut_to_table


def _starts(ev, kind: str):
    return ev.where(F.col("type") == kind).select(F.concat(F.lit("event:"), "id").alias("node_id"))


@on_events("nodes_by_type", f"WITH {GRAPH_SQL} SELECT node_id FROM nodes WHERE node_type='side_effect'", stored=True)
def _(ev):
    return G.nodes_by(L.graph_nodes(ev), node_type="side_effect").select("node_id")


@on_events("nodes_by_event_type", "SELECT 'event:' || id AS node_id FROM ev WHERE type='tool.call.error'", stored=True)
def _(ev):
    return G.nodes_by(L.graph_nodes(ev), event_type="tool.call.error").select("node_id")


@on_events("nodes_by_ids", "SELECT 'event:' || id AS node_id FROM ev WHERE type='run.error'", stored=True)
def _(ev):
    return G.nodes_by(L.graph_nodes(ev), ids=_starts(ev, "run.error")).select("node_id")


@on_events("edges_out", f"WITH {EDGES_SQL} SELECT edge_id FROM edges WHERE source IN (SELECT 'event:' || id FROM ev WHERE type='run.error')", stored=True)
def _(ev):
    return G.edges_of(L.graph_edges(ev), _starts(ev, "run.error"), "out").select("edge_id")


@on_events("edges_in", f"WITH {EDGES_SQL} SELECT edge_id FROM edges WHERE target IN (SELECT 'event:' || id FROM ev WHERE type='run.error')", stored=True)
def _(ev):
    return G.edges_of(L.graph_edges(ev), _starts(ev, "run.error"), "in").select("edge_id")


@on_events("edges_by_type", f"WITH {EDGES_SQL} SELECT edge_id FROM edges WHERE edge_type='data_flow'", stored=True)
def _(ev):
    return G.edges_by_type(L.graph_edges(ev), "data_flow").select("edge_id")


_WALK = """st AS (SELECT DISTINCT source, target FROM edges WHERE edge_type IN ({types})),
  wk AS (SELECT 'event:' || id AS start_id, {there} AS node_id FROM ev JOIN st ON {here}='event:' || id WHERE type='{kind}'
    UNION SELECT wk.start_id, {there} FROM wk JOIN st ON {here}=wk.node_id)"""


def _walk(kind: str, types: str, forward: bool) -> str:
    here, there = ("st.source", "st.target") if forward else ("st.target", "st.source")
    return _WALK.format(types=types, kind=kind, here=here, there=there)


@on_events("ancestors", f"WITH RECURSIVE {EDGES_SQL}, {_walk('run.error', repr('causal') + ',' + repr('data_flow'), False)} SELECT start_id, node_id FROM wk", stored=True)
def _(ev):
    return G.ancestors(L.graph_edges(ev), _starts(ev, "run.error"), ["causal", "data_flow"])


@on_events("descendants", f"WITH RECURSIVE {EDGES_SQL}, {_walk('prompt.output', repr('causal') + ',' + repr('produces'), True)} SELECT start_id, node_id FROM wk", stored=True)
def _(ev):
    return G.descendants(L.graph_edges(ev), _starts(ev, "prompt.output"), ["causal", "produces"])


_CHAIN = """cp AS (SELECT source, target FROM edges WHERE edge_type='causal'),
  up AS (SELECT node_id AS start_id, node_id, 0 AS up FROM starts UNION ALL SELECT up.start_id, cp.source, up.up+1 FROM up JOIN cp ON cp.target=up.node_id)"""


@on_events("causal_chain", f"""WITH RECURSIVE {EDGES_SQL}, starts AS (SELECT 'event:' || id AS node_id FROM ev WHERE type='run.error'), {_CHAIN}
  SELECT start_id, CAST(max(up) OVER (PARTITION BY start_id) - up AS BIGINT) AS position, node_id FROM up""", stored=True)
def _(ev):
    nodes, edges = L.build_graph(ev)
    return G.causal_chain(nodes, edges, _starts(ev, "run.error"))


@on_events("side_effects_by_system", f"SELECT {j('targetSystem')} AS system, count(*) AS n, min('side_effect:' || id) AS first_node FROM ev WHERE type LIKE 'side_effect.%' GROUP BY ALL", stored=True)
def _(ev):
    system = F.get_json_object("meta", "$.targetSystem")
    return G.side_effects(L.graph_nodes(ev)).groupBy(system.alias("system")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"))


@on_events("side_effects_by_run", "SELECT 'side_effect:' || id AS node_id, run_id FROM ev WHERE type LIKE 'side_effect.%'", stored=True)
def _(ev):
    return G.side_effects(L.graph_nodes(ev)).select("node_id", "run_id")


_IMPACT = f"""WITH RECURSIVE {GRAPH_SQL}, {_walk('tool.call.start', repr('causal') + ',' + repr('produces'), True)}
  SELECT start_id, count(*) FILTER (WHERE node_type='event') AS event_count, count(*) FILTER (WHERE node_type='side_effect') AS side_effect_count,
   count(*) FILTER (WHERE node_type='external_system') AS external_system_count FROM wk JOIN nodes USING (node_id) GROUP BY start_id"""


@on_events("impact", _IMPACT, stored=True)
def _(ev):
    nodes, edges = L.build_graph(ev)
    return G.impact_counts(G.impact(nodes, edges, _starts(ev, "tool.call.start")))


@on_events("impact_totals", _IMPACT, stored=True)
def _(ev):
    nodes, edges = (cut_to_table(x) for x in L.build_graph(ev))
    return G.impact_totals(nodes, edges, _starts(ev, "tool.call.start"))


@on_events("subgraph", f"""WITH {EDGES_SQL}, ids AS (SELECT 'event:' || id AS node_id FROM ev WHERE tenant_id='tenant-1')
  SELECT edge_type, count(*) AS n FROM edges WHERE source IN (SELECT node_id FROM ids) AND target IN (SELECT node_id FROM ids) GROUP BY edge_type
  UNION ALL SELECT 'nodes', count(*) FROM ids""", stored=True)
def _(ev):
    ids = ev.where(F.col("tenant_id") == "tenant-1").select(F.concat(F.lit("event:"), "id").alias("node_id"))
    nodes, edges = G.subgraph(*L.build_graph(ev), ids)
    return edges.groupBy("edge_type").agg(F.count("*").alias("n")).unionByName(
        nodes.agg(F.lit("nodes").alias("edge_type"), F.count("*").alias("n")))


@on_events("critical_path", f"""WITH RECURSIVE {EDGES_SQL}, cp AS (SELECT source, target FROM edges WHERE edge_type='causal'),
  dp AS (SELECT 'event:' || id AS node_id, 0 AS depth FROM ev WHERE 'event:' || id NOT IN (SELECT target FROM cp)
    UNION ALL SELECT cp.target, dp.depth+1 FROM dp JOIN cp ON cp.source=dp.node_id),
  starts AS (SELECT run_id, 'event:' || id AS node_id FROM ev JOIN dp ON dp.node_id='event:' || id QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY depth DESC, "timestamp", 'event:' || id)=1),
  up AS (SELECT run_id, node_id, 0 AS up FROM starts UNION ALL SELECT up.run_id, cp.source, up.up+1 FROM up JOIN cp ON cp.target=up.node_id)
  SELECT run_id, CAST(max(up) OVER (PARTITION BY run_id) - up AS BIGINT) AS position, node_id FROM up""", stored=True)
def _(ev):
    return G.critical_path(*L.build_graph(ev))


# ---- integrity: the graph is broken in a known way first ---------------------------------

def _broken(ev):
    nodes, edges = L.build_graph(ev, include_temporal=False)
    lost = ev.where(F.col("type").isin("custom", "annotation", "policy.violated")).select(
        F.concat(F.lit("event:"), "id").alias("node_id"))
    lost_runs = ev.where(F.col("type") == "custom").select(F.concat(F.lit("run:"), "run_id").alias("node_id")).distinct()
    nodes = nodes.join(lost.unionByName(lost_runs), "node_id", "left_anti")
    copies = edges.where(F.col("edge_type") == "data_flow").withColumn("edge_id", F.concat("edge_id", F.lit("+copy")))
    loops = edges.where(F.col("edge_type") == "delegation").withColumns(
        {"edge_id": F.concat("edge_id", F.lit("+loop")), "target": F.col("source")})
    return cut_to_table(nodes), cut_to_table(edges.unionByName(copies).unionByName(loops))


BROKEN_SQL = f"""{GRAPH_SQL}, bn AS (SELECT * FROM nodes WHERE node_id NOT IN (SELECT 'event:' || id FROM ev WHERE type IN ('custom','annotation','policy.violated'))
   AND node_id NOT IN (SELECT 'run:' || run_id FROM ev WHERE type='custom')),
 be AS (SELECT edge_id, edge_type, source, target FROM edges WHERE edge_type<>'temporal'
  UNION ALL SELECT edge_id || '+copy', edge_type, source, target FROM edges WHERE edge_type='data_flow'
  UNION ALL SELECT edge_id || '+loop', edge_type, source, source FROM edges WHERE edge_type='delegation'),
 i1 AS (SELECT 'dangling_edge_source' AS issue_type, {sql('dangling_edge_source')} AS message, source AS node_ids, edge_id AS edge_ids FROM be WHERE source NOT IN (SELECT node_id FROM bn)
  UNION ALL SELECT 'dangling_edge_target', {sql('dangling_edge_target')}, target, edge_id FROM be WHERE target NOT IN (SELECT node_id FROM bn)),
 i2 AS (SELECT 'self_loop' AS issue_type, {sql('self_loop')} AS message, source AS node_ids, edge_id AS edge_ids FROM be WHERE source=target),
 i3 AS (SELECT 'duplicate_edge' AS issue_type, {sql('duplicate_edge')} AS message, source || ',' || target AS node_ids, edge_id AS edge_ids
   FROM (SELECT *, row_number() OVER (PARTITION BY edge_type, source, target ORDER BY edge_id) AS n FROM be) WHERE n>1),
 i4 AS (SELECT 'missing_run_node' AS issue_type, {sql('missing_run_node')} AS message, node_id AS node_ids, '' AS edge_ids
   FROM bn WHERE node_type='event' AND 'run:' || run_id NOT IN (SELECT node_id FROM bn WHERE node_type='run')),
 i5 AS (SELECT 'orphan_node' AS issue_type, {sql('orphan_node')} AS message, node_id AS node_ids, '' AS edge_ids
   FROM bn WHERE node_type IN ('event','side_effect') AND node_id NOT IN (SELECT source FROM be UNION ALL SELECT target FROM be)),
 allissues AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3 UNION ALL SELECT * FROM i4 UNION ALL SELECT * FROM i5)"""


def _flat(issues):
    return issues.select("issue_type", "message", F.array_join("related_node_ids", ",").alias("node_ids"),
                         F.array_join("related_edge_ids", ",").alias("edge_ids"))


for _name, _build, _table in [
    ("integrity_dangling", lambda n, e: G.integrity_dangling(n, e), "i1"),
    ("integrity_self_loop", lambda n, e: G.integrity_self_loop(e), "i2"),
    ("integrity_duplicate", lambda n, e: G.integrity_duplicate(e), "i3"),
    ("integrity_missing_run", lambda n, e: G.integrity_missing_run(n), "i4"),
    ("integrity_orphan", lambda n, e: G.integrity_orphan(n, e), "i5"),
    ("graph_integrity", lambda n, e: G.graph_integrity(n, e), "allissues"),
]:
    on_events(_name, f"WITH {BROKEN_SQL} SELECT * FROM {_table}", stored=True)(lambda ev, build=_build: _flat(build(*_broken(ev))))


# Parent of a part inside its block of ten keys; two cycles, a self-loop, tails, an open end.
PARENT_IN_BLOCK = [1, 2, 0, 0, 3, 6, 5, 7, 90, None]


def _part_edges(spark, sf_dir):
    parent = "CASE p_partkey%10 " + " ".join(
        f"WHEN {i} THEN p_partkey - p_partkey%10 + {p}" for i, p in enumerate(PARENT_IN_BLOCK) if p is not None) + " END"
    part = events_table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{parent} AS p").where("p IS NOT NULL")
    return part.select(
        F.lit("causal").alias("edge_type"), F.concat(F.lit("part:"), "p").alias("source"),
        F.concat(F.lit("part:"), "k").alias("target"), F.col("k").cast("string").alias("edge_id"))


_PARENT_SQL = "CASE p_partkey%10 " + " ".join(
    f"WHEN {i} THEN p_partkey - p_partkey%10 + {p}" for i, p in enumerate(PARENT_IN_BLOCK) if p is not None) + " END"


@query("integrity_cycles", f"""WITH RECURSIVE f AS (SELECT p_partkey AS k, {_PARENT_SQL} AS p FROM part),
  w AS (SELECT k, p, 1 AS n, least('part:' || CAST(k AS VARCHAR), 'part:' || CAST(p AS VARCHAR)) AS low FROM f WHERE p IS NOT NULL
    UNION ALL SELECT w.k, f.p, n+1, least(low, 'part:' || CAST(f.p AS VARCHAR)) FROM w JOIN f ON f.k=w.p WHERE n<10 AND f.p IS NOT NULL AND w.p<>w.k)
  SELECT 'cycle_detected' AS issue_type, {sql('cycle_detected').replace('cycle_id', 'low')} AS message, 'part:' || CAST(k AS VARCHAR) AS node_ids, '' AS edge_ids FROM w WHERE k=p""", raw=True)
def _(spark, sf_dir):
    return _flat(G.integrity_cycles(_part_edges(spark, sf_dir)))

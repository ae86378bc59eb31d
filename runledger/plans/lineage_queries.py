"""Lineage graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import lineage as L
from runledger.operators.describe import describe_events, duration_text
from runledger.operators.timeline import timeline_index, tool_calls, tool_durations
from runledger.plans.registry import on_events
from runledger.plans.timeline_queries import CALLS_SQL, DEPTH_SQL, DURATIONS_SQL, ORDER, TL_SQL


def j(name: str) -> str:
    return f"json_extract_string(payload,'$.{name}')"


LABEL_SQL = f"""CASE type WHEN 'run.start' THEN coalesce({j('runName')},'Run started') WHEN 'run.end' THEN 'Run ended: ' || {j('status')}
  WHEN 'run.error' THEN 'Error: ' || {j('errorMessage')} WHEN 'prompt.input' THEN {j('role')} || ' prompt (' || coalesce({j('tokenCount')},'?') || ' tokens)'
  WHEN 'prompt.output' THEN 'Output (' || coalesce({j('tokenCount')},'?') || ' tokens)' WHEN 'context.retrieved' THEN 'Retrieved from ' || {j('source')}
  WHEN 'context.injected' THEN 'Injected from ' || {j('source')} WHEN 'tool.call.start' THEN 'Tool: ' || {j('toolName')}
  WHEN 'tool.call.end' THEN 'Tool done: ' || {j('toolName')} || ' (' || CASE WHEN {j('success')}='true' THEN 'ok' ELSE 'failed' END || ')'
  WHEN 'tool.call.error' THEN 'Tool error: ' || {j('toolName')} WHEN 'approval.requested' THEN 'Approval: ' || {j('requestedAction')}
  WHEN 'approval.granted' THEN 'Approval granted' WHEN 'approval.denied' THEN 'Approval denied' WHEN 'side_effect.executed' THEN 'Side effect: ' || {j('description')}
  WHEN 'side_effect.failed' THEN 'Side effect failed: ' || {j('description')} WHEN 'model.request' THEN 'Model: ' || {j('modelId')}
  WHEN 'model.response' THEN 'Model response: ' || {j('modelId')} WHEN 'policy.evaluated' THEN 'Policy: ' || {j('policyName')} || ' (' || {j('result')} || ')'
  WHEN 'policy.violated' THEN 'Policy violated: ' || {j('policyName')} WHEN 'annotation' THEN 'Annotation: ' || {j('key')} ELSE coalesce({j('customType')},'Custom event') END"""


def cut_sql(text: str, size: int) -> str:
    return f"CASE WHEN length({text})>{size} THEN substr({text},1,{size - 1}) || '…' ELSE {text} END"


SUMMARY_TEXT_SQL = f"""CASE type WHEN 'run.start' THEN 'Run: ' || {j('runName')} WHEN 'run.end' THEN 'Status: ' || {j('status')} WHEN 'run.error' THEN {j('errorType')} || ': ' || {j('errorMessage')}
  WHEN 'prompt.input' THEN {cut_sql(j('content'), 80)} WHEN 'prompt.output' THEN {cut_sql(j('content'), 80)} WHEN 'tool.call.start' THEN {j('toolName')} || '(…)'
  WHEN 'tool.call.end' THEN {j('toolName')} || ' → ' || CASE WHEN {j('success')}='true' THEN 'success' ELSE 'failed' END WHEN 'tool.call.error' THEN {j('toolName')} || ': ' || {j('errorMessage')}
  WHEN 'context.retrieved' THEN 'Source: ' || {j('source')} || coalesce(' (' || {j('snippetCount')} || ' snippets)','') WHEN 'context.injected' THEN 'Source: ' || {j('source')}
  WHEN 'approval.requested' THEN 'Action: ' || {j('requestedAction')} WHEN 'approval.granted' THEN 'Granted by ' || {j('decidedBy')}
  WHEN 'approval.denied' THEN 'Denied by ' || {j('decidedBy')} || coalesce(': ' || {j('reason')},'') WHEN 'side_effect.executed' THEN {j('effectType')} || ': ' || {j('description')}
  WHEN 'side_effect.failed' THEN {j('effectType')} || ' failed: ' || {j('description')} WHEN 'model.request' THEN {j('modelProvider')} || '/' || {j('modelId')}
  WHEN 'model.response' THEN {j('modelProvider')} || '/' || {j('modelId')} || coalesce(' (' || {j('latencyMs')} || 'ms)','') WHEN 'policy.evaluated' THEN {j('policyName')} || ': ' || {j('result')}
  WHEN 'policy.violated' THEN {j('policyName')} || ' violated' ELSE type END"""
DETAIL_SQL = f"""CASE type WHEN 'run.start' THEN 'Name: ' || {j('runName')} WHEN 'run.end' THEN 'Status: ' || {j('status')} WHEN 'run.error' THEN 'Error: ' || {j('errorMessage')}
  WHEN 'prompt.input' THEN 'Role: ' || {j('role')} WHEN 'prompt.output' THEN 'Tokens: ' || {j('tokenCount')} WHEN 'tool.call.start' THEN 'Tool: ' || {j('toolName')}
  WHEN 'tool.call.end' THEN 'Tool: ' || {j('toolName')} || ' — done' WHEN 'tool.call.error' THEN 'Tool: ' || {j('toolName')} || ' — FAILED'
  WHEN 'approval.requested' THEN 'Approval requested' WHEN 'approval.granted' THEN 'Approved' WHEN 'approval.denied' THEN 'Denied'
  WHEN 'context.retrieved' THEN 'source: ' || {j('source')} WHEN 'context.injected' THEN 'source: ' || {j('source')} WHEN 'side_effect.executed' THEN 'effectType: ' || {j('effectType')}
  WHEN 'side_effect.failed' THEN 'effectType: ' || {j('effectType')} WHEN 'model.request' THEN 'modelProvider: openai' WHEN 'model.response' THEN 'modelProvider: openai'
  WHEN 'policy.evaluated' THEN 'policyName: ' || {j('policyName')} WHEN 'policy.violated' THEN 'policyName: ' || {j('policyName')} WHEN 'annotation' THEN 'key: note'
  ELSE coalesce('customType: ' || {j('customType')}, 'reason: none') END"""


@on_events("describe_events", f"""SELECT run_id, id, type, {LABEL_SQL} AS label, {SUMMARY_TEXT_SQL} AS summary, {DETAIL_SQL} AS detail,
  CASE WHEN type LIKE 'prompt.%' THEN 'event-prompt' WHEN type LIKE 'tool.call.%' THEN 'event-tool-call' WHEN type LIKE '%.error' THEN 'event-error'
  WHEN type LIKE 'side_effect.%' THEN 'event-side-effect' WHEN type LIKE 'approval.%' THEN 'event-approval' WHEN type LIKE 'context.%' THEN 'event-context'
  WHEN type LIKE 'model.%' THEN 'event-model' WHEN type LIKE 'policy.%' THEN 'event-policy' WHEN type LIKE 'run.%' THEN 'event-run' ELSE '' END AS category FROM ev""")
def _(ev):
    return describe_events(ev)


@on_events("duration_text", f"""WITH {CALLS_SQL}, {DURATIONS_SQL} SELECT run_id, id, CASE WHEN duration_ms<1000 THEN CAST(duration_ms AS VARCHAR) || 'ms'
  WHEN duration_ms<60000 THEN printf('%.1f', duration_ms/1000.0) || 's' ELSE CAST(duration_ms//60000 AS VARCHAR) || 'm ' || CAST(CAST(floor((duration_ms%60000)/1000.0+0.5) AS BIGINT) AS VARCHAR) || 's' END AS text FROM durs""")
def _(ev):
    rows = tool_durations(tool_calls(timeline_index(ev)))
    return rows.select("run_id", "id", duration_text("duration_ms").alias("text"))


EFFECTS_SQL = f"""fx AS (SELECT *, {j('effectType')} AS effect_type, {j('targetSystem')} AS target_system, {j('description')} AS description,
  type='side_effect.executed' AND {j('reversible')}='true' AS reversible, type='side_effect.executed' AS success,
  CASE WHEN type='side_effect.failed' THEN {j('errorMessage')} END AS error_message FROM ev WHERE type IN ('side_effect.executed','side_effect.failed'))"""
RUN_NODES_SQL = f"""rs AS (SELECT * FROM tl WHERE type='run.start' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY idx)=1),
 re AS (SELECT * FROM tl WHERE type='run.end' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY idx)=1),
 rn AS (SELECT 'run:' || f.run_id AS node_id, f.run_id, f.tenant_id, f.source_agent AS agent_id, json_extract_string(rs.payload,'$.runName') AS run_name,
   json_extract_string(rs.payload,'$.triggerSource') AS trigger_source, coalesce(json_extract_string(re.payload,'$.status'),'running') AS status,
   rs."timestamp" AS start_time, re."timestamp" AS end_time,
   CASE WHEN re."timestamp" >= rs."timestamp" THEN epoch_ms(re."timestamp")-epoch_ms(rs."timestamp") END AS duration_ms,
   json_extract_string(rs.payload,'$.parentRunId') AS parent_run_id
   FROM (SELECT * FROM tl WHERE idx=0) f LEFT JOIN rs USING (run_id) LEFT JOIN re USING (run_id))"""


@on_events("run_nodes", f"WITH {TL_SQL}, {RUN_NODES_SQL} SELECT * FROM rn")
def _(ev):
    return L.run_nodes(ev)


@on_events("event_nodes", f"""SELECT 'event:' || id AS node_id, run_id, tenant_id, type AS event_type, source_agent, source_framework, "timestamp", sequence, {LABEL_SQL} AS label, id AS source_event_id FROM ev""")
def _(ev):
    return L.event_nodes(ev)


@on_events("side_effect_nodes", f"""WITH {EFFECTS_SQL} SELECT 'side_effect:' || id AS node_id, run_id, tenant_id, effect_type, target_system, description, reversible, success, error_message, id AS source_event_id, "timestamp" FROM fx""")
def _(ev):
    return L.side_effect_nodes(ev)


@on_events("external_system_nodes", f"""WITH {EFFECTS_SQL} SELECT 'external_system:' || tenant_id || '/' || target_system AS node_id, tenant_id, target_system AS system_name, count(*) AS effect_count FROM fx GROUP BY ALL""")
def _(ev):
    return L.external_system_nodes(ev)


def edge_sql(kind: str, source: str, target: str, meta: str, frm: str) -> str:
    return f"""SELECT '{kind}:' || {source} || '->' || {target} || ':' || CAST(ingestion_order AS VARCHAR) AS edge_id, '{kind}' AS edge_type, {source} AS source, {target} AS target,
      run_id, tenant_id, "timestamp", {meta} AS meta FROM {frm}"""


_PMETA = """'{"effectType":"' || effect_type || '","targetSystem":"' || target_system || '"}'"""
PRODUCES_SQL = f"""pe AS ({edge_sql('produces', "('event:' || id)", "('side_effect:' || id)", _PMETA, 'fx')}
  UNION ALL {edge_sql('produces', "('side_effect:' || id)", "('external_system:' || tenant_id || '/' || target_system)", _PMETA, 'fx')})"""
CAUSAL_SQL = f"""ce AS ({edge_sql('causal', "('event:' || parent_event_id)", "('event:' || id)", '''('{"parentEventId":"' || parent_event_id || '"}')''', 'ev WHERE parent_event_id IN (SELECT id FROM ev)')})"""
TEMPORAL_SQL = f"""tn AS (SELECT *, lead(id) OVER w AS nid, lead("timestamp") OVER w AS nts FROM tl WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
 te AS ({edge_sql('temporal', "('event:' || id)", "('event:' || nid)", '''('{"gapMs":' || CAST(epoch_ms(nts)-epoch_ms("timestamp") AS VARCHAR) || '}')''', 'tn WHERE nid IS NOT NULL')})"""
DELEGATION_SQL = f"""dl AS (SELECT rs.*, json_extract_string(rs.payload,'$.parentRunId') AS parent FROM rs),
 de AS ({edge_sql('delegation', "('run:' || parent)", "('run:' || run_id)", '''('{"parentRunId":"' || parent || '","childRunId":"' || run_id || '"}')''', "dl WHERE parent IN (SELECT run_id FROM ev)")})"""
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS st, '{b}' AS tt, '{d}' AS d" for a, b, d in L.DATA_FLOW_PAIRS)
DATA_FLOW_SQL = f"""pairs AS ({_PAIRS}),
 df0 AS (SELECT s.*, p.d, (SELECT arg_min(t.id, t.idx) FROM tl t WHERE t.run_id=s.run_id AND t.type=p.tt AND t."timestamp">=s."timestamp") AS hit FROM tl s JOIN pairs p ON s.type=p.st),
 fe AS ({edge_sql('data_flow', "('event:' || id)", "('event:' || hit)", '''('{"description":"' || d || '"}')''', 'df0 WHERE hit IS NOT NULL')})"""
EDGES_SQL = f"""{TL_SQL}, {EFFECTS_SQL}, {RUN_NODES_SQL}, {PRODUCES_SQL}, {CAUSAL_SQL}, {TEMPORAL_SQL}, {DELEGATION_SQL}, {DATA_FLOW_SQL},
 edges AS (SELECT * FROM pe UNION ALL SELECT * FROM ce UNION ALL SELECT * FROM te UNION ALL SELECT * FROM de UNION ALL SELECT * FROM fe)"""
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def meta_sql(**values: str) -> str:
    """A JSON object of the values that are not null, in the given order."""
    return "('{' || substr(" + " || ".join(f"""coalesce(',"{k}":' || CAST(to_json({v}) AS VARCHAR), '')""" for k, v in values.items()) + ", 2) || '}')"


RUN_META = meta_sql(agentId="agent_id", runName="run_name", triggerSource="trigger_source", status="status", startTime=_ISO("start_time"), endTime=_ISO("end_time"),
                    durationMs="duration_ms", parentRunId="parent_run_id")
EVENT_META = meta_sql(eventType="type", sourceAgent="source_agent", sourceFramework="source_framework", timestamp=_ISO('"timestamp"'), sequence="sequence", label=LABEL_SQL)
EFFECT_META = meta_sql(effectType="effect_type", targetSystem="target_system", description="description", reversible="reversible", success="success", errorMessage="error_message")
SYSTEM_META = meta_sql(systemName="target_system", effectCount="count(*)")
NODE_META_SQL = f"""node_meta AS (SELECT node_id, {RUN_META} AS meta FROM rn UNION ALL SELECT 'event:' || id, {EVENT_META} FROM ev UNION ALL SELECT 'side_effect:' || id, {EFFECT_META} FROM fx
  UNION ALL SELECT 'external_system:' || tenant_id || '/' || target_system, {SYSTEM_META} FROM fx GROUP BY tenant_id, target_system)"""
NODES_SQL = """nodes AS (SELECT node_id, 'run' AS node_type, run_id, tenant_id, NULL AS source_event_id, start_time AS "timestamp" FROM rn
  UNION ALL SELECT 'event:' || id, 'event', run_id, tenant_id, id, "timestamp" FROM ev
  UNION ALL SELECT 'side_effect:' || id, 'side_effect', run_id, tenant_id, id, "timestamp" FROM fx
  UNION ALL SELECT 'external_system:' || tenant_id || '/' || target_system, 'external_system', NULL, tenant_id, NULL, NULL FROM fx GROUP BY ALL)"""
GRAPH_SQL = f"{EDGES_SQL}, {NODES_SQL}"

for _name, _build, _table in [("produces_edges", L.produces_edges, "pe"), ("causal_edges", L.causal_edges, "ce"),
                              ("temporal_edges", L.temporal_edges, "te"), ("delegation_edges", L.delegation_edges, "de"),
                              ("data_flow_edges", L.data_flow_edges, "fe"), ("graph_edges", L.graph_edges, "edges")]:
    on_events(_name, f"WITH {EDGES_SQL} SELECT * FROM {_table}", stored=_name == "graph_edges")(_build)


@on_events("graph_nodes", f"WITH {GRAPH_SQL}, {NODE_META_SQL} SELECT nodes.*, meta FROM nodes JOIN node_meta USING (node_id)", stored=True)
def _(ev):
    return L.graph_nodes(ev)


def _sums(kind: str, table: str, names: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {table}.{kind}_type='{n}') AS {n}_{kind}s" for n in names)


@on_events("graph_summary", f"""WITH RECURSIVE {GRAPH_SQL}, {DEPTH_SQL},
  dd AS (SELECT dr.run_id, min(tenant_id) AS tenant_id, max(depth) AS depth FROM dr JOIN ev USING (run_id, id) GROUP BY dr.run_id),
  lv AS (SELECT 'run' AS level UNION ALL SELECT 'tenant' UNION ALL SELECT 'all'),
  n2 AS (SELECT level, CASE WHEN level<>'all' THEN tenant_id END AS tenant_id, CASE WHEN level='run' THEN run_id END AS run_id, {_sums('node', 'nodes', ['run', 'event', 'side_effect'])}
    FROM nodes, lv WHERE node_type<>'external_system' GROUP BY 1,2,3),
  e2 AS (SELECT level, CASE WHEN level<>'all' THEN tenant_id END AS tenant_id, CASE WHEN level='run' THEN run_id END AS run_id, {_sums('edge', 'edges', L.EDGE_TYPES)},
    count(DISTINCT CASE WHEN target LIKE 'external_system:%' THEN target END) AS external_system_nodes FROM edges, lv GROUP BY 1,2,3),
  d2 AS (SELECT level, CASE WHEN level<>'all' THEN tenant_id END AS tenant_id, CASE WHEN level='run' THEN run_id END AS run_id, max(depth)::BIGINT AS max_depth FROM dd, lv GROUP BY 1,2,3)
  SELECT n2.*, {', '.join(f'coalesce(e2.{c},0) AS {c}' for c in ['external_system_nodes', *[k + '_edges' for k in L.EDGE_TYPES]])},
    run_nodes+event_nodes+side_effect_nodes+coalesce(external_system_nodes,0) AS node_count,
    coalesce(causal_edges+temporal_edges+produces_edges+delegation_edges+data_flow_edges,0) AS edge_count, coalesce(delegation_edges,0)>0 AS has_delegation, max_depth
  FROM n2 LEFT JOIN e2 ON n2.level=e2.level AND n2.tenant_id IS NOT DISTINCT FROM e2.tenant_id AND n2.run_id IS NOT DISTINCT FROM e2.run_id
  LEFT JOIN d2 ON n2.level=d2.level AND n2.tenant_id IS NOT DISTINCT FROM d2.tenant_id AND n2.run_id IS NOT DISTINCT FROM d2.run_id""", stored=True)
def _(ev):
    nodes, edges = L.build_graph(ev)
    return L.graph_summary(nodes, edges, L.event_depths(ev))


def _ids(column: str, field: str):
    return F.array_join(F.transform(column, lambda x: x[field]), ",")


RUN_GRAPH_SQL = EDGES_SQL.replace("tenant_id || '/'", "run_id || '/'") + ", " + NODES_SQL.replace(
    "tenant_id || '/' || target_system, 'external_system', NULL,", "run_id || '/' || target_system, 'external_system', run_id,")


@on_events("serialize_graph", f"""WITH {RUN_GRAPH_SQL}, a AS (SELECT run_id, string_agg(node_id, ',' ORDER BY coalesce("timestamp", TIMESTAMP '1970-01-01'), node_id) AS node_ids FROM nodes GROUP BY run_id),
  b AS (SELECT run_id, string_agg(edge_id, ',' ORDER BY "timestamp", edge_id) AS edge_ids FROM edges GROUP BY run_id)
  SELECT run_id, 0::BIGINT AS part, node_ids, edge_ids FROM a FULL JOIN b USING (run_id)""", stored=True)
def _(ev):
    graphs = L.serialize_graph(*L.build_graph(ev, owner="run_id"))
    return graphs.select("run_id", "part", _ids("nodes", "node_id").alias("node_ids"), _ids("edges", "edge_id").alias("edge_ids"))


@on_events("deserialize_graph", f"""WITH {RUN_GRAPH_SQL} SELECT run_id, node_id AS element_id, node_type AS element_type FROM nodes UNION ALL SELECT run_id, edge_id, edge_type FROM edges""", stored=True)
def _(ev):
    nodes, edges = L.deserialize_graph(L.serialize_graph(*L.build_graph(ev, owner="run_id")))
    return nodes.select("run_id", F.col("node_id").alias("element_id"), F.col("node_type").alias("element_type")).unionByName(
        edges.select("run_id", F.col("edge_id").alias("element_id"), F.col("edge_type").alias("element_type")))


@on_events("adjacency", f"""WITH {EDGES_SQL}, x AS (SELECT source AS node_id, 'out' AS direction, edge_id, "timestamp" FROM edges UNION ALL SELECT target, 'in', edge_id, "timestamp" FROM edges)
  SELECT node_id, direction, 0::BIGINT AS part, string_agg(edge_id, ',' ORDER BY "timestamp", edge_id) AS edge_ids FROM x GROUP BY node_id, direction""", stored=True)
def _(ev):
    return L.adjacency(L.graph_edges(ev)).withColumn("edge_ids", F.array_join("edge_ids", ","))


@on_events("filter_edges", f"WITH {EDGES_SQL} SELECT edge_id, edge_type FROM edges WHERE edge_type<>'temporal'", stored=True)
def _(ev):
    return L.filter_edges(L.graph_edges(ev)).select("edge_id", "edge_type")


@on_events("validate_graph", f"""WITH {GRAPH_SQL} SELECT 'node' AS element, node_id AS element_id, 'type' AS path, 'invalid_enum_value' AS code FROM nodes WHERE source_event_id IN (SELECT id FROM ev WHERE type='custom')
  UNION ALL SELECT 'node', node_id, 'meta.effectCount', 'too_small' FROM nodes WHERE node_type='external_system'
  UNION ALL SELECT 'edge', edge_id, 'source', 'too_small' FROM edges WHERE edge_type='delegation'""", stored=True)
def _(ev):
    nodes, edges = L.build_graph(ev)
    # Break the rules in a known way: unknown node types, negative counts, empty sources.
    custom = F.get_json_object("meta", "$.eventType") == "custom"
    nodes = nodes.withColumn("node_type", F.when(custom, "thing").otherwise(F.col("node_type"))).withColumn(
        "meta", F.when(F.col("node_type") == "external_system", F.lit('{"effectCount":-1}')).otherwise(F.col("meta")))
    edges = edges.withColumn("source", F.when(F.col("edge_type") == "delegation", "").otherwise(F.col("source")))
    return L.validate_graph(nodes, edges)


@on_events("layer_graph", f"""WITH RECURSIVE {GRAPH_SQL},
  st AS (SELECT DISTINCT source, target FROM edges WHERE edge_type<>'temporal'),
  wk AS (SELECT node_id, 0 AS layer FROM nodes WHERE node_id NOT IN (SELECT target FROM edges WHERE edge_type IN ('causal','data_flow','delegation'))
    UNION SELECT st.target, wk.layer+1 FROM wk JOIN st ON st.source=wk.node_id),
  ly AS (SELECT node_id, max(layer)::BIGINT AS layer FROM wk GROUP BY node_id),
  al AS (SELECT n.*, coalesce(layer,0) AS layer, coalesce(run_id, tenant_id) AS graph_key FROM nodes n LEFT JOIN ly USING (node_id))
  SELECT node_id, node_type, graph_key, layer, row_number() OVER (PARTITION BY graph_key, layer ORDER BY CASE node_type WHEN 'run' THEN 0 WHEN 'external_system' THEN 2 ELSE 1 END,
    CASE WHEN node_type='event' THEN "timestamp" ELSE TIMESTAMP '1970-01-01' END, node_id)-1 AS "row" FROM al""", stored=True)
def _(ev):
    return L.layer_graph(*L.build_graph(ev))

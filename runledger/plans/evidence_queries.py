"""Evidence and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.messages import sql
from runledger.operators import evidence as E
from runledger.operators import reports as P
from runledger.operators.redact import redaction_audit
from runledger.operators.runs import build_runs
from runledger.plans.ingest_queries import HITS_SQL
from runledger.plans.lineage_queries import DETAIL_SQL, EDGES_SQL, j
from runledger.plans.registry import on_events
from runledger.plans.timeline_queries import CALLS_SQL, DEPTH_SQL, DURATIONS_SQL, GAPS_SQL, RUNS_SQL, TL_SQL
from runledger.session import cut_to_table

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
ISO_TS = _ISO.format('"timestamp"')
CHAIN_SQL = f"""ms AS (SELECT run_id, id, idx, id || '|' || {ISO_TS} || '|' || payload_sorted || '|' AS m FROM tl),
 chain AS (SELECT run_id, id, idx, sha256(m) AS hash FROM ms WHERE idx=0 UNION ALL SELECT ms.run_id, ms.id, ms.idx, sha256(ms.m || chain.hash) FROM chain JOIN ms ON ms.run_id=chain.run_id AND ms.idx=chain.idx+1)"""


@on_events("integrity_chain", f"WITH RECURSIVE {TL_SQL}, {CHAIN_SQL} SELECT run_id, idx, id AS event_id, hash FROM chain")
def _(ev):
    return E.integrity_chain(ev)


@on_events("root_hash", f"WITH RECURSIVE {TL_SQL}, {CHAIN_SQL} SELECT run_id, arg_max(hash, idx) AS root_hash, count(*) AS chain_length FROM chain GROUP BY run_id")
def _(ev):
    return E.root_hash(E.integrity_chain(ev))


# Tampering by the tenant's runs: chain missing, chain shortened, one hash changed, root changed, untouched.
_CASE = "abs(length(run_id) * 7 + CAST(substr(run_id, length(run_id)) AS INT)) % 5"


@on_events("verify_chain", f"""WITH RECURSIVE {TL_SQL}, {CHAIN_SQL}, q AS (SELECT *, {_CASE} AS c, count(*) OVER (PARTITION BY run_id) AS n FROM chain)
  SELECT run_id, min(c)=4 OR (min(c)=1 AND false) AS valid,
   CASE min(c) WHEN 0 THEN 0 WHEN 1 THEN min(n)-1 WHEN 2 THEN 0 WHEN 3 THEN min(n)-1 END AS broken_at_index,
   CASE min(c) WHEN 0 THEN arg_min(id, idx) WHEN 2 THEN arg_min(id, idx) WHEN 3 THEN arg_max(id, idx) END AS broken_at_event_id,
   CASE min(c) WHEN 0 THEN 'chain_missing' WHEN 1 THEN CASE WHEN min(n)=1 THEN 'chain_missing' ELSE 'length:' || CAST(min(n) AS VARCHAR) END WHEN 2 THEN arg_min(hash, idx) WHEN 3 THEN arg_max(hash, idx) END AS expected_hash,
   CASE min(c) WHEN 1 THEN CASE WHEN min(n)>1 THEN 'length:' || CAST(min(n)-1 AS VARCHAR) END WHEN 2 THEN 'tampered' WHEN 3 THEN 'wrong root' END AS actual_hash
  FROM (SELECT * FROM q) GROUP BY run_id HAVING NOT (min(c)=1 AND min(n)=1)""", stored=True)
def _(ev):
    chain = E.integrity_chain(ev)
    case = F.expr(_CASE)
    roots = E.root_hash(chain)
    stored = chain.join(roots, "run_id").where(case != 0).where((case != 1) | (F.col("idx") < F.col("chain_length") - 1)).withColumn(
        "hash", F.when((case == 2) & (F.col("idx") == 0), "tampered").otherwise(F.col("hash"))).select("run_id", "idx", "hash")
    bundles = roots.where(~((case == 1) & (F.col("chain_length") == 1))).withColumn(
        "root_hash", F.when(case == 3, "wrong root").otherwise(F.col("root_hash")))
    return E.verify_chain(ev, stored, bundles)


@on_events("snapshot_runs", f"""WITH {RUNS_SQL} SELECT id, tenant_id, agent_id, run_name, status, {_ISO.format('started_at')} AS started_at, {_ISO.format('ended_at')} AS ended_at FROM runs""")
def _(ev):
    m = F.col("run_metadata")
    return E.snapshot_runs(build_runs(ev)).select("id", m["tenantId"].alias("tenant_id"), m["agentId"].alias("agent_id"), m["runName"].alias("run_name"),
                                                  m["status"].alias("status"), m["startedAt"].alias("started_at"), m["endedAt"].alias("ended_at"))


def _requests(runs):
    """Every run is asked for; runs of agent-3 by the wrong tenant, those of agent-4 under an unknown id."""
    return runs.select(
        F.when(F.col("agent_id") == "agent-4", F.concat(F.lit("no-"), "id")).otherwise(F.col("id")).alias("run_id"),
        F.when(F.col("agent_id") == "agent-3", "other").otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.lit("2024-06-01 12:00:00").cast("timestamp").alias("created_at"))


def _bundles(ev):
    runs = build_runs(ev)
    return E.assemble_bundles(ev, runs, _requests(runs))


REQUESTS_SQL = "rq AS (SELECT CASE WHEN agent_id='agent-4' THEN 'no-' || id ELSE id END AS run_id, CASE WHEN agent_id='agent-3' THEN 'other' ELSE tenant_id END AS tenant_id FROM runs)"
BUNDLES_SQL = f"""{EDGES_SQL}, {CALLS_SQL[CALLS_SQL.index('calls AS'):]}, {DURATIONS_SQL}, {GAPS_SQL.strip()}, {DEPTH_SQL}, {CHAIN_SQL}, {HITS_SQL}, {RUNS_SQL}, {REQUESTS_SQL},
 mb AS (SELECT r.run_id AS g, r.run_id FROM rq r UNION SELECT p.run_id, c.id FROM rq p JOIN runs c ON c.parent_run_id=p.run_id),
 gn AS (SELECT g, count(*) + count(*) FILTER (WHERE type LIKE 'side_effect.%') + count(DISTINCT mb.run_id) + count(DISTINCT CASE WHEN type LIKE 'side_effect.%' THEN {j('targetSystem')} END) AS node_count FROM mb JOIN ev ON ev.run_id=mb.run_id GROUP BY g),
 ge AS (SELECT g, count(*) AS n FROM mb JOIN edges ON edges.run_id=mb.run_id WHERE edge_type<>'delegation' GROUP BY g),
 gd AS (SELECT a.g, count(*) AS n FROM mb a JOIN de ON de.run_id=a.run_id JOIN mb b ON b.g=a.g AND de.source='run:' || b.run_id GROUP BY a.g),
 bu AS (SELECT rq.run_id, rq.tenant_id, CASE WHEN r.id IS NULL THEN {sql('run_unknown').replace('run_id', 'rq.run_id')} WHEN r.tenant_id<>rq.tenant_id THEN {sql('run_of_other_tenant').replace('run_id', 'rq.run_id').replace('tenant_id', 'rq.tenant_id')} END AS error_message,
   r.status AS run_status, r.run_name, r.agent_id, r.started_at, r.ended_at,
   (SELECT count(*) FROM ev WHERE ev.run_id=rq.run_id) AS ec, (SELECT count(*) FROM gaps WHERE gaps.run_id=rq.run_id) AS gc, (SELECT max(depth) FROM dr WHERE dr.run_id=rq.run_id) AS md,
   (SELECT count(*) FROM hits WHERE hits.run_id=rq.run_id) AS hc, (SELECT arg_max(hash, idx) FROM chain WHERE chain.run_id=rq.run_id) AS rh, gn.node_count AS nc, coalesce(ge.n,0) + coalesce(gd.n,0) AS gec
   FROM rq LEFT JOIN runs r ON r.id=rq.run_id LEFT JOIN gn ON gn.g=rq.run_id LEFT JOIN ge ON ge.g=rq.run_id LEFT JOIN gd ON gd.g=rq.run_id),
 bundles AS (SELECT run_id, tenant_id, CASE WHEN error_message IS NULL THEN 'complete' ELSE 'failed' END AS status, error_message, run_status, run_name, agent_id, started_at, ended_at,
   CASE WHEN error_message IS NULL THEN ec ELSE 0 END AS event_count, CASE WHEN error_message IS NULL THEN gc ELSE 0 END AS gap_count, CASE WHEN error_message IS NULL THEN md::BIGINT END AS max_depth,
   CASE WHEN error_message IS NULL THEN nc ELSE 0 END AS node_count, CASE WHEN error_message IS NULL THEN gec ELSE 0 END AS edge_count, CASE WHEN error_message IS NULL THEN hc ELSE 0 END AS total_redacted_fields,
   CASE WHEN error_message IS NULL THEN rh END AS root_integrity_hash, coalesce(error_message IS NULL AND run_status='running', false) AS is_partial_run,
   CASE WHEN error_message IS NULL AND run_status='running' THEN {sql('run_unfinished').replace('made_at', chr(39) + '2024-06-01T12:00:00.000Z' + chr(39))} END AS partial_run_marker,
   sha256(run_id || '|' || tenant_id || '|2024-06-01T12:00:00.000Z') AS bid FROM bu)"""
_HEAD = ["run_id", "tenant_id", "status", "error_message", "event_count", "gap_count", "max_depth", "node_count", "edge_count",
         "total_redacted_fields", "root_integrity_hash", "is_partial_run", "partial_run_marker"]


@on_events("assemble_bundles", f"WITH RECURSIVE {BUNDLES_SQL} SELECT {', '.join(_HEAD)} FROM bundles", stored=True)
def _(ev):
    return _bundles(ev).select(*_HEAD)


@on_events("list_bundles", f"WITH RECURSIVE {BUNDLES_SQL} SELECT bid AS id, run_id, status FROM bundles WHERE tenant_id='tenant-1' ORDER BY bid LIMIT 20", stored=True)
def _(ev):
    return E.list_bundles(_bundles(ev), tenant="tenant-1").select("id", "run_id", "status")


_EVENT_LINE = f"""'{{"id":"' || id || '","runId":"' || run_id || '","type":"' || type || '","timestamp":"' || {ISO_TS} || '","sequence":' || coalesce(CAST(sequence AS VARCHAR),'null') || ',"parentEventId":' || coalesce('"' || parent_event_id || '"','null')
  || ',"tenantId":"' || tenant_id || '","sourceAgent":"' || source_agent || '","sourceFramework":' || coalesce('"' || source_framework || '"','null') || ',"payload":' || payload_sorted || ',"tags":["' || array_to_string(tags,'","') || '"],"schemaVersion":"1.0.0"}}'"""


@on_events("export_documents", f"""WITH RECURSIVE {BUNDLES_SQL}, ok AS (SELECT * FROM bundles WHERE status='complete'),
   e0 AS (SELECT run_id, sha256(CAST(idx AS VARCHAR) || '|' || {_EVENT_LINE}) AS h FROM tl WHERE run_id IN (SELECT run_id FROM ok)),
   e1 AS (SELECT run_id, substr(h,1,6) AS g, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM e0 GROUP BY ALL),
   e2 AS (SELECT run_id, substr(g,1,3) AS g, sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM e1 GROUP BY run_id, substr(g,1,3)),
   eh AS (SELECT run_id, sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM e2 GROUP BY run_id),
   ln AS (SELECT bid, 'header' AS section, 1 AS n, NULL AS h FROM ok UNION ALL SELECT bid, 'events', n, h FROM ok JOIN eh USING (run_id) UNION ALL SELECT bid, 'timeline.entries', event_count, NULL FROM ok
    UNION ALL SELECT bid, 'timeline.gaps', gap_count, NULL FROM ok WHERE gap_count>0 UNION ALL SELECT bid, 'timeline.summary', 1, NULL FROM ok
    UNION ALL SELECT bid, 'lineage.nodes', node_count, NULL FROM ok UNION ALL SELECT bid, 'lineage.edges', edge_count, NULL FROM ok WHERE edge_count>0
    UNION ALL SELECT bid, 'redactionAudit', total_redacted_fields, NULL FROM ok WHERE total_redacted_fields>0)
  SELECT bid AS bundle_id, section, n::BIGINT AS line_count, h AS section_hash FROM ln""", stored=True)
def _(ev):
    lines = E.export_lines(_bundles(ev), ev, build_runs(ev))
    parts = E.section_hashes(lines).select("bundle_id", "section", "line_count", "section_hash")
    # Only the text of the event lines is written out in the SQL as well.
    return parts.withColumn("section_hash", F.when(F.col("section") == "events", F.col("section_hash")))


@on_events("export_integrity", stored=True)
def _(ev):
    """Whole documents: the hash over all sections beside those of the sections. tests/test_evidence.py hashes the lines again in plain Python."""
    lines = E.export_lines(_bundles(ev), ev, build_runs(ev))
    parts = E.section_hashes(lines).select("bundle_id", "section", F.col("line_count").alias("section_lines"), "section_hash")
    return E.export_documents(lines).join(parts, "bundle_id")


@on_events("verify_exports", f"WITH {RUNS_SQL}, {REQUESTS_SQL} SELECT sha256(rq.run_id || '|' || rq.tenant_id || '|2024-06-01T12:00:00.000Z') AS bundle_id, r.tenant_id<>'tenant-1' AS is_valid FROM rq JOIN runs r ON r.id=rq.run_id AND r.tenant_id=rq.tenant_id", stored=True)
def _(ev):
    lines = E.export_lines(_bundles(ev), ev, build_runs(ev))
    # Documents of tenant-1 are changed after they were sealed.
    changed = lines.withColumn("line", F.when(
        (F.col("section") == "events") & (F.col("position") == 0), F.replace(F.col("line"), F.lit('"tenantId":"tenant-1"'), F.lit('"tenantId":"x"'))).otherwise(F.col("line")))
    return E.verify_exports(changed, cut_to_table(E.export_documents(lines)))  # one tree of hashes at a time


@on_events("validate_exports", f"""WITH {RUNS_SQL}, {REQUESTS_SQL}, ok AS (SELECT r.* FROM rq JOIN runs r ON r.id=rq.run_id AND r.tenant_id=rq.tenant_id)
  SELECT id AS run_id, 'header' AS section, 'bundle.status' AS path FROM ok UNION ALL SELECT run_id, 'events', 'type' FROM ev WHERE run_id IN (SELECT id FROM ok) AND type='custom'""", stored=True)
def _(ev):
    lines = E.export_lines(_bundles(ev), ev, build_runs(ev))
    odd = F.when(F.col("section") == "header", F.replace(F.col("line"), F.lit('"status":"complete"'), F.lit('"status":"odd"'))).when(
        F.col("section") == "events", F.replace(F.col("line"), F.lit('"type":"custom"'), F.lit('"type":null'))).otherwise(F.col("line"))
    issues = E.validate_exports(lines.withColumn("line", odd))
    return issues.join(lines.select("bundle_id", "run_id").distinct(), "bundle_id").select("run_id", "section", "path")


_TIME = """strftime("timestamp", '%Y-%m-%d %H:%M:%S.%g') || ' UTC'"""


@on_events("report_overview", f"""WITH RECURSIVE {BUNDLES_SQL} SELECT bid AS bundle_id, run_id, coalesce(run_name, run_id) AS run_name, agent_id, run_status, epoch_ms(ended_at)-epoch_ms(started_at) AS duration_ms, event_count,
   (SELECT count(*) FROM ev WHERE ev.run_id=b.run_id AND type='tool.call.start') AS tool_calls, (SELECT count(*) FROM ev WHERE ev.run_id=b.run_id AND (type LIKE 'approval.%' OR type LIKE 'policy.%')) AS decisions,
   (SELECT count(*) FROM ev WHERE ev.run_id=b.run_id AND type IN ('run.error','tool.call.error','side_effect.failed')) AS errors, total_redacted_fields, is_partial_run FROM bundles b WHERE status='complete'""", stored=True)
def _(ev):
    return P.report_overview(_bundles(ev), ev)


@on_events("report_timeline", f"WITH {TL_SQL} SELECT run_id, id, coalesce(sequence, idx+1)::BIGINT AS number, type, {_TIME} AS time, {DETAIL_SQL} AS detail FROM tl")
def _(ev):
    return P.report_timeline(ev)


@on_events("report_tool_calls", f"""SELECT run_id, id, {j('toolName')} AS tool_name, CASE type WHEN 'tool.call.error' THEN 'ERROR' ELSE substr(type, 11) END AS state, {_TIME} AS time,
   CASE WHEN type='tool.call.start' THEN CAST(json_extract(payload,'$.inputParameters') AS VARCHAR) END AS arguments, {j('output')} AS result, {j('errorMessage')} AS error FROM ev WHERE type LIKE 'tool.call.%'""")
def _(ev):
    return P.report_tool_calls(ev)


@on_events("report_decisions", f"SELECT run_id, id, replace(type, '.', ' → ') AS label, {_TIME} AS time, CAST(NULL AS VARCHAR) AS decision, {j('reason')} AS reason, {j('policyId')} AS policy_id FROM ev WHERE type LIKE 'approval.%' OR type LIKE 'policy.%'")
def _(ev):
    return P.report_decisions(ev)


@on_events("report_errors", f"SELECT run_id, id, type, {_TIME} AS time, {j('errorType')} AS error_type, {j('errorMessage')} AS message, {j('stackTrace')} AS stack FROM ev WHERE type IN ('run.error','tool.call.error','side_effect.failed')")
def _(ev):
    return P.report_errors(ev)


@on_events("report_redactions", f"WITH {HITS_SQL} SELECT * FROM hits")
def _(ev):
    return P.report_redactions(redaction_audit(ev)[1])

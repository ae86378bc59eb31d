"""Run check and search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runledger.operators import checks as C
from runledger.operators import search as S
from runledger.plans.lineage_queries import j
from runledger.plans.registry import on_events, query
from runledger.plans.testbed import events_table
from runledger.plans.timeline_queries import TL_SQL
from runledger.session import shared_dir

_ERR = "type IN ('run.error','tool.call.error','side_effect.failed')"
FINDINGS_SQL = f"""{TL_SQL},
 c1 AS (SELECT run_id, 'excessive_failures' AS finding, 'high' AS severity, CAST(f AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' tool calls failed' AS description, a AS first_event_id, b AS last_event_id, f AS event_count
   FROM (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE bad) AS f, arg_min(id, idx) FILTER (WHERE bad) AS a, arg_max(id, idx) FILTER (WHERE bad) AS b
     FROM (SELECT *, type='tool.call.error' OR {j('success')}='false' AS bad FROM tl WHERE type IN ('tool.call.end','tool.call.error')) GROUP BY run_id) WHERE f::DOUBLE/n > 0.30),
 tk AS (SELECT run_id, coalesce(sum(t) FILTER (WHERE type='model.response'), sum(t) FILTER (WHERE type='model.request'))::BIGINT AS tokens, count(*) AS n, arg_min(id, idx) AS a, arg_max(id, idx) AS b
   FROM (SELECT *, CAST({j('inputTokens')} AS BIGINT) + coalesce(CAST({j('outputTokens')} AS BIGINT), 0) AS t FROM tl WHERE type LIKE 'model.%') GROUP BY run_id),
 c2 AS (SELECT run_id, 'high_token_usage' AS finding, 'medium' AS severity, CAST(tokens AS VARCHAR) || ' tokens used' AS description, a AS first_event_id, b AS last_event_id, n AS event_count FROM tk WHERE tokens>100000),
 c3 AS (SELECT run_id, 'long_gap' AS finding, 'low' AS severity, CAST(ms AS VARCHAR) || ' ms without an event' AS description, id AS first_event_id, nid AS last_event_id, 2::BIGINT AS event_count
   FROM (SELECT *, lead(id) OVER w AS nid, epoch_ms(lead("timestamp") OVER w)-epoch_ms("timestamp") AS ms FROM tl WINDOW w AS (PARTITION BY run_id ORDER BY idx)) WHERE ms>60000),
 c4 AS (SELECT run_id, 'repeated_calls' AS finding, 'medium' AS severity, tool_name || ' called ' || CAST(count(*) AS VARCHAR) || ' times with the same input' AS description, arg_min(id, idx) AS first_event_id, arg_max(id, idx) AS last_event_id, count(*) AS event_count
   FROM tl WHERE type='tool.call.start' GROUP BY run_id, tool_name, json_extract_string(payload,'$.inputParameters.k') HAVING count(*)>=3),
 c5 AS (SELECT run_id, 'error_cascade' AS finding, 'high' AS severity, CAST(count(*) AS VARCHAR) || ' errors in a row' AS description, arg_min(id, idx) AS first_event_id, arg_max(id, idx) AS last_event_id, count(*) AS event_count
   FROM (SELECT *, idx - row_number() OVER (PARTITION BY run_id ORDER BY idx) AS g FROM tl WHERE {_ERR}) GROUP BY run_id, g HAVING count(*)>=3),
 anom AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5)"""
for _name, _build, _n in [("check_failure_rate", C.check_failure_rate, 1), ("check_token_use", C.check_token_use, 2), ("check_idle_gap", C.check_idle_gap, 3),
                          ("check_repeated_calls", C.check_repeated_calls, 4), ("check_error_cascade", C.check_error_cascade, 5)]:
    on_events(_name, f"WITH {FINDINGS_SQL} SELECT * FROM c{_n}")(_build)
on_events("anomalies", f"WITH {FINDINGS_SQL} SELECT * FROM anom", stored=True)(C.anomalies)


@on_events("overall_risk", f"""WITH {FINDINGS_SQL} SELECT run_id, count(*) AS finding_count, CASE max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS overall_risk FROM anom GROUP BY run_id""", stored=True)
def _(ev):
    return C.overall_risk(C.anomalies(ev))


COMPLIANCE_SQL = f"""{TL_SQL},
 rd AS (SELECT *, max(CASE WHEN type='approval.granted' THEN 1 ELSE 0 END) OVER w AS granted, max(CASE WHEN type IN ('context.retrieved','tool.call.end') THEN 1 ELSE 0 END) OVER w AS has_read
   FROM tl WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v1 AS (SELECT run_id, 'sensitive_data' AS finding, 'high' AS severity, 'matches builtin-email-value' AS description, id AS first_event_id, id AS last_event_id, 1::BIGINT AS event_count FROM ev WHERE type='prompt.input' AND k%2=0),
 v2 AS (SELECT run_id, 'missing_approval' AS finding, 'critical' AS severity, 'irreversible side effect without approval' AS description, id AS first_event_id, id AS last_event_id, 1::BIGINT AS event_count
   FROM rd WHERE type='side_effect.executed' AND {j('reversible')}='false' AND coalesce(granted,0)=0),
 v3 AS (SELECT run_id, 'data_exfiltration' AS finding, 'high' AS severity, 'read data, then reached ' || {j('targetSystem')} AS description, id AS first_event_id, id AS last_event_id, 1::BIGINT AS event_count FROM rd WHERE type='side_effect.executed' AND has_read=1),
 v4 AS (SELECT run_id, 'prompt_injection' AS finding, 'critical' AS severity, 'tool output with an instruction phrase' AS description, id AS first_event_id, id AS last_event_id, 1::BIGINT AS event_count FROM ev WHERE type='tool.call.end' AND k%10=0),
 viol AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4)"""
for _name, _build, _n in [("check_sensitive_data", C.check_sensitive_data, 1), ("check_missing_approval", C.check_missing_approval, 2),
                          ("check_read_then_send", C.check_read_then_send, 3), ("check_injection_marks", C.check_injection_marks, 4)]:
    on_events(_name, f"WITH {COMPLIANCE_SQL} SELECT * FROM v{_n}")(_build)
on_events("compliance", f"WITH {COMPLIANCE_SQL} SELECT * FROM viol", stored=True)(C.compliance)


@on_events("compliance_score", f"""WITH {COMPLIANCE_SQL} SELECT r.run_id, count(finding) AS violation_count, greatest(0, 100 - coalesce(sum(CASE severity WHEN 'high' THEN 20 WHEN 'critical' THEN 40 END), 0))::BIGINT AS score
   FROM (SELECT DISTINCT run_id FROM ev) r LEFT JOIN viol USING (run_id) GROUP BY r.run_id""", stored=True)
def _(ev):
    return C.compliance_score(ev)


@on_events("run_counts", """SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE type='tool.call.start') AS tool_calls, count(*) FILTER (WHERE type='model.request') AS model_calls,
   count(*) FILTER (WHERE type LIKE 'side_effect.%') AS side_effects FROM ev GROUP BY run_id""")
def _(ev):
    return C.run_counts(ev)


@on_events("run_effects", f"SELECT run_id, id, {j('effectType')} AS effect_type, {j('targetSystem')} AS target_system, {j('description')} AS description FROM ev WHERE type LIKE 'side_effect.%'")
def _(ev):
    return C.run_effects(ev)


@on_events("run_context_text", f"""WITH {TL_SQL}, ln AS (SELECT run_id, idx, '[' || CAST(idx+1 AS VARCHAR) || '] ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || 'Z | ' || type || ' | id=' || id || ' | agent=' || source_agent || ' | '
    || CASE WHEN length(payload)>60 THEN substr(payload,1,60) || '…' ELSE payload END AS line, count(*) OVER (PARTITION BY run_id) AS n FROM tl)
  SELECT run_id, string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE idx<10) || CASE WHEN max(n)>10 THEN chr(10) || chr(10) || '... (' || CAST(max(n)-10 AS VARCHAR) || ' more events truncated)' ELSE '' END AS context FROM ln GROUP BY run_id""")
def _(ev):
    return C.run_context_text(ev, max_events=10, max_payload=60)


@on_events("annotations_from_checks", f"""WITH {FINDINGS_SQL} SELECT run_id, min(e.tenant_id) AS tenant_id, 'annotation' AS type, 'check,' || finding AS tags, finding AS key, severity, description FROM anom JOIN ev e USING (run_id)
   GROUP BY run_id, finding, severity, description, first_event_id""", stored=True)
def _(ev):
    rows = C.annotations_from_checks(C.anomalies(ev), ev)
    at = lambda path: F.get_json_object("payload", path)
    return rows.select("run_id", "tenant_id", "type", F.array_join("tags", ",").alias("tags"), at("$.key").alias("key"),
                       at("$.value.severity").alias("severity"), at("$.value.description").alias("description"))


# ---- search --------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
# Payload values by their paths; keys are left out.
_VALUES = """[json_extract_string(payload, p) for p in ['$.runName','$.triggerSource','$.parentRunId','$.configuration.retries','$.status','$.durationMs','$.errorType','$.errorMessage','$.stackTrace','$.role',
  '$.content','$.tokenCount','$.finishReason','$.source','$.query','$.documentIds[0]','$.documentIds[1]','$.snippetCount','$.toolName','$.toolId','$.inputParameters.k','$.inputParameters.api_key','$.inputParameters.items[0].token',
  '$.inputParameters.items[1].note','$.output','$.approvalType','$.requestedAction','$.requestedBy','$.decidedBy','$.reason','$.effectType','$.targetSystem','$.description','$.modelProvider','$.modelId','$.inputTokens',
  '$.outputTokens','$.latencyMs','$.policyName','$.policyId','$.result','$.key','$.value','$.customType']]"""
INDEX_SQL = f"""fl AS (SELECT id, run_id, tenant_id, type, unnest(list_concat([{{'weight':'A','t':type}}, {{'weight':'A','t':source_agent}}, {{'weight':'B','t':coalesce(source_framework,'')}}, {{'weight':'B','t':array_to_string(tags,' ')}}],
   [{{'weight':'C','t':v}} for v in {_VALUES} if v IS NOT NULL])) AS f FROM ev),
 fn AS (SELECT id, run_id, tenant_id, type, f.weight AS weight, regexp_extract_all(lower(f.t), '[a-z0-9]+') AS ws, row_number() OVER () AS field_no FROM fl),
 ix AS (SELECT id, run_id, tenant_id, type, weight, field_no, unnest(ws) AS term, unnest(generate_series(0, len(ws)-1)) AS pos FROM fn WHERE len(ws)>0),
 idx AS (SELECT * FROM ix WHERE term NOT IN ({_STOP}))"""
SCORE_SQL = "round(sum(CASE weight WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END * (1 - 1.0::DOUBLE/(1+tf))), 9)"
MATCH_SQL = f"""{INDEX_SQL}, mt AS (SELECT DISTINCT id FROM idx WHERE id IN (SELECT id FROM idx WHERE term='tool') AND id IN (SELECT id FROM idx WHERE term IN ('start','error')) AND id NOT IN (SELECT id FROM idx WHERE term='t1')),
 tf AS (SELECT id, term, weight, count(*) AS tf FROM idx WHERE term IN ('tool','start','error') AND id IN (SELECT id FROM mt) GROUP BY ALL),
 rk AS (SELECT id, {SCORE_SQL} AS rank FROM tf GROUP BY id)"""


def _matched(ev):
    index = S.build_search_index(ev)
    ids = S.search_match(index, all_of=["tool"], any_of=["start", "error"], none_of=["t1"])
    return index, ids


@on_events("build_search_index", f"WITH {INDEX_SQL} SELECT id, term, weight, count(*) AS tf, min(pos)::BIGINT AS first_pos FROM idx GROUP BY ALL")
def _(ev):
    return S.build_search_index(ev).groupBy("id", "term", "weight").agg(
        F.count("*").alias("tf"), F.min("pos").cast("bigint").alias("first_pos"))


@on_events("search_match", f"WITH {MATCH_SQL} SELECT id FROM mt")
def _(ev):
    return _matched(ev)[1]


@on_events("search_phrase", f"SELECT id FROM ev WHERE regexp_matches(lower({j('content')}), 'answer is [0-9]+ and the long') AND {j('content')} LIKE '%55%'")
def _(ev):
    # Stop words keep their places but are not indexed, so phrases are of indexed words only.
    return S.search_match(S.build_search_index(ev), all_of=["55"], phrases=[["long", "tail"], ["goes"], ["well", "past"]])


@on_events("search_rank", f"WITH {MATCH_SQL} SELECT * FROM rk", stored=True)
def _(ev):
    index, ids = _matched(ev)
    return S.search_rank(index, ids, ["tool", "start", "error"])


@on_events("stored_search", f"WITH {MATCH_SQL} SELECT * FROM rk", stored=True)
def _(ev):
    """The same from an index that was stored in two batches."""
    folder = f"{shared_dir(ev.sparkSession)}/index-{uuid.uuid4().hex}"
    for batch in (0, 1):
        part = S.build_search_index(ev.where(F.pmod(F.xxhash64("run_id"), F.lit(2)) == batch))
        S.write_search_index(part, folder, batch, 16)
    asked = ["tool", "start", "error"]
    index = S.read_search_index(ev.sparkSession, folder, part.schema, [*asked, "t1"])
    return S.search_rank(index, S.search_match(index, all_of=["tool"], any_of=["start", "error"], none_of=["t1"]), asked)


@on_events("search_filters", "SELECT id FROM ev WHERE tenant_id='tenant-2' AND type IN ('tool.call.start','run.end') AND \"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" <= TIMESTAMP '2024-01-15'")
def _(ev):
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-{d} 00:00:00"))
    return S.search_filters(ev, tenant="tenant-2", types=["tool.call.start", "run.end"], after=day("05"), before=day("15")).select("id")


@on_events("search_headline", f"""SELECT id, regexp_replace(regexp_replace(type || ' ' || source_agent || ' ' || payload, '(?i)\\b(user|plan)\\b', '<mark>\\1</mark>', 'g'), '\\s+', ' ', 'g') AS headline FROM ev""")
def _(ev):
    return S.search_headline(ev, S.headline_text(), ["user", "plan"]).select("id", "headline")


@on_events("search_page", f"WITH {MATCH_SQL} SELECT id, rank, (SELECT count(*) FROM rk)>25 AS has_more FROM rk ORDER BY rank DESC, id LIMIT 25", stored=True)
def _(ev):
    index, ids = _matched(ev)
    return S.search_page(S.search_rank(index, ids, ["tool", "start", "error"]), 25)


@on_events("search_total", f"WITH {MATCH_SQL} SELECT count(*) AS total FROM mt")
def _(ev):
    return S.search_total(_matched(ev)[1])


@on_events("search_batch", f"""WITH {INDEX_SQL}, q AS (SELECT DISTINCT 'q-' || {j('toolName')} || '-' || type AS query_id, unnest(regexp_extract_all(lower({j('toolName')} || ' ' || type), '[a-z0-9]+')) AS term FROM ev WHERE type LIKE 'tool.call.%'),
  qn AS (SELECT query_id, count(DISTINCT term) AS n FROM q GROUP BY query_id), tf AS (SELECT id, term, weight, count(*) AS tf FROM idx GROUP BY ALL),
  sc AS (SELECT query_id, id, {SCORE_SQL} AS rank, count(DISTINCT term) AS found FROM tf JOIN q USING (term) GROUP BY ALL),
  pl AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS place FROM sc JOIN qn USING (query_id) WHERE found=n)
  SELECT query_id, place, id, rank FROM pl WHERE place<=10""", stored=True)
def _(ev):
    tool = F.get_json_object("payload", "$.toolName")
    queries = ev.where(F.col("type").startswith("tool.call.")).select(
        F.concat(F.lit("q-"), tool, F.lit("-"), "type").alias("query_id"),
        F.explode(S.words(F.concat_ws(" ", tool, "type"))).alias("term")).distinct()
    return S.search_batch(S.build_search_index(ev), queries).withColumn("place", F.col("place").cast("bigint"))


@query("search_documents", f"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
   t AS (SELECT id, count(*) AS tf FROM w WHERE term='license' GROUP BY id) SELECT id, round(0.2::DOUBLE*(1-1.0::DOUBLE/(1+tf)), 9) AS rank FROM t""", raw=True)
def _(spark, sf_dir):
    index = S.build_text_index(events_table(spark, sf_dir, "documents"), "doc_id", "text")
    return S.search_rank(index, S.search_match(index, all_of=["license"]), ["license"])

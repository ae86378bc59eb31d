"""Normalizer queries: raw vendor events made from the driver's `events`, with the expected result."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions.payload import canonical_json
from runledger.messages import TEXTS
from runledger.messages import sql as sql_text
from runledger.operators import normalize as N
from runledger.operators import otlp as O
from runledger.plans.registry import query
from runledger.plans.testbed import BASE_COLUMNS, events_table
from runledger.schemas import OTLP_DDL
from runledger.session import cut_to_table

# Vendor type, data as sent, canonical type, expected payload (keys sorted). `#` stands for a number.
CASES = {
    "openai-agents": [
        ("agent.start", '{"name":"n#","parent_run_id":"p#","config":{"a":#}}', "run.start", '{"configuration":{"a":#},"parentRunId":"p#","runName":"n#","triggerSource":"agent"}'),
        ("agent.start", '{}', "run.start", '{"runName":"bot#","triggerSource":"agent"}'),
        ("agent.end", '{"status":"Errored","duration_ms":#,"summary":"s"}', "run.end", '{"durationMs":#,"status":"failure","summary":"s"}'),
        ("tool_call.start", '{"tool_name":"t#","id":"i#","input":{"q":"#"}}', "tool.call.start", '{"inputParameters":{"q":"#"},"toolId":"i#","toolName":"t#"}'),
        ("tool_call.end", '{"name":5,"result":[#],"error":null}', "tool.call.end", '{"output":[#],"success":true,"toolName":"unknown"}'),
        ("tool_call.end", '{"name":"t","output":"o#","error":"bad"}', "tool.call.end", '{"output":"o#","success":false,"toolName":"t"}'),
        ("tool_call.error", '{"name":"t","error":"e#"}', "tool.call.error", '{"errorMessage":"e#","errorType":"ToolCallError","toolName":"t"}'),
        ("generation.start", '{"model":"m","prompt_tokens":#,"temperature":0.5}', "model.request", '{"inputTokens":#,"modelId":"m","modelProvider":"openai","temperature":0.5}'),
        ("generation.end", '{"output_tokens":#,"latency_ms":7}', "model.response", '{"latencyMs":7,"modelId":"unknown","modelProvider":"openai","outputTokens":#}'),
        ("handoff", '{"to_agent":"a#","from_agent":"b"}', "custom", '{"customType":"handoff","sourceAgent":"b","targetAgent":"a#"}'),
        ("guardrail.end", '{"guardrail_id":"g#","name":"G","result":"Tripwire","message":"m"}', "policy.evaluated", '{"details":"m","policyId":"g#","policyName":"G","result":"fail"}'),
        ("response.output_text", '{"text":"hello #","finish_reason":"stop"}', "prompt.output", '{"content":"hello #","finishReason":"stop"}'),
        ("agent.unknown", '{}', None, None),
        ("", '{}', None, None),
    ],
    "openai-codex": [
        ("codex.session.start", '{"sessionName":"s#","settings":{"x":true}}', "run.start", '{"configuration":{"x":true},"runName":"s#","triggerSource":"agent"}'),
        ("codex.session.end", '{"outcome":"timed_out","duration":#}', "run.end", '{"durationMs":#,"status":"timeout"}'),
        ("codex.session.error", '{"message":"m#","stack":"at"}', "run.error", '{"errorMessage":"m#","errorType":"CodexError","stackTrace":"at"}'),
        ("codex.tool.invoke", '{"toolName":"t","parameters":{"n":#}}', "tool.call.start", '{"inputParameters":{"n":#},"toolName":"t"}'),
        ("codex.tool.result", '{"toolName":"t","output":"#"}', "tool.call.end", '{"output":"#","success":true,"toolName":"t"}'),
        ("codex.tool.error", '{"toolName":"t","errorMessage":"x#"}', "tool.call.error", '{"errorMessage":"x#","errorType":"ToolCallError","toolName":"t"}'),
        ("codex.completion.request", '{"modelId":"m","inputTokens":#}', "model.request", '{"inputTokens":#,"modelId":"m","modelProvider":"openai"}'),
        ("codex.completion.response", '{"model":"m","completionTokens":#,"cost":0.25}', "model.response", '{"cost":0.25,"modelId":"m","modelProvider":"openai","outputTokens":#}'),
        ("codex.message", '{"content":"c#","stopReason":"end"}', "prompt.output", '{"content":"c#","finishReason":"end"}'),
        ("codex.prompt", '{"text":"p#"}', "prompt.input", '{"content":"p#","role":"user"}'),
        ("codex.approval.requested", '{"action":"a#","context":{"k":1}}', "approval.requested", '{"approvalType":"unknown","context":{"k":1},"requestedAction":"a#","requestedBy":"codex"}'),
        ("codex.approval.granted", '{"approvalType":"human"}', "approval.granted", '{"approvalType":"human","decidedBy":"user"}'),
        ("codex.approval.denied", '{"reason":"r#"}', "approval.denied", '{"approvalType":"unknown","decidedBy":"user","reason":"r#"}'),
        ("codex.context.injected", '{"source":"web","tokenCount":#}', "context.injected", '{"source":"web","tokenCount":#}'),
        ("codex.side_effect", '{"effectType":"email","reversible":true}', "side_effect.executed", '{"description":"","effectType":"email","reversible":true,"targetSystem":"unknown"}'),
        ("codex.annotation", '{"key":"k","value":[#]}', "annotation", '{"annotatedBy":"codex","key":"k","value":[#]}'),
        ("codex.other", '{}', None, None),
    ],
    "github-copilot": [
        ("copilot.session.start", '{"name":"s#"}', "run.start", '{"runName":"s#","triggerSource":"agent"}'),
        ("copilot.session.end", '{"status":"aborted"}', "run.end", '{"status":"cancelled"}'),
        ("copilot.session.error", '{"type":"T","errorMessage":"#"}', "run.error", '{"errorMessage":"#","errorType":"T"}'),
        ("copilot.tool.invoke", '{"name":"t","input":"text"}', "tool.call.start", '{"inputParameters":{},"toolName":"t"}'),
        ("copilot.tool.result", '{"toolName":"t","error":"e","durationMs":#}', "tool.call.end", '{"durationMs":#,"success":false,"toolName":"t"}'),
        ("copilot.completion.request", '{"model":"m","promptTokens":#}', "model.request", '{"inputTokens":#,"modelId":"m","modelProvider":"github"}'),
        ("copilot.completion.response", '{"latencyMs":#}', "model.response", '{"latencyMs":#,"modelId":"unknown","modelProvider":"github"}'),
        ("copilot.message", '{"text":"t#","outputTokens":3}', "prompt.output", '{"content":"t#","tokenCount":3}'),
        ("copilot.side_effect", '{}', None, None),
    ],
    "claude-code": [
        ("conversation.start", '{"title":"c#","parent_conversation_id":"p"}', "run.start", '{"parentRunId":"p","runName":"c#","triggerSource":"agent"}'),
        ("conversation.end", '{"outcome":"weird","elapsed_ms":#}', "run.end", '{"durationMs":#,"status":"success"}'),
        ("conversation.error", '{"kind":"K","message":"m#"}', "run.error", '{"errorMessage":"m#","errorType":"K"}'),
        ("tool_use.begin", '{"tool_name":"t","tool_use_id":"u#","parameters":{"a":[1,2]}}', "tool.call.start", '{"inputParameters":{"a":[1,2]},"toolId":"u#","toolName":"t"}'),
        ("tool_use.complete", '{"tool_name":"t","is_error":true,"output":#}', "tool.call.end", '{"output":#,"success":false,"toolName":"t"}'),
        ("tool_use.complete", '{"tool_name":"t","is_error":false}', "tool.call.end", '{"success":true,"toolName":"t"}'),
        ("tool_use.failed", '{"tool_name":"t","kind":"K"}', "tool.call.error", '{"errorMessage":"Unknown error","errorType":"K","toolName":"t"}'),
        ("inference.request", '{"model_id":"m","input_tokens":#}', "model.request", '{"inputTokens":#,"modelId":"m","modelProvider":"anthropic"}'),
        ("inference.response", '{"model":"m","completion_tokens":#,"duration_ms":9}', "model.response", '{"latencyMs":9,"modelId":"m","modelProvider":"anthropic","outputTokens":#}'),
        ("assistant.message", '{"message":"m#","stop_reason":"end"}', "prompt.output", '{"content":"m#","finishReason":"end"}'),
        ("permission.check", '{"check_id":"c#","decision":"flagged"}', "policy.evaluated", '{"policyId":"c#","policyName":"unknown","result":"warn"}'),
        ("permission.other", '{}', None, None),
    ],
}
VENDORS = {v.vendor_id: v for v in N.VENDORS}


def _quoted(text: str) -> str:
    """A text with # as an SQL expression."""
    return "'" + text.replace("'", "''").replace("#", "' || CAST(k AS {str}) || '") + "'"


def _choice(values: list[str], count: int) -> str:
    return f"CASE eid%{count} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def raw_data_sql(vendor_id: str) -> str:
    """The raw JSON of a row: envelope and nested data."""
    names, cases = VENDORS[vendor_id].names, CASES[vendor_id]
    n = len(cases)
    kind = _choice([f"'{c[0]}'" for c in cases], n)
    data = _choice([_quoted(c[1]) for c in cases], n)
    return ("'{\"type\":\"' || " + kind + " || '\",\"" + names["trace"] + "\":\"' || run_id || '\"'"
            " || CASE WHEN k%4<>0 THEN ',\"" + names["span"] + "\":\"s' || CAST(eid AS {str}) || '\"' ELSE '' END"
            " || CASE WHEN k%3=0 THEN ',\"" + names["parent"] + "\":\"p' || CAST(u AS {str}) || '\"' ELSE '' END"
            " || ',\"" + names["agent"] + "\":\"bot' || CAST(k AS {str}) || '\"'"
            " || ',\"timestamp\":\"2024-01-02T03:04:05.678Z\",\"" + names["data"] + "\":' || " + data + " || '}'")


def base_rows(spark, sf_dir):
    base = events_table(spark, sf_dir).selectExpr(
        *[f"{e} AS {n}" for n, e in BASE_COLUMNS.items()], "date_trunc('MILLISECOND', CAST(ts AS TIMESTAMP)) AS received_at")
    return base.withColumn("run_id", F.expr("'run-' || CAST(u AS STRING) || '-' || CAST(w AS STRING)"))


BASE_SQL = "bs AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in BASE_COLUMNS.items()) + """, date_trunc('millisecond', ts) AS received_at,
  'run-' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(FLOOR((EXTRACT(DAY FROM ts)-1)/7.0) AS INT) AS VARCHAR) AS run_id FROM events)"""


def vendor_rows(spark, sf_dir, vendor_id: str):
    return base_rows(spark, sf_dir).select(
        F.lit(vendor_id).alias("vendor"), F.expr(raw_data_sql(vendor_id).replace("{str}", "STRING")).alias("data"), "received_at",
        F.expr("'tenant-' || CAST(u%3 AS STRING)").alias("tenant_id"),
        F.expr("CASE WHEN eid%2=0 THEN 'given-' || CAST(u AS STRING) END").alias("run_id"))


def vendor_sql(vendor_id: str) -> str:
    cases, vendor = CASES[vendor_id], VENDORS[vendor_id]
    n = len(cases)
    ctype = _choice([f"'{c[2]}'" if c[2] else "NULL" for c in cases], n)
    payload = _choice([_quoted(c[3]) if c[3] else "NULL" for c in cases], n).replace("{str}", "VARCHAR")
    reason = _choice(["NULL" if c[2] else (sql_text("type_unknown", title=vendor.title, x_kind=c[0]) if c[0] else sql_text("type_missing", title=vendor.title)) for c in cases], n)
    return f"""SELECT CASE WHEN ctype IS NULL THEN 'error' ELSE 'success' END AS status, reason, ctype AS type, payload,
      CASE WHEN ctype IS NOT NULL AND k%4<>0 THEN 's' || CAST(eid AS VARCHAR) END AS span_id,
      CASE WHEN ctype IS NOT NULL THEN CASE WHEN eid%2=0 THEN 'given-' || CAST(u AS VARCHAR) ELSE run_id END END AS run_id, 'tenant-' || CAST(u%3 AS VARCHAR) AS tenant_id,
      CASE WHEN ctype IS NOT NULL AND k%3=0 THEN 'p' || CAST(u AS VARCHAR) END AS parent_event_id, CASE WHEN ctype IS NOT NULL THEN 'bot' || CAST(k AS VARCHAR) END AS source_agent,
      CASE WHEN ctype IS NOT NULL THEN '{vendor_id}' END AS tags, CASE WHEN ctype IS NOT NULL THEN TIMESTAMP '2024-01-02 03:04:05.678' END AS "timestamp"
      FROM (SELECT *, {ctype} AS ctype, {payload} AS payload, {reason} AS reason FROM bs)"""


def _shown(results):
    return results.select(
        "status", "reason", "type", canonical_json("payload").alias("payload"),
        F.when(F.length("id") < 32, F.col("id")).alias("span_id"), "run_id", "tenant_id", "parent_event_id", "source_agent",
        F.array_join("tags", ",").alias("tags"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


for _id in CASES:
    def _one(spark, sf_dir, vendor_id=_id):
        return _shown(N.normalize_vendor(vendor_rows(spark, sf_dir, vendor_id), VENDORS[vendor_id]))

    query(f"normalize_{_id.replace('-', '_')}", f"WITH {BASE_SQL} {vendor_sql(_id)}", raw=True)(_one)


def _envelope_sql(vendor_id: str) -> str:
    n = len(CASES[vendor_id])
    good = f"NOT {_bad(vendor_id)}"
    return f"""SELECT CASE WHEN {good} THEN 'success' ELSE 'error' END AS status, CASE WHEN {good} THEN '{vendor_id}' END AS normalized_by,
      CASE WHEN {good} THEN strftime(received_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS received,
      CASE WHEN {good} THEN {_choice([repr(c[0]) for c in CASES[vendor_id]], n)} END AS original_type, CASE WHEN {good} THEN run_id END AS trace, CASE WHEN {good} THEN k%4=0 END AS is_new_id FROM bs"""


def _bad(vendor_id: str) -> str:
    n = len(CASES[vendor_id])
    bad = [str(i) for i, c in enumerate(CASES[vendor_id]) if not c[2]]
    return f"eid%{n} IN ({', '.join(bad)})"


@query("normalize_envelope", f"WITH {BASE_SQL} {' UNION ALL '.join(_envelope_sql(v) for v in CASES)}", raw=True)
def _(spark, sf_dir):
    at = lambda n: F.get_json_object("raw_meta", f"$.{n}")
    out = None
    for vendor_id, vendor in ((v, VENDORS[v]) for v in CASES):
        results = N.normalize_vendor(vendor_rows(spark, sf_dir, vendor_id), vendor)
        part = results.select("status", at("normalizedBy").alias("normalized_by"), at("receivedAt").alias("received"), at("originalType").alias("original_type"),
                              at(vendor.names["trace"]).alias("trace"), (F.length("id") == 32).alias("is_new_id"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- spans ---------------------------------------------------------------------------------

SPAN_CASES = ["invoke_agent", "my.agent.run", "chat", "llm.call", "execute_tool", "x.tool.call.y", "misc", "misc"]
SERVICES = ["My-Copilot", "codex-svc", "Claude Agent", "cursor", "plain", "gemini-app"]

NAME_SQL, SERVICE_SQL = _choice([f"'{n}'" for n in SPAN_CASES], 8), _choice([f"'{s}'" for s in SERVICES], 6)


def otlp_rows(spark, sf_dir):
    """One export document per event."""
    model = "CASE WHEN eid%8 IN (2,3,7) THEN '{\"key\":\"gen_ai.request.model\",\"value\":{\"stringValue\":\"m' || CAST(k AS STRING) || '\"}},' ELSE '' END"
    tool = "CASE WHEN eid%8=4 THEN '{\"key\":\"gen_ai.tool.name\",\"value\":{\"stringValue\":\"tool' || CAST(k AS STRING) || '\"}},' ELSE '' END"
    export = f"""'{{"resourceSpans":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":"' || {SERVICE_SQL} || '"}}}}]}},
      "scopeSpans":[{{"scope":{{"name":"lib"}},"spans":[{{"traceId":"tr' || CAST(u AS STRING) || '","spanId":"s' || CAST(eid AS STRING) || '","name":"' || {NAME_SQL} || '","kind":1,'
      || CASE WHEN k%3=0 THEN '"parentSpanId":"sp0",' ELSE '' END || CASE WHEN k%4<>0 THEN '"endTimeUnixNano":"' || CAST(unix_micros(received_at)*1000 + c*1000000 AS STRING) || '",' ELSE '' END
      || '"startTimeUnixNano":"' || CAST(unix_micros(received_at)*1000 + 999 AS STRING) || '","attributes":[' || {model} || {tool}
      || '{{"key":"gen_ai.usage.input_tokens","value":{{"intValue":"' || CAST(k AS STRING) || '"}}}},{{"key":"flag","value":{{"boolValue":false}}}},{{"key":"flag","value":{{"boolValue":true}}}},
      {{"key":"gen_ai.tool.query","value":{{"arrayValue":{{"values":[{{"intValue":' || CAST(k AS STRING) || '}},{{"stringValue":"x"}}]}}}}}}],'
      || '"status":{{"code":' || CASE WHEN k%5=0 THEN '2' ELSE '0' END || CASE WHEN k%10=0 THEN ',"message":"bad"' ELSE '' END || '}},'
      || '"events":[{{"name":"exception","attributes":[{{"key":"exception.stacktrace","value":{{"stringValue":"st"}}}}]}}]}}]}}]}}]}}'"""
    return base_rows(spark, sf_dir).select(F.from_json(F.expr(export), OTLP_DDL).alias("o")).select("o.*")


SPANS_SQL = f"""{BASE_SQL}, sn AS (SELECT *, 'tr' || CAST(u AS VARCHAR) AS trace_id, 's' || CAST(eid AS VARCHAR) AS span_id, {NAME_SQL} AS name, {SERVICE_SQL} AS service,
   CASE eid%6 WHEN 0 THEN 'otel-copilot' WHEN 1 THEN 'otel-codex' WHEN 2 THEN 'otel-claude' WHEN 3 THEN 'otel-cursor' ELSE 'otel-genai' END AS vendor,
   CASE eid%6 WHEN 0 THEN 'openai' WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' WHEN 3 THEN 'openai' WHEN 4 THEN 'unknown' ELSE 'google' END AS provider,
   CASE WHEN eid%8 IN (2,3,7) THEN '"m' || CAST(k AS VARCHAR) || '"' ELSE 'null' END AS model, k%4<>0 AS ended, k%5=0 AS failed,
   (c*1000000-999)//1000000 AS dur FROM bs)"""


@query("flatten_otlp", f"""WITH {SPANS_SQL} SELECT trace_id, span_id, CASE WHEN k%3=0 THEN 'sp0' ELSE '' END AS parent_span_id, name, 1 AS kind, epoch_us(received_at)*1000+999 AS start_nano,
   CASE WHEN ended THEN epoch_us(received_at)*1000 + c*1000000 END AS end_nano, service, 'lib' AS scope_name, '' AS scope_version,
   '{{"flag":true,' || CASE WHEN model='null' THEN '' ELSE '"gen_ai.request.model":' || model || ',' END || CASE WHEN eid%8=4 THEN '"gen_ai.tool.name":"tool' || CAST(k AS VARCHAR) || '",' ELSE '' END
   || '"gen_ai.tool.query":[' || CAST(k AS VARCHAR) || ',"x"],"gen_ai.usage.input_tokens":' || CAST(k AS VARCHAR) || '}}' AS attributes FROM sn""", raw=True)
def _(spark, sf_dir):
    spans = O.flatten_otlp(otlp_rows(spark, sf_dir))
    known = F.map_filter("attributes", lambda k, v: v.isNotNull())
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "name", "kind", F.col("start_nano").cast("bigint").alias("start_nano"),
        F.expr("CAST(nullif(end_nano, '') AS BIGINT)").alias("end_nano"),
        F.try_variant_get(F.col("resource_attributes")["service.name"], "$", "string").alias("service"), "scope_name", "scope_version",
        canonical_json(F.to_json(known)).alias("attributes"))


@query("otlp_counts", "SELECT count(*) AS resource_count, count(*) AS span_count FROM events", raw=True)
def _(spark, sf_dir):
    return O.otlp_counts(otlp_rows(spark, sf_dir))


def raw_spans(spark, sf_dir):
    return O.spans_to_raw(O.flatten_otlp(otlp_rows(spark, sf_dir)), "tenant-x", F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query("spans_to_raw", f"""WITH {SPANS_SQL} SELECT vendor, trace_id AS run_id, 'tenant-x' AS tenant_id, span_id, strftime(received_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start_time,
   CASE WHEN ended THEN strftime(received_at + to_milliseconds(c), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS end_time FROM sn""", raw=True)
def _(spark, sf_dir):
    at = lambda n: F.get_json_object("data", f"$.{n}")
    return raw_spans(spark, sf_dir).select("vendor", "run_id", "tenant_id", at("spanId").alias("span_id"),
                                           at("startTime").alias("start_time"), at("endTime").alias("end_time"))


_D = "CAST(dur AS VARCHAR)"
_K = "CAST(k AS VARCHAR)"
_M = """'"inputTokens":' || {k} || ',{lat}"modelId":"' || CASE WHEN model='null' THEN 'unknown' ELSE trim(model,'"') END || '","modelProvider":"' || provider || '"}}'"""
_TOOLNAME = f"CASE WHEN eid%8=4 THEN 'tool' || {_K} ELSE name END"
_ATTRS = f"""'{{"flag":true,' || CASE WHEN model='null' THEN '' ELSE '"gen_ai.request.model":' || model || ',' END || CASE WHEN eid%8=4 THEN '"gen_ai.tool.name":"tool' || {_K} || '",' ELSE '' END || '"gen_ai.tool.query":[' || {_K} || ',"x"],"gen_ai.usage.input_tokens":' || {_K} || '}}'"""
OTEL_SQL = f"""{SPANS_SQL}, cl AS (SELECT *, CASE WHEN eid%8 IN (0,1) THEN 'agent' WHEN eid%8 IN (2,3,7) THEN 'chat' WHEN eid%8 IN (4,5) THEN 'tool' ELSE 'annotation' END AS cls FROM sn),
 oe AS (SELECT span_id AS id, 'run.start' AS type, '{{"runName":"' || service || '","triggerSource":"agent"}}' AS payload, false AS follow, vendor || ',otel' AS tags, cl.* FROM cl WHERE cls='agent'
  UNION ALL SELECT span_id || ':end', 'run.end', '{{"durationMs":' || {_D} || ',"status":"' || CASE WHEN failed THEN 'failure' ELSE 'success' END || '"}}', true, vendor || ',otel', cl.* FROM cl WHERE cls='agent' AND ended
  UNION ALL SELECT span_id || ':error', 'run.error', '{{"errorMessage":"' || CASE WHEN k%10=0 THEN 'bad' ELSE '{TEXTS['span_failed']}' END || '","errorType":"SpanError","fatal":false,"stackTrace":"st"}}', true, vendor || ',otel,error', cl.* FROM cl WHERE cls='agent' AND ended AND failed
  UNION ALL SELECT span_id, 'model.request', '{{' || {_M.format(k=_K, lat='')}, false, vendor || ',otel', cl.* FROM cl WHERE cls='chat'
  UNION ALL SELECT span_id || ':end', 'model.response', '{{' || {_M.format(k=_K, lat='"latencyMs":' + "' || " + _D + " || '" + ',')}, true, vendor || ',otel', cl.* FROM cl WHERE cls='chat' AND ended
  UNION ALL SELECT span_id, 'tool.call.start', '{{"inputParameters":{{"query":[' || {_K} || ',"x"]}},"toolName":"' || {_TOOLNAME} || '"}}', false, vendor || ',otel', cl.* FROM cl WHERE cls='tool'
  UNION ALL SELECT span_id || ':end', 'tool.call.end', '{{"durationMs":' || {_D} || ',"success":' || CASE WHEN failed THEN 'false' ELSE 'true' END || ',"toolName":"' || {_TOOLNAME} || '"}}', true, vendor || ',otel', cl.* FROM cl WHERE cls='tool' AND ended
  UNION ALL SELECT span_id || ':error', 'tool.call.error', '{{"errorMessage":"' || CASE WHEN k%10=0 THEN 'bad' ELSE '{TEXTS['tool_span_failed']}' END || '","errorType":"ToolCallError","toolName":"' || {_TOOLNAME} || '"}}', true, vendor || ',otel,error', cl.* FROM cl WHERE cls='tool' AND ended AND failed
  UNION ALL SELECT span_id, 'annotation', '{{"annotatedBy":"opentelemetry","key":"otel.span","value":{{"attributes":' || {_ATTRS} || ',"kind":1,"name":"' || name || '"}}}}', false, vendor || ',otel,unmapped', cl.* FROM cl WHERE cls='annotation')"""
OTEL_SQL = OTEL_SQL.replace("}}'", "}'").replace("'{{", "'{").replace("{{", "{").replace("}}", "}") if "{{" in OTEL_SQL else OTEL_SQL


@query("normalize_otel", f"""WITH {OTEL_SQL} SELECT id, type, payload, trace_id AS run_id, CASE WHEN follow THEN span_id WHEN k%3=0 THEN 'sp0' END AS parent_event_id, service AS source_agent, tags,
   CASE WHEN follow THEN received_at + to_milliseconds(c) ELSE received_at END AS "timestamp" FROM oe""", raw=True)
def _(spark, sf_dir):
    return N.normalize_otel(raw_spans(spark, sf_dir)).select(
        "id", "type", canonical_json("payload").alias("payload"), "run_id", "parent_event_id", "source_agent",
        F.array_join("tags", ",").alias("tags"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


# ---- all vendors together --------------------------------------------------------------------

def wire_rows(spark, sf_dir):
    data = """'{"id":"00000000-0000-4000-8000-' || lpad(CAST(eid AS STRING), 12, '0') || '","runId":"00000000-0000-4000-9000-' || lpad(CAST(u AS STRING), 12, '0')
      || '","type":"annotation","timestamp":"2024-01-02T03:04:05.678Z","tenantId":"t","sourceAgent":"a","schemaVersion":"1.0.0","payload":{' || CASE WHEN k%7=0 THEN '' ELSE '"key":"k' || CAST(k AS STRING) || '"' END || '}}'"""
    return base_rows(spark, sf_dir).select(F.lit("sdk").alias("vendor"), F.expr(data).alias("data"), "received_at",
                                           F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("run_id"))


@query("normalize_passthrough", """WITH b AS (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
  SELECT CASE WHEN k%7=0 THEN 'error' ELSE 'success' END AS status, CASE WHEN k%7=0 THEN 'Not a valid event: payload.key: invalid_type' END AS reason,
   CASE WHEN k%7<>0 THEN '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS id, CASE WHEN k%7<>0 THEN '{"key":"k' || CAST(k AS VARCHAR) || '"}' END AS payload,
   CASE WHEN k%7<>0 THEN 'canonical' END AS normalized_by FROM b""", raw=True)
def _(spark, sf_dir):
    return N.normalize_passthrough(wire_rows(spark, sf_dir)).select(
        "status", "reason", "id", "payload", F.get_json_object("raw_meta", "$.normalizedBy").alias("normalized_by"))


def all_raw(spark, sf_dir):
    """Rows of every kind; half of the vendor rows come under a name that has to be probed."""
    rows = wire_rows(spark, sf_dir).unionByName(raw_spans(spark, sf_dir))
    for vendor_id in CASES:
        some = vendor_rows(spark, sf_dir, vendor_id)
        rows = rows.unionByName(some.withColumn("vendor", F.when(F.col("run_id").isNull(), "other").otherwise(F.col("vendor"))))
    return rows


def _missing_type(vendor_id: str) -> str:
    n = len(CASES[vendor_id])
    unknown = [i for i, c in enumerate(CASES[vendor_id]) if not c[0]]
    return f"eid%{n} IN ({', '.join(map(str, unknown))})" if unknown else "false"


_ROUTES = " UNION ALL ".join(
    f"SELECT CASE WHEN eid%2=0 THEN '{v}' ELSE 'other' END AS vendor, CASE WHEN eid%2=1 AND ({_missing_type(v)}) THEN NULL ELSE '{v}' END AS adapter FROM bs" for v in CASES)


@query("route_adapter", f"""WITH {SPANS_SQL}, r AS (SELECT 'sdk' AS vendor, 'canonical' AS adapter FROM bs UNION ALL SELECT vendor, 'otel-genai' FROM sn UNION ALL {_ROUTES})
  SELECT vendor, coalesce(adapter, 'none') AS adapter, count(*) AS n FROM r GROUP BY ALL""", raw=True)
def _(spark, sf_dir):
    routed = N.route_adapter(cut_to_table(all_raw(spark, sf_dir)))
    return routed.groupBy("vendor", F.coalesce("adapter", F.lit("none")).alias("adapter")).agg(F.count("*").alias("n"))


@query("normalization_stats", f"""WITH {BASE_SQL}, r AS (SELECT k%7=0 AS bad FROM bs UNION ALL SELECT false FROM bs {' '.join(f'UNION ALL SELECT {_bad(v)} FROM bs' for v in CASES)})
  SELECT count(*) AS processed, count(*) FILTER (WHERE NOT bad) AS succeeded, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE bad) AS dead_lettered FROM r""", raw=True)
def _(spark, sf_dir):
    return N.normalization_stats(N.normalize(cut_to_table(all_raw(spark, sf_dir))))

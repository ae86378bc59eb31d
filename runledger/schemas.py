"""Schemas (as DDL text) and fixed vocabularies of the event model."""

from __future__ import annotations

SCHEMA_VERSION = "1.0.0"

# The event types, run states and edge vocabulary of the data model.
EVENT_TYPES = [
    "run.start", "run.end", "run.error",
    "prompt.input", "prompt.output",
    "context.retrieved", "context.injected",
    "tool.call.start", "tool.call.end", "tool.call.error",
    "approval.requested", "approval.granted", "approval.denied",
    "side_effect.executed", "side_effect.failed",
    "model.request", "model.response",
    "policy.evaluated", "policy.violated",
    "annotation", "custom",
]
RUN_STATUSES = ["success", "failure", "timeout", "cancelled"]
PROMPT_ROLES = ["system", "user", "assistant", "tool"]
TRIGGER_SOURCES = ["api", "schedule", "user", "agent"]
POLICY_RESULTS = ["pass", "warn", "fail"]
NODE_TYPES = ["run", "event", "side_effect", "external_system"]
EDGE_TYPES = ["causal", "temporal", "produces", "delegation", "data_flow"]
ERROR_TYPES = ["run.error", "tool.call.error", "side_effect.failed"]
TOOL_TYPES = ["tool.call.start", "tool.call.end", "tool.call.error"]
DECISION_TYPES = [
    "approval.requested", "approval.granted", "approval.denied",
    "policy.evaluated", "policy.violated",
]
DATA_FLOW_PAIRS = [
    ("context.retrieved", "context.injected", "Retrieved context injected into prompt"),
    ("context.injected", "prompt.input", "Context injected as prompt input"),
    ("prompt.input", "model.request", "Prompt sent to model"),
    ("model.response", "prompt.output", "Model response received as output"),
    ("prompt.output", "tool.call.start", "Model output triggers tool call"),
    ("model.response", "tool.call.start", "Model response triggers tool call"),
    ("tool.call.end", "prompt.input", "Tool output fed back as prompt"),
]

EVENT_DDL = (
    "id STRING, run_id STRING, tenant_id STRING, type STRING, sequence INT, "
    "parent_event_id STRING, source_agent STRING, source_framework STRING, payload STRING, "
    "raw_meta STRING, tags ARRAY<STRING>, schema_version STRING, timestamp TIMESTAMP, "
    "received_at TIMESTAMP, ingestion_order BIGINT"
)
RUN_DDL = (
    "id STRING, tenant_id STRING, agent_id STRING, run_name STRING, trigger_source STRING, "
    "parent_run_id STRING, status STRING, started_at TIMESTAMP, ended_at TIMESTAMP, "
    "tags ARRAY<STRING>, metadata STRING, schema_version STRING, created_at TIMESTAMP, "
    "updated_at TIMESTAMP"
)
# The event as clients send it: camelCase names, times as ISO text, objects as JSON text.
WIRE_EVENT_DDL = (
    "id STRING, runId STRING, type STRING, timestamp STRING, sequence STRING, "
    "parentEventId STRING, tenantId STRING, sourceAgent STRING, sourceFramework STRING, "
    "payload STRING, rawMeta STRING, tags ARRAY<STRING>, schemaVersion STRING"
)
RAW_EVENT_DDL = (
    "vendor STRING, data STRING, receivedAt STRING, tenantId STRING, runId STRING, _corrupt_record STRING"
)

ANY_VALUE_DDL = (
    "STRUCT<stringValue: STRING, intValue: STRING, doubleValue: DOUBLE, boolValue: BOOLEAN, "
    "bytesValue: STRING, arrayValue: STRING, kvlistValue: STRING>"
)
_ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {ANY_VALUE_DDL}>>"
OTLP_DDL = (
    f"""resourceSpans ARRAY<STRUCT<
      resource: STRUCT<attributes: {_ATTRIBUTES}>,
      scopeSpans: ARRAY<STRUCT<
        scope: STRUCT<name: STRING, version: STRING>,
        spans: ARRAY<STRUCT<
          traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: INT,
          startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {_ATTRIBUTES},
          status: STRUCT<code: INT, message: STRING>,
          events: ARRAY<STRUCT<name: STRING, timeUnixNano: STRING, attributes: {_ATTRIBUTES}>>,
          links: ARRAY<STRUCT<traceId: STRING, spanId: STRING, attributes: {_ATTRIBUTES}>>>>>>>>"""
)

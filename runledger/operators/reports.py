"""Report tables of evidence bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.payload import cut, fields, millis_between
from runledger.operators.describe import DISPLAY_FIELDS, report_detail
from runledger.operators.timeline import timeline_index
from runledger.schemas import DECISION_TYPES, ERROR_TYPES, TOOL_TYPES

DETAIL_SIZE = 80
VALUE_SIZE = 200


def report_overview(bundles: DataFrame, ev: DataFrame) -> DataFrame:
    """Totals of each complete bundle."""
    counts = ev.groupBy("run_id").agg(
        F.count_if(F.col("type") == "tool.call.start").alias("tool_calls"),
        F.count_if(F.col("type").isin(DECISION_TYPES)).alias("decisions"),
        F.count_if(F.col("type").isin(ERROR_TYPES)).alias("errors"))
    zero = F.lit(0).cast("bigint")
    run = F.col("run_metadata")
    start, end = F.to_timestamp(run["startedAt"]), F.to_timestamp(run["endedAt"])
    return bundles.where(F.col("status") == "complete").join(counts, "run_id", "left").select(
        F.col("id").alias("bundle_id"), "run_id", F.coalesce(run["runName"], F.col("run_id")).alias("run_name"),
        run["agentId"].alias("agent_id"), run["status"].alias("run_status"), millis_between(start, end).alias("duration_ms"),
        "event_count", F.coalesce("tool_calls", zero).alias("tool_calls"), F.coalesce("decisions", zero).alias("decisions"),
        F.coalesce("errors", zero).alias("errors"), "total_redacted_fields", "is_partial_run")


def _time_text() -> Column:
    return F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))


def report_timeline(ev: DataFrame) -> DataFrame:
    """Number, type, time and short detail of every event."""
    places = timeline_index(ev).select("run_id", "id", "idx")
    detail = cut(report_detail(fields("payload", **DISPLAY_FIELDS)), DETAIL_SIZE)
    rows = ev.select("run_id", "id", "type", "sequence", _time_text().alias("time"), detail.alias("detail"))
    return rows.join(places, ["run_id", "id"]).select(
        "run_id", "id", F.coalesce("sequence", F.col("idx") + 1).cast("bigint").alias("number"), "type", "time", "detail")


def report_tool_calls(ev: DataFrame) -> DataFrame:
    """Tool events with their state and what went in and came out."""
    p = fields("payload", **dict.fromkeys(
        ["toolName", "args", "arguments", "input", "inputParameters", "result", "output", "error", "errorMessage"], "string"))
    state = F.when(F.col("type") == "tool.call.error", "ERROR").otherwise(F.regexp_replace("type", r"^tool\.call\.", ""))
    return ev.where(F.col("type").isin(TOOL_TYPES)).select(
        "run_id", "id", F.coalesce(p["toolName"], F.lit("—")).alias("tool_name"), state.alias("state"), _time_text().alias("time"),
        cut(F.coalesce(p["args"], p["arguments"], p["input"], p["inputParameters"]), VALUE_SIZE).alias("arguments"),
        cut(F.coalesce(p["result"], p["output"]), VALUE_SIZE).alias("result"),
        cut(F.coalesce(p["error"], p["errorMessage"]), VALUE_SIZE).alias("error"))


def report_decisions(ev: DataFrame) -> DataFrame:
    """Approvals and policy events."""
    p = fields("payload", decision="string", reason="string", policyId="string")
    return ev.where(F.col("type").isin(DECISION_TYPES)).select(
        "run_id", "id", F.replace(F.col("type"), F.lit("."), F.lit(" → ")).alias("label"), _time_text().alias("time"),
        p["decision"].alias("decision"), p["reason"].alias("reason"), p["policyId"].alias("policy_id"))


def report_errors(ev: DataFrame) -> DataFrame:
    p = fields("payload", **dict.fromkeys(["errorType", "error", "errorMessage", "message", "stack", "stackTrace"], "string"))
    return ev.where(F.col("type").isin(ERROR_TYPES)).select(
        "run_id", "id", "type", _time_text().alias("time"), p["errorType"].alias("error_type"),
        F.coalesce(p["error"], p["errorMessage"], p["message"]).alias("message"),
        F.coalesce(p["stack"], p["stackTrace"]).alias("stack"))


def report_redactions(audit_events: DataFrame) -> DataFrame:
    """One row per redacted field, from the per-event audit."""
    return audit_events.select("run_id", "id", F.explode("redacted_fields").alias("f")).select(
        "run_id", "id", "f.field_path", "f.rule_id", "f.action")

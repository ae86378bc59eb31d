"""Short texts and display categories for events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.payload import cut, fields

DISPLAY_FIELDS = dict.fromkeys(
    ["runName", "status", "errorType", "errorMessage", "error", "message", "role", "content", "tokenCount",
     "source", "snippetCount", "toolName", "requestedAction", "decidedBy", "reason", "effectType", "description",
     "modelId", "modelProvider", "latencyMs", "policyName", "policyId", "result", "key", "customType"], "string",
) | {"success": "boolean"}


def _or(value: Column, text: str) -> Column:
    return F.coalesce(value, F.lit(text))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _by_type(texts: dict[str, Column | str], otherwise: Column) -> Column:
    out = None
    for kind, text in texts.items():
        value = F.lit(text) if isinstance(text, str) else text
        hit = F.col("type") == kind
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def event_label(p: Column) -> Column:
    """Label of an event node."""
    undefined = "undefined"
    return _by_type({
        "run.start": _or(p["runName"], "Run started"),
        "run.end": _text("Run ended: ", _or(p["status"], undefined)),
        "run.error": _text("Error: ", _or(p["errorMessage"], undefined)),
        "prompt.input": _text(_or(p["role"], undefined), " prompt (", _or(p["tokenCount"], "?"), " tokens)"),
        "prompt.output": _text("Output (", _or(p["tokenCount"], "?"), " tokens)"),
        "context.retrieved": _text("Retrieved from ", _or(p["source"], undefined)),
        "context.injected": _text("Injected from ", _or(p["source"], undefined)),
        "tool.call.start": _text("Tool: ", _or(p["toolName"], undefined)),
        "tool.call.end": _text("Tool done: ", _or(p["toolName"], undefined), " (",
                               F.when(p["success"], "ok").otherwise("failed"), ")"),
        "tool.call.error": _text("Tool error: ", _or(p["toolName"], undefined)),
        "approval.requested": _text("Approval: ", _or(p["requestedAction"], undefined)),
        "approval.granted": "Approval granted",
        "approval.denied": "Approval denied",
        "side_effect.executed": _text("Side effect: ", _or(p["description"], undefined)),
        "side_effect.failed": _text("Side effect failed: ", _or(p["description"], undefined)),
        "model.request": _text("Model: ", _or(p["modelId"], undefined)),
        "model.response": _text("Model response: ", _or(p["modelId"], undefined)),
        "policy.evaluated": _text("Policy: ", _or(p["policyName"], undefined), " (", _or(p["result"], undefined), ")"),
        "policy.violated": _text("Policy violated: ", _or(p["policyName"], undefined)),
        "annotation": _text("Annotation: ", _or(p["key"], undefined)),
        "custom": _or(p["customType"], "Custom event"),
    }, F.lit(None).cast("string"))


def event_summary(p: Column) -> Column:
    """One line for the replay view."""
    tool = _or(p["toolName"], "unknown tool")
    model = _text(_or(p["modelProvider"], ""), "/", _or(p["modelId"], "unknown"))
    policy = F.coalesce(p["policyName"], p["policyId"], F.lit("policy"))

    def extra(value: Column, *parts) -> Column:
        return F.when(value.isNotNull(), _text(*parts)).otherwise("")

    return _by_type({
        "run.start": F.when(F.length(p["runName"]) > 0, _text("Run: ", p["runName"])).otherwise("Run started"),
        "run.end": _text("Status: ", _or(p["status"], "unknown")),
        "run.error": _text(_or(p["errorType"], "Error"), ": ", _or(p["errorMessage"], "")),
        "prompt.input": cut(_or(p["content"], ""), 80),
        "prompt.output": cut(_or(p["content"], ""), 80),
        "tool.call.start": _text(tool, "(…)"),
        "tool.call.end": _text(tool, " → ", F.when(p["success"], "success").otherwise("failed")),
        "tool.call.error": _text(tool, ": ", _or(p["errorMessage"], "error")),
        "context.retrieved": _text("Source: ", _or(p["source"], "unknown"),
                                   extra(p["snippetCount"], " (", p["snippetCount"], " snippets)")),
        "context.injected": _text("Source: ", _or(p["source"], "unknown")),
        "approval.requested": _text("Action: ", _or(p["requestedAction"], "unknown")),
        "approval.granted": _text("Granted by ", _or(p["decidedBy"], "unknown")),
        "approval.denied": _text("Denied by ", _or(p["decidedBy"], "unknown"), extra(p["reason"], ": ", p["reason"])),
        "side_effect.executed": _text(_or(p["effectType"], "effect"), ": ", _or(p["description"], "")),
        "side_effect.failed": _text(_or(p["effectType"], "effect"), " failed: ", _or(p["description"], "")),
        "model.request": model,
        "model.response": _text(model, extra(p["latencyMs"], " (", p["latencyMs"], "ms)")),
        "policy.evaluated": _text(policy, ": ", _or(p["result"], "")),
        "policy.violated": _text(policy, " violated"),
    }, F.col("type"))


def first_text_field(payload: str = "payload") -> Column:
    """`key: value` of the first top-level string field that is not empty, value cut to 60."""
    members = F.map_entries(F.from_json(payload, "map<string,variant>"))
    texts = F.filter(members, lambda e: (F.schema_of_variant(e["value"]) == "STRING")
                     & (F.length(F.try_variant_get(e["value"], "$", "string")) > 0))
    first = F.try_element_at(texts, F.lit(1))
    return F.concat(first["key"], F.lit(": "), cut(F.try_variant_get(first["value"], "$", "string"), 60))


def report_detail(p: Column) -> Column:
    """Detail text of a report line, before it is cut."""
    dash = "—"
    return _by_type({
        "run.start": F.when(p["runName"].isNotNull(), _text("Name: ", p["runName"])).otherwise("Run started"),
        "run.end": _text("Status: ", _or(p["status"], dash)),
        "run.error": _text("Error: ", F.coalesce(p["error"], p["errorMessage"], p["message"], F.lit(dash))),
        "prompt.input": _text("Role: ", _or(p["role"], dash)),
        "prompt.output": _text("Tokens: ", _or(p["tokenCount"], dash)),
        "tool.call.start": _text("Tool: ", _or(p["toolName"], dash)),
        "tool.call.end": _text("Tool: ", _or(p["toolName"], dash), " — done"),
        "tool.call.error": _text("Tool: ", _or(p["toolName"], dash), " — FAILED"),
        "approval.requested": "Approval requested",
        "approval.granted": "Approved",
        "approval.denied": "Denied",
    }, F.coalesce(first_text_field(), F.col("type")))


def event_category() -> Column:
    """Display category by type prefix, first match wins."""
    kind = F.col("type")
    return (
        F.when(kind.startswith("prompt."), "event-prompt")
        .when(kind.startswith("tool.call."), "event-tool-call")
        .when(kind.endswith(".error"), "event-error")
        .when(kind.startswith("side_effect."), "event-side-effect")
        .when(kind.startswith("approval."), "event-approval")
        .when(kind.startswith("context."), "event-context")
        .when(kind.startswith("model."), "event-model")
        .when(kind.startswith("policy."), "event-policy")
        .when(kind.startswith("run."), "event-run")
        .otherwise("")
    )


def duration_text(ms: str | Column) -> Column:
    """Milliseconds as `12ms`, `3.4s` or `5m 6s`."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return (
        F.when(ms.isNull(), "—")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "),
                            F.floor((ms % 60_000) / 1000 + 0.5).cast("string"), F.lit("s")))
    )


def describe_events(ev: DataFrame) -> DataFrame:
    """Label, summary, report detail and category of every event, in one projection."""
    p = fields("payload", **DISPLAY_FIELDS)
    return ev.select(
        "run_id", "id", "type",
        event_label(p).alias("label"), event_summary(p).alias("summary"),
        cut(report_detail(p), 80).alias("detail"), event_category().alias("category"))

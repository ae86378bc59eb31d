"""Validation of events in their wire form, from a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.schemas import EVENT_TYPES, POLICY_RESULTS, PROMPT_ROLES, RUN_STATUSES, TRIGGER_SOURCES

TEXT, FLAG, OBJECT, COUNT, AMOUNT, NUMBER, TEXTS, NUMBERS = (
    "text", "flag", "object", "count", "amount", "number", "texts", "numbers")
_MODEL = "modelProvider! text, modelId! text, inputTokens count, outputTokens count, latencyMs amount, cost amount, temperature number"
_POLICY = "policyId! text, policyName! text, result! policy_result, details text"
_DECISION = "approvalType! text, decidedBy! text, reason text, durationMs amount"
_EFFECT = "effectType! text, targetSystem! text, description! text, metadata object"
# Payload fields by event type; `!` marks required ones.
PAYLOAD_RULES = {
    "run.start": "runName text, triggerSource trigger_source, parentRunId text, configuration object",
    "run.end": "status! run_status, durationMs amount, summary text",
    "run.error": "errorType! text, errorMessage! text, stackTrace text, fatal! flag",
    "prompt.input": "role! prompt_role, content! text, contentHash text, tokenCount count",
    "prompt.output": "content! text, contentHash text, tokenCount count, finishReason text, modelId text",
    "context.retrieved": "source! text, query text, documentIds texts, snippetCount count, relevanceScores numbers, content text",
    "context.injected": "source! text, tokenCount count, content text",
    "tool.call.start": "toolName! text, toolId text, inputParameters! object",
    "tool.call.end": "toolName! text, toolId text, durationMs amount, success! flag",
    "tool.call.error": "toolName! text, toolId text, errorType! text, errorMessage! text",
    "approval.requested": "approvalType! text, requestedAction! text, requestedBy! text, context object",
    "approval.granted": _DECISION,
    "approval.denied": _DECISION,
    "side_effect.executed": _EFFECT + ", reversible! flag",
    "side_effect.failed": _EFFECT + ", errorType! text, errorMessage! text",
    "model.request": _MODEL,
    "model.response": _MODEL,
    "policy.evaluated": _POLICY,
    "policy.violated": _POLICY,
    "annotation": "key! text, annotatedBy text",
    "custom": "customType text",
}
ENUMS = {"trigger_source": TRIGGER_SOURCES, "run_status": RUN_STATUSES,
         "prompt_role": PROMPT_ROLES, "policy_result": POLICY_RESULTS}
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
_ISSUE = "array<struct<path:string,code:string>>"


def _issue(path: str, code: str) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))


def _field_issue(payload: Column, name: str, kind: str, required: bool) -> Column:
    """Issue of one payload field, or null. `payload` is a VARIANT."""
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    json_type = F.schema_of_variant(value)
    path = f"payload.{name}"
    wrong = _issue(path, "invalid_type")
    missing = F.when(json_type.isNull(), wrong) if required else F.when(json_type.isNull(), F.lit(None))
    number = json_type.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    amount = F.try_variant_get(value, "$", "double")
    if kind in ENUMS:
        text = F.try_variant_get(value, "$", "string")
        return missing.when(json_type != "STRING", wrong).when(~text.isin(ENUMS[kind]), _issue(path, "invalid_enum_value"))
    if kind == TEXT:
        return missing.when(json_type != "STRING", wrong)
    if kind == FLAG:
        return missing.when(json_type != "BOOLEAN", wrong)
    if kind == OBJECT:
        return missing.when(~json_type.startswith("OBJECT"), wrong)
    if kind == NUMBER:
        return missing.when(~number, wrong)
    if kind == AMOUNT:
        return missing.when(~number, wrong).when(amount < 0, _issue(path, "too_small"))
    if kind == COUNT:
        whole = number & (amount == F.floor(amount))
        return missing.when(~whole, wrong).when(amount < 0, _issue(path, "too_small"))
    item = "STRING" if kind == TEXTS else "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)"
    empty = F.to_json(value) == "[]"
    return missing.when(~(json_type.rlike(f"^ARRAY<{item}>$") | empty), wrong)


def _payload_issues(payload: Column) -> Column:
    out = None
    for event_type, text in PAYLOAD_RULES.items():
        checks = []
        for part in text.split(", "):
            name, kind = part.split(" ")
            checks.append(_field_issue(payload, name.rstrip("!"), kind, name.endswith("!")))
        hit = F.col("type") == event_type
        issues = F.array_compact(F.array(*checks))
        out = F.when(hit, issues) if out is None else out.when(hit, issues)
    return out


def base_issues() -> Column:
    """Issues of the fields outside the payload."""
    def bad(path: str, code: str, condition: Column) -> Column:
        return F.when(condition, _issue(path, code))

    def text(name: str) -> Column:
        col = F.col(name)
        return F.when(col.isNull(), _issue(name, "invalid_type")).when(F.length(col) == 0, _issue(name, "too_small"))

    def uuid(name: str, required: bool) -> Column:
        wrong = F.when(~F.col(name).rlike(UUID), _issue(name, "invalid_string"))
        return F.when(F.col(name).isNull(), _issue(name, "invalid_type") if required else F.lit(None)).otherwise(wrong)

    return F.array_compact(F.array(
        uuid("id", True), uuid("runId", True), uuid("parentEventId", False),
        F.when(F.col("timestamp").isNull(), _issue("timestamp", "invalid_type")).when(
            ~F.col("timestamp").rlike(ISO_TIME) | F.try_to_timestamp("timestamp").isNull(), _issue("timestamp", "invalid_string")),
        bad("sequence", "invalid_type", ~F.col("sequence").rlike(r"^-?\d+(\.0+)?$")),
        bad("sequence", "too_small", F.col("sequence").rlike(r"^-0*[1-9]\d*(\.0+)?$")),
        text("tenantId"), text("sourceAgent"),
        bad("rawMeta", "invalid_type", F.col("rawMeta").isNotNull() & ~F.coalesce(
            F.schema_of_variant(F.try_parse_json("rawMeta")).startswith("OBJECT"), F.lit(False))),
        bad("schemaVersion", "invalid_type", F.col("schemaVersion").isNull())))


def validate_events(wire: DataFrame) -> DataFrame:
    """Adds `is_valid` and `issues` (path and code). Unknown payload fields are let through.

    An unknown event type is the only issue of its event.
    """
    parsed = wire.withColumn("_p", F.try_parse_json("payload"))
    is_object = F.coalesce(F.schema_of_variant("_p").startswith("OBJECT"), F.lit(False))
    payload = F.when(is_object, _payload_issues(F.col("_p"))).otherwise(F.array(_issue("payload", "invalid_type")))
    known = F.coalesce(F.col("type").isin(EVENT_TYPES), F.lit(False))
    issues = F.when(known, F.concat(base_issues(), payload)).otherwise(
        F.array(_issue("type", "invalid_union_discriminator")))
    return parsed.withColumn("issues", issues.cast(_ISSUE)).withColumn("is_valid", F.size("issues") == 0).drop("_p")

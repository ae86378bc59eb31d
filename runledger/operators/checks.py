"""Checks over runs: anomalies, compliance, counts and context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.ordered import SLICE, following, max_before, position, scan, sum_to
from runledger.functions.payload import canonical_json, fields, iso_millis, millis_between
from runledger.operators.redact import first_match, load_rules
from runledger.operators.timeline import timeline_order
from runledger.schemas import ERROR_TYPES, SCHEMA_VERSION

FAILURE_RATE = 0.30
TOKEN_LIMIT = 100_000
IDLE_MILLIS = 60_000
REPEAT_LIMIT = 3
CASCADE_LENGTH = 3
SEVERITIES = ["low", "medium", "high", "critical"]
VIOLATION_WEIGHTS = {"low": 5, "medium": 10, "high": 20, "critical": 40}
INJECTION_MARKS = ["ignore (all )?previous instructions", "disregard the above", "system prompt"]


def _narrow(ev: DataFrame, *columns: Column) -> DataFrame:
    """Order columns and the given ones, without the payload."""
    keep = [SLICE] if SLICE in ev.columns else []
    return ev.select("run_id", "tenant_id", "id", "type", "timestamp", "sequence", "ingestion_order", *columns, *keep)


def _finding(kind: str, severity: str, description: Column, first: Column, last: Column, count: Column) -> list[Column]:
    return [F.col("run_id"), F.lit(kind).alias("finding"), F.lit(severity).alias("severity"),
            description.alias("description"), first.alias("first_event_id"), last.alias("last_event_id"),
            count.cast("bigint").alias("event_count")]


def check_failure_rate(ev: DataFrame, limit: float = FAILURE_RATE) -> DataFrame:
    """Runs whose failed tool calls are more than `limit` of the finished ones."""
    p = fields("payload", success="boolean")
    done = F.col("type").isin("tool.call.end", "tool.call.error")
    failed = (F.col("type") == "tool.call.error") | ((F.col("type") == "tool.call.end") & (p["success"] == F.lit(False)))
    place = F.struct(*timeline_order())
    rows = ev.where(done).select("run_id", "id", failed.alias("failed"), place.alias("place"))
    at_failure = F.when(F.col("failed"), F.col("place"))
    per_run = rows.groupBy("run_id").agg(
        F.count("*").alias("finished"), F.count_if("failed").alias("failures"),
        F.min_by("id", at_failure).alias("first_id"), F.max_by("id", at_failure).alias("last_id"))
    text = F.concat("failures", F.lit(" of "), "finished", F.lit(" tool calls failed"))
    return per_run.where(F.col("failures") / F.col("finished") > limit).select(
        *_finding("excessive_failures", "high", text, F.col("first_id"), F.col("last_id"), F.col("failures")))


def run_tokens(ev: DataFrame) -> DataFrame:
    """Input and output tokens per run: of the responses, or of the requests in runs without any."""
    p = fields("payload", inputTokens="bigint", outputTokens="bigint")
    tokens = F.coalesce(p["inputTokens"], F.lit(0)) + F.coalesce(p["outputTokens"], F.lit(0))
    response = F.col("type") == "model.response"
    per_run = ev.where(F.col("type").isin("model.request", "model.response")).groupBy("run_id").agg(
        F.sum(F.when(response, tokens)).alias("responses"), F.sum(F.when(~response, tokens)).alias("requests"),
        F.count("*").alias("calls"), F.min_by("id", F.struct(*timeline_order())).alias("first_id"),
        F.max_by("id", F.struct(*timeline_order())).alias("last_id"))
    return per_run.select("run_id", F.coalesce("responses", "requests").alias("tokens"), "calls", "first_id", "last_id")


def check_token_use(ev: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    text = F.concat("tokens", F.lit(" tokens used"))
    return run_tokens(ev).where(F.col("tokens") > limit).select(
        *_finding("high_token_usage", "medium", text, F.col("first_id"), F.col("last_id"), F.col("calls")))


def check_idle_gap(ev: DataFrame, limit_ms: int = IDLE_MILLIS) -> DataFrame:
    """Neighbours of a run further apart than the limit."""
    nxt = F.struct(F.col("id").alias("id"), F.col("timestamp").alias("timestamp"))
    rows = scan(_narrow(ev), ["run_id"], timeline_order(), nxt=following(nxt))
    ms = millis_between("timestamp", "nxt.timestamp")
    return rows.where(ms > limit_ms).select(
        *_finding("long_gap", "low", F.concat(ms, F.lit(" ms without an event")), F.col("id"), F.col("nxt.id"), F.lit(2)))


def check_repeated_calls(ev: DataFrame, limit: int = REPEAT_LIMIT) -> DataFrame:
    """The same tool with the same input at least `limit` times in a run."""
    p = fields("payload", toolName="string", inputParameters="string")
    calls = ev.where(F.col("type") == "tool.call.start").select(
        "run_id", "id", p["toolName"].alias("tool"), canonical_json(p["inputParameters"]).alias("input"),
        F.struct(*timeline_order()).alias("place"))
    same = calls.groupBy("run_id", "tool", "input").agg(
        F.count("*").alias("n"), F.min_by("id", "place").alias("first_id"), F.max_by("id", "place").alias("last_id"))
    text = F.concat("tool", F.lit(" called "), "n", F.lit(" times with the same input"))
    return same.where(F.col("n") >= limit).select(
        *_finding("repeated_calls", "medium", text, F.col("first_id"), F.col("last_id"), F.col("n")))


def check_error_cascade(ev: DataFrame, length: int = CASCADE_LENGTH) -> DataFrame:
    """At least `length` error events in a row.

    Errors with the same number of other events before them are one island.
    """
    is_error = F.col("type").isin(ERROR_TYPES)
    rows = scan(_narrow(ev), ["run_id"], timeline_order(), idx=position(), others=sum_to((~is_error).cast("bigint")))
    islands = rows.where(is_error).groupBy("run_id", "others").agg(
        F.count("*").alias("n"), F.min_by("id", "idx").alias("first_id"), F.max_by("id", "idx").alias("last_id"))
    return islands.where(F.col("n") >= length).select(
        *_finding("error_cascade", "high", F.concat("n", F.lit(" errors in a row")), F.col("first_id"), F.col("last_id"), F.col("n")))


def anomalies(ev: DataFrame) -> DataFrame:
    """All anomaly findings."""
    return (check_failure_rate(ev).unionByName(check_token_use(ev)).unionByName(check_idle_gap(ev))
            .unionByName(check_repeated_calls(ev)).unionByName(check_error_cascade(ev)))


def _severity_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))


def overall_risk(findings: DataFrame) -> DataFrame:
    """Number of findings and the highest severity per run."""
    return findings.groupBy("run_id").agg(
        F.count("*").alias("finding_count"), F.max_by("severity", _severity_rank()).alias("overall_risk"))


def check_sensitive_data(ev: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Prompts and tool outputs a value rule is found in."""
    rules = load_rules() if rules is None else rules
    p = fields("payload", content="string", output="string")
    rows = ev.where(F.col("type").isin("prompt.input", "tool.call.end")).select(
        "run_id", "id", F.when(F.col("type") == "prompt.input", p["content"]).otherwise(p["output"]).alias("text"))
    hit = rows.withColumn("hit", first_match(rules, "value", F.col("text"))).where(F.col("hit").isNotNull())
    name = F.element_at(F.array(*[F.lit(r["id"]) for r in rules]), F.col("hit") + 1)
    return hit.select(*_finding("sensitive_data", "high", F.concat(F.lit("matches "), name), F.col("id"), F.col("id"), F.lit(1)))


def check_missing_approval(ev: DataFrame) -> DataFrame:
    """Side effects that cannot be undone, with no approval granted earlier in the run."""
    p = fields("payload", reversible="boolean")
    granted = F.col("type") == "approval.granted"
    final = (F.col("type") == "side_effect.executed") & ~F.coalesce(p["reversible"], F.lit(False))
    rows = _narrow(ev, final.alias("final"))
    rows = scan(rows, ["run_id"], timeline_order(), approved=max_before(granted.cast("int")))
    return rows.where(F.col("final") & (F.coalesce("approved", F.lit(0)) == 0)).select(
        *_finding("missing_approval", "critical", F.lit("irreversible side effect without approval"), F.col("id"), F.col("id"), F.lit(1)))


def check_read_then_send(ev: DataFrame, inside: list[str] | None = None) -> DataFrame:
    """Side effects to an outside system after something was read in the run.

    Systems listed in `inside` are not outside.
    """
    p = fields("payload", targetSystem="string")
    sends = F.col("type") == "side_effect.executed"
    if inside:
        sends = sends & ~F.coalesce(p["targetSystem"].isin(inside), F.lit(False))
    reads = F.col("type").isin("context.retrieved", "tool.call.end")
    rows = _narrow(ev, sends.alias("sends"), p["targetSystem"].alias("system"))
    rows = scan(rows, ["run_id"], timeline_order(), has_read=max_before(reads.cast("int")))
    return rows.where(F.col("sends") & (F.col("has_read") == 1)).select(
        *_finding("data_exfiltration", "high", F.concat(F.lit("read data, then reached "), "system"), F.col("id"), F.col("id"), F.lit(1)))


def check_injection_marks(ev: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Tool outputs with one of the given phrases."""
    patterns = INJECTION_MARKS if patterns is None else patterns
    text = F.lower(fields("payload", output="string")["output"])
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.regexp_like(text, F.lit(pattern))
    return ev.where((F.col("type") == "tool.call.end") & hit).select(
        *_finding("prompt_injection", "critical", F.lit("tool output with an instruction phrase"), F.col("id"), F.col("id"), F.lit(1)))


def compliance(ev: DataFrame) -> DataFrame:
    """All compliance findings."""
    return (check_sensitive_data(ev).unionByName(check_missing_approval(ev))
            .unionByName(check_read_then_send(ev)).unionByName(check_injection_marks(ev)))


def compliance_score(ev: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """100 minus a weight per violation, not below 0; runs without violations have 100."""
    findings = compliance(ev) if findings is None else findings
    weights = F.create_map(*[F.lit(x) for pair in VIOLATION_WEIGHTS.items() for x in pair])
    lost = findings.groupBy("run_id").agg(
        F.count("*").alias("violation_count"), F.sum(F.element_at(weights, F.col("severity"))).alias("lost"))
    zero = F.lit(0).cast("bigint")
    return ev.select("run_id").distinct().join(lost, "run_id", "left").select(
        "run_id", F.coalesce("violation_count", zero).alias("violation_count"),
        F.greatest(zero, F.least(F.lit(100).cast("bigint"), 100 - F.coalesce("lost", zero))).alias("score"))


def run_counts(ev: DataFrame) -> DataFrame:
    """Tool calls, model calls and side effects per run; the effects themselves are in `run_effects`."""
    return ev.groupBy("run_id").agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("type") == "tool.call.start").alias("tool_calls"),
        F.count_if(F.col("type") == "model.request").alias("model_calls"),
        F.count_if(F.col("type").startswith("side_effect.")).alias("side_effects"))


def run_effects(ev: DataFrame) -> DataFrame:
    p = fields("payload", effectType="string", targetSystem="string", description="string")
    return ev.where(F.col("type").startswith("side_effect.")).select(
        "run_id", "id", p["effectType"].alias("effect_type"), p["targetSystem"].alias("target_system"),
        p["description"].alias("description"))


def run_context_text(ev: DataFrame, max_events: int = 200, max_payload: int = 500) -> DataFrame:
    """Numbered lines of the first events of each run, with a note of how many more there are."""
    cut = F.when(F.length("payload") > max_payload, F.concat(F.substring("payload", 1, max_payload), F.lit("…"))).otherwise(F.col("payload"))
    rows = _narrow(ev, cut.alias("text"), F.col("source_agent"))
    # Spark keeps the first rows of each run before the shuffle, given the filter on the rank.
    first = rows.withColumn("idx", F.row_number().over(Window.partitionBy("run_id").orderBy(*timeline_order()))).where(
        F.col("idx") <= max_events)
    line = F.concat(F.lit("["), "idx", F.lit("] "), iso_millis("timestamp"), F.lit(" | "), "type", F.lit(" | id="), "id",
                    F.lit(" | agent="), "source_agent", F.lit(" | "), "text")
    lines = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    totals = ev.groupBy("run_id").agg(F.count("*").alias("n"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    more = F.when(F.col("n") > max_events, F.concat(F.lit("\n\n... ("), F.col("n") - max_events, F.lit(" more events truncated)"))).otherwise("")
    return lines.join(totals, "run_id").select("run_id", F.concat(body, more).alias("context"))


def annotations_from_checks(findings: DataFrame, ev: DataFrame, author: str = "run-checks") -> DataFrame:
    """Findings as annotation events of their runs, ready for the event store."""
    runs = ev.groupBy("run_id").agg(F.min("tenant_id").alias("tenant_id"), F.max("timestamp").alias("timestamp"))
    none = F.lit(None).cast("string")
    value = F.struct("severity", "description", F.col("first_event_id").alias("firstEventId"),
                     F.col("last_event_id").alias("lastEventId"), F.col("event_count").alias("eventCount"))
    payload = F.to_json(F.struct(F.col("finding").alias("key"), value.alias("value"), F.lit(author).alias("annotatedBy")))
    return findings.join(runs, "run_id").select(
        F.sha2(F.concat_ws("|", "run_id", "finding", "first_event_id", "last_event_id", "description"), 256).alias("id"),
        "run_id", "tenant_id", F.lit("annotation").alias("type"), F.lit(None).cast("int").alias("sequence"),
        none.alias("parent_event_id"), F.lit(author).alias("source_agent"), none.alias("source_framework"),
        payload.alias("payload"), none.alias("raw_meta"), F.array(F.lit("check"), F.col("finding")).alias("tags"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), "timestamp")

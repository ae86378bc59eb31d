"""Redaction by rules on field paths and values, with an audit of what was hit.

Rules are a list in priority order. Matching and audit are relational; only the walk over
arbitrary JSON and its rebuild are small Arrow functions.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

DEFAULT_MASK = "[REDACTED]"
GONE = object()
TOO_DEEP_RULE = "nested-too-deep"  # names the mask of a payload that cannot be parsed for its depth


def path_rule(rule_id: str, path: str, action: str = "mask", replacement: str | None = None) -> dict:
    return {"id": rule_id, "path": path, "value": None, "action": action, "replacement": replacement}


def value_rule(rule_id: str, value: str, action: str = "mask", replacement: str | None = None) -> dict:
    return {"id": rule_id, "path": None, "value": value, "action": action, "replacement": replacement}


# The built-in rules.
BUILT_IN_RULES = [
    path_rule("builtin-api-key-field", "**.apiKey"),
    path_rule("builtin-api-key-field-2", "**.api_key"),
    path_rule("builtin-secret-field", "**.secret"),
    path_rule("builtin-password-field", "**.password"),
    path_rule("builtin-token-field", "**.token"),
    path_rule("builtin-auth-header", "**.authorization"),
    path_rule("builtin-access-token", "**.accessToken"),
    path_rule("builtin-access-token-2", "**.access_token"),
    value_rule("builtin-email-value", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    value_rule("builtin-bearer-token-value", r"Bearer\s+[A-Za-z0-9\-._~+/]+=*"),
    value_rule("builtin-aws-key-value", r"AKIA[0-9A-Z]{16}"),
    value_rule("builtin-ssn-value", r"\b\d{3}-\d{2}-\d{4}\b"),
]


def load_rules(extra: list[dict] | None = None, enabled: bool = True) -> list[dict]:
    """The built-in rules with extra ones behind them; none if redaction is off."""
    return [*BUILT_IN_RULES, *(extra or [])] if enabled else []


def rules_table(spark, rules: list[dict]) -> DataFrame:
    rows = [(n, r["id"], r["path"], r["value"], r["action"], r["replacement"]) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_order int, id string, path string, value string, action string, replacement string")


def path_regex(glob: str) -> str:
    """Regular expression for a dotted path with a dot behind every segment."""
    segments = {"*": r"[^.]*\.", "**": r"(?:[^.]*\.)*"}
    return "^" + "".join(segments.get(s) or re.escape(s) + r"\." for s in glob.split(".")) + "$"


NODE_TYPE = ("array<struct<path:string,is_key:boolean,kind:string,text:string,above:array<string>>>")
NOT_JSON, TOO_DEEP = object(), object()
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def _members(value, path: str):
    if isinstance(value, dict):
        return iter([(f"{path}.{k}" if path else k, v, True) for k, v in value.items()])
    return iter([(f"{path}[{i}]", v, False) for i, v in enumerate(value)])


def parsed(text: str):
    """The value of a JSON text, `NOT_JSON`, or `TOO_DEEP` for what nests deeper than the parser goes (some thousand levels)."""
    try:
        return json.loads(text)
    except ValueError:
        return NOT_JSON
    except RecursionError:
        return TOO_DEEP


def _nodes_of(text: str | None) -> list[dict]:
    """Nodes in document order, with a stack of open objects and arrays instead of recursion."""
    value = None if text is None else parsed(text)
    if value is NOT_JSON or value is TOO_DEEP:  # one string value
        return [{"path": "", "is_key": False, "kind": "string" if value is NOT_JSON else "too_deep", "text": text, "above": []}]
    found: list[dict] = []
    stack = [(_members(value, ""), [])] if isinstance(value, (dict, list)) else []
    while stack:
        members, above = stack[-1]
        for where, item, is_key in members:
            kind = _KINDS.get(type(item), "number")
            shown = item if kind == "string" else None if kind in ("object", "array", "null") else json.dumps(item)
            found.append({"path": where, "is_key": is_key, "kind": kind, "text": shown, "above": above})
            if kind in ("object", "array"):
                stack.append((_members(item, where), [*above, where] if is_key else above))
                break
        else:
            stack.pop()
    return found


def json_nodes(payload: str | Column) -> Column:
    """All nodes of a JSON text as an array."""

    def nodes(texts: pd.Series) -> pd.Series:
        return texts.map(_nodes_of)

    return F.pandas_udf(nodes, NODE_TYPE)(payload)


def flatten_payload(ev: DataFrame) -> DataFrame:
    """One row per JSON node of each payload, in document order, whatever the depth.

    `above` are the paths of the object members around the node.
    """
    return ev.select("run_id", "id", F.posexplode(json_nodes("payload")).alias("position", "n")).select(
        "run_id", "id", "position", "n.*")


def first_match(rules: list[dict], kind: str, text: Column) -> Column:
    """Place in the rule list of the first rule that matches."""
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules))):
        if rule[kind]:
            pattern = path_regex(rule["path"]) if kind == "path" else rule["value"]
            out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(n)).otherwise(out)
    return out


def _dotted(path: Column) -> Column:
    return F.concat(path, F.lit("."))


def match_path_rules(nodes: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds `path_hit`, the first path rule for an object member that is not inside another hit."""
    covered = F.exists("above", lambda p: first_match(rules, "path", _dotted(p)).isNotNull())
    hit = F.when(F.col("is_key"), first_match(rules, "path", _dotted(F.col("path"))))
    return nodes.withColumns({"covered": covered, "path_hit": F.when(~covered, hit)})


def match_value_rules(nodes: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds `value_hit`, the first value rule found in a string that no path rule took."""
    free = (F.col("kind") == "string") & ~F.col("covered") & F.col("path_hit").isNull()
    return nodes.withColumn("value_hit", F.when(free, first_match(rules, "value", F.col("text"))))


def redaction_hits(ev: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """One row per redacted field in document order: field path, rule and action. It is the log of `redact_events`."""
    rules = load_rules() if rules is None else rules
    if not rules:
        return ev.limit(0).select("run_id", "id", F.lit(0).alias("position"), F.lit("").alias("field_path"), F.lit("").alias("rule_id"), F.lit("").alias("action"))
    # no filter on the payload: pushed below, it would have every payload made twice where it is computed
    log = ev.select("run_id", "id", _redactor(rules)(F.when(may_hit("payload", rules), F.col("payload")))["redacted_fields"].alias("log"))
    return log.select("run_id", "id", F.posexplode("log").alias("position", "f")).select("run_id", "id", "position", "f.*")


def _redactor(rules: list[dict]):
    tail = lambda path: "" if path.split(".")[-1] in ("*", "**") else path.split(".")[-1]
    paths = [(r, tail(r["path"]), re.compile(path_regex(r["path"]))) for r in rules if r["path"]]
    values = [(r, re.compile(r["value"])) for r in rules if r["value"]]

    def apply(rule: dict, value):
        if rule["action"] == "hash":
            text = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
            return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        return DEFAULT_MASK if rule["replacement"] is None else rule["replacement"]

    def found(rule: dict, where: str, log: list) -> dict:
        log.append({"field_path": where, "rule_id": rule["id"], "action": rule["action"]})
        return rule

    def hit(value, where: str, is_key: bool) -> dict | None:
        rule = next((r for r, end, p in paths if where.endswith(end) and p.match(where + ".")), None) if is_key else None
        if rule is None and isinstance(value, str):
            rule = next((r for r, p in values if p.search(value)), None)
        return rule

    def rebuild(value, log: list):
        """A copy without what rules take, made with a stack of open objects and arrays."""
        if not isinstance(value, (dict, list)):
            return value
        whole = type(value)()
        stack = [(_members(value, ""), iter(value), whole)]
        while stack:
            members, keys, out = stack[-1]
            for (where, item, is_key), key in zip(members, keys):  # noqa: B905
                rule = hit(item, where, is_key)
                if rule is not None:
                    found(rule, where, log)
                    item = GONE if rule["action"] == "remove" else apply(rule, item)
                    if item is GONE and is_key:
                        continue
                    item = None if item is GONE else item
                    inner = None
                else:
                    inner = type(item)() if isinstance(item, (dict, list)) else None
                new = item if inner is None else inner
                if is_key:
                    out[key] = new
                else:
                    out.append(new)
                if inner is not None:
                    stack.append((_members(item, where), iter(item), inner))
                    break
            else:
                stack.pop()
        return whole

    def whole_text(text: str, log: list):
        rule = hit(text, "", False)
        if rule is None:
            return text
        found(rule, "", log)
        return None if rule["action"] == "remove" else apply(rule, text)

    @F.pandas_udf("payload string, redacted_fields array<struct<field_path:string,rule_id:string,action:string>>")
    def redact(payload: pd.Series) -> pd.DataFrame:
        rows = []
        for text in payload:
            log: list[dict] = []
            value = None if text is None else parsed(text)
            try:
                if text is None:
                    rows.append((None, log))
                elif value is NOT_JSON:  # value rules apply to the whole text
                    rows.append((whole_text(text, log), log))
                elif value is TOO_DEEP and (paths or values):
                    raise RecursionError
                elif value is TOO_DEEP:
                    rows.append((text, log))
                else:
                    rows.append((json.dumps(rebuild(value, log), separators=(",", ":"), ensure_ascii=False), log))
            except RecursionError:  # nothing is known about what lies inside, so nothing of it goes out
                rows.append((DEFAULT_MASK, [{"field_path": "", "rule_id": TOO_DEEP_RULE, "action": "mask"}]))
        return pd.DataFrame(rows, columns=["payload", "redacted_fields"])

    return redact


def may_hit(payload: str | Column, rules: list[dict]) -> Column:
    """Whether some rule may take something of the payload, told from its text inside the JVM; false is certain.

    A path rule needs a key that ends like its last segment, a value rule a match somewhere in the text. Texts with
    escapes, and patterns whose matches depend on where a value begins or ends, may always hit.
    """
    if not rules:
        return F.lit(False)
    patterns = [r"\\"]
    for rule in rules:
        if rule["path"]:
            tail = rule["path"].split(".")[-1]
            patterns.append("" if tail in ("*", "**") else re.escape(tail) + '"')
        else:
            placed = any(sign in rule["value"] for sign in ("^", "$", "(?", r"\A", r"\z", r"\Z", r"\G", r"\B"))
            patterns.append("" if placed else rule["value"])
    if "" in patterns:
        return F.lit(True)
    # one pattern, so that the payload is asked for once however it is made
    return F.coalesce(F.regexp_like(F.col(payload) if isinstance(payload, str) else payload, F.lit("|".join(f"(?:{p})" for p in patterns))), F.lit(False))


def redact_events(ev: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Events with redacted payloads and the list of redacted fields.

    Payloads that no rule can hit stay in the JVM and come through as they are. One that nests too deep to be parsed, and
    might hold something to redact, is masked as a whole.
    """
    rules = load_rules() if rules is None else rules
    done = ev.withColumn("_hit", may_hit("payload", rules)).withColumn("_r", _redactor(rules)(F.when(F.col("_hit"), F.col("payload"))))
    nothing = F.array().cast("array<struct<field_path:string,rule_id:string,action:string>>")
    return done.withColumns({"payload": F.when(F.col("_hit"), F.col("_r.payload")).otherwise(F.col("payload")),
                             "redacted_fields": F.when(F.col("_hit"), F.col("_r.redacted_fields")).otherwise(nothing)}).drop("_r", "_hit")


def redact_text(df: DataFrame, column: str, rules: list[dict] | None = None) -> DataFrame:
    """Value rules on a plain text column: the new text and the rule that hit."""
    rules = load_rules() if rules is None else rules
    text = F.col(column)
    hit = first_match(rules, "value", text)
    new = text
    for n, rule in enumerate(rules):
        if rule["value"]:
            by = {
                "mask": F.lit(DEFAULT_MASK if rule["replacement"] is None else rule["replacement"]),
                "hash": F.concat(F.lit("sha256:"), F.sha2(text, 256)),
                "remove": F.lit(None).cast("string"),
            }[rule["action"]]
            new = F.when(F.col("_hit") == n, by).otherwise(new)
    rule_id = F.lit(None).cast("string")
    for n, rule in enumerate(rules):
        rule_id = F.when(F.col("_hit") == n, rule["id"]).otherwise(rule_id)
    return df.withColumn("_hit", hit).withColumns({"rule_id": rule_id, column: new}).drop("_hit")


def redaction_audit(ev: DataFrame, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Totals per run, and per event with hits the list of its redacted fields."""
    hits = redaction_hits(ev, rules)
    entry = F.struct("position", "field_path", "rule_id", "action")
    per_event = hits.groupBy("run_id", "id").agg(
        F.count("*").alias("field_count"), F.array_sort(F.collect_list(entry)).alias("redacted_fields"))
    per_run = hits.groupBy("run_id").agg(
        F.count("*").alias("total_redacted_fields"), F.count_distinct("id").alias("events_redacted"))
    return per_run, per_event

"""Path globs against a brute-force matcher; actions, precedence, nesting."""

import hashlib
import json
import random
import re

from rows import collected, event, frame

from runledger.operators import redact as X


def _match(pattern, path):
    if not pattern:
        return not path
    if pattern[0] == "**":
        return any(_match(pattern[1:], path[i:]) for i in range(len(path) + 1))
    return bool(path) and pattern[0] in ("*", path[0]) and _match(pattern[1:], path[1:])


def test_globs():
    rng = random.Random(1)
    for _ in range(5000):
        pattern = [rng.choice(["*", "**", "a", "b", "a[0]"]) for _ in range(rng.randrange(1, 5))]
        path = [rng.choice(["a", "b", "a[0]", "ab"]) for _ in range(rng.randrange(1, 5))]
        assert bool(re.match(X.path_regex(".".join(pattern)), ".".join(path) + ".")) == _match(pattern, path), (pattern, path)


RULES = X.load_rules([X.path_rule("hash-it", "a.code", "hash"), X.path_rule("drop", "**.gone", "remove"),
                      X.value_rule("drop-value", "^bye", "remove"), X.path_rule("mark", "x", "mask", "***")])
PAYLOAD = {"a": {"code": 5, "password": {"deep": "me@example.com"}}, "list": [{"token": "t"}, "bye now", 3, None, ["x@example.org"]],
           "gone": 1, "n": 1.5, "none": None, "x": "y", "aws": "AKIA" + "A" * 16, "ssn": "id 123-45-6789.", "auth": "Bearer abc", "ok": "fine"}


def test_actions(spark):
    ev = frame(spark, [event(1, "custom", 0, **PAYLOAD)])
    row = X.redact_events(ev, RULES).collect()[0]
    new = json.loads(row["payload"])
    mask = X.DEFAULT_MASK
    assert new == {
        "a": {"code": "sha256:" + hashlib.sha256(b"5").hexdigest(), "password": mask},
        "list": [{"token": mask}, None, 3, None, [mask]], "n": 1.5, "none": None, "x": "***",
        "aws": mask, "ssn": mask, "auth": mask, "ok": "fine"}
    fields = [(f["field_path"], f["rule_id"], f["action"]) for f in row["redacted_fields"]]
    assert ("list[4][0]", "builtin-email-value", "mask") in fields and ("list[1]", "drop-value", "remove") in fields
    assert collected(X.redaction_hits(ev, RULES), "field_path", "rule_id", "action") == sorted(fields, key=repr)
    # The relational matchers find the same fields.
    nodes = X.match_value_rules(X.match_path_rules(X.flatten_payload(ev), RULES), RULES).collect()
    matched = [(n["path"], RULES[n["path_hit"] if n["path_hit"] is not None else n["value_hit"]]["id"]) for n in nodes if n["path_hit"] is not None or n["value_hit"] is not None]
    assert sorted(matched) == sorted((p, r) for p, r, _ in fields)


def test_off_switch(spark):
    ev = frame(spark, [event(1, "custom", 0, password="x")])
    assert X.redaction_hits(ev, X.load_rules(enabled=False)).count() == 0
    assert json.loads(X.redact_events(ev, []).collect()[0]["payload"]) == {"password": "x"}


def test_text_rules(spark):
    df = spark.createDataFrame([(1, "mail me@example.com"), (2, "nothing"), (3, None)], "id int, text string")
    assert collected(X.redact_text(df, "text"), "id", "text", "rule_id") == [
        (1, X.DEFAULT_MASK, "builtin-email-value"), (2, "nothing", None), (3, None, None)]


def _nested(depth, inside):
    return '{"a":' * depth + json.dumps(inside) + "}" * depth


def test_deep_payloads(spark):
    """Whatever the depth, what a rule takes is gone; a payload too deep for the parser is masked as a whole."""
    rows = []
    for n, depth in enumerate((1, 500, 3000)):
        rows.append((*event(n, "custom", n)[:8], _nested(depth, {"token": "t", "ok": [1, "me@example.com"]}), *event(n, "custom", n)[9:]))
    far = _nested(50_000, {"token": "t"})
    calm = _nested(50_000, 1)
    rows += [(*event(8, "custom", 8)[:8], far, *event(8, "custom", 8)[9:]), (*event(9, "custom", 9)[:8], calm, *event(9, "custom", 9)[9:])]
    ev = frame(spark, rows)
    out = {r["id"]: r for r in X.redact_events(ev).collect()}
    for n, depth in enumerate((1, 500, 3000)):
        assert out[f"e{n}"]["payload"] == _nested(depth, {"token": X.DEFAULT_MASK, "ok": [1, X.DEFAULT_MASK]}).replace(": ", ":").replace(", ", ",")
        assert [f["rule_id"] for f in out[f"e{n}"]["redacted_fields"]] == ["builtin-token-field", "builtin-email-value"]
    assert (out["e8"]["payload"], out["e8"]["redacted_fields"][0]["rule_id"]) == (X.DEFAULT_MASK, X.TOO_DEEP_RULE)
    assert (out["e9"]["payload"], out["e9"]["redacted_fields"]) == (calm, [])
    hits = X.redaction_hits(ev).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in hits} == {"e0": 2, "e1": 2, "e2": 2, "e8": 1}


def test_prefilter_never_loses_a_hit(spark):
    """Random payloads: what the text filter calls safe has no hit."""
    rng = random.Random(3)
    bits = ["token", "x.token", "to\\u006ben", "api_key", "me@example.com", "plain", "123-45-6789", "Bearer abc", "bye now", 'q"uote', "é"]
    rows = []
    for n in range(300):
        value = {rng.choice(bits): rng.choice([rng.choice(bits), [rng.choice(bits)], {rng.choice(bits): 1}, 5, None]) for _ in range(rng.randrange(3))}
        rows.append((*event(n, "custom", n)[:8], json.dumps(value, ensure_ascii=rng.random() < 0.5), *event(n, "custom", n)[9:]))
    ev = frame(spark, rows)
    for rules in (X.load_rules(), RULES):
        redactor = X._redactor(rules)
        every = {r["id"]: r["f"] for r in ev.select("id", redactor("payload")["redacted_fields"].alias("f")).collect()}
        got = {r["id"]: r["redacted_fields"] for r in X.redact_events(ev, rules).collect()}
        assert got == every
    assert 0 < ev.where(X.may_hit("payload", X.load_rules())).count() < 300

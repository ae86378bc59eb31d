"""Rows that are not what they should be end as dead letters or plain text, not as failed jobs."""

import json

from rows import collected

from runledger.operators import normalize as N
from runledger.operators import otlp as O
from runledger.operators import redact as R
from runledger.sources import tables as T


def test_malformed_lines_are_dead_letters(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"vendor":"odd","data":{"type":"x"}}\nnot json at all\n')
    results = N.normalize(T.read_raw_events(spark, str(tmp_path)))
    assert collected(N.dead_letters(results), "data", "reason") == [
        ("not json at all", 'No format fits data of vendor ""'), ('{"type":"x"}', 'No format fits data of vendor "odd"')]
    assert N.canonical_rows(results).count() == 0


def test_otlp_files_of_any_layout(spark, tmp_path):
    span = {"traceId": "t", "spanId": "s", "name": "n", "attributes": [{"key": "a", "value": {"intValue": "1.5"}}, {"key": "b", "value": {"intValue": "x"}}]}
    (tmp_path / "a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}, indent=2))
    spans = O.flatten_otlp(T.read_otlp(spark, str(tmp_path), whole_files=True)).selectExpr("to_json(attributes) AS a").collect()
    assert [json.loads(r["a"]).get("a") for r in spans] == [1]
    lines = T.read_otlp(spark, str(tmp_path)).cache()
    assert lines.where("_corrupt_record IS NOT NULL").count() > 0
    lines.unpersist()


def test_payloads_that_are_not_json(spark):
    ev = spark.createDataFrame([("1", "r", "not json Bearer abcdef12345"), ("2", "r", '{"password":"x"}'), ("3", "r", "plain")], "id string, run_id string, payload string")
    assert collected(R.redact_events(ev), "id", "payload") == [("1", "[REDACTED]"), ("2", '{"password":"[REDACTED]"}'), ("3", "plain")]
    assert collected(R.redaction_hits(ev), "id", "rule_id") == [("1", "builtin-bearer-token-value"), ("2", "builtin-password-field")]

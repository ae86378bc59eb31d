"""Attribute values of OTLP at any depth."""

import json
import random

from pyspark.sql import functions as F

from runledger.operators import otlp as O
from runledger.schemas import OTLP_DDL


def _wire(value):
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, str):
        return {"stringValue": value}
    if isinstance(value, int):
        return {"intValue": str(value)}
    if isinstance(value, float):
        return {"doubleValue": value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [_wire(x) for x in value]}}
    if isinstance(value, dict):
        return {"kvlistValue": {"values": _pairs(value)}}
    return {}


def _pairs(values):
    return [{"key": k, "value": _wire(x)} for k, x in values.items()]


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["x", '"arrayValue"', "", 7, -3, 2.5, True, None, 2**62])
    inside = [_random(rng, depth - 1) for _ in range(rng.randrange(1, 3))]
    return inside if rng.random() < 0.5 else {f"k{i}": x for i, x in enumerate(inside)}


def _chain(depth):
    value = "end"
    for i in range(depth):
        value = [value] if i % 2 else {"in": value}
    return value


def _decoded(spark, attributes, **more):
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1", "attributes": attributes, **more}
    doc = {"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"spans": [span]}]}]}
    rows = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", OTLP_DDL).alias("o")).select("o.*")
    return O.flatten_otlp(rows)


def test_values_of_any_depth(spark):
    rng = random.Random(5)
    values = {f"d{d}": _chain(d) for d in (1, 2, 3, 4, 5, 6, 40)} | {f"r{i}": _random(rng, i % 9) for i in range(60)}
    values = {k: v for k, v in values.items() if v is not None}
    spans = _decoded(spark, _pairs(values), events=[{"name": "e", "attributes": _pairs(values)}], links=[{"traceId": "l", "attributes": _pairs(values)}])
    row = spans.select(F.to_json("attributes"), F.to_json("resource_attributes"), F.to_json(F.col("events")[0]["attributes"]), F.to_json(F.col("links")[0]["attributes"])).first()
    for text in row:
        assert json.loads(text) == values


def test_python_and_jvm_agree(spark):
    odd = [{"arrayValue": {"values": [{}, {"intValue": " 12x"}, {"intValue": "x"}, {"intValue": 5}, {"intValue": "99999999999999999999"}, {"doubleValue": 3}, {"stringValue": 4}]}},
           {"arrayValue": {}}, {"kvlistValue": {}}, {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "1"}}, {"key": "a", "value": {}}, {"key": "b", "value": {"bytesValue": "AA=="}}]}}]
    row = _decoded(spark, [{"key": f"o{i}", "value": v} for i, v in enumerate(odd)]).select(F.to_json("attributes")).first()
    wires = [("a" + json.dumps(v["arrayValue"])) if "arrayValue" in v else "k" + json.dumps(v["kvlistValue"]) for v in odd]
    assert json.loads(row[0]) == {f"o{i}": json.loads(O.plain_text(w)) for i, w in enumerate(wires)}


def test_broken_and_endless_values():
    assert O.plain_text("a{") == "[]" and O.plain_text("k{") == "{}"
    wire = "a" + '{"values":[{"arrayValue":' * 100_000 + "1"
    assert O.plain_text(wire) in (wire[1:], "[]")


def test_only_deep_texts_go_to_python(spark):
    spans = _decoded(spark, _pairs({"flat": [1, [2]], "deep": _chain(4)}))
    assert "ArrowEvalPython" in spans._jdf.queryExecution().executedPlan().toString()
    pairs = spark.createDataFrame([(json.dumps(_pairs({"flat": [1, [2]], "text": "x"})),), (json.dumps(_pairs({"deep": _chain(4)})),)], "j string")
    plain = pairs.select(O.deep_values(F.from_json("j", O.PAIRS)).alias("p")).collect()
    assert plain[0]["p"] is None and [json.loads(x) for x in plain[1]["p"].values()] == [_chain(4)]

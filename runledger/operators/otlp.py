"""OTLP trace exports: nested export documents to flat spans to raw events."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.payload import iso_millis
from runledger.schemas import ANY_VALUE_DDL

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

NANOS_PER_MILLI = 1_000_000
# Attribute values nested no deeper than this are decoded in the JVM, the rare others in Python.
VALUE_DEPTH = 3
NESTED = r'"(?:array|kvlist)Value"|\\u'  # a level of nesting, or a sign that may spell one
PAIRS = f"array<struct<key:string,value:{ANY_VALUE_DDL}>>"


def _whole_number(text: Column) -> Column:
    """The whole number a text starts with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def _any_value(value: Column, depth: int, plain: Column | None = None) -> Column:
    """The value of an OTLP AnyValue as VARIANT. `plain` has the decoded texts of `_deep_values`."""
    if depth == 0:
        nested = [F.try_parse_json(value["arrayValue"]), F.try_parse_json(value["kvlistValue"])]
    else:
        items = F.from_json(value["arrayValue"], f"values array<{ANY_VALUE_DDL}>")["values"]
        pairs = F.from_json(value["kvlistValue"], f"values {PAIRS}")["values"]
        array = F.transform(F.coalesce(items, F.array().cast(f"array<{ANY_VALUE_DDL}>")), lambda x: _any_value(x, depth - 1))
        nested = [
            F.when(value["arrayValue"].isNotNull(), F.parse_json(F.to_json(array))),
            F.when(value["kvlistValue"].isNotNull(), F.parse_json(F.to_json(_pairs_to_map(pairs, depth - 1)))),
        ]
    if plain is not None:
        nested = [F.coalesce(F.try_parse_json(plain[F.concat(F.lit(kind), value[name])]), shallow)
                  for (kind, name), shallow in zip(_KINDS, nested, strict=True)]
    return F.coalesce(
        value["stringValue"].cast("variant"), _whole_number(value["intValue"]).cast("variant"),
        value["doubleValue"].cast("variant"), value["boolValue"].cast("variant"),
        value["bytesValue"].cast("variant"), *nested)


def _pairs_to_map(pairs: Column, depth: int, plain: Column | None = None) -> Column:
    return F.map_from_entries(F.transform(
        F.coalesce(pairs, F.array().cast(PAIRS)), lambda a: F.struct(a["key"].alias("key"), _any_value(a["value"], depth, plain).alias("value"))))


def decode_attributes(attributes: Column, plain: Column | None = None) -> Column:
    """OTLP key/value list as a map; the last value of a key wins.

    Values nested more than VALUE_DEPTH levels stay as they were sent, unless `plain` is `deep_values` of these attributes.
    """
    return _pairs_to_map(attributes, VALUE_DEPTH, plain)


_KINDS = (("a", "arrayValue"), ("k", "kvlistValue"))


def deep_values(*attributes: Column) -> Column:
    """Map of the nested values in these lists that are, or may be, deeper than VALUE_DEPTH to their plain JSON.

    Null where there are none; Python gets nothing but these texts.
    """
    both = F.flatten(F.array(*[F.coalesce(a, F.array().cast(PAIRS)) for a in attributes]))
    texts = F.flatten(F.transform(both, lambda a: F.array(*[F.concat(F.lit(kind), a["value"][name]) for kind, name in _KINDS])))
    deep = F.array_distinct(F.filter(texts, lambda t: F.regexp_count(t, F.lit(NESTED)) >= VALUE_DEPTH))
    deep = F.when(F.size(deep) > 0, deep)
    return F.map_from_arrays(deep, _plain_texts(deep))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _plain_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: None if xs is None else [plain_text(x) for x in xs])


def plain_text(text: str) -> str:
    """Plain JSON of a nested value in wire form, at any depth; `a` or `k` before it tells an array from a map.

    What is no JSON is empty; what is nested beyond Python's own limit stays as it was sent.
    """
    try:
        return json.dumps(_plain({"arrayValue" if text[0] == "a" else "kvlistValue": json.loads(text[1:])}))
    except ValueError:
        return "[]" if text[0] == "a" else "{}"
    except RecursionError:
        return text[1:]


def _plain(value):
    def text(x):
        return x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))

    def given(name):
        return value.get(name) is not None

    if not isinstance(value, dict):
        return None
    if given("stringValue"):
        return text(value["stringValue"])
    if given("intValue"):
        number = re.match(r"[ \t\n\x0B\f\r]*([+-]?[0-9]+)", text(value["intValue"]))
        if number and -(2**63) <= int(number[1]) < 2**63:
            return int(number[1])
    x = value.get("doubleValue")
    if isinstance(x, int | float) and not isinstance(x, bool):
        return float(x)
    if x in ("NaN", "Infinity", "-Infinity"):
        return x
    if isinstance(value.get("boolValue"), bool):
        return value["boolValue"]
    if given("bytesValue"):
        return text(value["bytesValue"])
    if given("arrayValue"):
        return [_plain(x) for x in _values(value["arrayValue"])]
    if given("kvlistValue"):
        pairs = [x for x in _values(value["kvlistValue"]) if isinstance(x, dict) and x.get("key") is not None]
        return {text(x["key"]): _plain(x.get("value")) for x in pairs}
    return None


def _values(nested) -> list:
    values = nested.get("values") if isinstance(nested, dict) else None
    return values if isinstance(values, list) else []


def nano_to_time(nano: str | Column) -> Column:
    """Nanoseconds as text to a time with milliseconds; null for an empty text."""
    return F.timestamp_millis(whole_millis(F.col(nano) if isinstance(nano, str) else nano))


def whole_millis(nano: Column) -> Column:
    """Nanoseconds as text to whole milliseconds."""
    return F.floor(nano.try_cast("decimal(20,0)") / NANOS_PER_MILLI).cast("bigint")


def flatten_otlp(otlp: DataFrame) -> DataFrame:
    """One row per span, with its resource attributes and scope. Missing arrays are empty."""

    def text(col: str, default: str = "") -> Column:
        return F.coalesce(col, F.lit(default))

    resources = otlp.select(F.explode("resourceSpans").alias("r"))
    scopes = resources.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeSpans").alias("s"))
    spans = scopes.select("resource", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("p"))
    inner = [F.flatten(F.transform(f"p.{c}", lambda e: F.coalesce(e["attributes"], F.array().cast(PAIRS)))) for c in ("events", "links")]
    spans = spans.withColumn("plain", deep_values(F.col("p.attributes"), F.col("resource"), *inner))
    plain = F.col("plain")
    return spans.select(
        F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"),
        text("p.parentSpanId").alias("parent_span_id"), F.col("p.name").alias("name"),
        F.coalesce("p.kind", F.lit(0)).alias("kind"),
        F.col("p.startTimeUnixNano").alias("start_nano"), text("p.endTimeUnixNano").alias("end_nano"),
        decode_attributes(F.col("p.attributes"), plain).alias("attributes"),
        F.col("p.status").alias("status"),
        F.transform(_or_empty("p.events", "array<struct<name:string,timeUnixNano:string,attributes:array<struct<key:string,value:" + ANY_VALUE_DDL + ">>>>"),
                    lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("name"),
                                       F.coalesce(e["timeUnixNano"], F.lit("")).alias("timeUnixNano"),
                                       decode_attributes(e["attributes"], plain).alias("attributes"))).alias("events"),
        F.transform(_or_empty("p.links", "array<struct<traceId:string,spanId:string,attributes:array<struct<key:string,value:" + ANY_VALUE_DDL + ">>>>"),
                    lambda e: F.struct(F.coalesce(e["traceId"], F.lit("")).alias("traceId"),
                                       F.coalesce(e["spanId"], F.lit("")).alias("spanId"),
                                       decode_attributes(e["attributes"], plain).alias("attributes"))).alias("links"),
        decode_attributes(F.col("resource"), plain).alias("resource_attributes"),
        text("scope.name").alias("scope_name"), text("scope.version").alias("scope_version"))


def _or_empty(col: str, ddl: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast(ddl))


def otlp_counts(otlp: DataFrame) -> DataFrame:
    """Number of resources and spans over all exports."""
    spans = F.aggregate(
        F.coalesce(F.flatten(F.transform("resourceSpans", lambda r: F.transform(r["scopeSpans"], lambda s: F.size(s["spans"])))), F.array().cast("array<int>")),
        F.lit(0).cast("bigint"), lambda acc, n: acc + F.greatest(n, F.lit(0)))
    return otlp.select(F.greatest(F.size("resourceSpans"), F.lit(0)).alias("r"), spans.alias("s")).agg(
        F.sum("r").alias("resource_count"), F.sum("s").alias("span_count"))


# Vendor by a word in the service name, in this order.
VENDOR_WORDS = [("copilot", "otel-copilot"), ("codex", "otel-codex"), ("claude", "otel-claude"), ("cursor", "otel-cursor")]


def detect_vendor(service_name: Column) -> Column:
    out = F.lit("otel-genai")
    for word, vendor in reversed(VENDOR_WORDS):
        out = F.when(F.contains(F.lower(service_name), F.lit(word)), vendor).otherwise(out)
    return out


def spans_to_raw(spans: DataFrame, tenant: str | Column, received_at: Column | None = None) -> DataFrame:
    """Spans as raw events: the whole span in `data`, the trace id as run id."""
    received = F.current_timestamp() if received_at is None else received_at
    service = F.col("resource_attributes")["service.name"]
    service_text = F.when(F.schema_of_variant(service) == "STRING", F.try_variant_get(service, "$", "string"))
    data = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"), "name", "kind",
        F.col("start_nano").alias("startTimeUnixNano"), F.col("end_nano").alias("endTimeUnixNano"),
        iso_millis(F.coalesce(nano_to_time("start_nano"), received)).alias("startTime"),
        iso_millis(nano_to_time("end_nano")).alias("endTime"),
        "attributes", F.col("resource_attributes").alias("resourceAttributes"), "status", "events", "links",
        F.col("scope_name").alias("scopeName"), F.col("scope_version").alias("scopeVersion"))
    return spans.select(
        detect_vendor(service_text).alias("vendor"), F.to_json(data).alias("data"), received.alias("received_at"),
        (F.lit(tenant) if isinstance(tenant, str) else tenant).alias("tenant_id"), F.col("trace_id").alias("run_id"))

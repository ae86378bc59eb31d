"""Reading JSON payloads inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One literal of a JSON text: a string (with a colon behind it when it is a key) or a number.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|-?[0-9][0-9.eE+-]*+'


def fields(payload: str | Column, **types: str) -> Column:
    """Parse the named payload fields once; the optimizer prunes those not used."""
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    return F.from_json(payload, ddl)


def canonical_json(text: str | Column) -> Column:
    """JSON text with keys sorted at every level."""
    return F.to_json(F.try_parse_json(text))


def iso_millis(time: str | Column) -> Column:
    """UTC time as ISO text with milliseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_kind(text: Column, path: str) -> Column:
    """JSON type of a value: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, OBJECT<..>, ARRAY<..>, VOID."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def json_values(text: str | Column) -> Column:
    """All string and number values of a JSON text in order of appearance, without the keys."""
    tokens = F.regexp_extract_all(text, F.lit(JSON_TOKEN), 0)
    values = F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":")))
    return F.from_json(
        F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"
    )


def cut(text: Column, size: int) -> Column:
    """Text cut to `size` characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def millis_between(start: str | Column, end: str | Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)

"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.plans.testbed import canonical_events, canonical_sql
from runledger.session import cut_to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register a query. `sql` may use `ev`, the canonical events; `raw` leaves that out."""

    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            body = sql.strip()
            if raw:
                ORACLES[name] = body
            elif body.upper().startswith("WITH RECURSIVE "):
                ORACLES[name] = f"WITH RECURSIVE {canonical_sql()}, {body[len('WITH RECURSIVE '):]}"
            elif body.upper().startswith("WITH "):
                ORACLES[name] = f"WITH {canonical_sql()}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH {canonical_sql()} {body}"
        return build

    return keep


def on_events(name: str, sql: str | None = None, stored: bool = False):
    """Register a query that is a function of the canonical events.

    `stored` writes the events to a table first, for queries that read them many times.
    """

    def keep(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ev = canonical_events(spark, sf_dir)
            return plain_times(build(cut_to_table(ev) if stored else ev))

        query(name, sql)(run)
        return build

    return keep


def plain_times(df: DataFrame) -> DataFrame:
    """Times without zone, as the driver tables have them."""
    zoned = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({n: df[n].cast("timestamp_ntz") for n in zoned}) if zoned else df

"""Literal canonical events for tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from runledger.schemas import EVENT_DDL

DAY = datetime(2024, 5, 1)


def event(n, kind, at, /, run="r1", parent=None, seq=None, arrival=None, agent="a", tenant="t", **payload):
    """One event; `at` is in milliseconds, ids are e<n>."""
    time = DAY + timedelta(milliseconds=at)
    return (f"e{n}", run, tenant, kind, seq, parent, agent, None, json.dumps(payload), None, [], "1.0.0", time,
            time, arrival if arrival is not None else n)


def frame(spark, events):
    return spark.createDataFrame(events, EVENT_DDL)


def collected(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)

"""Compare registered queries with their SQL on the driver tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

BASE = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(zip(*columns), key=repr) if columns else []


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short text."""
    ours = spark_df.toArrow()
    theirs = con.sql(sql).to_arrow_table()
    names, rows = _rows(ours)
    other_names, other_rows = _rows(theirs)
    if names != other_names:
        return f"columns {names} / {other_names}"
    types = {n: (str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names}
    wrong = {n: t for n, t in types.items() if t[0] != t[1] and "null" not in t}
    if len(rows) != len(other_rows):
        return f"rows {len(rows)} / {len(other_rows)}"
    if rows != other_rows:
        ours_only = Counter(map(repr, rows)) - Counter(map(repr, other_rows))
        theirs_only = Counter(map(repr, other_rows)) - Counter(map(repr, rows))
        if ours_only or theirs_only:
            show = [sorted(x)[:2] for x in (ours_only, theirs_only)]
            return f"values {names} {ours_only.total()} {show[0]} / {show[1]}"
    return f"types {wrong}" if wrong else None

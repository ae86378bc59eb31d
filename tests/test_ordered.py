"""Ordered scans: plain windows, slices, and a brute-force walk give the same."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger.functions.ordered import first_at_or_after, following, lists, max_before, position, preceding, scan, sum_to, with_slices

DDL = "g string, t timestamp, n long, v long"


def _rows(seed, size):
    rng = random.Random(seed)
    # One group holds most rows; times repeat.
    return [("hot" if rng.random() < 0.7 else f"g{rng.randrange(4)}", rng.randrange(60), i, rng.choice([None, 1, 2, 3])) for i in range(size)]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "g string, s long, n long, v long")
    return df.select("g", F.timestamp_seconds("s").alias("t"), "n", "v")


def _brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        total, best = 0, None
        for i, (_, _, n, v) in enumerate(mine):
            total += v or 0
            nxt = mine[i + 1][3] if i + 1 < len(mine) else None
            prev = mine[i - 1][2] if i else None
            out[n] = (i, nxt, prev, best, total)
            best = v if best is None else best if v is None else max(best, v)
    return out


def _scan(df):
    done = scan(df, ["g"], [F.col("t"), F.col("n")], idx=position(), nxt=following(F.col("v")), prev=preceding(F.col("n")),
                top=max_before(F.col("v")), total=sum_to(F.coalesce("v", F.lit(0))))
    return {r["n"]: (r["idx"], r["nxt"], r["prev"], r["top"], r["total"]) for r in done.collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_scan(spark, seed):
    rows = _rows(seed, 120)
    df = _frame(spark, rows)
    sliced = with_slices(df, ["g"], "t", max_rows=10)
    assert "slice" in sliced.columns
    assert sliced.where("g = 'hot'").select("slice").distinct().count() > 5
    assert _scan(df) == _brute(rows) == _scan(sliced)


def test_first_at_or_after(spark):
    rows = _rows(3, 200)
    df = _frame(spark, rows)
    want = {n: min(((r[1], r[2]) for r in rows if r[0] == g and r[3] == 2 and r[1] >= s), default=None) for g, s, n, _ in rows}
    for frame in (df, with_slices(df, ["g"], "t", max_rows=10)):
        value = F.when(F.col("v") == 2, F.struct(F.unix_seconds("t").alias("s"), "n"))
        got = {r["n"]: tuple(r["hit"]) if r["hit"] else None for r in first_at_or_after(frame, ["g"], "t", value, "hit").collect()}
        assert got == want


def test_lists_in_parts(spark):
    rows = _rows(5, 100)
    df = _frame(spark, rows)
    parts = lists(with_slices(df, ["g"], "t", max_rows=10), ["g"], [F.col("t"), F.col("n")], "n", "ns", part_size=7).collect()
    assert max(len(p["ns"]) for p in parts) <= 7
    for g in {r[0] for r in rows}:
        joined = [n for p in sorted((p for p in parts if p["g"] == g), key=lambda p: p["part"]) for n in p["ns"]]
        assert joined == [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]


def test_slices_withstand_an_odd_time(spark):
    """One row of 1970, and a burst, among rows of one key: no slice holds much more than its share."""
    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, F.timestamp_seconds(F.lit(0))).when(
        F.col("id") < 15_000, F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id"))).otherwise(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("t"))
    sliced = with_slices(rows, ["k"], "t", 2000).groupBy("slice").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("slice").collect()
    assert sum(r["n"] for r in sliced) == 20_000 and max(r["n"] for r in sliced) <= 2000
    assert all(a["hi"] < b["lo"] for a, b in zip(sliced, sliced[1:]))

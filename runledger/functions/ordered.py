"""Ordered scans inside groups that may be very large.

A plain window puts a whole group into one task. Here a group that holds more rows than a
task should sort gets a `slice` number, a function of its time, so that slices follow each
other in order. A scan then runs one window per (group, slice) and corrects it by a value
carried over from the earlier (or later) slices. The carried values come from a partial
aggregate with one row per slice, so no task ever holds a large group. Groups below the bound keep
the plain window and pay nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.session import cut_lineage

SLICE = "slice"
# Rows of one group that one task sorts without help; quantiles to cut a larger one at, and how
# much finer than needed it is cut, since quantiles are approximate.
MAX_GROUP_ROWS = 2_000_000
QUANTILES = 1024
FINER = 4
# Broadcast bound for the table of large groups (about 60 bytes a row).
MAX_BROADCAST_ROWS = 500_000


def with_slices(
    df: DataFrame, keys: list[str], time: str, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add `slice` if some group has more than `max_rows` rows, else return `df` as it is.

    One narrow aggregate decides. Slices are cut at quantiles of the group's own times, so one odd time
    or a burst does not fill a slice; rows of equal time stay together.
    """
    micros = F.unix_micros(time)
    large = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max_rows)
    if large.isEmpty():
        return df
    large = cut_lineage(large)
    if large.count() <= MAX_BROADCAST_ROWS:  # at most rows/max_rows groups are large
        large = F.broadcast(large)
    cuts = (df.select(*keys, micros.alias("at")).join(large, keys).groupBy(*keys)
            .agg(F.percentile_approx("at", [i / QUANTILES for i in range(1, QUANTILES)], 20 * QUANTILES).alias("cuts"), F.first("n").alias("n")))
    step = F.greatest(F.lit(1), F.floor(QUANTILES / (F.ceil(F.col("n") / max_rows) * FINER)))
    cuts = cut_lineage(cuts.withColumn("step", step).select(*keys, F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % F.col("step") == 0)).alias("cuts")))
    if cuts.count() <= MAX_BROADCAST_ROWS // QUANTILES:
        cuts = F.broadcast(cuts)
    slice_no = F.coalesce(F.size(F.filter("cuts", lambda c: c < micros)), F.lit(0)).cast("bigint")
    return df.join(cuts, keys, "left").withColumn(SLICE, F.when(F.col("cuts").isNull(), F.lit(0).cast("bigint")).otherwise(slice_no)).drop("cuts")


@dataclass
class Step:
    """One value an ordered scan adds to each row."""

    kind: str
    expr: Column | None = None


def position() -> Step:
    """0-based position in the group."""
    return Step("position")


def following(expr: Column) -> Step:
    """`expr` of the next row."""
    return Step("following", expr)


def preceding(expr: Column) -> Step:
    """`expr` of the row before."""
    return Step("preceding", expr)


def max_before(expr: Column) -> Step:
    """Largest `expr` over all earlier rows."""
    return Step("max_before", expr)


def sum_to(expr: Column) -> Step:
    """Sum of `expr` over earlier rows and this one."""
    return Step("sum_to", expr)


def _local(step: Step, window) -> Column:
    if step.kind == "position":
        return (F.row_number().over(window) - 1).cast("bigint")
    if step.kind == "following":
        return F.lead(F.struct(step.expr.alias("v"))).over(window)
    if step.kind == "preceding":
        return F.lag(F.struct(step.expr.alias("v"))).over(window)
    if step.kind == "max_before":
        return F.max(step.expr).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.sum(step.expr).over(window.rowsBetween(Window.unboundedPreceding, 0))


def _per_slice(step: Step, order: Column) -> Column:
    if step.kind == "position":
        return F.count("*")
    if step.kind == "following":
        return F.min_by(F.struct(step.expr.alias("v")), order)
    if step.kind == "preceding":
        return F.max_by(F.struct(step.expr.alias("v")), order)
    if step.kind == "max_before":
        return F.max(step.expr)
    return F.sum(step.expr)


def _carry(step: Step, name: str, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if step.kind in ("position", "sum_to"):
        return F.sum(name).over(before)
    if step.kind == "following":
        return F.lead(name).over(window)
    if step.kind == "preceding":
        return F.lag(name).over(window)
    return F.max(name).over(before)


def _merge(step: Step, local: Column, carry: Column | None) -> Column:
    if step.kind in ("following", "preceding"):
        whole = local if carry is None else F.coalesce(local, carry)
        return whole["v"]
    if carry is None:
        return local
    if step.kind == "max_before":
        return F.greatest(local, carry)
    return local + F.coalesce(carry, F.lit(0))


def scan(df: DataFrame, keys: list[str], order: list[Column], **steps: Step) -> DataFrame:
    """Add the given steps to every row, in the given order inside each group.

    With a `slice` column the order must start with the time the slices were cut by, or
    with something that rises with it.
    """
    if SLICE not in df.columns:
        window = Window.partitionBy(*keys).orderBy(*order)
        out = df.select("*", *[_local(s, window).alias(n) for n, s in steps.items()])
        return out.withColumns({n: _merge(s, F.col(n), None) for n, s in steps.items()})

    groups = [*keys, SLICE]
    window = Window.partitionBy(*groups).orderBy(*order)
    rows = df.select("*", *[_local(s, window).alias(n) for n, s in steps.items()])
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carried = (
        df.groupBy(*groups)
        .agg(*[_per_slice(s, F.struct(*order)).alias(f"_c_{n}") for n, s in steps.items()])
        .select(*groups, *[_carry(s, f"_c_{n}", across).alias(f"_c_{n}") for n, s in steps.items()])
    )
    joined = rows.join(carried, groups, "left")
    merged = {n: _merge(s, F.col(n), F.col(f"_c_{n}")) for n, s in steps.items()}
    return joined.withColumns(merged).select(*df.columns, *steps)


def first_at_or_after(df: DataFrame, keys: list[str], time: str, value: Column, name: str) -> DataFrame:
    """Smallest `value` over the rows of the group whose time is not before this row's.

    The window runs backwards over a growing frame; a frame that ends at UNBOUNDED
    FOLLOWING would be computed again for every row.
    """
    sliced = SLICE in df.columns
    groups = [*keys, SLICE] if sliced else keys
    backwards = (
        Window.partitionBy(*groups)
        .orderBy(F.col(time).desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = df.withColumn(name, F.min(value).over(backwards))
    if not sliced:
        return rows
    across = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc())
    carried = (
        df.groupBy(*groups)
        .agg(F.min(value).alias("_c"))
        .withColumn("_c", F.min("_c").over(across.rowsBetween(Window.unboundedPreceding, -1)))
    )
    return rows.join(carried, groups, "left").withColumn(name, F.least(name, "_c")).drop("_c")


def lists(
    df: DataFrame, keys: list[str], order: list[Column], value: str, name: str, part_size: int = 10_000
) -> DataFrame:
    """Ordered lists of `value` per group, in parts of at most `part_size` items.

    A group that fits is one row with part 0; a larger one is several rows, so that no
    single row has to hold a large group.
    """
    placed = scan(df, keys, order, _pos=position())
    part = F.expr(f"_pos div {part_size}")
    return (
        placed.groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("v")))).alias("_l"))
        .select(*keys, "part", F.transform("_l", lambda x: x["v"]).alias(name))
    )

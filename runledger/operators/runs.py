"""Runs as aggregates of their events, and queries over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.payload import fields, millis_between
from runledger.operators.timeline import timeline_order
from runledger.session import cut_lineage

MAX_PAGE = 100
MAX_ANCESTORS = 20
MAX_BROADCAST_IDS = 100_000


def _lifecycle(ev: DataFrame) -> DataFrame:
    p = fields("payload", runName="string", triggerSource="string", parentRunId="string",
               configuration="string", status="string", fatal="boolean")
    start, end, error = (F.col("type") == t for t in ("run.start", "run.end", "run.error"))
    return ev.select(
        "run_id", "tenant_id", "source_agent", "schema_version", "timestamp", "received_at",
        F.col("ingestion_order").alias("arrival"), start.alias("is_start"),
        F.when(start, p["runName"]).alias("run_name"),
        F.when(start, p["triggerSource"]).alias("trigger_source"),
        F.when(start, p["parentRunId"]).alias("parent_run_id"),
        F.when(start, p["configuration"]).alias("metadata"),
        F.when(end, p["status"]).when(error & p["fatal"], F.lit("failure")).alias("new_status"),
        (error & F.coalesce(p["fatal"], F.lit(False))).alias("is_fatal"),
    )


def run_columns(policy: str = "merge") -> list[Column]:
    """Aggregates that fold the events of a run in arrival order; for batch and streaming alike.

    `merge`: every run.start fills fields, the last value that is not null wins, and a fatal
    error clears the end time. `first`: a run.start counts only as the first arrival, and a
    fatal error keeps the end time.
    """
    if policy not in ("merge", "first"):
        raise ValueError(f"unknown policy: {policy}")

    def at_first(name: str) -> Column:
        return F.min_by(F.struct(name), "arrival")[name]

    def from_start(name: str) -> Column:
        if policy == "first":
            return at_first(name)
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("arrival")))

    ends = F.col("new_status").isNotNull()
    if policy == "merge":
        ended_at = F.max_by(
            F.struct(F.when(~F.col("is_fatal"), F.col("timestamp")).alias("t")),
            F.when(ends, F.col("arrival")))["t"]
    else:
        ended_at = F.max_by("timestamp", F.when(ends & ~F.col("is_fatal"), F.col("arrival")))
    changed = ends | F.col("is_start") if policy == "merge" else ends
    return [
        at_first("tenant_id").alias("tenant_id"),
        at_first("source_agent").alias("agent_id"),
        from_start("run_name").alias("run_name"),
        from_start("trigger_source").alias("trigger_source"),
        from_start("parent_run_id").alias("parent_run_id"),
        F.coalesce(F.max_by("new_status", F.when(ends, F.col("arrival"))), F.lit("running")).alias("status"),
        at_first("timestamp").alias("started_at"),
        ended_at.alias("ended_at"),
        from_start("metadata").alias("metadata"),
        at_first("schema_version").alias("schema_version"),
        at_first("received_at").alias("created_at"),
        F.coalesce(F.max_by("received_at", F.when(changed, F.col("arrival"))), at_first("received_at")).alias("updated_at"),
    ]


def build_runs(ev: DataFrame, policy: str = "merge") -> DataFrame:
    """One row per run, folded from its events. All parts combine on the map side."""
    runs = _lifecycle(ev).groupBy(F.col("run_id").alias("id")).agg(*run_columns(policy))
    return runs.withColumn("tags", F.array().cast("array<string>"))


def page_size(limit: int | None, default: int = 20) -> int:
    return min(max(default if limit is None else limit, 1), MAX_PAGE)


def page(df: DataFrame, keys: list[tuple[str, bool]], size: int, cursor: list | None = None) -> DataFrame:
    """Keyset paging: the `size` rows behind `cursor`, ordered by keys of (column, descending).

    `has_more` tells if a further page exists.
    """
    if cursor is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (name, descending), value in zip(keys, cursor):
            col = F.col(name)
            behind = behind | (equal & ((col < F.lit(value)) if descending else (col > F.lit(value))))
            equal = equal & (col == F.lit(value))
        df = df.where(behind)
    order = [F.col(n).desc() if d else F.col(n).asc() for n, d in keys]
    # size + 1 rows at most: the global window below runs over one page.
    top = df.orderBy(*order).limit(size + 1)
    everything = Window.orderBy(*order)
    return (
        top.withColumn("_n", F.row_number().over(everything))
        .withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(1))) > size)
        .where(F.col("_n") <= size).drop("_n")
    )


def page_offset(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """Offset paging; `page_count` is on every row. The order must be total."""
    pages = -(-df.count() // size)
    return df.orderBy(*order).offset(page_no * size).limit(size).withColumn("page_count", F.lit(pages).cast("bigint"))


def list_runs(runs: DataFrame, ev: DataFrame, tenant: str | None = None, status: str | None = None,
              agent: str | None = None, after=None, before=None, cursor: tuple | None = None,
              limit: int | None = None) -> DataFrame:
    """One page of runs, newest first, with their event counts.

    Events are counted for the runs of the page only.
    """
    for name, value in (("tenant_id", tenant), ("status", status), ("agent_id", agent)):
        if value:
            runs = runs.where(F.col(name) == value)
    if after is not None:
        runs = runs.where(F.col("started_at") >= F.lit(after))
    if before is not None:
        runs = runs.where(F.col("started_at") <= F.lit(before))
    size = page_size(limit)
    rows = page(runs, [("started_at", True), ("id", False)], size, list(cursor) if cursor else None)
    on_page = rows.select(F.col("id").alias("run_id"))
    counts = ev.select("run_id").join(F.broadcast(on_page), "run_id").groupBy("run_id").agg(F.count("*").alias("event_count"))
    return rows.join(F.broadcast(counts), rows["id"] == counts["run_id"], "left").drop("run_id").withColumn(
        "event_count", F.coalesce("event_count", F.lit(0).cast("bigint")))


def child_runs(runs: DataFrame) -> DataFrame:
    """Runs that name a known run as their parent."""
    parents = runs.select(F.col("id").alias("parent_run_id"))
    return runs.where(F.col("parent_run_id").isNotNull()).join(parents, "parent_run_id", "left_semi")


def delegation_points(runs: DataFrame) -> DataFrame:
    return child_runs(runs).select(
        "parent_run_id", F.col("id").alias("child_run_id"), F.col("agent_id").alias("child_agent_id"),
        F.col("run_name").alias("child_run_name"), F.col("status").alias("child_status"),
        F.col("started_at").alias("child_started_at"), F.col("ended_at").alias("child_ended_at"))


def run_details(runs: DataFrame, ev: DataFrame) -> DataFrame:
    """Per run: event count, duration, parent, number of children. The children are in `child_runs`."""
    counts = ev.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("event_count"))
    children = (
        runs.where(F.col("parent_run_id").isNotNull())
        .groupBy(F.col("parent_run_id").alias("id"))
        .agg(F.count("*").alias("child_count"), F.min_by("id", F.struct("started_at", "id")).alias("first_child_id"))
    )
    known = runs.select(F.col("id").alias("parent_run_id"), F.col("status").alias("parent_status"))
    zero = F.lit(0).cast("bigint")
    return (
        runs.join(counts, "id", "left").join(children, "id", "left").join(known, "parent_run_id", "left")
        .select("id", "tenant_id", "agent_id", "status", "started_at", "ended_at",
                F.coalesce("event_count", zero).alias("event_count"),
                millis_between("started_at", "ended_at").alias("duration_ms"),
                F.coalesce("child_count", zero).alias("child_count"), "first_child_id",
                F.when(F.col("parent_status").isNotNull(), F.col("parent_run_id")).alias("parent_run_id"),
                "parent_status")
    )


def ancestry(runs: DataFrame, starts: DataFrame | None = None, limit: int = MAX_ANCESTORS) -> DataFrame:
    """Parent, grandparent and so on of each run (or of `starts` with column id), nearest first."""
    links = cut_lineage(runs.where(F.col("parent_run_id").isNotNull()).select("id", F.col("parent_run_id").alias("parent")))
    known = runs.select(F.col("id").alias("ancestor_id"))
    begin = links if starts is None else links.join(starts.select("id"), "id", "left_semi")
    frontier = begin.select(F.col("id").alias("run_id"), F.col("parent").alias("ancestor_id"))
    found = None
    for level in range(1, limit + 1):
        frontier = cut_lineage(frontier.join(known, "ancestor_id", "left_semi"))
        if frontier.isEmpty():
            break
        here = frontier.select("run_id", "ancestor_id", F.lit(level).cast("bigint").alias("level"))
        found = here if found is None else found.unionByName(here)
        frontier = frontier.join(links, frontier["ancestor_id"] == links["id"]).select(
            "run_id", F.col("parent").alias("ancestor_id"))
    if found is None:
        found = frontier.select("run_id", "ancestor_id", F.lit(0).cast("bigint").alias("level")).limit(0)
    return found


def events_by_run(ev: DataFrame, run_id: str | None = None) -> DataFrame:
    """Events in timeline order; of one run if given."""
    rows = ev if run_id is None else ev.where(F.col("run_id") == run_id)
    return rows.orderBy("run_id", *timeline_order())


def lookup(df: DataFrame, ids: DataFrame | list[str], key: str = "id") -> DataFrame:
    """Rows of `df` with the given ids. A list is broadcast up to a fixed size."""
    if isinstance(ids, list):
        spark = df.sparkSession
        wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{key} string")
        if len(ids) <= MAX_BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return df.join(wanted, key, "left_semi")
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")

"""Taking events in: rows, arrival numbers, duplicates, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.ordered import MAX_GROUP_ROWS, SLICE, position, scan, with_slices
from runledger.operators.validate import validate_events

MAX_BATCH = 100


def events_to_rows(wire: DataFrame) -> DataFrame:
    """Wire events as store rows: snake_case names, times as instants, empty tags as `[]`."""
    received = F.col("received_at") if "received_at" in wire.columns else F.current_timestamp()
    return wire.select(
        "id", F.col("runId").alias("run_id"), F.col("tenantId").alias("tenant_id"), "type",
        F.expr("try_cast(try_cast(sequence AS DOUBLE) AS INT)").alias("sequence"),
        F.col("parentEventId").alias("parent_event_id"), F.col("sourceAgent").alias("source_agent"),
        F.col("sourceFramework").alias("source_framework"), "payload", F.col("rawMeta").alias("raw_meta"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("schemaVersion").alias("schema_version"),
        F.try_to_timestamp("timestamp").alias("timestamp"), received.alias("received_at"))


def rows_to_events(rows: DataFrame) -> DataFrame:
    """Store rows in their wire form again."""
    return rows.select(
        "id", F.col("run_id").alias("runId"), "type",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("sequence").cast("string").alias("sequence"), F.col("parent_event_id").alias("parentEventId"),
        F.col("tenant_id").alias("tenantId"), F.col("source_agent").alias("sourceAgent"),
        F.col("source_framework").alias("sourceFramework"), "payload", F.col("raw_meta").alias("rawMeta"),
        "tags", F.col("schema_version").alias("schemaVersion"))


def assign_ingestion_order(ev: DataFrame, start: int = 0, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Number the rows by arrival from `start` + 1. More than `max_rows` rows are numbered in slices of time."""
    rows = with_slices(ev.withColumn("_all", F.lit(0)), ["_all"], "received_at", max_rows)
    placed = scan(rows, ["_all"], [F.col("received_at"), F.col("id")], _n=position())
    return placed.withColumn("ingestion_order", F.col("_n") + start + 1).drop("_n", "_all", SLICE)


def dedupe_events(new: DataFrame, existing_ids: DataFrame | None = None) -> DataFrame:
    """Adds `status`: `created` for the first arrival of a new id, else `duplicate`.

    The first arrival per id is found by a partial aggregate, so a much repeated id is cheap.
    """
    first = new.groupBy("id").agg(F.min("ingestion_order").alias("_first"))
    if existing_ids is not None:
        first = first.join(existing_ids.select("id"), "id", "left_anti")
    joined = new.join(first, "id", "left")
    created = F.coalesce(F.col("ingestion_order") == F.col("_first"), F.lit(False))
    return joined.withColumn("status", F.when(created, "created").otherwise("duplicate")).drop("_first")


def split_batch(wire: DataFrame, limit: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """Accepted events, and one row per refused batch event with the reason.

    `wire` has batch_id and batch_index besides the event. A batch is taken whole or not at
    all; it must hold 1 to `limit` events.
    """
    checked = validate_events(wire)
    verdict = checked.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_valid")).alias("bad"))
    code = F.when(F.col("n") > limit, "BATCH_TOO_LARGE").when(F.col("bad") > 0, "INVALID_BATCH_EVENTS")
    joined = checked.join(verdict.withColumn("code", code), "batch_id")
    accepted = joined.where(F.col("code").isNull()).drop("n", "bad", "code", "issues", "is_valid")
    refused = joined.where(F.col("code").isNotNull()).select(
        "batch_id", "batch_index", "id", "code", F.col("bad").alias("failed_count"), "issues")
    return accepted, refused

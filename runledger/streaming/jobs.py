"""Streams of raw and canonical events.

Files come in any order, so no job here drops a row for its time: what must know the past reads it
from stored parts, and windows keep their state unless a delay is given.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.operators.normalize import canonical_rows, dead_letters, normalize, stats_columns
from runledger.operators.runs import _lifecycle, run_columns
from runledger.operators.timeline import run_summary, timeline_index
from runledger.operators.otlp import flatten_otlp, spans_to_raw
from runledger.schemas import EVENT_DDL, OTLP_DDL, RAW_EVENT_DDL
from runledger.sources.tables import raw_event_rows, read_runs, store_events_by_run
from runledger.streaming.state import CALLS_DDL, first_arrivals, tool_call_changes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def stream_raw_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Raw vendor events from files as they come."""
    raw = spark.readStream.schema(RAW_EVENT_DDL).option("maxFilesPerTrigger", max_files).json(path)
    return raw_event_rows(raw)


def stream_otlp(spark: SparkSession, path: str, tenant: str, max_files: int = 100, whole_files: bool = False) -> DataFrame:
    """Spans of OTLP/JSON trace exports as raw events, from files as they come: one export a line, or a file with `whole_files`.

    A span arrives when its file is read. What is not JSON comes as a raw event without vendor and ends as a dead letter.
    """
    exports = spark.readStream.schema(OTLP_DDL + ", _corrupt_record STRING").option("maxFilesPerTrigger", max_files).option("multiLine", whole_files).json(path)
    spans = spans_to_raw(flatten_otlp(exports.where(F.col("_corrupt_record").isNull())), tenant)
    nothing = F.lit(None).cast("string")
    broken = exports.where(F.col("_corrupt_record").isNotNull() & F.col("resourceSpans").isNull()).select(
        nothing.alias("vendor"), F.col("_corrupt_record").alias("data"), F.current_timestamp().alias("received_at"), F.lit(tenant).alias("tenant_id"), nothing.alias("run_id"))
    return spans.unionByName(broken)


def stream_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Canonical store rows from Parquet files as they come."""
    return spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", max_files).parquet(path)


def _start(df: DataFrame, sink, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_normalize(raw: DataFrame, out: str, dead: str, checkpoint: str, once: bool = True, stats: str | None = None) -> StreamingQuery:
    """Raw events to canonical events in `out` or dead letters in `dead`; with `stats`, counts of each batch there.

    Each batch replaces its own folder, so a batch that is run again after a failure
    leaves one copy. The counts are observed while the batch is normalized, without a pass of their own.
    Until both tables are written, a batch is held without what neither takes: raw data is held for dead letters alone.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        dead_only = {c: F.when(F.col("status") == "error", F.col(c)) for c in ("vendor", "data", "raw_run_id")}
        results = batch.observe(seen, *stats_columns()).withColumns(dead_only).drop("step", "adapter").persist()
        canonical_rows(results).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        dead_letters(results).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        results.unpersist()
        if stats:
            batch.sparkSession.createDataFrame([seen.get], "processed long, succeeded long, failed long, dead_lettered long").coalesce(1).write.mode("overwrite").parquet(f"{stats}/batch={batch_id}")

    return _start(normalize(raw), sink, checkpoint, once=once)


def stream_dedupe(events: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """First arrivals only, appended to `out`. Nothing is dropped for being late: the ids seen so far are keyed state, see `state.py`.

    Each batch replaces its own folder, so a batch that is run again after a failure leaves one copy.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(first_arrivals(events), sink, checkpoint, once=once)


def stream_runs(events: DataFrame, policy: str = "merge") -> DataFrame:
    """Run rows kept current (update mode), folded by arrival number as in the batch job."""
    return _lifecycle(events).groupBy(F.col("run_id").alias("id")).agg(*run_columns(policy))


def stream_activity(events: DataFrame, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Events per run and window of arrival time. With `delay`, windows end that long after them and later rows are dropped."""
    timed = events.withWatermark("received_at", delay) if events.isStreaming and delay else events
    return timed.groupBy(F.window("received_at", width).alias("w"), "run_id").agg(F.count("*").alias("event_count")).select(
        "run_id", F.col("w.start").alias("window_start"), "event_count")


def stream_sessions(events: DataFrame, gap: str = "12 hours", delay: str | None = None) -> DataFrame:
    """Stretches of activity per run, split where nothing arrives for `gap`. `delay` as in `stream_activity`."""
    timed = events.withWatermark("received_at", delay) if events.isStreaming and delay else events
    return timed.groupBy(F.session_window("received_at", gap).alias("w"), "run_id").agg(F.count("*").alias("event_count")).select(
        "run_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")


def stream_open_tools(events: DataFrame, out: str, checkpoint: str, once: bool = True, remind_ms: int | None = None) -> StreamingQuery:
    """Tool calls kept current in `out`; `open_tools` reads them.

    The tool events of a run and tool are keyed state in timeline order. An event finds its place among
    them and changes the pairs next to it, so the result does not depend on the order of arrival or on how
    rows are batched. A batch stores the calls it changed and replaces its own folder when it is run again.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(tool_call_changes(events, remind_ms), sink, checkpoint, mode="update", once=once)


def open_tools(spark: SparkSession, out: str, timeout_ms: int = 3_600_000) -> DataFrame:
    """The calls as last stored: `closed`, `open`, or `unclosed` where the newest event of all is `timeout_ms` past the start."""
    stored = spark.read.schema(CALLS_DDL + ", batch BIGINT").parquet(out)
    last = stored.agg(F.max(F.unix_millis("newest"))).first()[0]
    now = F.struct("run_id", "tool_key", "timestamp", "end_id", "duration_ms", "state")
    calls = stored.where(F.col("start_id").isNotNull()).groupBy("start_id").agg(F.max_by(now, "batch").alias("c")).select("start_id", "c.*").where("state <> 'none'")
    late = (F.col("state") == "open") & (F.unix_millis("timestamp") + timeout_ms < F.lit(last))
    return calls.select("run_id", "tool_key", "start_id", "end_id", "duration_ms", F.when(late, "unclosed").otherwise(F.col("state")).alias("state"))


def rebuild_touched_runs(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Run summaries of the runs a late batch touches, from all their events in source order."""
    touched = batch.select("run_id").distinct()
    first = F.min_by(F.struct(*[c for c in batch.columns if c != "id"]), F.struct("received_at", "ingestion_order"))  # of an id that comes twice
    fresh = batch.join(stored.select("id"), "id", "left_anti").groupBy("id").agg(first.alias("e")).select("id", "e.*").select(*batch.columns)
    everything = stored.select(*batch.columns).unionByName(fresh)
    return run_summary(timeline_index(everything.join(touched, "run_id", "left_semi")))


def rebuild_late_runs(batch: DataFrame, store: str, batch_id: int) -> DataFrame:
    """Add a late batch to a store by run; summaries of the runs it touches, in source order, from their buckets alone."""
    store_events_by_run(batch, store, batch_id)
    return run_summary(timeline_index(read_runs(batch.sparkSession, store, batch.schema, batch)))

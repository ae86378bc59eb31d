"""Source, sink and streaming queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runledger.messages import sql as sql_text
from runledger.operators import evidence as E
from runledger.operators import normalize as N
from runledger.operators.ingest import rows_to_events
from runledger.operators.runs import build_runs
from runledger.plans.evidence_queries import _requests
from runledger.plans.normalize_queries import BASE_SQL, CASES, OTEL_SQL, SPANS_SQL, _bad, all_raw, otlp_rows
from runledger.plans.registry import on_events, plain_times, query
from runledger.plans.testbed import events_table
from runledger.plans.timeline_queries import GAPS_SQL, CALLS_SQL, DURATIONS_SQL, RUNS_SQL, SUMMARY_SQL
from runledger.schemas import EVENT_DDL
from runledger.session import cut_to_table, shared_dir
from runledger.sources import tables as S
from runledger.streaming import jobs as J

_EVENT_COLUMNS = 'id, run_id, tenant_id, type, sequence, parent_event_id, payload, "timestamp"'


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


@on_events("read_events", f"SELECT {_EVENT_COLUMNS.replace('payload', 'payload_sorted AS payload')} FROM ev")
def _(ev):
    folder = _folder(ev.sparkSession)
    wire = rows_to_events(ev).withColumn("payload", F.parse_json("payload"))
    wire.write.json(folder)
    return S.read_events(ev.sparkSession, folder, "jsonl").select(*_EVENT_COLUMNS.replace('"', "").split(", "))


@on_events("append_events", f"SELECT {_EVENT_COLUMNS} FROM ev")
def _(ev):
    folder = _folder(ev.sparkSession)
    S.append_events(ev.where("tenant_id = 'tenant-0'"), folder)
    S.append_events(ev.where("tenant_id <> 'tenant-0'"), folder)
    return S.read_events(ev.sparkSession, folder).select(*_EVENT_COLUMNS.replace('"', "").split(", "))


def _raw_json(raw):
    return raw.select("vendor", F.parse_json("data").alias("data"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("receivedAt"),
                      F.col("tenant_id").alias("tenantId"), F.col("run_id").alias("runId"))


_RAW_SQL = " UNION ALL ".join(f"SELECT CASE WHEN eid%2=0 THEN '{v}' ELSE 'other' END AS vendor, received_at, 'tenant-' || CAST(u%3 AS VARCHAR) AS tenant_id FROM bs" for v in CASES)


@query("read_raw_events", f"""WITH {SPANS_SQL}, r AS (SELECT 'sdk' AS vendor, received_at, 't' AS tenant_id FROM bs UNION ALL SELECT vendor, TIMESTAMP '2024-03-01', 'tenant-x' FROM sn UNION ALL {_RAW_SQL})
  SELECT vendor, received_at, tenant_id, count(*) AS n FROM r GROUP BY ALL""", raw=True)
def _(spark, sf_dir):
    folder = _folder(spark)
    _raw_json(all_raw(spark, sf_dir)).write.json(folder, compression="gzip")  # a file has the rows of one piece
    rows = S.read_raw_events(spark, folder)
    return plain_times(rows.groupBy("vendor", "received_at", "tenant_id").agg(F.count("*").alias("n")))


@query("read_otlp", "SELECT 'tr' || CAST(user_id AS VARCHAR) AS trace_id, count(*) AS n FROM events GROUP BY ALL", raw=True)
def _(spark, sf_dir):
    folder = _folder(spark)
    otlp_rows(spark, sf_dir).write.json(folder)
    return S.read_otlp(spark, folder).select(F.explode("resourceSpans.scopeSpans").alias("s")).select(
        F.explode("s").alias("s")).select(F.explode("s.spans").alias("p")).groupBy(F.col("p.traceId").alias("trace_id")).agg(F.count("*").alias("n"))


def _reasons_sql(vendor: N.Vendor) -> str:
    """Reason of each bad case of a vendor. Without a type, rows under another name find no adapter."""
    whens = []
    for i, (kind, _, mapped, _) in enumerate(CASES[vendor.vendor_id]):
        if mapped is None and kind:
            whens.append(f"WHEN {i} THEN {sql_text('type_unknown', title=vendor.title, x_kind=kind)}")
        elif mapped is None:
            whens.append(f"""WHEN {i} THEN CASE WHEN eid%2=1 THEN {sql_text('adapter_missing', vendor='other')} ELSE {sql_text('type_missing', title=vendor.title)} END""")
    return f"SELECT CASE eid%{len(CASES[vendor.vendor_id])} {' '.join(whens)} END FROM bs WHERE {_bad(vendor.vendor_id)}"


@query("write_dead_letters", f"""WITH {BASE_SQL}, r AS (SELECT 'Not a valid event: payload.key: invalid_type' AS reason FROM bs WHERE k%7=0
   {' '.join('UNION ALL ' + _reasons_sql(v) for v in N.VENDORS)})
  SELECT reason, count(*) AS n FROM r GROUP BY reason""", raw=True)
def _(spark, sf_dir):
    folder = _folder(spark)
    S.write_dead_letters(N.dead_letters(N.normalize(cut_to_table(all_raw(spark, sf_dir)))), folder)
    return spark.read.parquet(folder).groupBy("reason").agg(F.count("*").alias("n"))


@on_events("write_bundles", f"""WITH {RUNS_SQL} SELECT tenant_id, status, count(*) AS n FROM (SELECT CASE WHEN agent_id='agent-3' THEN 'other' ELSE tenant_id END AS tenant_id,
   CASE WHEN agent_id IN ('agent-3','agent-4') THEN 'failed' ELSE 'complete' END AS status FROM runs) GROUP BY ALL""", stored=True)
def _(ev):
    folder, runs = _folder(ev.sparkSession), build_runs(ev)
    S.write_bundles(E.assemble_bundles(ev, runs, _requests(runs)), folder)
    return ev.sparkSession.read.parquet(folder).groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


@on_events("write_export", f"""WITH {RUNS_SQL}, ok AS (SELECT id FROM runs WHERE agent_id NOT IN ('agent-3','agent-4'))
  SELECT 'evidence-' || run_id || '-2024-06-01_12-00-00-000.json' AS document, count(*) AS event_lines FROM ev WHERE run_id IN (SELECT id FROM ok) GROUP BY run_id""", stored=True)
def _(ev):
    spark, folder, runs = ev.sparkSession, _folder(ev.sparkSession), build_runs(ev)
    lines = E.export_lines(E.assemble_bundles(ev, runs, _requests(runs)), ev, runs, keep=("created_at",))  # the time is in the names
    S.write_export(lines, folder, E.export_file_name())
    return S.read_export(spark, folder).where(F.col("section") == "events").groupBy("document").agg(F.count("*").alias("event_lines"))


# ---- streams ---------------------------------------------------------------------------------

FILE_ROWS = 100_000  # rows of a file that a stream picks up
LEAST_FILE_ROWS = 5_000  # of a compressed one, if there are so many


def _files(rows: int, batches: int) -> int:
    """Files in each of so many batches of a stream, for files of at most about FILE_ROWS rows."""
    return max(1, -(-rows // (batches * FILE_ROWS)))


def _event_files(ev) -> tuple[str, int]:
    """The events as files a stream can pick up, and how many of them make one of six batches."""
    folder, files = _folder(ev.sparkSession), _files(ev.count(), 6)
    names = [c.split(" ")[0] for c in EVENT_DDL.split(", ")]
    ev.select(*names).repartition(6 * files, F.xxhash64("id")).write.parquet(folder)  # in no order
    return folder, files


def _json_files(rows, count: int, folder: str, batches: int) -> int:
    """So many rows as compressed JSON lines a stream can pick up, and how many files make one of so many batches.

    A file is one task's: they have enough rows that starting a task does not count, or are some for each core.
    """
    each = max(LEAST_FILE_ROWS, count // (batches * 4 * rows.sparkSession.sparkContext.defaultParallelism))
    rows.write.option("maxRecordsPerFile", min(FILE_ROWS, each)).json(folder, compression="gzip")
    return -(-len(rows.sparkSession.read.text(folder).inputFiles()) // batches)


def _stream_of(ev):
    folder, files = _event_files(ev)
    return J.stream_events(ev.sparkSession, folder, max_files=files)


def _finish(running):
    running.awaitTermination()
    return running


@query("stream_normalize", f"""WITH {OTEL_SQL}, r AS (SELECT k%7=0 AS bad, 'sdk' AS source FROM bs {' '.join(f"UNION ALL SELECT {_bad(v)}, '{v}' FROM bs" for v in CASES)} UNION ALL SELECT false, 'opentelemetry' FROM oe)
  SELECT source, count(*) FILTER (WHERE NOT bad) AS events, count(*) FILTER (WHERE bad) AS dead FROM r GROUP BY source""", raw=True)
def _(spark, sf_dir):
    """Vendor events from one folder, spans in OTLP exports from another."""
    folder = _folder(spark)
    events = events_table(spark, sf_dir).count()
    raw = _json_files(_raw_json(all_raw(spark, sf_dir).where("NOT vendor LIKE 'otel%'")), events * (len(CASES) + 1), f"{folder}/in", 3)
    spans = _json_files(otlp_rows(spark, sf_dir), events, f"{folder}/spans", 3)
    _finish(J.stream_normalize(J.stream_raw_events(spark, f"{folder}/in", max_files=raw), f"{folder}/out", f"{folder}/dead", f"{folder}/check"))
    _finish(J.stream_normalize(J.stream_otlp(spark, f"{folder}/spans", "tenant-x", max_files=spans), f"{folder}/out-spans", f"{folder}/dead-spans", f"{folder}/check-spans"))
    # Names of the envelope fields tell the formats apart.
    both = spark.read.parquet(f"{folder}/out").unionByName(spark.read.parquet(f"{folder}/out-spans"))
    events = both.select(F.coalesce("source_framework", F.lit("sdk")).alias("source"), F.lit(1).alias("e"), F.lit(0).alias("d"))
    data = F.col("data")
    kind = F.get_json_object(data, "$.type")
    by_type = (F.when(kind.startswith("codex."), "openai-codex").when(kind.startswith("copilot."), "github-copilot")
               .when(kind.rlike("^(conversation|tool_use|inference|assistant|permission)[.]"), "claude-code")
               .when(F.get_json_object(data, "$.schemaVersion").isNotNull(), "sdk").otherwise("openai-agents"))
    dead = spark.read.parquet(f"{folder}/dead").unionByName(spark.read.parquet(f"{folder}/dead-spans")).select(by_type.alias("source"), F.lit(0).alias("e"), F.lit(1).alias("d"))
    return events.unionByName(dead).groupBy("source").agg(F.sum("e").alias("events"), F.sum("d").alias("dead"))


@on_events("stream_dedupe", "SELECT id, run_id, type FROM ev", stored=True)
def _(ev):
    spark, (folder, files) = ev.sparkSession, _event_files(ev)
    names = [c.split(" ")[0] for c in EVENT_DDL.split(", ")]
    # Every error event is sent again, some of them long after.
    again = ev.where("type = 'run.error'").select(*names)
    twice = again.unionByName(again.withColumn("received_at", F.expr("received_at + INTERVAL 90 DAYS")))
    twice.repartition(2 * files, F.xxhash64("received_at", "id")).write.mode("append").parquet(folder)  # two batches more
    out = _folder(spark)
    _finish(J.stream_dedupe(J.stream_events(spark, folder, max_files=files), f"{out}/out", f"{out}/check"))
    return spark.read.parquet(f"{out}/out").select("id", "run_id", "type")


@on_events("stream_runs", f"WITH {RUNS_SQL} SELECT id, tenant_id, agent_id, run_name, status, started_at, ended_at FROM runs", stored=True)
def _(ev):
    spark, out = ev.sparkSession, _folder(ev.sparkSession)
    updates = J.stream_runs(_stream_of(ev))

    def sink(batch, batch_id):
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/b={batch_id}")

    _finish(J._start(updates, sink, f"{out}/check", mode="update"))
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("id").agg(F.max_by(F.struct("tenant_id", "agent_id", "run_name", "status", "started_at", "ended_at"), "version").alias("r"))
    return last.select("id", "r.*")


def _complete(ev, job):
    """The last result of a stream over the event files, one file per trigger."""
    spark, out = ev.sparkSession, _folder(ev.sparkSession)

    def sink(batch, batch_id):
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/b={batch_id}")

    _finish(J._start(job(_stream_of(ev)), sink, f"{out}/check", mode="complete"))
    rows = spark.read.parquet(f"{out}/rows")
    return rows.join(rows.agg(F.max("version").alias("version")), "version").drop("version", "b")


@on_events("stream_activity", """SELECT run_id, date_trunc('day', received_at) AS window_start, count(*) AS event_count FROM ev GROUP BY ALL""", stored=True)
def _(ev):
    return _complete(ev, J.stream_activity)


@on_events("stream_sessions", """WITH g AS (SELECT *, CASE WHEN received_at - lag(received_at) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY received_at)),
  s AS (SELECT *, sum(cut) OVER (PARTITION BY run_id ORDER BY received_at ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT run_id, min(received_at) AS session_start, max(received_at) + INTERVAL 12 HOUR AS session_end, count(*) AS event_count FROM s GROUP BY run_id, n""", stored=True)
def _(ev):
    return _complete(ev, J.stream_sessions)


@on_events("stream_open_tools", f"""WITH {CALLS_SQL}, {DURATIONS_SQL} SELECT c.run_id, c.id AS start_id, duration_ms, 'closed' AS state FROM calls c JOIN durs USING (run_id, id)
  UNION ALL SELECT run_id, id, NULL, CASE WHEN epoch_ms("timestamp") + 3600000 < (SELECT max(epoch_ms("timestamp")) FROM calls) THEN 'unclosed' ELSE 'open' END
  FROM calls WHERE type = 'tool.call.start' AND next_type IS NULL""", stored=True)
def _(ev):
    spark, out = ev.sparkSession, _folder(ev.sparkSession)
    _finish(J.stream_open_tools(_stream_of(ev), f"{out}/out", f"{out}/check"))
    return J.open_tools(spark, f"{out}/out").select("run_id", "start_id", "duration_ms", "state")


_LATE = f"WITH {CALLS_SQL}, {GAPS_SQL.strip()}, {SUMMARY_SQL} SELECT * FROM sums WHERE run_id IN (SELECT run_id FROM ev WHERE type='side_effect.failed')"


@on_events("late_data_by_run", _LATE, stored=True)
def _(ev):
    """The same with a store that keeps runs apart."""
    folder = f"{shared_dir(ev.sparkSession)}/runs-{uuid.uuid4().hex}"
    S.store_events_by_run(ev.where("type <> 'side_effect.failed' OR tenant_id = 'tenant-1'"), folder, 0)
    return J.rebuild_late_runs(ev.where("type = 'side_effect.failed'"), folder, 1)


@on_events("late_data", _LATE, stored=True)
def _(ev):
    """Failed side effects arrive late, some of them twice: the runs they touch are rebuilt."""
    late = ev.where("type = 'side_effect.failed'")
    stored = ev.where("type <> 'side_effect.failed' OR tenant_id = 'tenant-1'")
    return J.rebuild_touched_runs(stored, late)

"""Timeline and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.messages import sql
from runledger.operators import runs as R
from runledger.operators import timeline as TL
from runledger.plans.registry import on_events

ORDER = 'ORDER BY "timestamp", coalesce(sequence, 2147483647), ingestion_order'
TL_SQL = f"""tl AS (SELECT *, row_number() OVER (PARTITION BY run_id {ORDER}) - 1 AS idx,
  CASE WHEN type LIKE 'tool.call.%' THEN coalesce(json_extract_string(payload,'$.toolId'), json_extract_string(payload,'$.toolName')) END AS tool_key,
  CASE WHEN type LIKE 'tool.call.%' THEN json_extract_string(payload,'$.toolName') END AS tool_name FROM ev)"""
CALLS_SQL = f"""{TL_SQL}, calls AS (SELECT *, lead(type) OVER w AS next_type, lead("timestamp") OVER w AS next_ts,
  max(CASE WHEN type='tool.call.start' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, tool_key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started
  FROM tl WHERE type LIKE 'tool.call.%' WINDOW w AS (PARTITION BY run_id, tool_key ORDER BY idx))"""
DURATIONS_SQL = """durs AS (SELECT run_id, id, tool_key, epoch_ms(next_ts) - epoch_ms("timestamp") AS duration_ms FROM calls
  WHERE type='tool.call.start' AND next_type IN ('tool.call.end','tool.call.error'))"""
GAPS_SQL = f"""
 g1 AS (SELECT run_id, 'missing_run_start' AS gap_type, {sql('missing_run_start')} AS message, '' AS related, 0::BIGINT AS detected_at_index
   FROM tl GROUP BY run_id HAVING NOT bool_or(type='run.start')),
 g2 AS (SELECT run_id, 'missing_run_end' AS gap_type, {sql('missing_run_end')} AS message, '' AS related, max(idx) AS detected_at_index
   FROM tl GROUP BY run_id HAVING NOT bool_or(type='run.end')),
 g3 AS (SELECT run_id, 'unclosed_tool_call' AS gap_type, {sql('unclosed_tool_call')} AS message, id AS related, idx AS detected_at_index
   FROM calls WHERE type='tool.call.start' AND next_type IS NULL),
 g4 AS (SELECT run_id, 'orphan_tool_end' AS gap_type, {sql('orphan_tool_end')} AS message, id AS related, idx AS detected_at_index
   FROM calls WHERE type='tool.call.end' AND coalesce(started,0)=0),
 g5 AS (SELECT run_id, 'unclosed_approval' AS gap_type, {sql('unclosed_approval')} AS message, id AS related, idx AS detected_at_index
   FROM tl r WHERE type='approval.requested' AND NOT EXISTS (SELECT 1 FROM tl d WHERE d.run_id=r.run_id AND d.parent_event_id=r.id
     AND d.type IN ('approval.granted','approval.denied') AND d.idx>r.idx)),
 gaps AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5)"""
DEPTH_SQL = """d0 AS (SELECT run_id, id, parent_event_id AS p FROM ev),
 dr AS (SELECT run_id, id, 0 AS depth FROM d0 WHERE p IS NULL
   UNION ALL SELECT run_id, id, 1 FROM d0 WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d0 q WHERE q.run_id=d0.run_id AND q.id=d0.p)
   UNION ALL SELECT d0.run_id, d0.id, dr.depth+1 FROM d0 JOIN dr ON d0.run_id=dr.run_id AND d0.p=dr.id)"""
SUMMARY_SQL = """sums AS (SELECT s.*, coalesce(gc.gap_count,0) AS gap_count, coalesce(gc.gap_count,0)>0 AS has_gaps FROM (
   SELECT run_id, min(tenant_id) AS tenant_id, count(*) AS event_count, min("timestamp") AS start_time, max("timestamp") AS end_time,
     epoch_ms(max("timestamp")) - epoch_ms(min("timestamp")) AS duration_ms,
     arg_min(json_extract_string(payload,'$.status'), idx) FILTER (WHERE type='run.end') AS status,
     bool_or(type IN ('run.error','tool.call.error','side_effect.failed')) AS has_errors,
     count(DISTINCT tool_name) FILTER (WHERE type='tool.call.start') AS tool_count FROM tl GROUP BY run_id) s
   LEFT JOIN (SELECT run_id, count(*) AS gap_count FROM gaps GROUP BY run_id) gc USING (run_id))"""


def _joined(col: str):
    return F.array_join(col, ",")


def _flat_gaps(gaps):
    return gaps.select("run_id", "gap_type", "message", _joined("related_event_ids").alias("related"), "detected_at_index")


@on_events("timeline_index", f"WITH {TL_SQL} SELECT run_id, id, type, idx FROM tl")
def _(ev):
    return TL.timeline_index(ev).select("run_id", "id", "type", "idx")


@on_events("child_event_ids", f"""WITH {TL_SQL}, ch AS (SELECT run_id, parent_event_id AS id, string_agg(id, ',' ORDER BY idx) AS ids FROM tl WHERE parent_event_id IS NOT NULL GROUP BY ALL)
  SELECT tl.run_id, tl.id, coalesce(ids,'') AS child_event_ids FROM tl LEFT JOIN ch USING (run_id, id)""")
def _(ev):
    return TL.child_event_ids(TL.timeline_index(ev)).select("run_id", "id", _joined("child_event_ids").alias("child_event_ids"))


@on_events("causal_depth", f"WITH RECURSIVE {DEPTH_SQL} SELECT run_id, id, depth::BIGINT AS depth FROM dr")
def _(ev):
    return TL.causal_depth(ev)


@on_events("tool_durations", f"WITH {CALLS_SQL}, {DURATIONS_SQL} SELECT * FROM durs")
def _(ev):
    return TL.tool_durations(TL.tool_calls(TL.timeline_index(ev)))


for _name, _build, _from_calls in [
    ("gap_missing_run_start", TL.gap_missing_run_start, False),
    ("gap_missing_run_end", TL.gap_missing_run_end, False),
    ("gap_unclosed_tool", TL.gap_unclosed_tool, True),
    ("gap_orphan_tool_end", TL.gap_orphan_tool_end, True),
    ("gap_unclosed_approval", TL.gap_unclosed_approval, False),
]:
    _number = ["gap_missing_run_start", "gap_missing_run_end", "gap_unclosed_tool", "gap_orphan_tool_end",
               "gap_unclosed_approval"].index(_name) + 1

    def _one(ev, build=_build, from_calls=_from_calls):
        tl = TL.timeline_index(ev)
        return _flat_gaps(build(TL.tool_calls(tl) if from_calls else tl))

    on_events(_name, f"WITH {CALLS_SQL}, {GAPS_SQL.strip()} SELECT * FROM g{_number}")(_one)


@on_events("timeline_gaps", f"WITH {CALLS_SQL}, {GAPS_SQL.strip()} SELECT * FROM gaps")
def _(ev):
    return _flat_gaps(TL.timeline_gaps(TL.timeline_index(ev)))


@on_events("gaps_by_index", f"""WITH {CALLS_SQL}, {GAPS_SQL.strip()} SELECT run_id, detected_at_index AS idx,
  CASE gap_type WHEN 'missing_run_start' THEN 'before' WHEN 'missing_run_end' THEN 'after' ELSE 'inline' END AS place,
  count(*) AS gap_count, string_agg(gap_type, ',' ORDER BY gap_type) AS gap_types FROM gaps GROUP BY ALL""")
def _(ev):
    return TL.gaps_by_index(TL.timeline_gaps(TL.timeline_index(ev))).withColumn("gap_types", _joined("gap_types"))


@on_events("run_summary", f"WITH {CALLS_SQL}, {GAPS_SQL.strip()}, {SUMMARY_SQL} SELECT * FROM sums", stored=True)
def run_summary_query(ev):
    return TL.run_summary(TL.timeline_index(ev))


@on_events("event_type_counts", """SELECT run_id, string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY type) AS counts
  FROM (SELECT run_id, type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY run_id""")
def _(ev):
    pairs = F.transform(F.map_entries("event_type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return TL.event_type_counts(ev).select("run_id", F.array_join(pairs, ",").alias("counts"))


@on_events("event_type_counts_wide", "SELECT run_id, " + ", ".join(
    f"count(*) FILTER (WHERE type='{t}') AS {t.replace('.', '_')}" for t in TL.EVENT_TYPES) + " FROM ev GROUP BY run_id")
def _(ev):
    return TL.event_type_counts_wide(ev)


@on_events("timeline", f"""WITH RECURSIVE {CALLS_SQL}, {DURATIONS_SQL}, {DEPTH_SQL},
  ch AS (SELECT run_id, parent_event_id AS id, count(*) AS child_count FROM tl WHERE parent_event_id IS NOT NULL GROUP BY ALL)
  SELECT tl.run_id, tl.id, tl.type, tl."timestamp", tl.idx, dr.depth::BIGINT AS depth, coalesce(child_count,0) AS child_count, duration_ms
  FROM tl LEFT JOIN dr USING (run_id, id) LEFT JOIN ch USING (run_id, id) LEFT JOIN durs USING (run_id, id)""", stored=True)
def _(ev):
    return TL.timeline(ev).drop("slice")


@on_events("duration_share", f"""WITH {CALLS_SQL}, {DURATIONS_SQL}, sc AS (SELECT run_id, epoch_ms(max("timestamp")) - epoch_ms(min("timestamp")) AS run_ms FROM tl GROUP BY run_id),
  lo AS (SELECT run_id, max(duration_ms) AS longest FROM durs GROUP BY run_id),
  s AS (SELECT run_id, CASE WHEN run_ms>0 THEN run_ms WHEN longest>0 THEN longest END AS scale FROM sc LEFT JOIN lo USING (run_id))
  SELECT run_id, id, duration_ms, round(CASE WHEN scale IS NOT NULL THEN least(100.0::DOUBLE, greatest(2.0::DOUBLE, duration_ms::DOUBLE/scale*100)) END, 6) AS share FROM durs JOIN s USING (run_id)""")
def _(ev):
    tl = TL.timeline_index(ev)
    durations = TL.tool_durations(TL.tool_calls(tl))
    spans = tl.groupBy("run_id").agg(TL.millis_between(F.min("timestamp"), F.max("timestamp")).alias("duration_ms"))
    return TL.duration_share(durations, spans).withColumn("share", F.round("share", 6))


@on_events("arrival_disorder", f"""WITH {TL_SQL} SELECT run_id, id, row_number() OVER (PARTITION BY run_id ORDER BY ingestion_order) - 1 AS arrival_idx, idx AS timeline_idx,
  coalesce(max("timestamp") OVER (PARTITION BY run_id ORDER BY ingestion_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "timestamp", false) AS is_late FROM tl""")
def _(ev):
    return TL.arrival_disorder(ev)


# ---- runs ----------------------------------------------------------------

_START = "CASE WHEN type='run.start' THEN json_extract_string(payload,'$.{}') END"
_META = "CASE WHEN type='run.start' THEN CAST(json_extract(payload,'$.configuration') AS VARCHAR) END"
LIFE_SQL = f"""life AS (SELECT *, ingestion_order AS arrival, {_START.format('runName')} AS run_name, {_START.format('triggerSource')} AS trigger_source,
   {_START.format('parentRunId')} AS parent_run_id, {_META} AS metadata,
   type='run.error' AND coalesce(json_extract_string(payload,'$.fatal')='true', false) AS is_fatal,
   CASE WHEN type='run.end' THEN json_extract_string(payload,'$.status') WHEN type='run.error' AND json_extract_string(payload,'$.fatal')='true' THEN 'failure' END AS new_status FROM ev),
 fst AS (SELECT * FROM life QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY arrival)=1)"""


def _runs_sql(policy: str) -> str:
    def start(name):
        if policy == "first":
            return f"max(f.{name}) AS {name}"
        return f"arg_max(l.{name}, l.arrival) FILTER (WHERE l.{name} IS NOT NULL) AS {name}"

    if policy == "merge":
        ended = "CASE WHEN NOT coalesce(arg_max(l.is_fatal, l.arrival) FILTER (WHERE l.new_status IS NOT NULL), true) THEN arg_max(l.\"timestamp\", l.arrival) FILTER (WHERE l.new_status IS NOT NULL) END"
        changed = "l.new_status IS NOT NULL OR l.type='run.start'"
    else:
        ended = "arg_max(l.\"timestamp\", l.arrival) FILTER (WHERE l.new_status IS NOT NULL AND NOT l.is_fatal)"
        changed = "l.new_status IS NOT NULL"
    return f"""{LIFE_SQL}, runs AS (SELECT l.run_id AS id, max(f.tenant_id) AS tenant_id, max(f.source_agent) AS agent_id, {start('run_name')}, {start('trigger_source')}, {start('parent_run_id')},
   coalesce(arg_max(l.new_status, l.arrival) FILTER (WHERE l.new_status IS NOT NULL), 'running') AS status, max(f."timestamp") AS started_at, {ended} AS ended_at, {start('metadata')},
   max(f.schema_version) AS schema_version, max(f.received_at) AS created_at,
   coalesce(arg_max(l.received_at, l.arrival) FILTER (WHERE {changed}), max(f.received_at)) AS updated_at
   FROM life l JOIN fst f USING (run_id) GROUP BY l.run_id)"""


RUNS_SQL = _runs_sql("merge")


@on_events("build_runs", f"WITH {RUNS_SQL} SELECT * FROM runs")
def _(ev):
    return R.build_runs(ev).drop("tags")


@on_events("build_runs_first", f"WITH {_runs_sql('first')} SELECT * FROM runs")
def _(ev):
    return R.build_runs(ev, policy="first").drop("tags")


@on_events("list_runs", f"""WITH {RUNS_SQL}, p AS (SELECT * FROM runs WHERE tenant_id='tenant-1' ORDER BY started_at DESC, id LIMIT 21)
  SELECT id, agent_id, status, started_at, (SELECT count(*) FROM ev WHERE ev.run_id=q.id) AS event_count, (SELECT count(*) FROM p)>20 AS has_more
  FROM (SELECT * FROM p ORDER BY started_at DESC, id LIMIT 20) q""")
def _(ev):
    return R.list_runs(R.build_runs(ev), ev, tenant="tenant-1").select("id", "agent_id", "status", "started_at", "event_count", "has_more")


@on_events("run_details", f"""WITH {RUNS_SQL} SELECT r.id, r.tenant_id, r.agent_id, r.status, r.started_at, r.ended_at,
   (SELECT count(*) FROM ev WHERE ev.run_id=r.id) AS event_count, epoch_ms(r.ended_at)-epoch_ms(r.started_at) AS duration_ms,
   (SELECT count(*) FROM runs c WHERE c.parent_run_id=r.id) AS child_count,
   (SELECT arg_min(c.id, (c.started_at, c.id)) FROM runs c WHERE c.parent_run_id=r.id) AS first_child_id,
   p.id AS parent_run_id, p.status AS parent_status FROM runs r LEFT JOIN runs p ON r.parent_run_id=p.id""", stored=True)
def _(ev):
    return R.run_details(R.build_runs(ev), ev)


@on_events("child_runs", f"""WITH {RUNS_SQL} SELECT c.parent_run_id, c.id, c.status, c.started_at FROM runs c JOIN runs p ON c.parent_run_id=p.id""")
def _(ev):
    return R.child_runs(R.build_runs(ev)).select("parent_run_id", "id", "status", "started_at")


@on_events("ancestry", f"""WITH RECURSIVE {RUNS_SQL}, an AS (SELECT r.id AS run_id, p.id AS ancestor_id, p.parent_run_id AS up, 1 AS level FROM runs r JOIN runs p ON r.parent_run_id=p.id
   UNION ALL SELECT an.run_id, p.id, p.parent_run_id, an.level+1 FROM an JOIN runs p ON an.up=p.id WHERE an.level<20)
   SELECT run_id, ancestor_id, level::BIGINT AS level FROM an""")
def _(ev):
    return R.ancestry(R.build_runs(ev))


@on_events("delegation_points", f"""WITH {RUNS_SQL} SELECT c.parent_run_id, c.id AS child_run_id, c.agent_id AS child_agent_id, c.run_name AS child_run_name, c.status AS child_status,
   c.started_at AS child_started_at, c.ended_at AS child_ended_at FROM runs c JOIN runs p ON c.parent_run_id=p.id""")
def _(ev):
    return R.delegation_points(R.build_runs(ev))


@on_events("events_by_run", f'SELECT run_id, id, type, "timestamp", sequence, ingestion_order FROM ev')
def _(ev):
    return R.events_by_run(ev).select("run_id", "id", "type", "timestamp", "sequence", "ingestion_order")


@on_events("lookup", "SELECT id, run_id, type, payload FROM ev WHERE id IN (SELECT parent_event_id FROM ev WHERE type='run.error')")
def _(ev):
    wanted = ev.where(F.col("type") == "run.error").select("parent_event_id")
    return R.lookup(ev, wanted).select("id", "run_id", "type", "payload")


@on_events("page_keyset", f"""SELECT id, "timestamp", (SELECT count(*) FROM ev WHERE "timestamp" < TIMESTAMP '2024-01-20' ) > 50 AS has_more FROM ev
   WHERE "timestamp" < TIMESTAMP '2024-01-20' ORDER BY "timestamp" DESC, id LIMIT 50""")
def _(ev):
    cursor_time = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return R.page(ev.select("id", "timestamp"), [("timestamp", True), ("id", False)], 50, [cursor_time, ""]).where("timestamp < '2024-01-20'")


@on_events("page_offset", """SELECT id, (SELECT CAST(ceil(count(*)/50.0) AS BIGINT) FROM ev) AS page_count FROM ev ORDER BY "timestamp", id LIMIT 50 OFFSET 100""")
def _(ev):
    return R.page_offset(ev.select("id", "timestamp"), [F.col("timestamp"), F.col("id")], 2, 50).select("id", "page_count")

"""Replay timelines: order, causal depth, tool-call pairing, gaps and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.ordered import SLICE, following, lists, max_before, position, scan
from runledger.functions.payload import fields, millis_between
from runledger.messages import text
from runledger.schemas import ERROR_TYPES, EVENT_TYPES, TOOL_TYPES
from runledger.session import cut_lineage

LAST_SEQUENCE = 2_147_483_647
SKETCH = 12  # 4,096 registers a sketch


def timeline_order() -> list[Column]:
    """Source time, then sequence with missing ones last, then arrival."""
    return [F.col("timestamp"), F.coalesce("sequence", F.lit(LAST_SEQUENCE)), F.col("ingestion_order")]


def _kept_slice(df: DataFrame) -> list[str]:
    return [SLICE] if SLICE in df.columns else []


def timeline_index(ev: DataFrame) -> DataFrame:
    """Timeline rows: 0-based place of each event in its run, and the few fields later steps need.

    The payload is parsed before the shuffle and left behind.
    """
    p = fields("payload", toolId="string", toolName="string", status="string")
    tool = F.col("type").isin(TOOL_TYPES)
    narrow = ev.select(
        "id", "run_id", "tenant_id", "type", "timestamp", "sequence", "ingestion_order", "parent_event_id",
        F.when(tool, F.coalesce(p["toolId"], p["toolName"])).alias("tool_key"),
        F.when(tool, p["toolName"]).alias("tool_name"),
        F.when(F.col("type") == "run.end", p["status"]).alias("end_status"),
        *_kept_slice(ev),
    )
    return scan(narrow, ["run_id"], timeline_order(), idx=position())


def tool_calls(tl: DataFrame) -> DataFrame:
    """Tool events with the next event of the same run and key, and whether a start came before."""
    tools = tl.where(F.col("type").isin(TOOL_TYPES)).select(
        "run_id", "id", "type", "timestamp", "idx", F.coalesce("tool_key", F.lit("")).alias("tool_key"),
        *_kept_slice(tl),
    )
    nxt = F.struct(F.col("type").alias("type"), F.col("timestamp").alias("timestamp"), F.col("id").alias("id"))
    return scan(
        tools, ["run_id", "tool_key"], [F.col("idx")],
        next_event=following(nxt),
        started=max_before((F.col("type") == "tool.call.start").cast("int")),
    )


def tool_durations(calls: DataFrame) -> DataFrame:
    """Milliseconds from a start to the end or error that closes it."""
    closed = (F.col("type") == "tool.call.start") & F.col("next_event.type").isin("tool.call.end", "tool.call.error")
    ms = millis_between("timestamp", "next_event.timestamp")
    return calls.where(closed & (ms >= 0)).select("run_id", "id", "tool_key", ms.alias("duration_ms"))


def _gap(kind: str, related: Column, index: Column) -> list[Column]:
    return [
        F.col("run_id"), F.lit(kind).alias("gap_type"), text(kind).alias("message"),
        related.alias("related_event_ids"), index.cast("bigint").alias("detected_at_index"),
    ]


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def _run_ends(tl: DataFrame) -> DataFrame:
    return tl.groupBy("run_id").agg(
        F.bool_or(F.col("type") == "run.start").alias("has_start"),
        F.bool_or(F.col("type") == "run.end").alias("has_end"),
        F.max("idx").alias("last_idx"),
    )


def gap_missing_run_start(tl: DataFrame) -> DataFrame:
    return _run_ends(tl).where(~F.col("has_start")).select(
        *_gap("missing_run_start", _no_ids(), F.lit(0)))


def gap_missing_run_end(tl: DataFrame) -> DataFrame:
    return _run_ends(tl).where(~F.col("has_end")).select(
        *_gap("missing_run_end", _no_ids(), F.col("last_idx")))


def gap_unclosed_tool(calls: DataFrame) -> DataFrame:
    """A start that is the last event of its run and key."""
    return calls.where((F.col("type") == "tool.call.start") & F.col("next_event").isNull()).select(
        *_gap("unclosed_tool_call", F.array("id"), F.col("idx")))


def gap_orphan_tool_end(calls: DataFrame) -> DataFrame:
    """An end with no earlier start of its run and key."""
    orphan = (F.col("type") == "tool.call.end") & (F.coalesce("started", F.lit(0)) == 0)
    return calls.where(orphan).select(*_gap("orphan_tool_end", F.array("id"), F.col("idx")))


def gap_unclosed_approval(tl: DataFrame) -> DataFrame:
    """A request no later decision points at. Decisions are reduced to one row per request first."""
    decided = (
        tl.where(F.col("type").isin("approval.granted", "approval.denied") & F.col("parent_event_id").isNotNull())
        .groupBy("run_id", F.col("parent_event_id").alias("id"))
        .agg(F.max("idx").alias("decided_idx"))
    )
    requests = tl.where(F.col("type") == "approval.requested").select("run_id", "id", "idx")
    still_open = requests.join(decided, ["run_id", "id"], "left").where(
        F.col("decided_idx").isNull() | (F.col("decided_idx") <= F.col("idx")))
    return still_open.select(
        *_gap("unclosed_approval", F.array("id"), F.col("idx")))


def timeline_gaps(tl: DataFrame) -> DataFrame:
    """All five kinds of gap, one row each."""
    calls = tool_calls(tl)
    ends = _run_ends(tl).withColumn("gap", F.explode(F.array_compact(F.array(
        F.when(~F.col("has_start"), F.struct(
            F.lit("missing_run_start").alias("kind"),
            text("missing_run_start").alias("message"),
            F.lit(0).cast("bigint").alias("idx"))),
        F.when(~F.col("has_end"), F.struct(
            F.lit("missing_run_end").alias("kind"),
            text("missing_run_end").alias("message"),
            F.col("last_idx").alias("idx"))),
    )))).select("run_id", F.col("gap.kind").alias("gap_type"), F.col("gap.message").alias("message"),
                _no_ids().alias("related_event_ids"), F.col("gap.idx").alias("detected_at_index"))
    starts = (F.col("type") == "tool.call.start") & F.col("next_event").isNull()
    orphans = (F.col("type") == "tool.call.end") & (F.coalesce("started", F.lit(0)) == 0)
    tools = calls.where(starts | orphans).select(
        "run_id",
        F.when(starts, "unclosed_tool_call").otherwise("orphan_tool_end").alias("gap_type"),
        F.when(starts, text("unclosed_tool_call")).otherwise(text("orphan_tool_end")).alias("message"),
        F.array("id").alias("related_event_ids"), F.col("idx").alias("detected_at_index"))
    return ends.unionByName(tools).unionByName(gap_unclosed_approval(tl))


def gaps_by_index(gaps: DataFrame) -> DataFrame:
    """Gaps shown at a position; a missing start or end stands before or after the list."""
    place = (
        F.when(F.col("gap_type") == "missing_run_start", "before")
        .when(F.col("gap_type") == "missing_run_end", "after")
        .otherwise("inline")
    )
    # At most one gap per kind and position, so the list is short.
    return gaps.groupBy("run_id", F.col("detected_at_index").alias("idx"), place.alias("place")).agg(
        F.count("*").alias("gap_count"), F.array_sort(F.collect_list("gap_type")).alias("gap_types"))


def tool_sketches(tl: DataFrame, keys: list[str] | None = None, precision: int = SKETCH) -> DataFrame:
    """One HyperLogLog sketch of the tools started per run, or per other `keys` such as run and batch; kept, they merge later."""
    started = tl.where(F.col("type") == "tool.call.start")
    # a start without a tool name counts as one more tool
    return started.groupBy(*(keys or ["run_id"])).agg(F.hll_sketch_agg(F.coalesce(F.concat(F.lit("t:"), "tool_name"), F.lit("none")), precision).alias("tools"))


def merge_tool_sketches(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sketches of slices or batches as one per run, and the estimated number of tools."""
    merged = sketches.groupBy(*(keys or ["run_id"])).agg(F.hll_union_agg("tools").alias("tools"))
    return merged.withColumn("tool_count", F.hll_sketch_estimate("tools"))


def run_summary(tl: DataFrame, gaps: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """One row per run, as the head of a replay view.

    With `approx`, tools are counted by sketches: one aggregate instead of two with all names shuffled, for an error of about
    1.6 % (one standard deviation); counts of a few hundred are nearly always exact.
    """
    is_end = F.col("type") == "run.end"
    per_run = tl.groupBy("run_id").agg(
        F.min_by("tenant_id", "idx").alias("tenant_id"),
        F.count("*").alias("event_count"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.min_by(F.struct("end_status"), F.when(is_end, F.col("idx")))["end_status"].alias("status"),
        F.bool_or(F.col("type").isin(ERROR_TYPES)).alias("has_errors"),
    )
    tools = (
        tl.where(F.col("type") == "tool.call.start").select("run_id", "tool_name").distinct()
        .groupBy("run_id").agg(F.count("*").alias("tool_count"))
    )
    if approx:
        tools = merge_tool_sketches(tool_sketches(tl)).select("run_id", "tool_count")
    with_gaps = (timeline_gaps(tl) if gaps is None else gaps).groupBy("run_id").agg(F.count("*").alias("gap_count"))
    zero = F.lit(0).cast("bigint")
    return (
        per_run.join(tools, "run_id", "left").join(with_gaps, "run_id", "left")
        .select(
            "run_id", "tenant_id", "event_count", "start_time", "end_time",
            millis_between("start_time", "end_time").alias("duration_ms"), "status", "has_errors",
            F.coalesce("tool_count", zero).alias("tool_count"),
            F.coalesce("gap_count", zero).alias("gap_count"),
            (F.coalesce("gap_count", zero) > 0).alias("has_gaps"),
        )
    )


def event_type_counts(ev: DataFrame) -> DataFrame:
    """Map from event type to number of events, per run (at most one entry per type)."""
    return (
        ev.groupBy("run_id", "type").agg(F.count("*").alias("n"))
        .groupBy("run_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("event_type_counts"))
    )


def event_type_counts_wide(ev: DataFrame) -> DataFrame:
    """The same counts with one column per type."""
    return ev.groupBy("run_id").agg(
        *[F.count_if(F.col("type") == t).alias(t.replace(".", "_")) for t in EVENT_TYPES])


def child_event_ids(tl: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Ids of the direct children of each event in timeline order; `[]` for none.

    A parent with more than `part_size` children has several rows (part 0, 1, ...).
    """
    children = tl.where(F.col("parent_event_id").isNotNull()).select(
        "run_id", F.col("parent_event_id").alias("parent_id"), "idx", F.col("id").alias("child_id"), *_kept_slice(tl))
    listed = lists(children, ["run_id", "parent_id"], [F.col("idx")], "child_id", "child_event_ids", part_size)
    return (
        tl.select("run_id", "id").join(listed.withColumnRenamed("parent_id", "id"), ["run_id", "id"], "left")
        .select("run_id", "id", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
                F.coalesce("child_event_ids", _no_ids()).alias("child_event_ids"))
    )


def ancestor_hops(links: DataFrame, keys: list[str]) -> DataFrame:
    """Hops from each node to the end of its parent chain, by pointer doubling.

    `links` has the keys, `id` and `parent`. A parent that is not a node counts as a last
    hop. Nodes on or behind a cycle get null. The number of rounds is the logarithm of the
    longest chain: a round in which no node comes to its end leaves only cycles.
    """
    state = links.select(
        *keys, "id", F.col("parent").alias("anc"), F.col("parent").isNotNull().cast("bigint").alias("hops"))
    state = cut_lineage(state)
    active = state.where(F.col("anc").isNotNull()).count()
    while active:
        moving = state.where(F.col("anc").isNotNull())
        target = state.select(
            *keys, F.col("id").alias("anc"), F.col("anc").alias("next_anc"), F.col("hops").alias("next_hops"))
        moved = moving.join(target, [*keys, "anc"], "left").select(
            *keys, "id", F.col("next_anc").alias("anc"),
            (F.col("hops") + F.coalesce("next_hops", F.lit(0))).alias("hops"))
        state = cut_lineage(state.where(F.col("anc").isNull()).unionByName(moved))
        left = state.where(F.col("anc").isNotNull()).count()
        if left == active:
            break
        active = left
    return state.select(*keys, "id", F.when(F.col("anc").isNull(), F.col("hops")).alias("hops"))


def causal_depth(ev: DataFrame) -> DataFrame:
    """Number of parent hops of each event inside its run.

    Only events that are somebody's parent take part in the rounds; all others are one hop
    below their parent.
    """
    rows = ev.select("run_id", "id", F.col("parent_event_id").alias("parent"))
    parents = rows.where(F.col("parent").isNotNull()).select("run_id", F.col("parent").alias("id")).distinct()
    inner = ancestor_hops(rows.join(parents, ["run_id", "id"], "left_semi"), ["run_id"])
    found = inner.select("run_id", F.col("id").alias("parent"), (F.col("hops") + 1).alias("below"), F.lit(True).alias("known"))
    depth = (
        F.when(F.col("parent").isNull(), F.lit(0))
        .when(F.col("known"), F.col("below"))
        .otherwise(F.lit(1))
    )
    return rows.join(found, ["run_id", "parent"], "left").select("run_id", "id", depth.cast("bigint").alias("depth"))


def timeline(ev: DataFrame) -> DataFrame:
    """Timeline entries: place, depth, number of direct children, duration of tool starts.

    The children themselves are in `child_event_ids`.
    """
    tl = timeline_index(ev)
    children = (
        tl.where(F.col("parent_event_id").isNotNull())
        .groupBy("run_id", F.col("parent_event_id").alias("id")).agg(F.count("*").alias("child_count"))
    )
    return (
        tl.join(causal_depth(ev), ["run_id", "id"], "left")
        .join(children, ["run_id", "id"], "left")
        .join(tool_durations(tool_calls(tl)).select("run_id", "id", "duration_ms"), ["run_id", "id"], "left")
        .select("run_id", "id", "type", "timestamp", "idx", "depth",
                F.coalesce("child_count", F.lit(0).cast("bigint")).alias("child_count"), "duration_ms",
                *_kept_slice(tl))
    )


def duration_share(entries: DataFrame, summary: DataFrame) -> DataFrame:
    """Bar length in percent, between 2 and 100, on the scale of the run or else its longest entry."""
    longest = entries.groupBy("run_id").agg(F.max("duration_ms").alias("longest_ms"))
    scale = summary.select("run_id", F.col("duration_ms").alias("run_ms")).join(longest, "run_id", "left").select(
        "run_id",
        F.when(F.col("run_ms") > 0, F.col("run_ms")).when(F.col("longest_ms") > 0, F.col("longest_ms")).alias("scale_ms"))
    share = F.least(F.lit(100.0), F.greatest(F.lit(2.0), F.col("duration_ms") / F.col("scale_ms") * 100))
    return (
        entries.where(F.col("duration_ms").isNotNull()).join(scale, "run_id")
        .select("run_id", "id", "duration_ms", F.when(F.col("scale_ms").isNotNull(), share).alias("share"))
    )


def arrival_disorder(ev: DataFrame, rank_rows: int = 1_000_000) -> DataFrame:
    """Arrival place against timeline place; late = arrived after an event with later source time."""
    tl = timeline_index(ev)
    arrivals = tl.select("run_id", "id", "idx", "timestamp", "ingestion_order")
    if SLICE in tl.columns:
        # Arrival order needs slices of its own: numbered by blocks of the arrival sequence.
        bounds = arrivals.groupBy("run_id").agg(F.min("ingestion_order").alias("lo"), F.max("ingestion_order").alias("hi"), F.count("*").alias("n"))
        width = F.expr(f"greatest(1, (hi - lo) div ceil(n / {rank_rows}) + 1)")
        arrivals = arrivals.join(bounds, "run_id").withColumn(SLICE, F.expr("(ingestion_order - lo)") / width)
        arrivals = arrivals.withColumn(SLICE, F.floor(SLICE)).drop("lo", "hi", "n")
    placed = scan(arrivals, ["run_id"], [F.col("ingestion_order")],
                  arrival_idx=position(), latest_before=max_before(F.col("timestamp")))
    return placed.select("run_id", "id", "arrival_idx", F.col("idx").alias("timeline_idx"),
                         F.coalesce(F.col("latest_before") > F.col("timestamp"), F.lit(False)).alias("is_late"))

"""Timelines: golden runs, random pairing against a state machine, skewed runs, any arrival order."""

import random

import pytest
from compare import BASE
from pyspark.sql import functions as F
from rows import collected, event, frame

from runledger.operators import checks, evidence, lineage, runs, timeline
from runledger.plans.testbed import canonical_events


def _summary(spark, events):
    return timeline.run_summary(timeline.timeline_index(frame(spark, events))).collect()[0]


def _gaps(spark, events):
    return collected(timeline.timeline_gaps(timeline.timeline_index(frame(spark, events))), "gap_type", "detected_at_index")


def test_simple_chat(spark):
    kinds = ["run.start", "prompt.input", "model.request", "model.response", "prompt.output"]
    events = [event(i, k, i * 500) for i, k in enumerate(kinds)] + [event(9, "run.end", 2500, status="success")]
    s = _summary(spark, events)
    assert (s["event_count"], s["status"], s["tool_count"], s["duration_ms"], s["has_gaps"], s["has_errors"]) == (6, "success", 0, 2500, False, False)


def test_partial_telemetry(spark):
    events = [event(1, "prompt.input", 300, seq=3), event(2, "prompt.output", 500, seq=5), event(3, "tool.call.end", 700, seq=7, toolName="x"),
              event(4, "model.request", 400, seq=4), event(5, "annotation", 900, seq=9)]
    order = timeline.timeline_index(frame(spark, events)).orderBy("idx").select("sequence").collect()
    assert [r[0] for r in order] == [3, 4, 5, 7, 9]
    assert _gaps(spark, events) == [("missing_run_end", 4), ("missing_run_start", 0), ("orphan_tool_end", 3)]
    assert _summary(spark, events)["status"] is None


def test_approval_denied(spark):
    events = [event(1, "run.start", 0), event(2, "approval.requested", 3000), event(3, "approval.denied", 330_000, parent="e2"),
              event(4, "run.end", 333_000, status="cancelled")]
    assert _gaps(spark, events) == []
    depth = dict(collected(timeline.causal_depth(frame(spark, events)), "id", "depth"))
    assert depth["e3"] == 1
    assert _summary(spark, events)["duration_ms"] == 333_000


def test_error_run(spark):
    events = [event(1, "run.start", 0), event(2, "tool.call.start", 1000, toolName="db"), event(3, "tool.call.error", 3000, toolName="db"),
              event(4, "run.error", 4000, fatal=True), event(5, "run.end", 6000, status="failure")]
    tl = timeline.timeline_index(frame(spark, events))
    assert collected(timeline.tool_durations(timeline.tool_calls(tl)), "id", "duration_ms") == [("e2", 2000)]
    assert _summary(spark, events)["has_errors"] is True


def test_ties_by_sequence_then_arrival(spark):
    events = [event(1, "custom", 0, seq=None, arrival=1), event(2, "custom", 0, seq=6, arrival=2), event(3, "custom", 0, seq=1, arrival=9),
              event(4, "custom", 0, seq=None, arrival=0)]
    order = timeline.timeline_index(frame(spark, events)).orderBy("idx").collect()
    assert [r["id"] for r in order] == ["e3", "e2", "e4", "e1"]


def test_delegation(spark):
    events = [event(1, "run.start", 0, run="p"), event(2, "run.end", 50, run="p", status="success"),
              event(3, "run.start", 10, run="c", parentRunId="p"), event(4, "run.end", 20, run="c", status="success")]
    ev = frame(spark, events)
    assert collected(lineage.delegation_edges(ev), "source", "target") == [("run:p", "run:c")]
    assert collected(runs.delegation_points(runs.build_runs(ev)), "parent_run_id", "child_run_id", "child_status") == [("p", "c", "success")]


def test_run_policies(spark):
    events = [event(1, "custom", 0, arrival=1), event(2, "run.start", 5, arrival=2, runName="late"), event(3, "run.end", 9, arrival=3, status="success"),
              event(4, "run.error", 12, arrival=4, fatal=True)]
    ev = frame(spark, events)
    merged, first = runs.build_runs(ev).collect()[0], runs.build_runs(ev, "first").collect()[0]
    assert (merged["run_name"], merged["status"], merged["ended_at"]) == ("late", "failure", None)
    assert first["run_name"] is None and first["status"] == "failure" and first["ended_at"] is not None


def test_depth_cycle_and_missing_parent(spark):
    events = [event(1, "custom", 0, parent="e2"), event(2, "custom", 1, parent="e1"), event(3, "custom", 2, parent="e2"),
              event(4, "custom", 3, parent="gone"), event(5, "custom", 4, parent="e4"), event(6, "custom", 5)]
    events += [event(i, "custom", i, parent=f"e{i - 1}") for i in range(7, 40)]
    depth = dict(collected(timeline.causal_depth(frame(spark, events)), "id", "depth"))
    assert [depth[f"e{i}"] for i in (1, 2, 3, 4, 5, 6)] == [None, None, None, 1, 2, 0]
    assert depth["e39"] == 33


def _pairing(events):
    """Brute force: open starts per key, in order."""
    open_at, durations, orphans, started = {}, {}, [], set()
    for e in events:
        key = e[2]
        if e[1] == "tool.call.start":
            open_at[key] = e
            started.add(key)
        else:
            if e[1] == "tool.call.end" and key not in started:
                orphans.append(e[0])
            if key in open_at:
                start = open_at.pop(key)
                durations[start[0]] = e[3] - start[3]
    return durations, sorted(orphans), sorted(e[0] for e in open_at.values())


@pytest.mark.parametrize("seed", range(2))
def test_pairing_random(spark, seed):
    rng = random.Random(seed)
    plain = [(f"e{i}", rng.choice(["tool.call.start", "tool.call.end", "tool.call.error"]), rng.choice("abc"), i * 10) for i in range(300)]
    rows = [event(int(i[1:]), kind, at, toolName=key) for i, kind, key, at in plain]
    rng.shuffle(rows)
    tl = timeline.timeline_index(frame(spark, rows))
    calls = timeline.tool_calls(tl)
    durations, orphans, still_open = _pairing(plain)
    assert dict(collected(timeline.tool_durations(calls), "id", "duration_ms")) == durations
    assert sorted(r[0][0] for r in collected(timeline.gap_orphan_tool_end(calls), "related_event_ids")) == orphans
    assert sorted(r[0][0] for r in collected(timeline.gap_unclosed_tool(calls), "related_event_ids")) == still_open


@pytest.fixture(scope="module")
def both(spark):
    """The same events with and without slices; in the first, every longer run counts as large."""
    sf = f"{BASE}/sf0.001"
    skewed = canonical_events(spark, sf, max_rows=6)
    assert "slice" in skewed.columns
    return canonical_events(spark, sf), skewed


@pytest.mark.parametrize("build", [
    lambda ev: timeline.timeline_index(ev).select("id", "idx"),
    lambda ev: timeline.timeline_gaps(timeline.timeline_index(ev)),
    lambda ev: timeline.tool_durations(timeline.tool_calls(timeline.timeline_index(ev))),
    lambda ev: timeline.child_event_ids(timeline.timeline_index(ev)),
    lambda ev: timeline.arrival_disorder(ev, rank_rows=3),
    lambda ev: lineage.temporal_edges(ev),
    lambda ev: lineage.data_flow_edges(ev),
    lambda ev: checks.anomalies(ev),
    lambda ev: checks.compliance(ev),
    lambda ev: checks.run_context_text(ev, 5),
    lambda ev: evidence.integrity_chain(ev, max_rows=4),
])
def test_large_runs(both, build):
    plain, skewed = (build(ev) for ev in both)
    assert sorted(plain.columns) == sorted(skewed.columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, skewed.select(*plain.columns).collect()))


def test_arrival_order_does_not_matter(both):
    ev = both[0]
    shuffled = ev.withColumn("ingestion_order", F.xxhash64("id")).orderBy(F.rand(1))
    assert collected(timeline.timeline_index(ev), "id", "idx") == collected(timeline.timeline_index(shuffled), "id", "idx")


def test_tool_sketches(spark):
    """Sketches of parts merge to the count of the whole; the exact summary is the same but for the way tools are counted."""
    events = [event(0, "run.start", 0)] + [event(k, "tool.call.start", k, toolName=f"t{k % 37}") for k in range(1, 400)] + [event(900 + k, "tool.call.start", k, run="r2") for k in range(3)]
    tl = timeline.timeline_index(frame(spark, events))
    exact = {r["run_id"]: r["tool_count"] for r in timeline.run_summary(tl).collect()}
    rough = {r["run_id"]: r["tool_count"] for r in timeline.run_summary(tl, approx=True).collect()}
    assert exact == rough == {"r1": 37, "r2": 1}
    halves = [timeline.tool_sketches(tl.where(f"idx % 2 = {k}")) for k in (0, 1)]
    merged = {r["run_id"]: r["tool_count"] for r in timeline.merge_tool_sketches(halves[0].unionByName(halves[1])).collect()}
    assert merged == exact
    many = spark.range(200_000).selectExpr("'r' AS run_id", "'tool.call.start' AS type", "'n' || id AS tool_name")
    assert abs(timeline.merge_tool_sketches(timeline.tool_sketches(many)).first()["tool_count"] / 200_000 - 1) < 0.06

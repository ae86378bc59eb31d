"""Streams end with what the batch jobs give."""

import json
import os
import random

import pytest
from rows import DAY, collected, event, frame

from runledger.operators.normalize import normalization_stats, normalize
from runledger.operators.runs import page
from runledger.session import shared_dir
from runledger.sources.tables import read_raw_events
from runledger.streaming import jobs as J
from runledger.streaming import state


def _stream(spark, tmp, *batches):
    folder = f"{tmp}/in"
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(folder)
    return J.stream_events(spark, folder, max_files=1)


def test_open_tools_timeout(spark, tmp_path):
    tmp = str(tmp_path)
    hour = 3_600_000
    stream = _stream(spark, tmp,
                     [event(1, "tool.call.start", 0, toolName="a"), event(2, "tool.call.start", 10, toolName="b"), event(3, "tool.call.end", 40, toolName="b")],
                     [event(4, "tool.call.start", 9 * hour, run="r2", toolName="z")], [event(5, "tool.call.start", 20 * hour, run="r3", toolName="z")])
    J.stream_open_tools(stream, f"{tmp}/out", f"{tmp}/check").awaitTermination()
    got = collected(J.open_tools(spark, f"{tmp}/out", timeout_ms=hour), "start_id", "end_id", "duration_ms", "state")
    assert ("e2", "e3", 30, "closed") in got and ("e1", None, None, "unclosed") in got and ("e5", None, None, "open") in got


def test_open_tools_in_any_order(spark, tmp_path):
    """Ends before starts, a call hours behind in the last file, a repeated event: the pairs are those of source order."""
    hour, tmp = 3_600_000, str(tmp_path)
    pairs = [[event(2 * k, "tool.call.start", k * 1000, toolName="a"), event(2 * k + 1, "tool.call.end", k * 1000 + 7, toolName="a")] for k in range(1, 12)]
    late = [event(90, "tool.call.start", -19 * hour, toolName="b"), event(91, "tool.call.end", 5 - 19 * hour, toolName="b")]
    batches = [[p[1] for p in pairs[::-1]], [p[0] for p in pairs[6:]], [p[0] for p in pairs[:6]], [late[1], pairs[0][0]], [late[0]]]
    J.stream_open_tools(_stream(spark, tmp, *batches), f"{tmp}/out", f"{tmp}/check").awaitTermination()
    got = collected(J.open_tools(spark, f"{tmp}/out"), "start_id", "end_id", "duration_ms", "state")
    assert sorted(got) == sorted([(f"e{2 * k}", f"e{2 * k + 1}", 7, "closed") for k in range(1, 12)] + [("e90", "e91", 5, "closed")])


@pytest.fixture
def one_task(spark):
    """Many small batches need one task each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _plain_pairs(events):
    """Starts with what follows them in their run and tool, by order of time."""
    out, by_key = [], {}
    for e in {e[0]: e for e in reversed(events)}.values():
        by_key.setdefault((e[1], json.loads(e[8])["toolName"]), []).append(e)
    for (run, tool), own in by_key.items():
        own.sort(key=lambda e: (e[12], e[14]))
        for a, b in zip(own, [*own[1:], None], strict=True):
            if a[3] == "tool.call.start" and (b is None or b[3] != "tool.call.start"):
                out.append((run, tool, a[0], b and b[0]))
    return sorted(out, key=repr)


def test_open_tools_over_many_batches(spark, tmp_path, monkeypatch, one_task):
    """20 batches with late and repeated events, chunks of four: pairs as by a plain sort, and no batch touches more state than another."""
    monkeypatch.setattr(state, "CHUNK", 4)
    rng, events = random.Random(1), []
    for k in range(400):
        kind = rng.choice(["tool.call.start", "tool.call.end", "tool.call.error"])
        events.append(event(k, kind, rng.randrange(10**6), run=f"r{rng.randrange(3)}", toolName=rng.choice("ab")))
    rng.shuffle(events)
    batches = [events[k: k + 20] + ([events[k - 5]] if k else []) for k in range(0, 400, 20)]
    tmp = str(tmp_path)
    query = J.stream_open_tools(_stream(spark, tmp, *batches), f"{tmp}/out", f"{tmp}/check")
    query.awaitTermination()
    assert collected(J.open_tools(spark, f"{tmp}/out"), "run_id", "tool_key", "start_id", "end_id") == _plain_pairs(events)
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["numInputRows"]]
    assert len(updated) == 20
    assert max(updated[-10:]) <= 1.5 * max(updated[:10]) + 30


def test_open_tools_reminder(spark):
    """A timer gives a start that is still open."""
    class Value:
        def exists(self):
            return True

        def get(self):
            return (json.dumps({"events": [[5, 0, 1, False, "e1"], [9000, 0, 2, True, "e2"]]}),)

    job = state.OpenTools(1000)
    job.whole, job.chunks, job.ids = Value(), None, None
    assert [(r["start_id"], r["state"]) for r in job.handleExpiredTimer(("r", "t"), None, None)] == [("e2", "unclosed")]


def test_dedupe_touches_only_its_ids(spark, tmp_path, one_task):
    """20 batches, each with ids of before: every id once, and as many state rows are written for the last batch as for the first."""
    tmp = str(tmp_path)
    batches = [[event(20 * b + i, "custom", i) for i in range(20)] + [event(max(0, 20 * b - 7), "custom", 1)] for b in range(20)]
    query = J.stream_dedupe(_stream(spark, tmp, *batches), f"{tmp}/out", f"{tmp}/check")
    query.awaitTermination()
    assert len(collected(spark.read.parquet(f"{tmp}/out").distinct(), "id")) == spark.read.parquet(f"{tmp}/out").count() == 400
    updated = {p["stateOperators"][0]["numRowsUpdated"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["numInputRows"]}
    assert updated == {20}


def test_dedupe_takes_the_first_arrival(spark, tmp_path):
    tmp = str(tmp_path)
    batch = [event(1, "custom", k, arrival=9 - k, tag=k) for k in range(8)] + [event(2, "custom", 5)]
    batch = [(*e[:13], None if e[0] == "e2" else DAY, e[14]) for e in batch]
    J.stream_dedupe(_stream(spark, tmp, batch), f"{tmp}/out", f"{tmp}/check").awaitTermination()
    assert collected(spark.read.parquet(f"{tmp}/out"), "id", "ingestion_order") == [("e1", 2), ("e2", 2)]


def test_dedupe_keeps_ids_alone_as_state(spark, tmp_path):
    """Copies of one id in many pieces, an id that is missing, numbers beyond 2^53; no Python state call per id."""
    tmp, big = str(tmp_path), 2**60
    batch = [event(1, "custom", 5, arrival=big + 1 + k, tag=k) for k in (*range(1, 300), 0)] + [event(2, "custom", 5, arrival=k) for k in (9, 8)]
    batch += [(None, *event(0, "custom", 1, arrival=k)[1:]) for k in (4, 3)]
    folder = f"{tmp}/in"
    frame(spark, batch).repartition(7).write.parquet(folder)
    query = J.stream_dedupe(J.stream_events(spark, folder), f"{tmp}/out", f"{tmp}/check")
    query.awaitTermination()
    assert collected(spark.read.parquet(f"{tmp}/out"), "id", "ingestion_order") == sorted([("e1", big + 1), ("e2", 8), (None, 3)], key=repr)
    assert {p["stateOperators"][0]["operatorName"] for p in map(json.loads, (p.json for p in query.recentProgress)) if p["numInputRows"]} == {"dedupe"}


def test_more_rows_make_more_files_not_more_batches(spark, monkeypatch):
    from runledger.plans import stream_queries as Q

    ev = frame(spark, [event(k, "custom", k) for k in range(500)])
    assert Q._event_files(ev)[1] == 1
    monkeypatch.setattr(Q, "FILE_ROWS", 20)
    folder, files = Q._event_files(ev)
    assert files == 5 and spark.read.parquet(folder).count() == 500
    written = len([n for n in os.listdir(folder) if n.endswith(".parquet")])
    assert 6 * files - 6 <= written <= 6 * files


def test_otlp_inlet(spark, tmp_path):
    """Exports come as span events; text that is not JSON ends as a dead letter."""
    tmp = str(tmp_path)
    span = {"traceId": "t1", "spanId": "s1", "name": "execute_tool", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001000000000",
            "attributes": [{"key": "gen_ai.tool.name", "value": {"stringValue": "grep"}}], "status": {"code": 0}}
    export = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}]}]}
    os.makedirs(f"{tmp}/in")
    with open(f"{tmp}/in/a.json", "w") as f:
        f.write(json.dumps(export) + "\nnot json\n")
    J.stream_normalize(J.stream_otlp(spark, f"{tmp}/in", "t"), f"{tmp}/out", f"{tmp}/dead", f"{tmp}/check").awaitTermination()
    assert collected(spark.read.parquet(f"{tmp}/out"), "id", "type", "run_id") == [("s1", "tool.call.start", "t1"), ("s1:end", "tool.call.end", "t1")]
    assert collected(spark.read.parquet(f"{tmp}/dead"), "data") == [("not json",)]


def test_dedupe_keeps_all_new_ids(spark, tmp_path):
    tmp = str(tmp_path)
    batches = [[event(20 * b + i, "custom", (5 - b) * 10**8 + i) for i in range(20)] + [event(0, "custom", 1)] for b in range(5)]
    J.stream_dedupe(_stream(spark, tmp, *batches), f"{tmp}/out", f"{tmp}/check").awaitTermination()
    assert len(collected(spark.read.parquet(f"{tmp}/out"), "id")) == 100


def test_dedupe_after_restart(spark, tmp_path):
    tmp = str(tmp_path)
    stream = _stream(spark, tmp, [event(1, "custom", 0), event(2, "custom", 1)])
    J.stream_dedupe(stream, f"{tmp}/out", f"{tmp}/check").awaitTermination()
    stream = _stream(spark, tmp, [event(2, "custom", 1), event(1, "custom", 10**10), event(3, "custom", 2)])
    J.stream_dedupe(stream, f"{tmp}/out", f"{tmp}/check").awaitTermination()
    assert collected(spark.read.parquet(f"{tmp}/out"), "id") == [("e1",), ("e2",), ("e3",)]


def test_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(i % 3, f"k{i:02d}") for i in range(20)], "rank int, id string")
    seen, cursor = [], None
    while True:
        rows = page(df, [("rank", True), ("id", False)], 6, cursor).collect()
        rows.sort(key=lambda r: (-r["rank"], r["id"]))
        seen += [(r["rank"], r["id"]) for r in rows]
        if not rows[-1]["has_more"]:
            break
        cursor = [rows[-1]["rank"], rows[-1]["id"]]
    assert seen == sorted(((i % 3, f"k{i:02d}") for i in range(20)), key=lambda x: (-x[0], x[1]))


def test_shared_dir_from_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_counts_of_batches(spark, tmp_path):
    """Observed counts of all batches add up to those of the batch operator."""
    tmp = str(tmp_path)
    rows = [{"vendor": "openai-codex", "data": {"type": t, "sessionId": "s"}, "tenantId": "t"} for t in ("codex.session.start", "codex.other", "codex.message", "codex.session.end", "codex.nothing")]
    os.makedirs(f"{tmp}/in")
    for k, row in enumerate(rows):
        with open(f"{tmp}/in/{k}.json", "w") as f:
            f.write(json.dumps(row) + "\n")
    J.stream_normalize(J.stream_raw_events(spark, f"{tmp}/in", max_files=2), f"{tmp}/out", f"{tmp}/dead", f"{tmp}/check", stats=f"{tmp}/stats").awaitTermination()
    names = ["processed", "succeeded", "failed", "dead_lettered"]
    counts = spark.read.parquet(f"{tmp}/stats")
    assert counts.count() == 3
    whole = normalization_stats(normalize(read_raw_events(spark, f"{tmp}/in"))).first()
    assert [counts.groupBy().sum(n).first()[0] for n in names] == [whole[n] for n in names]
    assert whole["failed"] == 2


def test_input_files_are_compressed_and_small(spark, tmp_path):
    """Files a stream picks up have a bounded number of rows, come in as many batches as asked for, and hold every row once."""
    from pyspark.sql import functions as F

    from runledger.plans.stream_queries import LEAST_FILE_ROWS, _json_files

    path = f"{tmp_path}/in"
    files_each = _json_files(spark.range(0, 6 * LEAST_FILE_ROWS, 1, 3), 6 * LEAST_FILE_ROWS, path, 3)
    files = spark.read.text(path).inputFiles()
    assert all(f.endswith(".json.gz") for f in files) and -(-len(files) // files_each) == 3
    rows = spark.read.schema("id BIGINT").json(path)
    assert rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= LEAST_FILE_ROWS
    assert rows.count() == rows.distinct().count() == 6 * LEAST_FILE_ROWS

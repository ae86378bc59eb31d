"""What steps send through shuffles, write and compute beside what is asked for."""

import os
from zlib import crc32

from pyspark.sql import functions as F

from runledger.operators import evidence as E
from runledger.operators import normalize as N
from runledger.plans import stream_queries
from runledger.plans.catalog import QUERIES

LINES = [(f"b{crc32(str(i).encode()) % 5}", s, i, f'{{"n":{i % 7}}}') for i in range(300) for s in ("events", "header")]
RAW = "vendor string, data string, received_at timestamp, tenant_id string, run_id string"


def test_sections_are_shuffled_once(spark):
    lines = spark.createDataFrame([*LINES, (None, "events", 1, "{}")], "bundle_id string, section string, position bigint, line string")
    short = E.section_hashes(lines)
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    both, long = E.section_hashes(lines, max_lines=60), E.section_hashes(lines, max_lines=0)
    assert sorted(short.collect(), key=str) == sorted(both.collect(), key=str) == sorted(long.collect(), key=str)


def test_only_what_is_asked_is_normalized(spark):
    raw = spark.createDataFrame([], RAW)
    plan = N.normalization_stats(N.normalize(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert " AS x_kind#" in plan and " AS x_resource#" not in plan and " AS x_agent#" not in plan
    assert "resourceAttributes" not in N.route_adapter(raw)._jdf.queryExecution().analyzed().toString()


def test_columns_beside_the_raw_ones_do_no_harm(spark):
    raw = spark.createDataFrame([("openai-agents", '{"type":"agent.start","data":{}}', None, "t", None)], RAW)
    odd = raw.withColumns({"type": F.lit("x"), "payload": F.lit("y"), "id": F.lit("z")})
    assert N.normalize(odd).collect() == N.normalize(raw).collect()


def test_raw_events_are_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "_folder", lambda _: str(tmp_path / "raw"))
    QUERIES["read_raw_events"](spark, os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001")
    parts = [p for p in os.listdir(tmp_path / "raw") if p.startswith("part-")]
    assert parts and all(p.endswith(".json.gz") for p in parts)

"""Hash chains and export documents: values, tampering."""

import hashlib
import json
import re
import time

from pyspark.sql import functions as F
from rows import collected, event, frame

from runledger.operators import evidence as E
from runledger.operators import graph as G
from runledger.operators.runs import build_runs


def _events():
    return [event(1, "run.start", 0, zeta=1, alpha={"b": 2, "a": [1, "x"]}), event(2, "tool.call.start", 5, toolName="t"),
            event(3, "run.end", 9, status="success")]


def test_chain_values(spark):
    last = ""
    for e, row in zip(_events(), E.integrity_chain(frame(spark, _events())).orderBy("idx").collect()):
        time = e[12].strftime("%Y-%m-%dT%H:%M:%S.") + f"{e[12].microsecond // 1000:03d}Z"
        text = json.dumps(json.loads(e[8]), sort_keys=True, separators=(",", ":"))
        last = hashlib.sha256(f"{e[0]}|{time}|{text}|{last}".encode()).hexdigest()
        assert (row["event_id"], row["hash"]) == (e[0], last)


def test_bad_requests_and_documents(spark):
    ev = frame(spark, _events())
    runs = build_runs(ev)
    requests = spark.createDataFrame([("r1", "t"), ("r1", "other"), ("none", "t")], "run_id string, tenant_id string").selectExpr(
        "*", "timestamp'2024-06-01 00:00:00' AS created_at")
    bundles = E.assemble_bundles(ev, runs, requests)
    assert collected(bundles, "status", "error_message") == [
        ("complete", None), ("failed", "No such run: none"), ("failed", "Tenant other has no run r1")]
    lines = E.export_lines(bundles, ev, runs)
    documents = E.export_documents(lines)
    assert documents.count() == 1
    assert [r["is_valid"] for r in E.verify_exports(lines, documents).collect()] == [True]
    assert [r["is_valid"] for r in E.verify_exports(lines.where("section <> 'events' OR position < 2"), documents).collect()] == [False]
    assert E.validate_exports(lines).count() == 0


def test_documents_do_not_depend_on_each_other(spark):
    """A child run's document is the same alone and beside its parent's, and holds what its header counts."""
    p = [event(1, "run.start", 0, run="p"), event(2, "tool.call.start", 5, run="p", toolName="t"), event(3, "side_effect.executed", 6, run="p", effectType="w", targetSystem="s"), event(4, "run.end", 9, run="p", status="success")]
    c = [event(5, "run.start", 3, run="c", parent="e2", parentRunId="p"), event(6, "side_effect.executed", 4, run="c", effectType="w", targetSystem="s"), event(7, "run.end", 8, run="c", status="success")]
    ev = frame(spark, p + c)
    runs = build_runs(ev)

    def export(*ids):
        requests = spark.createDataFrame([(i, "t") for i in ids], "run_id string, tenant_id string").selectExpr("*", "timestamp'2024-06-01 00:00:00' AS created_at")
        bundles = E.assemble_bundles(ev, runs, requests).cache()
        lines = E.export_lines(bundles, ev, runs)
        counts = {(r["run_id"], r["section"]): r["n"] for r in lines.groupBy("run_id", "section").agg(F.count("*").alias("n")).collect()}
        for r in bundles.collect():
            assert counts[r["run_id"], "lineage.nodes"] == r["node_count"] and counts[r["run_id"], "lineage.edges"] == r["edge_count"]
        documents = E.export_documents(lines).join(bundles.select(F.col("id").alias("bundle_id"), "run_id"), "bundle_id")
        return {r["run_id"]: r["integrity_hash"] for r in documents.collect()}

    both = export("p", "c")
    assert export("c")["c"] == both["c"] and export("p")["p"] == both["p"]


def test_document_hashes(spark):
    """Hashes of all sections and documents against the same tree in plain Python, on the registered query's tables."""
    from compare import BASE

    from runledger.plans.catalog import QUERIES
    from runledger.plans.evidence_queries import _bundles
    from runledger.plans.testbed import canonical_events
    from runledger.session import cut_to_table

    sf = f"{BASE}/sf0.001"
    ev = cut_to_table(canonical_events(spark, sf))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    found = {}
    for r in E.export_lines(_bundles(ev), ev, build_runs(ev)).collect():
        found.setdefault((r["bundle_id"], r["section"]), []).append(sha(f"{r['position']}|{r['line']}"))

    def tree(hashes):
        for digits in (6, 3, 0):
            groups = {}
            for key, h in hashes if digits < 6 else [(h, h) for h in hashes]:
                groups.setdefault(key[:digits], []).append(h)
            hashes = [(key, sha("".join(sorted(group)))) for key, group in groups.items()]
        return hashes[0][1]

    sections = {key: tree(hashes) for key, hashes in found.items()}
    documents = {}
    for (bundle, section), h in sorted(sections.items(), key=lambda x: E.SECTIONS.index(x[0][1])):
        documents.setdefault(bundle, []).append(f"{section}:{h}")
    rows = QUERIES["export_integrity"](spark, sf).collect()
    assert {(r["bundle_id"], r["section"]): (r["section_hash"], r["section_lines"]) for r in rows} == {k: (sections[k], len(found[k])) for k in found}
    for r in rows:
        assert r["integrity_hash"] == sha("|".join(documents[r["bundle_id"]]))
        assert r["line_count"] == sum(len(h) for (b, _), h in found.items() if b == r["bundle_id"])
    assert len({r["section"] for r in rows}) == len(E.SECTIONS)


def _edges(spark, pairs):
    rows = [("causal", s, t, f"{s}-{t}") for s, t in pairs]
    return spark.createDataFrame(rows, "edge_type string, source string, target string, edge_id string")


def test_cycles(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("p", "q")])
    assert collected(G.causal_cycles(edges), "cycle_id", "node_id") == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")]


def test_reachability_with_cycle(spark):
    edges = _edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    starts = spark.createDataFrame([("a",), ("c",)], "node_id string")
    assert collected(G.descendants(edges, starts), "start_id", "node_id") == [("a", "a"), ("a", "b"), ("a", "c")]
    nodes = spark.createDataFrame([(n,) for n in "abc"], "node_id string")
    assert collected(G.causal_chain(nodes, edges, starts), "start_id", "position", "node_id") == [
        ("a", 0, "b"), ("a", 1, "a"), ("c", 0, "a"), ("c", 1, "b"), ("c", 2, "c")]


def test_stored_lines_leave_no_shuffle_files(spark):
    """Lines are read from storage however often they are asked for, and the shuffle files they were made with are gone."""
    ev = frame(spark, _events())
    runs = build_runs(ev)
    requests = runs.select(F.col("id").alias("run_id"), "tenant_id", F.lit("2024-06-01 00:00:00").cast("timestamp").alias("created_at"))
    bundles = E.assemble_bundles(ev, runs, requests)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n for n in re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" "))}

    before = shuffled()
    lines = E.export_lines(bundles, ev, runs, keep=("created_at",))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffled() - before
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert {r["created_at"] for r in lines.select("created_at").distinct().collect()} == {r["created_at"] for r in requests.collect()}


def test_verification_reads_stored_documents(spark, monkeypatch):
    """The hashes that were sealed are stored before they are compared, so the hash trees of both are not on disk together."""
    from compare import BASE

    from runledger.plans.catalog import QUERIES

    plans = []
    verify = E.verify_exports

    def seen(lines, documents):
        plans.append(documents._jdf.queryExecution().executedPlan().toString())
        return verify(lines, documents)

    monkeypatch.setattr(E, "verify_exports", seen)
    QUERIES["verify_exports"](spark, f"{BASE}/sf0.001")
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_section_hashes_of_nulls_and_long_sections(spark):
    """Sections are the same whether they count as long or not; a section without a name is one too."""
    lines = spark.createDataFrame([(f"b{i % 3}" if i % 3 else None, "events" if i % 2 else None, i, f"line {i}") for i in range(60)],
                                  "bundle_id string, section string, position long, line string")
    names = ("bundle_id", "section", "line_count", "section_hash")
    whole = collected(E.section_hashes(lines), *names)
    assert len(whole) == 6 and whole == collected(E.section_hashes(lines, max_lines=5), *names)

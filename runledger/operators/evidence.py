"""Evidence bundles: hash chains, assembly, export documents and their verification.

A bundle is one header row plus section tables keyed by run, so that no row has to hold a
whole run.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.ordered import SLICE, position, scan
from runledger.functions.payload import canonical_json, fields, iso_millis
from runledger.messages import text
from runledger.operators.lineage import data_flow_edges, graph_edges, graph_nodes
from runledger.operators.redact import redaction_hits
from runledger.operators.runs import page_size
from runledger.operators.timeline import causal_depth, timeline_gaps, timeline_index, timeline_order, tool_calls, tool_durations
from runledger.session import cut_lineage, cut_to_table, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

BUNDLE_SCHEMA_VERSION = "1.0.0"
EXPORT_SCHEMA_VERSION = "1.0.0"
EXPORT_FORMAT = "runledger-evidence-export"
BUNDLE_STATUSES = ["pending", "assembling", "complete", "failed"]
# Events of one run a task hashes in one go; longer runs are hashed in several rounds.
CHAIN_ROWS = 1_000_000
_CHAIN = "run_id string, idx long, event_id string, hash string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash sorted rows one after the other; only the last hash is kept between batches."""
    run, last, n = None, "", 0
    for batch in batches:
        hashes, places = [], []
        for run_id, message, carried, first in zip(batch["run_id"], batch["message"], batch["carried"], batch["first_idx"]):
            if run_id != run:
                run, last, n = run_id, carried, int(first)
            last = hashlib.sha256((message + last).encode()).hexdigest()
            hashes.append(last)
            places.append(n)
            n += 1
        yield pd.DataFrame({"run_id": batch["run_id"], "idx": places, "event_id": batch["id"], "hash": hashes})


def _hash_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Chain rows of `rows`, each run in one sorted stretch of a partition."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("run_id", "id", "message", "carried", "first_idx", *[c.alias(n) for c, n in zip(order, names)])
    return keyed.repartition("run_id").sortWithinPartitions("run_id", *names).drop(*names).mapInPandas(_fold, _CHAIN)


def integrity_chain(ev: DataFrame, max_rows: int = CHAIN_ROWS) -> DataFrame:
    """Hash of each event over its id, time, payload and the hash before it, in timeline order.

    Every hash needs the one before, so a run is a sequence by nature. Rows stream through
    in order with nothing kept but the last hash. A run of more than `max_rows` events is
    cut by its timeline index and hashed in rounds, each starting from the last hash of the round before.
    """
    message = F.concat_ws("|", "id", iso_millis("timestamp"), canonical_json("payload"), F.lit(""))
    if SLICE not in ev.columns:
        rows = ev.select("run_id", "id", "timestamp", "sequence", "ingestion_order", message.alias("message"),
                         F.lit("").alias("carried"), F.lit(0).cast("bigint").alias("first_idx"))
        return _hash_rows(rows, timeline_order())

    rows = ev.select("run_id", "id", "timestamp", "sequence", "ingestion_order", SLICE, message.alias("message"))
    placed = scan(rows, ["run_id"], timeline_order(), idx=position())
    folder = f"{shared_dir(ev.sparkSession)}/chain-{uuid.uuid4().hex}"
    spark = ev.sparkSession
    placed.select("run_id", "id", "message", "idx", F.expr(f"idx div {max_rows}").alias("round")).write.partitionBy("round").parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")
    rounds = stored.agg(F.max("idx")).first()[0]
    carried = None
    for n in range(0 if rounds is None else rounds // max_rows + 1):
        part = stored.where(F.col("round") == n)
        if carried is None:
            part = part.withColumn("carried", F.lit(""))
        else:
            part = part.join(carried, "run_id")
        part = part.withColumn("first_idx", F.lit(n * max_rows).cast("bigint"))
        _hash_rows(part, [F.col("idx")]).write.parquet(f"{folder}/chain/round={n}")
        done = spark.read.schema(_CHAIN).parquet(f"{folder}/chain/round={n}")
        carried = done.groupBy("run_id").agg(F.max_by("hash", "idx").alias("carried"))
    return spark.read.schema(_CHAIN + ", round int").parquet(f"{folder}/chain").drop("round")


def root_hash(chain: DataFrame) -> DataFrame:
    """Last hash of each run."""
    return chain.groupBy("run_id").agg(F.max_by("hash", "idx").alias("root_hash"), F.count("*").alias("chain_length"))


def verify_chain(ev: DataFrame, stored: DataFrame, bundles: DataFrame) -> DataFrame:
    """Check stored chains: valid, or where the chain first breaks with expected and actual value.

    `stored` holds the chain rows of the bundles, `bundles` has run_id and root_hash.
    """
    fresh = integrity_chain(ev)
    both = fresh.join(stored.select("run_id", "idx", F.col("hash").alias("stored_hash")), ["run_id", "idx"], "left")
    broken = F.struct("idx", "event_id", "hash", "stored_hash")
    first = both.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count("stored_hash").alias("matched"),
        F.min_by("event_id", "idx").alias("first_event"), F.max_by("event_id", "idx").alias("last_event"),
        F.max_by("hash", "idx").alias("last_hash"),
        F.min_by(broken, F.when(F.col("stored_hash") != F.col("hash"), F.col("idx"))).alias("b"))
    lengths = stored.groupBy("run_id").agg(F.count("*").alias("m"))
    rows = bundles.select("run_id", "root_hash").join(first, "run_id", "left").join(lengths, "run_id", "left")
    n, m = F.coalesce("n", F.lit(0).cast("bigint")), F.coalesce("m", F.lit(0).cast("bigint"))
    none = F.lit(None).cast("string")

    def verdict(valid: bool, index: Column, event: Column, expected: Column, actual: Column) -> Column:
        return F.struct(F.lit(valid).alias("valid"), index.cast("bigint").alias("broken_at_index"),
                        event.alias("broken_at_event_id"), expected.alias("expected_hash"), actual.alias("actual_hash"))

    fine = verdict(True, F.lit(None), none, none, none)
    result = (
        F.when((m == 0) & (n == 0), fine)
        .when(m == 0, verdict(False, F.lit(0), F.col("first_event"), F.lit("chain_missing"), none))
        .when(m != n, verdict(False, F.least(m, n), none, F.concat(F.lit("length:"), n), F.concat(F.lit("length:"), m)))
        .when(F.col("b").isNotNull(), verdict(False, F.col("b.idx"), F.col("b.event_id"), F.col("b.hash"), F.col("b.stored_hash")))
        .when((F.col("root_hash") != "") & (F.col("root_hash") != F.col("last_hash")),
              verdict(False, n - 1, F.col("last_event"), F.col("last_hash"), F.col("root_hash")))
        .otherwise(fine)
    )
    return rows.select("run_id", result.alias("r")).select("run_id", "r.*")


def snapshot_runs(runs: DataFrame) -> DataFrame:
    """Run fields as they are at assembly, times as text."""
    return runs.select(
        "id", F.struct(
            F.col("id").alias("runId"), F.col("tenant_id").alias("tenantId"), F.col("agent_id").alias("agentId"),
            F.col("run_name").alias("runName"), F.col("trigger_source").alias("triggerSource"),
            F.col("parent_run_id").alias("parentRunId"), "status", iso_millis("started_at").alias("startedAt"),
            iso_millis("ended_at").alias("endedAt"), "tags", "metadata",
            F.col("schema_version").alias("schemaVersion")).alias("run_metadata"))


def bundle_members(runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Runs whose events a bundle's graph holds: the run and its child runs; rows (graph_run, run_id)."""
    own = requested.select(F.col("run_id").alias("graph_run"), "run_id").distinct()
    children = runs.where(F.col("parent_run_id").isNotNull()).select(F.col("parent_run_id").alias("graph_run"), F.col("id").alias("run_id"))
    return own.unionByName(children.join(own.select("graph_run"), "graph_run", "left_semi")).distinct()


def bundle_graph_counts(ev: DataFrame, runs: DataFrame, requested: DataFrame) -> DataFrame:
    """Node and edge counts of the graph of each requested run with its child runs."""
    members = bundle_members(runs, requested)
    p = fields("payload", targetSystem="string")
    effect = F.col("type").startswith("side_effect.")
    rows = ev.select("run_id", "id", "parent_event_id", effect.alias("effect"), F.when(effect, p["targetSystem"]).alias("system")).join(members, "run_id")
    per_graph = rows.groupBy("graph_run").agg(
        F.count("*").alias("events"), F.count_if("effect").alias("effects"),
        F.count_distinct("run_id").alias("runs"), F.count_distinct("system").alias("systems"))
    known = rows.select("graph_run", F.col("id").alias("parent_event_id"))
    causal = rows.where(F.col("parent_event_id").isNotNull()).join(known, ["graph_run", "parent_event_id"], "left_semi").groupBy(
        "graph_run").agg(F.count("*").alias("causal"))
    flows = data_flow_edges(ev.join(members.select("run_id").distinct(), "run_id", "left_semi")).groupBy("run_id").agg(F.count("*").alias("n")).join(members, "run_id").groupBy(
        "graph_run").agg(F.sum("n").alias("flows"))
    place = F.struct(*timeline_order())
    starts = ev.where(F.col("type") == "run.start").groupBy("run_id").agg(
        F.min_by(F.struct(fields("payload", parentRunId="string")["parentRunId"].alias("parent")), place)["parent"].alias("parent"))
    in_graph = members.select("graph_run", F.col("run_id").alias("parent"))
    delegation = members.join(starts, "run_id").join(in_graph, ["graph_run", "parent"], "left_semi").groupBy(
        "graph_run").agg(F.count("*").alias("delegations"))
    out = per_graph.join(causal, "graph_run", "left").join(flows, "graph_run", "left").join(delegation, "graph_run", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.col("graph_run").alias("run_id"),
        (F.col("events") + F.col("effects") + F.col("runs") + F.col("systems")).alias("node_count"),
        (F.coalesce("causal", zero) + F.coalesce("flows", zero) + F.coalesce("delegations", zero)
         + 2 * F.col("effects") + F.col("events") - F.col("runs")).alias("edge_count"))


def assemble_bundles(ev: DataFrame, runs: DataFrame, requests: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """One header row per request (run_id, tenant_id, created_at); a bad request gives a failed bundle.

    Only the events of requested runs are worked on. The sections of a bundle are the rows
    of `export_lines` with its run id.
    """
    asked = requests.select("run_id").distinct()
    own = ev.join(asked, "run_id", "left_semi")
    tl = timeline_index(own)
    chain = integrity_chain(own) if chain is None else chain
    events = tl.groupBy("run_id").agg(F.count("*").alias("event_count"))
    gaps = timeline_gaps(tl).groupBy("run_id").agg(F.count("*").alias("gap_count"))
    depths = causal_depth(own).groupBy("run_id").agg(F.max("depth").alias("max_depth"))
    redacted = redaction_hits(own).groupBy("run_id").agg(F.count("*").alias("total_redacted_fields"))
    snapshots = snapshot_runs(runs).withColumnRenamed("id", "run_id")
    out = requests.select("run_id", "tenant_id", "created_at")
    for part in (snapshots, events, gaps, depths, redacted, bundle_graph_counts(ev, runs, asked), root_hash(chain)):
        out = out.join(part, "run_id", "left")
    meta = F.col("run_metadata")
    problem = (
        F.when(meta.isNull(), text("run_unknown"))
        .when(meta["tenantId"] != F.col("tenant_id"), text("run_of_other_tenant"))
    )
    out = out.withColumn("error_message", problem)
    good = F.col("error_message").isNull()
    partial = good & (meta["status"] == "running")
    zero = F.lit(0).cast("bigint")

    def count(name: str) -> Column:
        return F.when(good, F.coalesce(name, zero)).otherwise(zero).alias(name)

    note = text("run_unfinished")
    return out.withColumn("made_at", iso_millis("created_at")).select(
        F.sha2(F.concat_ws("|", "run_id", "tenant_id", iso_millis("created_at")), 256).alias("id"), "run_id", "tenant_id",
        F.when(good, "complete").otherwise("failed").alias("status"), "created_at",
        F.when(good, F.col("created_at")).alias("completed_at"), F.when(good, meta).alias("run_metadata"),
        count("event_count"), count("gap_count"), F.when(good, F.col("max_depth")).alias("max_depth"),
        count("node_count"), count("edge_count"), count("total_redacted_fields"),
        F.when(good, F.col("root_hash")).alias("root_integrity_hash"),
        F.coalesce(partial, F.lit(False)).alias("is_partial_run"), F.when(partial, note).alias("partial_run_marker"),
        "error_message", F.lit(BUNDLE_SCHEMA_VERSION).alias("bundle_schema_version"))


def list_bundles(bundles: DataFrame, run_id: str | None = None, tenant: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest bundles first; of a run or a tenant if given."""
    if run_id:
        bundles = bundles.where(F.col("run_id") == run_id)
    if tenant:
        bundles = bundles.where(F.col("tenant_id") == tenant)
    return bundles.orderBy(F.col("created_at").desc(), "id").limit(page_size(limit))


# ---- export documents ----------------------------------------------------------------------

# Sections of a document in the order they are hashed.
SECTIONS = ["header", "events", "timeline.entries", "timeline.gaps", "timeline.summary", "lineage.nodes",
            "lineage.edges", "redactionAudit"]


def _lines(df: DataFrame, section: str, place: Column, record: Column, run: str = "run_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select("bundle_id", F.col(run).alias("run_id"), F.lit(section).alias("section"), place.cast("bigint").alias("position"),
                     F.to_json(record, {"ignoreNullFields": "false"}).alias("line"), *keep)


def _event_record() -> Column:
    return F.struct(
        "id", F.col("run_id").alias("runId"), "type", iso_millis("timestamp").alias("timestamp"), "sequence",
        F.col("parent_event_id").alias("parentEventId"), F.col("tenant_id").alias("tenantId"),
        F.col("source_agent").alias("sourceAgent"), F.col("source_framework").alias("sourceFramework"),
        F.try_parse_json("payload").alias("payload"), "tags", F.col("schema_version").alias("schemaVersion"))


def export_lines(bundles: DataFrame, ev: DataFrame, runs: DataFrame, exported_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents of all complete bundles as lines: one JSON record per row, by section and position; with the columns `keep` of its bundle.

    The graph of a document is that of its run and the child runs, built for each document by itself, so
    it does not depend on what else is exported, and has as many lines as the header counts. A document is the lines of a bundle in section order; a run of any size is just more rows.
    Lines are stored section by section, so they can be read many times, and only one section's shuffle files exist at a time.
    """
    done = cut_lineage(bundles.where(F.col("status") == "complete"))
    keys = done.select(F.col("id").alias("bundle_id"), "run_id", *keep)
    exported = F.col("completed_at") if exported_at is None else exported_at
    header = F.struct(
        F.lit(EXPORT_FORMAT).alias("formatId"), F.lit(EXPORT_SCHEMA_VERSION).alias("schemaVersion"),
        iso_millis(exported).alias("exportedAt"),
        F.struct(F.col("id").alias("bundleId"), "status", iso_millis("created_at").alias("createdAt"),
                 iso_millis("completed_at").alias("completedAt"), F.col("is_partial_run").alias("isPartialRun"),
                 F.col("partial_run_marker").alias("partialRunMarker"),
                 F.col("bundle_schema_version").alias("bundleSchemaVersion")).alias("bundle"),
        F.col("run_metadata").alias("run"))
    members = cut_to_table(ev.join(bundle_members(runs, keys), "run_id"))  # sections read these events alone, without a join of their own
    own = members.where(F.col("graph_run") == F.col("run_id")).select(*ev.columns)
    tl = timeline_index(own)
    gaps = timeline_gaps(tl)
    depths = causal_depth(own)
    places = tl.select("run_id", "id", "idx")
    edge = gaps.select("run_id", F.explode("related_event_ids").alias("id")).distinct().withColumn("boundary", F.lit(True))
    entries = (
        places.join(depths, ["run_id", "id"]).join(tool_durations(tool_calls(tl)).select("run_id", "id", "duration_ms"), ["run_id", "id"], "left")
        .join(edge, ["run_id", "id"], "left"))
    gap_rows = gaps.select("run_id", "detected_at_index", "gap_type", F.try_element_at("related_event_ids", F.lit(1)).alias("before"))
    counts = own.groupBy("run_id", "type").agg(F.count("*").alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))
    spans = tl.groupBy("run_id").agg(
        (F.unix_millis(F.max("timestamp")) - F.unix_millis(F.min("timestamp"))).alias("ms"),
        F.bool_or(F.col("type").isin("run.error", "tool.call.error", "side_effect.failed")).alias("has_errors"))
    summary = done.select(F.col("id").alias("bundle_id"), "run_id", "event_count", "gap_count", "max_depth", *keep).join(
        counts, "run_id").join(spans, "run_id")
    nodes, edges = (build(members, owner="graph_run", group=("graph_run",)) for build in (graph_nodes, graph_edges))
    hits = redaction_hits(own)
    audit = hits.select("run_id", "id", F.col("position").alias("p"), "field_path", "rule_id", "action").join(places, ["run_id", "id"])

    def of_bundle(df: DataFrame) -> DataFrame:
        return df.join(keys, "run_id")

    def of_graph(df: DataFrame) -> DataFrame:
        return df.join(keys.select("bundle_id", F.col("run_id").alias("graph_run"), *keep), "graph_run")

    def lines(*of) -> DataFrame:
        return cut_to_table(_lines(*of, keep=keep))

    parts = [
        lines(done.withColumn("bundle_id", F.col("id")), "header", F.lit(0), header),
        # Places are of the runs asked for alone and take the bundle's id along, so whole events are shuffled once.
        lines(own.join(of_bundle(places), ["run_id", "id"]), "events", F.col("idx"), _event_record()),
        lines(of_bundle(entries), "timeline.entries", F.col("idx"), F.struct(
            F.col("id").alias("eventId"), "depth", F.col("duration_ms").alias("durationMs"),
            F.coalesce("boundary", F.lit(False)).alias("isGapBoundary"))),
        lines(of_bundle(gap_rows), "timeline.gaps", F.col("detected_at_index"), F.struct(
            F.col("before").alias("beforeEventId"), F.lit(None).cast("string").alias("afterEventId"),
            F.lit(0).alias("gapMs"), F.col("gap_type").alias("type"))),
        lines(summary, "timeline.summary", F.lit(0), F.struct(
            F.col("event_count").alias("totalEvents"), F.col("ms").alias("totalDurationMs"),
            F.col("counts").alias("eventTypeCounts"), F.col("max_depth").alias("maxDepth"),
            F.col("gap_count").alias("gapCount"), F.col("has_errors").alias("hasErrors"))),
        lines(of_graph(nodes), "lineage.nodes", F.coalesce(F.unix_millis("timestamp"), F.lit(0)), F.struct(
            F.col("node_id").alias("id"), F.col("node_type").alias("type"), F.col("run_id").alias("runId"),
            F.col("tenant_id").alias("tenantId"), F.try_parse_json("meta").alias("meta"),
            F.col("source_event_id").alias("sourceEventId")), "graph_run"),
        lines(of_graph(edges), "lineage.edges", F.unix_millis("timestamp"), F.struct(
            F.col("edge_id").alias("id"), F.col("edge_type").alias("type"), "source", "target", F.try_parse_json("meta").alias("meta")), "graph_run"),
        lines(of_bundle(audit), "redactionAudit", F.col("idx"), F.struct(
            F.col("id").alias("eventId"), F.col("field_path").alias("fieldPath"), F.col("rule_id").alias("ruleId"), "action")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Digits of the line hash the lowest and the middle level of the hash tree group by. With 16.7
# million lowest groups even a section of 10^10 lines has groups of under a thousand.
TREE_DIGITS = (6, 3)
# Lines of a section that one task puts together; the levels of longer ones are shuffled.
SECTION_LINES = 1_000_000


def section_hashes(lines: DataFrame, max_lines: int = SECTION_LINES) -> DataFrame:
    """Line count and hash of each section of each document.

    Place and text of a line are hashed, and the hashes put together in a tree over their
    leading digits, so that no step holds more than a small part of a long section. Sections of up to
    `max_lines` lines are brought together once, as 32 bytes a line, and go through all levels there.
    The lines are read twice: from storage, as those of `export_lines` are.
    """
    keys = ["bundle_id", "section"]
    hashed = lines.select(*keys, F.unhex(F.sha2(F.concat_ws("|", "position", "line"), 256)).alias("h"))
    # Sections are counted by a hash of their keys: two that share one only count as longer, and both ways give the same hashes.
    key = F.xxhash64(*keys)
    long = cut_lineage(lines.groupBy(key.alias("long")).agg(F.count("*").alias("n")).where(F.col("n") > max_lines).select("long"))
    if long.isEmpty():
        return _tree(hashed.repartition(*keys))
    same = key == F.col("long")
    short = hashed.join(long, same, "left_anti").repartition(*keys)
    return _tree(short).unionByName(_tree(hashed.join(long, same, "left_semi")))


def _tree(hashed: DataFrame) -> DataFrame:
    keys = ["bundle_id", "section"]
    level = hashed.select(*keys, F.lower(F.hex("h")).alias("h"), F.lit(1).cast("bigint").alias("n"))
    for digits in TREE_DIGITS:
        level = level.groupBy(*keys, F.substring("h" if digits == TREE_DIGITS[0] else "g", 1, digits).alias("g")).agg(
            _together(), F.sum("n").alias("n"))
    return level.groupBy(*keys).agg(_together().alias("section_hash"), F.sum("n").alias("line_count"))


def _together() -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")


def export_documents(lines: DataFrame) -> DataFrame:
    """One row per document: its line count and the hash over all its sections."""
    parts = section_hashes(lines)
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    pair = F.struct(order.alias("o"), F.concat_ws(":", "section", "section_hash").alias("t"))
    return parts.groupBy("bundle_id").agg(
        F.sum("line_count").alias("line_count"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), "|"), 256).alias("integrity_hash"))


def verify_exports(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Recompute the document hashes and compare them with the stored ones."""
    fresh = export_documents(lines).select("bundle_id", F.col("integrity_hash").alias("fresh_hash"))
    return documents.join(fresh, "bundle_id", "left").select(
        "bundle_id", F.coalesce(F.col("fresh_hash") == F.col("integrity_hash"), F.lit(False)).alias("is_valid"))


def validate_exports(lines: DataFrame) -> DataFrame:
    """Rule breaks in document lines: missing or wrong required fields and values."""
    v = F.try_parse_json("line")

    def at(path: str, cast: str = "string") -> Column:
        return F.try_variant_get(v, f"$.{path}", cast)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))

    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"

    def no_text(path: str) -> Column:
        return ~F.coalesce(kind(path) == "STRING", F.lit(False))

    def no_count(path: str) -> Column:
        return ~F.coalesce(kind(path).rlike("^BIGINT") & (at(path, "bigint") >= 0), F.lit(False))

    def no_flag(path: str) -> Column:
        return ~F.coalesce(kind(path) == "BOOLEAN", F.lit(False))

    rules = {
        "header": {
            "formatId": ~F.coalesce(at("formatId") == EXPORT_FORMAT, F.lit(False)),
            "schemaVersion": ~F.coalesce(at("schemaVersion") == EXPORT_SCHEMA_VERSION, F.lit(False)),
            "exportedAt": ~F.coalesce(at("exportedAt").rlike(iso), F.lit(False)),
            "bundle.bundleId": no_text("bundle.bundleId"),
            "bundle.status": ~F.coalesce(at("bundle.status").isin(BUNDLE_STATUSES), F.lit(False)),
            "bundle.isPartialRun": no_flag("bundle.isPartialRun"),
            "run.status": F.coalesce(kind("run"), F.lit("VOID")).startswith("OBJECT") & no_text("run.status"),
        },
        "events": {"id": no_text("id"), "type": no_text("type"), "timestamp": ~F.coalesce(at("timestamp").rlike(iso), F.lit(False))},
        "timeline.entries": {"depth": no_count("depth"), "isGapBoundary": no_flag("isGapBoundary")},
        "timeline.gaps": {"type": no_text("type")},
        "timeline.summary": {"totalEvents": no_count("totalEvents"), "gapCount": no_count("gapCount"), "hasErrors": no_flag("hasErrors")},
        "redactionAudit": {"action": ~F.coalesce(at("action").isin("mask", "remove", "hash"), F.lit(False)), "ruleId": no_text("ruleId")},
    }
    out = None
    for section, checks in rules.items():
        issues = F.array_compact(F.array(*[F.when(bad, F.lit(path)) for path, bad in checks.items()]))
        out = F.when(F.col("section") == section, issues) if out is None else out.when(F.col("section") == section, issues)
    return lines.select("bundle_id", "section", "position", F.explode(out).alias("path"))


def export_file_name() -> Column:
    """File name from run id and creation time."""
    stamp = F.regexp_replace(F.regexp_replace(iso_millis("created_at"), "[:.]", "-"), "T", "_")
    return F.concat(F.lit("evidence-"), "run_id", F.lit("-"), F.regexp_replace(stamp, "Z", ""), F.lit(".json"))

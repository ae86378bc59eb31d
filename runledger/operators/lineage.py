"""Lineage graph of all runs: nodes and edges as tables.

Node ids are `run:<id>`, `event:<id>`, `side_effect:<event id>` and
`external_system:<owner>/<name>`, the owner being the tenant (or the run, for graphs of one run).
The ordinal at the end of an edge id is the arrival number of the event the edge comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.ordered import SLICE, first_at_or_after, following, lists, position, scan, with_slices
from runledger.functions.payload import fields, iso_millis, millis_between
from runledger.operators.describe import DISPLAY_FIELDS, event_label
from runledger.operators.timeline import causal_depth, timeline_order
from runledger.schemas import DATA_FLOW_PAIRS, EDGE_TYPES, NODE_TYPES
from runledger.session import cut_lineage

EFFECT_TYPES = ["side_effect.executed", "side_effect.failed"]


def _node_id(kind: str, *parts) -> Column:
    return F.concat(F.lit(f"{kind}:"), *[F.lit(p) if p == "/" else F.col(p) for p in parts])


def _effects(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    p = fields("payload", effectType="string", targetSystem="string", description="string",
               reversible="boolean", errorMessage="string")
    done = F.col("type") == "side_effect.executed"
    return ev.where(F.col("type").isin(EFFECT_TYPES)).select(
        *group, "id", "run_id", "tenant_id", "timestamp", "ingestion_order",
        p["effectType"].alias("effect_type"), p["targetSystem"].alias("target_system"),
        p["description"].alias("description"),
        F.when(done, p["reversible"]).otherwise(F.lit(False)).alias("reversible"), done.alias("success"),
        F.when(~done, p["errorMessage"]).alias("error_message"))


def run_nodes(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """One node per run: agent of the first event, name and parent of the first run.start, status of the first run.end."""
    p = fields("payload", runName="string", triggerSource="string", parentRunId="string", status="string")
    start, end = F.col("type") == "run.start", F.col("type") == "run.end"
    place = F.struct(*timeline_order())
    head = F.struct("timestamp", p["runName"].alias("run_name"), p["triggerSource"].alias("trigger_source"),
                    p["parentRunId"].alias("parent_run_id"))
    rows = ev.select(*group, "run_id", "tenant_id", "source_agent", place.alias("place"),
                     F.when(start, head).alias("head"),
                     F.when(end, F.struct("timestamp", p["status"].alias("status"))).alias("tail"))
    per_run = rows.groupBy(*group, "run_id").agg(
        F.min_by("tenant_id", "place").alias("tenant_id"), F.min_by("source_agent", "place").alias("agent_id"),
        F.min_by("head", F.when(F.col("head").isNotNull(), F.col("place"))).alias("head"),
        F.min_by("tail", F.when(F.col("tail").isNotNull(), F.col("place"))).alias("tail"))
    ms = millis_between("head.timestamp", "tail.timestamp")
    return per_run.select(
        *group, _node_id("run", "run_id").alias("node_id"), "run_id", "tenant_id", "agent_id",
        "head.run_name", "head.trigger_source", F.coalesce("tail.status", F.lit("running")).alias("status"),
        F.col("head.timestamp").alias("start_time"), F.col("tail.timestamp").alias("end_time"),
        F.when(ms >= 0, ms).alias("duration_ms"), "head.parent_run_id")


def event_nodes(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return ev.select(
        *group, _node_id("event", "id").alias("node_id"), "run_id", "tenant_id", F.col("type").alias("event_type"),
        "source_agent", "source_framework", "timestamp", "sequence",
        event_label(fields("payload", **DISPLAY_FIELDS)).alias("label"), F.col("id").alias("source_event_id"))


def side_effect_nodes(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    return _effects(ev, group).select(
        *group, _node_id("side_effect", "id").alias("node_id"), "run_id", "tenant_id", "effect_type", "target_system",
        "description", "reversible", "success", "error_message", F.col("id").alias("source_event_id"), "timestamp")


def external_system_nodes(ev: DataFrame, owner: str = "tenant_id") -> DataFrame:
    """One node per owner (tenant, run, or another key of the events) and target system."""
    if owner not in ("tenant_id", "run_id"):
        return _effects(ev, (owner,)).groupBy(owner, "target_system").agg(F.min("tenant_id").alias("tenant_id"), F.count("*").alias("effect_count")).select(
            owner, _node_id("external_system", owner, "/", "target_system").alias("node_id"), "tenant_id",
            F.col("target_system").alias("system_name"), "effect_count")
    keys = ["tenant_id", "target_system"] if owner == "tenant_id" else ["run_id", "tenant_id", "target_system"]
    return _effects(ev).groupBy(*keys).agg(F.count("*").alias("effect_count")).select(
        _node_id("external_system", owner, "/", "target_system").alias("node_id"), *keys[:-1],
        F.col("target_system").alias("system_name"), "effect_count")


def _edge(kind: str, source: Column, target: Column, meta: Column, group: tuple[str, ...] = ()) -> list[Column]:
    return [
        *[F.col(g) for g in group],
        F.concat(F.lit(f"{kind}:"), source, F.lit("->"), target, F.lit(":"), F.col("ingestion_order")).alias("edge_id"),
        F.lit(kind).alias("edge_type"), source.alias("source"), target.alias("target"),
        "run_id", "tenant_id", "timestamp", F.to_json(meta).alias("meta"),
    ]


def produces_edges(ev: DataFrame, owner: str = "tenant_id", group: tuple[str, ...] = ()) -> DataFrame:
    """Event to side effect, and side effect to system: two edges per effect, from one pass."""
    effect = _node_id("side_effect", "id")
    hops = F.explode(F.array(
        F.struct(_node_id("event", "id").alias("source"), effect.alias("target")),
        F.struct(effect.alias("source"), _node_id("external_system", owner, "/", "target_system").alias("target"))))
    rows = _effects(ev, group).select("*", hops.alias("hop"))
    meta = F.struct(F.col("effect_type").alias("effectType"), F.col("target_system").alias("targetSystem"))
    return rows.select(*_edge("produces", F.col("hop.source"), F.col("hop.target"), meta, group))


def causal_edges(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Parent to child where both exist, also across runs."""
    known = ev.select(*group, F.col("id").alias("parent_event_id"))
    children = ev.where(F.col("parent_event_id").isNotNull()).select(
        *group, "parent_event_id", "id", "run_id", "tenant_id", "timestamp", "ingestion_order")
    meta = F.struct(F.col("parent_event_id").alias("parentEventId"))
    return children.join(known, [*group, "parent_event_id"], "left_semi").select(
        *_edge("causal", _node_id("event", "parent_event_id"), _node_id("event", "id"), meta, group))


def temporal_edges(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours of a run in timeline order."""
    keep = [SLICE] if SLICE in ev.columns else []
    narrow = ev.select(*group, "id", "run_id", "tenant_id", "timestamp", "sequence", "ingestion_order", *keep)
    nxt = F.struct(F.col("id").alias("id"), F.col("timestamp").alias("timestamp"))
    rows = scan(narrow, [*group, "run_id"], timeline_order(), nxt=following(nxt)).where(F.col("nxt").isNotNull())
    meta = F.struct(millis_between("timestamp", "nxt.timestamp").alias("gapMs"))
    return rows.select(*_edge("temporal", _node_id("event", "id"), F.concat(F.lit("event:"), "nxt.id"), meta, group))


def delegation_edges(ev: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Parent run to child run, named by the child's first run.start, where both runs have events."""
    p = fields("payload", parentRunId="string")
    place = F.struct(*timeline_order())
    starts = (
        ev.where(F.col("type") == "run.start")
        .select(*group, "run_id", "tenant_id", "timestamp", "ingestion_order", place.alias("place"), p["parentRunId"].alias("parent"))
        .groupBy(*group, "run_id")
        .agg(F.min_by(F.struct("tenant_id", "timestamp", "ingestion_order", "parent"), "place").alias("s"))
        .select(*group, "run_id", "s.*").where(F.col("parent") != "")
    )
    known = ev.select(*group, F.col("run_id").alias("parent")).distinct()
    meta = F.struct(F.col("parent").alias("parentRunId"), F.col("run_id").alias("childRunId"))
    return starts.join(known, [*group, "parent"], "left_semi").select(
        *_edge("delegation", _node_id("run", "parent"), _node_id("run", "run_id"), meta, group))


def data_flow_edges(ev: DataFrame, pairs=None, group: tuple[str, ...] = ()) -> DataFrame:
    """For each pair of types: every source event to the first target of its run not before it."""
    pairs = DATA_FLOW_PAIRS if pairs is None else pairs
    roles = [(n, kind, role) for n, (src, tgt, _) in enumerate(pairs) for kind, role in ((src, "source"), (tgt, "target"))]
    table = F.broadcast(ev.sparkSession.createDataFrame(roles, "pair int, type string, role string"))  # a few fixed rows
    keep = [SLICE] if SLICE in ev.columns else []
    rows = ev.select(*group, "id", "run_id", "tenant_id", "type", "timestamp", "sequence", "ingestion_order", *keep).join(table, "type")
    target = F.when(F.col("role") == "target", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(timeline_order())], F.col("id").alias("id")))
    found = first_at_or_after(rows, [*group, "run_id", "pair"], "timestamp", target, "hit")
    texts = F.element_at(F.array(*[F.lit(d) for _, _, d in pairs]), F.col("pair") + 1)
    return found.where((F.col("role") == "source") & F.col("hit").isNotNull()).select(
        *_edge("data_flow", _node_id("event", "id"), F.concat(F.lit("event:"), "hit.id"),
               F.struct(texts.alias("description")), group))


def graph_nodes(ev: DataFrame, owner: str = "tenant_id", group: tuple[str, ...] = ()) -> DataFrame:
    """All nodes with their meta data as JSON text.

    With `group`, columns of the events, each value of these is a graph of its own.
    """

    def typed(df: DataFrame, kind: str, time: str | None, meta: dict[str, str | Column], event: bool) -> DataFrame:
        run = F.col("run_id") if "run_id" in df.columns else F.lit(None).cast("string")
        values = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in meta.items()]
        return df.select(
            *group, "node_id", F.lit(kind).alias("node_type"), run.alias("run_id"), "tenant_id",
            (F.col("source_event_id") if event else F.lit(None).cast("string")).alias("source_event_id"),
            (F.col(time) if time else F.lit(None).cast("timestamp")).alias("timestamp"),
            F.to_json(F.struct(*values)).alias("meta"))

    return (
        typed(run_nodes(ev, group), "run", "start_time", {
            "agentId": "agent_id", "runName": "run_name", "triggerSource": "trigger_source", "status": "status",
            "startTime": iso_millis("start_time"), "endTime": iso_millis("end_time"),
            "durationMs": "duration_ms", "parentRunId": "parent_run_id"}, False)
        .unionByName(typed(event_nodes(ev, group), "event", "timestamp", {
            "eventType": "event_type", "sourceAgent": "source_agent", "sourceFramework": "source_framework",
            "timestamp": iso_millis("timestamp"), "sequence": "sequence", "label": "label"}, True))
        .unionByName(typed(side_effect_nodes(ev, group), "side_effect", "timestamp", {
            "effectType": "effect_type", "targetSystem": "target_system", "description": "description",
            "reversible": "reversible", "success": "success", "errorMessage": "error_message"}, True))
        .unionByName(typed(external_system_nodes(ev, owner), "external_system", None, {
            "systemName": "system_name", "effectCount": "effect_count"}, False))
    )


def graph_edges(ev: DataFrame, include_temporal: bool = True, include_data_flow: bool = True,
                owner: str = "tenant_id", group: tuple[str, ...] = ()) -> DataFrame:
    edges = produces_edges(ev, owner, group).unionByName(causal_edges(ev, group)).unionByName(delegation_edges(ev, group))
    if include_temporal:
        edges = edges.unionByName(temporal_edges(ev, group))
    if include_data_flow:
        edges = edges.unionByName(data_flow_edges(ev, group=group))
    return edges


def build_graph(ev: DataFrame, include_temporal: bool = True, include_data_flow: bool = True,
                related: DataFrame | None = None, owner: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the given events and, if given, those of related runs."""
    if related is not None:
        ev = ev.unionByName(related)
    return graph_nodes(ev, owner), graph_edges(ev, include_temporal, include_data_flow, owner)


def graph_summary(nodes: DataFrame, edges: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Counts per run, per tenant and in all. `depths` has run_id, tenant_id and depth.

    Systems are counted by the runs that reach them.
    """
    levels = [["tenant_id", "run_id"], ["tenant_id"], []]
    level = F.when(F.grouping_id() == 0, "run").when(F.grouping_id() == 1, "tenant").otherwise("all").alias("level")

    def count_of(column: str, kind: str) -> Column:
        return F.count_if(F.col(column) == kind).alias(f"{kind}_{column.split('_')[0]}s")

    own = nodes.where(F.col("node_type") != "external_system")
    n = own.groupingSets(levels, "tenant_id", "run_id").agg(level, *[count_of("node_type", k) for k in NODE_TYPES[:3]])
    system = F.when((F.col("edge_type") == "produces") & F.col("target").startswith("external_system:"), F.col("target"))
    e = edges.groupingSets(levels, "tenant_id", "run_id").agg(
        level, *[count_of("edge_type", k) for k in EDGE_TYPES], F.count_distinct(system).alias("external_system_nodes"))
    keys = ["level", "tenant_id", "run_id"]
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    both = n.alias("n").join(e.alias("e"), same, "left").select(
        *[F.col(f"n.{k}") for k in keys], *[F.col(f"n.{k}_nodes") for k in NODE_TYPES[:3]],
        *[F.coalesce(F.col(f"e.{c}"), F.lit(0).cast("bigint")).alias(c)
          for c in ["external_system_nodes", *[f"{k}_edges" for k in EDGE_TYPES]]])
    out = both.withColumns({
        "node_count": sum((F.col(f"{k}_nodes") for k in NODE_TYPES[1:]), F.col("run_nodes")),
        "edge_count": sum((F.col(f"{k}_edges") for k in EDGE_TYPES[1:]), F.col("causal_edges")),
        "has_delegation": F.col("delegation_edges") > 0,
    })
    if depths is None:
        return out.withColumn("max_depth", F.lit(0).cast("bigint"))
    d = depths.groupingSets(levels, "tenant_id", "run_id").agg(level, F.max("depth").alias("max_depth"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    return out.alias("o").join(d.alias("d"), same, "left").select("o.*", "d.max_depth")


def event_depths(ev: DataFrame) -> DataFrame:
    """Depth of each event with its tenant, for `graph_summary`."""
    return causal_depth(ev).join(ev.select("run_id", "id", "tenant_id"), ["run_id", "id"])


NODE_STRUCT = ["node_id", "node_type", "tenant_id", "source_event_id", "timestamp", "meta"]
EDGE_STRUCT = ["edge_id", "edge_type", "source", "target", "tenant_id", "timestamp", "meta"]


def serialize_graph(nodes: DataFrame, edges: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Nested arrays of nodes and edges per run, in parts of at most `part_size` elements each.

    Use nodes and edges built with `owner="run_id"`, so that systems belong to a run.
    """
    n = nodes.select("run_id", "timestamp", "node_id", F.struct(*NODE_STRUCT).alias("item"))
    e = edges.select("run_id", "timestamp", "edge_id", F.struct(*EDGE_STRUCT).alias("item"))
    n_lists = lists(with_slices(n.withColumn("timestamp", _known_time()), ["run_id"], "timestamp"),
                    ["run_id"], [F.col("timestamp"), F.col("node_id")], "item", "nodes", part_size)
    e_lists = lists(with_slices(e, ["run_id"], "timestamp"),
                    ["run_id"], [F.col("timestamp"), F.col("edge_id")], "item", "edges", part_size)
    return n_lists.join(e_lists, ["run_id", "part"], "full")


def _known_time() -> Column:
    return F.coalesce("timestamp", F.lit("1970-01-01 00:00:00").cast("timestamp"))


def deserialize_graph(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges back from their nested form."""
    nodes = graphs.select("run_id", F.explode("nodes").alias("n")).select("run_id", "n.*")
    edges = graphs.select("run_id", F.explode("edges").alias("e")).select("run_id", "e.*")
    return nodes, edges


def adjacency(edges: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Edge ids per node, outgoing and incoming, in parts of at most `part_size`."""
    ends = edges.select("edge_id", "timestamp", F.explode(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit("out").alias("direction")),
        F.struct(F.col("target").alias("node_id"), F.lit("in").alias("direction")))).alias("x")).select(
            "x.node_id", "x.direction", "edge_id", "timestamp")
    keys = ["node_id", "direction"]
    return lists(with_slices(ends, keys, "timestamp"), keys, [F.col("timestamp"), F.col("edge_id")],
                 "edge_id", "edge_ids", part_size)


def filter_edges(edges: DataFrame, visible: list[str] | None = None) -> DataFrame:
    """Edges of the visible types; temporal ones are hidden by default."""
    return edges.where(F.col("edge_type").isin(
        [t for t in EDGE_TYPES if t != "temporal"] if visible is None else visible))


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rule breaks of graph rows: unknown types, empty ids, missing or negative values."""

    def broken(df: DataFrame, element: str, key: str, rules: dict[tuple[str, str], Column]) -> DataFrame:
        issues = F.array_compact(F.array(*[
            F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))
            for (path, code), bad in rules.items()]))
        return df.select(F.lit(element).alias("element"), F.col(key).alias("element_id"),
                         F.explode(issues).alias("i")).select("element", "element_id", "i.path", "i.code")

    def empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    effects = fields("meta", effectCount="bigint")["effectCount"]
    duration = fields("meta", durationMs="double")["durationMs"]
    node_rules = {
        ("id", "too_small"): empty("node_id"),
        ("type", "invalid_enum_value"): ~F.coalesce(F.col("node_type").isin(NODE_TYPES), F.lit(False)),
        ("tenantId", "required"): F.col("tenant_id").isNull(),
        ("meta", "required"): F.col("meta").isNull(),
        ("meta.effectCount", "too_small"): (F.col("node_type") == "external_system") & (effects < 0),
        ("meta.durationMs", "too_small"): (F.col("node_type") == "run") & (duration < 0),
    }
    edge_rules = {
        ("id", "too_small"): empty("edge_id"),
        ("type", "invalid_enum_value"): ~F.coalesce(F.col("edge_type").isin(EDGE_TYPES), F.lit(False)),
        ("source", "too_small"): empty("source"),
        ("target", "too_small"): empty("target"),
        ("meta", "required"): F.col("meta").isNull(),
    }
    return broken(nodes, "node", "node_id", node_rules).unionByName(broken(edges, "edge", "edge_id", edge_rules))


PEELED = 16  # layers that are taken one by one before chains are contracted


def _anchored(single: DataFrame) -> DataFrame:
    """Rows (node, anchor, floor, length) of nodes with one parent, followed up to the first node that has not one parent.

    layer(node) = max(floor, layer(anchor) + length); two such steps make one, so each round doubles the part of a chain
    that is done. Chains that run into a circle keep a node with one parent as their anchor.
    """
    single = cut_lineage(single)
    moving = single.count() + 1
    while moving:
        up = single.select(F.col("node").alias("anchor"), F.col("anchor").alias("next"), F.col("floor").alias("up_floor"), F.col("length").alias("up_length"))
        single = cut_lineage(single.join(up, "anchor", "left").select(
            "node", F.coalesce("next", "anchor").alias("anchor"), F.greatest("floor", F.col("length") + F.coalesce("up_floor", F.lit(0))).alias("floor"),
            (F.col("length") + F.coalesce("up_length", F.lit(0))).alias("length"), F.col("next").isNotNull().alias("moved")))
        before, moving = moving, single.where("moved").count()
        single = single.drop("moved")
        if moving == before:  # a round in which no chain comes to its end leaves only circles and what hangs on them
            break
    return single


def longest_paths(steps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (node_id, layer) of all targets of the distinct edges (source, target): most edges on a path to them.

    `known` has layers of nodes that are no targets; the others that are none have layer 0.

    A round takes out all nodes with one parent at once: whole chains are contracted by pointer doubling and their edges
    moved up to where they begin. Nodes all of whose parents are settled get their layer. So rounds grow with how often
    paths meet, and steps in a round with the logarithm of the longest chain. Layers of contracted
    nodes are filled in at the end. Nodes on a cycle, or behind one, are not in the result.
    """
    edges = cut_lineage(steps.select(F.col("source").alias("s"), F.col("target").alias("t"), F.lit(1).cast("bigint").alias("w")))
    floors = None  # (node, floor) of targets: what their settled parents ask for
    settled = [_stacked([], steps.sparkSession) if known is None else known.select(F.col("node_id").alias("node"), "layer")]
    hanging, left = [], edges.count()
    while left:
        heads = edges.groupBy("t").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("w").alias("w"))
        heads = heads.withColumn("floor", F.lit(0).cast("bigint")) if floors is None else heads.join(floors, heads["t"] == floors["node"], "left").select("t", "n", "s", "w", F.coalesce("floor", F.lit(0)).alias("floor"))
        heads = cut_lineage(heads)
        single = _anchored(heads.where("n = 1").select(F.col("t").alias("node"), F.col("s").alias("anchor"), "floor", F.col("w").alias("length")))
        many = heads.where("n > 1").select(F.col("t").alias("node"), F.col("floor").alias("own_floor"))
        kinds = heads.select(F.col("t").alias("anchor"), (F.col("n") == 1).alias("circling"))
        found = _stacked(settled, steps.sparkSession).select(F.col("node").alias("anchor"), F.col("layer").alias("anchor_layer"))
        # An anchor that no edge leads to is settled, one with one parent lies on a circle, the others are open.
        single = cut_lineage(single.join(kinds, "anchor", "left").join(found, "anchor", "left").select(
            "node", "anchor", "floor", "length", "circling",
            F.when(F.col("circling").isNull(), F.greatest("floor", F.coalesce("anchor_layer", F.lit(0)) + F.col("length"))).alias("layer")))
        settled.append(single.where("circling IS NULL").select("node", "layer"))
        hanging.append(single.where("NOT circling").select("node", "anchor", "floor", "length"))
        moved = single.select(F.col("node").alias("s"), F.when(F.col("circling"), F.col("node")).otherwise(F.col("anchor")).alias("up"), "circling", "layer",
                              F.when(F.col("circling"), 0).otherwise(F.col("floor")).alias("up_floor"), F.when(F.col("circling"), 0).otherwise(F.col("length")).alias("up_length"))
        rest = edges.join(many, edges["t"] == many["node"], "left_semi").join(moved, "s", "left")
        direct = kinds.select(F.col("anchor").alias("s"), F.lit(True).alias("is_head"))
        first = found.select(F.col("anchor").alias("s"), "anchor_layer")
        rest = rest.join(direct, "s", "left").join(first, "s", "left")
        # What a parent asks for: its layer if that is known, else what its chain asks for whatever its anchor turns out to be.
        is_open = F.coalesce(F.col("is_head") & F.col("layer").isNull(), F.lit(False))
        asks = F.when(is_open, F.coalesce("up_floor", F.lit(0))).otherwise(F.coalesce("layer", "anchor_layer", F.lit(0))) + F.col("w")
        pulled = cut_lineage(rest.select("t", F.when(is_open, F.coalesce("up", "s")).alias("s"), (F.col("w") + F.coalesce("up_length", F.lit(0))).alias("w"), asks.alias("ask"))
                             .groupBy("t", "s").agg(F.max("w").alias("w"), F.max("ask").alias("ask")))
        targets = cut_lineage(pulled.groupBy("t").agg(F.max("ask").alias("ask"), F.count("s").alias("open")).join(many, F.col("t") == many["node"])
                              .select("node", F.greatest("ask", "own_floor").alias("floor"), "open"))
        settled.append(targets.where("open = 0").select("node", F.col("floor").alias("layer")))
        floors = targets.where("open > 0").select("node", "floor")
        circles = single.where("circling").select(F.col("node").alias("s"), F.col("node").alias("t"), F.lit(1).cast("bigint").alias("w"))
        edges = pulled.where("s IS NOT NULL").select("s", "t", "w").unionByName(circles)
        now = edges.count()
        if now == left:
            break
        left = now
    out = cut_lineage(_stacked(settled[1:], steps.sparkSession))
    for chained in reversed(hanging):
        above = out.select(F.col("node").alias("anchor"), F.col("layer").alias("anchor_layer"))
        more = chained.join(above, "anchor").select("node", F.greatest("floor", F.col("anchor_layer") + F.col("length")).alias("layer"))
        out = cut_lineage(out.unionByName(more))
    return out.select(F.col("node").alias("node_id"), "layer")


def _stacked(parts: list[DataFrame], spark) -> DataFrame:
    out = spark.createDataFrame([], "node string, layer bigint")
    for part in parts:
        out = out.unionByName(part)
    return out


def layer_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer of each node (longest path from the roots, without temporal edges) and its row in the layer.

    The first PEELED layers come one by one: round k takes the nodes whose last open edge was closed in round k - 1.
    What lies deeper is contracted by `longest_paths`, so rounds do not grow with the length of chains.
    Nodes on a cycle, or behind one, have no layer. `integrity_cycles` names them.
    """
    links = edges.where(F.col("edge_type") != "temporal").select("source", "target").distinct()
    ids = nodes.select("node_id").distinct()
    steps = cut_lineage(links.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi"))
    waiting = cut_lineage(steps.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("open")))
    layers = cut_lineage(ids.join(waiting, "node_id", "left_anti").withColumn("layer", F.lit(0).cast("bigint")))
    frontier, depth = layers, 0
    while depth < PEELED and not frontier.isEmpty():
        depth += 1
        closed = frontier.join(steps, frontier["node_id"] == steps["source"]).groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("closed"))
        waiting = cut_lineage(waiting.join(closed, "node_id", "left").select("node_id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")))
        frontier = waiting.where("open = 0").select("node_id", F.lit(depth).cast("bigint").alias("layer"))
        layers = layers.unionByName(frontier)
        waiting = waiting.where("open > 0")
    if not frontier.isEmpty():
        layers = cut_lineage(layers)
        deeper = steps.join(waiting.select(F.col("node_id").alias("target")), "target", "left_semi").select("source", "target")
        layers = layers.unionByName(longest_paths(deeper, layers))
    rows = nodes.select(
        "node_id", "node_type", F.coalesce("run_id", "tenant_id").alias("graph_key"),
        F.when(F.col("node_type") == "event", F.col("timestamp")).alias("timestamp")).join(layers, "node_id", "left")
    group = F.when(F.col("node_type") == "run", 0).when(F.col("node_type") == "external_system", 2).otherwise(1)
    rows = with_slices(rows.withColumn("timestamp", _known_time()), ["graph_key", "layer"], "timestamp")
    if SLICE in rows.columns:
        last = F.lit(2**62)
        rows = rows.withColumn(SLICE, F.when(group == 0, F.lit(-1)).when(group == 2, last).otherwise(F.col(SLICE)))

    return scan(rows, ["graph_key", "layer"], [group, F.col("timestamp"), F.col("node_id")], row=position()).select(
        "node_id", "node_type", "graph_key", "layer", "row")

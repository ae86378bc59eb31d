"""Queries over the lineage graph: lookups, reachability, chains, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.messages import text
from runledger.operators.timeline import ancestor_hops
from runledger.session import cut_lineage


def nodes_by(nodes: DataFrame, node_type: str | None = None, event_type: str | None = None,
             ids: DataFrame | None = None) -> DataFrame:
    """Nodes of a type, event nodes of an event type, nodes with given ids (column node_id)."""
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    if event_type is not None:
        nodes = nodes.where((F.col("node_type") == "event") & (F.get_json_object("meta", "$.eventType") == event_type))
    if ids is not None:
        nodes = nodes.join(ids.select("node_id"), "node_id", "left_semi")
    return nodes


def edges_of(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """Edges that leave (`out`) or enter (`in`) the given nodes."""
    end = "source" if direction == "out" else "target"
    return edges.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")


def edges_by_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type)


def _reach(edges: DataFrame, starts: DataFrame, types: list[str] | None, forward: bool) -> DataFrame:
    """Pairs (start_id, node_id): every node on some path from each start, found once.

    Frontier by frontier; a start is in its own result only if it lies on a cycle.
    """
    if types is not None:
        edges = edges.where(F.col("edge_type").isin(types))
    here, there = ("source", "target") if forward else ("target", "source")
    steps = cut_lineage(edges.select(F.col(here).alias("node_id"), F.col(there).alias("next_id")).distinct())
    frontier = cut_lineage(starts.select(F.col("node_id").alias("start_id"), "node_id").distinct())
    found = None
    while True:
        nxt = frontier.join(steps, "node_id").select("start_id", F.col("next_id").alias("node_id")).distinct()
        if found is not None:
            nxt = nxt.join(found, ["start_id", "node_id"], "left_anti")
        frontier = cut_lineage(nxt)
        if frontier.isEmpty():
            return frontier if found is None else found
        found = frontier if found is None else found.unionByName(frontier)


def ancestors(edges: DataFrame, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """All nodes from which each start can be reached."""
    return _reach(edges, starts, types, forward=False)


def descendants(edges: DataFrame, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """All nodes that can be reached from each start."""
    return _reach(edges, starts, types, forward=True)


def _causal_parent(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("edge_type") == "causal").groupBy(F.col("target").alias("id"))
        .agg(F.min_by("source", "edge_id").alias("parent"))
    )


def causal_chain(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes from the root down to each start along causal parents; rows (start_id, position, node_id).

    Each round doubles the part of the chain that is known, so the number of rounds is the
    logarithm of the longest chain. A chain that runs into a cycle stops before it repeats.
    """
    starts = starts.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    return _chain(cut_lineage(_causal_parent(edges)), starts)


def _chain(jump: DataFrame, starts: DataFrame) -> DataFrame:
    chain = cut_lineage(starts.select("node_id").distinct().select(
        F.col("node_id").alias("start_id"), "node_id", F.lit(0).cast("bigint").alias("up")))
    reach = 1
    while True:
        # A node that the chain holds already lies on a cycle, and so does all above it.
        further = chain.join(jump, chain["node_id"] == jump["id"]).select(
            "start_id", F.col("parent").alias("node_id"), (F.col("up") + reach).alias("up"))
        further = cut_lineage(further.groupBy("start_id", "node_id").agg(F.min("up").alias("up")).join(
            chain.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti"))
        if further.isEmpty():
            break
        chain = chain.unionByName(further)
        jump = _twice(jump)
        reach *= 2
    longest = chain.groupBy("start_id").agg(F.max("up").alias("top"))
    return chain.join(longest, "start_id").select("start_id", (F.col("top") - F.col("up")).alias("position"), "node_id")


def side_effects(nodes: DataFrame, run_id: str | None = None, system: str | None = None) -> DataFrame:
    out = nodes.where(F.col("node_type") == "side_effect")
    if run_id is not None:
        out = out.where(F.col("run_id") == run_id)
    if system is not None:
        out = out.where(F.get_json_object("meta", "$.targetSystem") == system)
    return out


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """What each start caused: rows (start_id, node_id, node_type) over causal and produces edges."""
    reached = descendants(edges, starts, ["causal", "produces"])
    return reached.join(nodes.select("node_id", "node_type"), "node_id").select("start_id", "node_id", "node_type")


def impact_counts(impacts: DataFrame) -> DataFrame:
    return impacts.groupBy("start_id").agg(*[
        F.count_if(F.col("node_type") == kind).alias(f"{kind}_count")
        for kind in ("event", "side_effect", "external_system")])


KINDS = ("event", "side_effect", "external_system")


def impact_totals(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """`impact_counts` of `impact`, without a row for each start and node it reaches.

    Where every node has one cause, the counts are sums over subtrees: in round k a node adds the sums of the
    nodes exactly 2**k below it, so all starts together take as many rounds as the logarithm of the longest chain.
    Shared leaves (systems) are counted once per start through distinct (node, system) rows. Starts that reach a
    node with several causes, or lie on or behind a circle, are walked by `impact`; nobody else is.
    """
    kinds = nodes.select("node_id", "node_type").distinct()
    steps = edges.where(F.col("edge_type").isin("causal", "produces")).select("source", "target").distinct()
    targets = steps.groupBy("target").agg(F.count("*").alias("causes"), F.min("source").alias("cause"))
    inner = steps.select(F.col("source").alias("target"), F.lit(True).alias("inner")).distinct()
    targets = cut_lineage(
        targets.join(kinds.withColumnRenamed("node_id", "target"), "target", "left").join(inner, "target", "left")
        .withColumn("leaf", F.col("inner").isNull() & F.col("node_type").eqNullSafe("external_system")))
    single = targets.where((F.col("causes") == 1) & ~F.col("leaf"))
    links = cut_lineage(single.select(F.col("target").alias("id"), F.col("cause").alias("parent"), "node_type", F.col("inner").isNotNull().alias("inner")))
    # Only nodes with something below take part in the rounds; the others are counted at their cause.
    hops = ancestor_hops(links.where("inner").select("id", "parent"), [])
    circular = cut_lineage(hops.where(F.col("hops").isNull()).select(F.col("id").alias("node_id")))
    jump = cut_lineage(links.where("inner").select("id", "parent").join(circular.withColumnRenamed("node_id", "id"), "id", "left_anti"))

    tangled = steps.join(targets.where((F.col("causes") > 1) & ~F.col("leaf")).select("target"), "target", "left_semi")
    counts = [F.count_if(F.col("node_type") == kind).alias(f"{kind}_count") for kind in KINDS]
    below = links.groupBy(F.col("parent").alias("node_id")).agg(*counts, F.count("node_type").alias("reached"), F.lit(0).cast("bigint").alias("tangled"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in below.columns[1:-1]]
    sums = below.unionByName(tangled.groupBy(F.col("source").alias("node_id")).agg(*zero, F.count("*").alias("tangled")))
    names = sums.columns[1:]

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node_id").agg(*[F.sum(c).alias(c) for c in names])

    leaves = steps.join(targets.where("leaf").select("target"), "target", "left_semi").select(F.col("source").alias("node_id"), F.col("target").alias("leaf"))
    # A node with nothing but leaves below has rows of its own and hands them to its cause like all inner nodes.
    sums, leaves = cut_lineage(added(sums)), cut_lineage(leaves)
    while not jump.isEmpty():
        up = jump.withColumnRenamed("id", "node_id")
        sums = cut_lineage(added(sums.unionByName(
            up.join(sums, "node_id").drop("node_id").withColumnRenamed("parent", "node_id"))))
        leaves = cut_lineage(leaves.unionByName(
            up.join(leaves, "node_id").select(F.col("parent").alias("node_id"), "leaf")).distinct())
        second = jump.select(F.col("id").alias("parent"), F.col("parent").alias("next_parent"))
        jump = cut_lineage(jump.join(second, "parent").select("id", F.col("next_parent").alias("parent")))

    starts = starts.select("node_id").distinct()
    systems = leaves.groupBy("node_id").agg(F.count("*").alias("leaves"))
    found = cut_lineage(
        starts.join(sums, "node_id", "left").join(systems, "node_id", "left")
        .join(circular.withColumn("circular", F.lit(True)), "node_id", "left").na.fill(0)
        .withColumn("hard", F.col("circular").isNotNull() | (F.col("tangled") > 0)))
    out = found.where(~F.col("hard") & (F.col("reached") + F.col("leaves") > 0)).select(
        F.col("node_id").alias("start_id"), "event_count", "side_effect_count",
        (F.col("external_system_count") + F.col("leaves")).alias("external_system_count"))
    hard = found.where("hard").select("node_id")
    return out if hard.isEmpty() else out.unionByName(impact_counts(impact(nodes, edges, hard)))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The given nodes and the edges with both ends among them."""
    wanted = ids.select("node_id")
    inside = edges.join(wanted.withColumnRenamed("node_id", "source"), "source", "left_semi").join(
        wanted.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return nodes.join(wanted, "node_id", "left_semi"), inside


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest causal chain of each run, rows (run_id, position, node_id).

    Ties: the end with the smallest time, then the smallest id. Events on cycles, or below one, end no path
    unless a run has no others.
    """
    events = nodes.where(F.col("node_type") == "event").select("node_id", "run_id", "timestamp")
    pairs = edges.where(F.col("edge_type") == "causal").select("edge_type", "edge_id", "source", "target")
    src = events.select(F.col("node_id").alias("source"), F.col("run_id").alias("source_run"))
    tgt = events.select(F.col("node_id").alias("target"), F.col("run_id").alias("target_run"))
    links = cut_lineage(_causal_parent(
        pairs.join(src, "source").join(tgt, "target").where(F.col("source_run") == F.col("target_run"))
        .select("edge_type", "edge_id", "source", "target")))
    # Only nodes that are parents take part in the rounds; a leaf is one hop below its parent.
    parents = links.select(F.col("parent").alias("id")).distinct()
    hops = ancestor_hops(links.join(parents, "id", "left_semi"), []).select(F.col("id").alias("parent"), "hops", F.lit(True).alias("known"))
    # A parent without a row is a root; one with a null lies on a cycle or above none, and has no depth.
    depth = (
        links.join(hops, "parent", "left")
        .select(F.col("id").alias("node_id"), F.when(F.col("known").isNull(), 1).otherwise(F.col("hops") + 1).alias("depth"), F.lit(True).alias("linked"))
    )
    place = F.struct(
        (F.col("linked").isNotNull() & F.col("depth").isNull()).alias("circular"),
        (-F.coalesce("depth", F.lit(0))).cast("bigint").alias("up"), "timestamp", "node_id")
    ends = cut_lineage(
        events.join(depth, "node_id", "left").groupBy("run_id").agg(F.min(place).alias("e"))
        .select("run_id", "e.node_id", (-F.col("e.up")).alias("position"), "e.circular").where(F.col("node_id").isNotNull()))
    path = _climb(links, ends.where(~F.col("circular")).drop("circular"))
    circular = ends.where("circular").select("run_id", F.col("node_id").alias("start_id"))
    if circular.isEmpty():
        return path
    chain = _chain(links, circular.select(F.col("start_id").alias("node_id")))
    return path.unionByName(chain.join(circular, "start_id").select("run_id", "position", "node_id"))


def _climb(jump: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (run_id, position, node_id) with all nodes above theirs, for nodes `position` hops below a root."""
    longest, reach = rows.agg(F.max("position")).first()[0] or 0, 1
    path = rows.select("run_id", "position", "node_id")
    while reach <= longest:
        # Rows further than `reach` from their end have `reach` nodes in the path already, each hands on to one above.
        above = path.where(F.col("position") >= reach).join(jump, F.col("node_id") == F.col("id")).select(
            "run_id", (F.col("position") - reach).alias("position"), F.col("parent").alias("node_id"))
        path = path.unionByName(cut_lineage(above))
        reach *= 2
        if reach <= longest:
            jump = _twice(jump)
    return path


def _twice(jump: DataFrame) -> DataFrame:
    """Links of double the length."""
    second = jump.select(F.col("id").alias("parent"), F.col("parent").alias("next_parent"))
    return cut_lineage(jump.join(second, "parent").select("id", F.col("next_parent").alias("parent")))


def _issue(kind: str, nodes: list[str], edges: list[str]) -> list[Column]:
    def ids(names: list[str]) -> Column:
        return F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<string>")

    return [F.lit(kind).alias("issue_type"), text(kind).alias("message"),
            ids(nodes).alias("related_node_ids"), ids(edges).alias("related_edge_ids")]


def integrity_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target does not exist."""
    known = nodes.select("node_id")

    def side(end: str) -> DataFrame:
        return edges.join(known.withColumnRenamed("node_id", end), end, "left_anti").select(*_issue(
            f"dangling_edge_{end}", [end], ["edge_id"]))

    return side("source").unionByName(side("target"))


def integrity_self_loop(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("source") == F.col("target")).select(*_issue(
        "self_loop", ["source"], ["edge_id"]))


def integrity_duplicate(edges: DataFrame) -> DataFrame:
    """The second and later edges of a type between two nodes.

    Copies are reduced to their first id before the join, so a much copied edge is cheap.
    """
    keys = ["edge_type", "source", "target"]
    copied = edges.groupBy(*keys).agg(F.min("edge_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return edges.join(copied, keys).where(F.col("edge_id") != F.col("first_id")).select(*_issue(
        "duplicate_edge", ["source", "target"], ["edge_id"]))


def integrity_missing_run(nodes: DataFrame) -> DataFrame:
    """Event nodes whose run node does not exist."""
    runs = nodes.where(F.col("node_type") == "run").select("run_id")
    events = nodes.where((F.col("node_type") == "event") & F.col("run_id").isNotNull())
    return events.join(runs, "run_id", "left_anti").select(*_issue(
        "missing_run_node", ["node_id"], []))


def integrity_orphan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Event and side-effect nodes without any edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return nodes.where(~F.col("node_type").isin("run", "external_system")).join(ends, "node_id", "left_anti").select(
        *_issue("orphan_node", ["node_id"], []))


def causal_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on causal cycles, rows (cycle_id, node_id); the cycle id is its smallest node.

    A node has one causal parent. Each round doubles the length of the walks and drops nodes whose walk ends or that
    no walk comes to. A round that drops none leaves nodes that walk onto each other, each on a cycle; if it finds no
    smaller node either, every walk has been round its cycle. So the number of rounds is the logarithm of the longest
    chain or cycle, whatever the number of nodes.
    """
    walk = cut_lineage(_causal_parent(edges).select("id", F.col("parent").alias("anc"), F.least("id", "parent").alias("low")))
    nodes = walk.count()
    while nodes:
        reached = walk.select(F.col("anc").alias("id")).distinct()
        step = walk.select(F.col("id").alias("anc"), F.col("anc").alias("next_anc"), F.col("low").alias("next_low"))
        walk = cut_lineage(walk.join(reached, "id", "left_semi").join(step, "anc").select(
            "id", F.col("next_anc").alias("anc"), F.least("low", "next_low").alias("low"), (F.col("next_low") < F.col("low")).alias("moved")))
        left, moved = walk.agg(F.count("*"), F.count_if("moved")).first()
        if left == nodes and not moved:
            break
        nodes = left
    return walk.select(F.col("low").alias("cycle_id"), F.col("id").alias("node_id"))


def integrity_cycles(edges: DataFrame) -> DataFrame:
    """One row per node of a causal cycle; `message` names the cycle by its smallest node."""
    return causal_cycles(edges).select(*_issue(
        "cycle_detected", ["node_id"], []))


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All issues of a graph."""
    parts = [integrity_dangling(nodes, edges), integrity_self_loop(edges), integrity_duplicate(edges),
             integrity_missing_run(nodes), integrity_orphan(nodes, edges), integrity_cycles(edges)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

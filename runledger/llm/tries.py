"""The trie of conversation prefixes, by splitters and their skeleton.

A conversation is the path of its turns, a token of 24 bytes each: 16 of a hash of role and text, 8 for the
bytes of the text. Equal paths are counted first, so a path that a third of all conversations share is one row.
Paths are range-partitioned and sorted into shards. Nodes whose paths lie in two neighbouring shards are the
common prefixes of the last path of one and the first of the next: with the root they are the skeleton, a small
trie that is broadcast. Every task walks its sorted shard with one open node per depth and finishes all other
nodes; for those of the skeleton it gives partial aggregates, which one reduction by node combines.

A path longer than `SEGMENT` turns is cut into segments, each a path of its own below the hash of all that
comes before; levels of segments are worked off from the deepest, each handing the totals of its tops to the level above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.ordered import SLICE, position, scan, with_slices
from runledger.llm.arrow import prepare
from runledger.session import cut_lineage, cut_to_table

TOKEN = 24
SEGMENT = 1 << 16  # turns of a path that one row holds
SHARD = 1 << 19  # tokens a shard has about
SKELETON = 1 << 20  # tokens the skeleton has at most
IDS = 50_000  # conversation ids that one row joins
EMPTY = hashlib.sha256(b"").hexdigest()


def token(role: Column, text: Column) -> Column:
    """A turn as 48 hexadecimal digits."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 16, "0"))


def turns_in_order(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, token) of all turns; pos is 0 for the first. Null turns come first; equal ones go by role, then token."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    narrow = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.timestamp_micros(F.col(turn_col).cast("long")).alias("at"), role.alias("role"), token(role, text).alias("token"))
    narrow = with_slices(narrow, ["conv_id"], "at")
    return scan(narrow, ["conv_id"], [F.col("at").asc_nulls_first(), F.col("role"), F.col("token")], pos=position()).select("conv_id", "pos", "token")


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv_id, pos, token) of the rebuilt conversations, and a row with null pos for each conversation.

    Conversation c takes the first h turns of conversation c - c % 5, h = crc32(c) % 9, then its own after its first h.
    """
    sizes = cut_to_table(placed.groupBy("conv_id").agg(F.count("*").alias("size")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h)
    base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = cut_to_table(convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")))
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "token")
    first = placed.where("pos < 8").withColumnRenamed("conv_id", "base")
    lent = first.join(convs, "base").where("pos < h").select("conv_id", "pos", "token")
    return own.unionByName(lent).unionByName(convs.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("token")))


def paths(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, level, path, below): a row for each `segment` turns of a conversation, one at least.

    From level 1 on a path starts with a token of all turns before it, the top; `below` is that of the next level, null where the conversation ends.
    """
    level = F.coalesce(F.expr(f"pos div {segment}"), F.lit(0)).cast("int")
    rows = turns.groupBy("conv_id", level.alias("level")).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token")))).alias("turns"))
    rows = rows.select("conv_id", "level", F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), "")).alias("path"))
    rows = cut_to_table(rows)
    if rows.where("level > 0").isEmpty():
        return rows.withColumn("below", F.lit(None).cast("binary"))
    hashes = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("level", F.sha2("path", 256).alias("h")))).alias("hashes")).where(F.size("hashes") > 1)  # one a segment
    top = lambda k: F.unhex(F.substring(F.aggregate(F.slice("hashes", F.lit(1), k), F.lit(""), lambda a, x: F.sha2(F.concat(a, x["h"]).cast("binary"), 256)), 1, 2 * TOKEN))
    at = F.col("level")
    tops = hashes.select("conv_id", "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("level"))
    tops = tops.select("conv_id", "level", F.when(at > 0, top(at)).alias("top"), F.when(at < F.size("hashes") - 1, top(at + 1)).alias("below"))
    return cut_to_table(rows.join(tops, ["conv_id", "level"], "left").select("conv_id", "level", F.concat(F.coalesce("top", F.lit(b"")), "path").alias("path"), "below"))


def ends_of(rows: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the ids of conversations that end with a path, going up. Many ids are joined slice by slice and hashed in a stream."""
    ending = rows.where("below IS NULL").select(F.sha2("path", 256).alias("key"), "conv_id", F.timestamp_micros("conv_id").alias("at"))
    ending = with_slices(ending, ["key"], "at", IDS)
    by = ["key", SLICE] if SLICE in ending.columns else ["key"]
    parts = ending.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    if len(by) == 1:
        return parts.select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))

    def hashed(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    digest.update(b",")
                else:
                    done += [(key, digest.hexdigest())] if digest else []
                    key, digest = k, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], pa.string()) for j in (0, 1)], names=["key", "ends"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends"])

    parts = parts.repartition("key").sortWithinPartitions("key", SLICE).select("key", "ids")
    return parts.mapInArrow(hashed, "key string, ends string")


class Skeleton:
    """The trie of what neighbouring shards have in common; node 0 is the root, children have larger numbers than parents."""

    def __init__(self, bounds: list[tuple[bytes, bytes]]):
        self.child, self.parent, self.token = {}, [-1], [b""]
        for (_, last), (first, _) in zip(bounds, bounds[1:], strict=False):
            node = 0
            for k in range(0, min(len(last), len(first)), TOKEN):
                t = last[k: k + TOKEN]
                if t != first[k: k + TOKEN]:
                    break
                if (node, t) not in self.child:
                    self.child[node, t] = len(self.parent)
                    self.parent.append(node)
                    self.token.append(t)
                node = self.child[node, t]


class Open:
    """A node whose shard is still being read."""

    __slots__ = ("below", "children", "conv", "ends", "leaves", "n", "node", "saved", "token", "waiting")

    def __init__(self, token: bytes, node: int):
        self.token, self.node = token, node  # number in the skeleton, -1 if not of it
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends, self.below, self.waiting = 0, None, 0, 0, 0, None, None, []


def walk(rows: Iterator[tuple], skeleton: Skeleton, level: int, segment: int) -> Iterator[tuple]:
    """Node rows, partial aggregates and tops of a sorted shard: see `NODES`.

    A finished node waits for its parent to be closed, as the parent's smallest id is part of its row; below
    the skeleton rows leave at once with the number of the parent.
    """
    stack, deeper, above = [Open(b"", 0)], 1 if level else 0, level * segment

    def close():
        x, depth = stack.pop(), len(stack)
        up = stack[-1] if stack else None
        if x.node >= 0:
            yield ("skeleton", x.conv, None, None, x.node, None, x.n, x.children, x.leaves, x.saved, x.ends, None, None)
        else:
            is_top = depth == 1 and deeper
            for row in x.waiting:
                yield (*row[:3], None if is_top else x.conv, None, x.token if is_top else None, *row[6:])
            x.waiting = []
            x.leaves = x.leaves or 1
            up.children += 1
            if is_top:
                yield ("top", x.conv, None, None, None, None, x.n, x.children, x.leaves, x.saved, x.ends, None, x.token)
            else:
                x.saved += (x.n - 1) * int.from_bytes(x.token[16:], "big")
                row = ("node", x.conv, above + depth - deeper, None, up.node, None, x.n, x.children, x.leaves, x.saved, x.ends or EMPTY, x.below, None)
                if up.node >= 0:
                    yield row
                else:
                    up.waiting.append(row)
        if up:
            up.n, up.leaves, up.saved = up.n + x.n, up.leaves + x.leaves, up.saved + x.saved
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)

    for path, n, conv, ends, below, children, leaves, saved in rows:
        tokens = [path[k: k + TOKEN] for k in range(0, len(path), TOKEN)]
        common = 0
        while common < len(tokens) and common + 1 < len(stack) and stack[common + 1].token == tokens[common]:
            common += 1
        while len(stack) > common + 1:
            yield from close()
        for t in tokens[common:]:
            stack.append(Open(t, skeleton.child.get((stack[-1].node, t), -1) if stack[-1].node >= 0 else -1))
        x = stack[-1]
        x.n, x.conv, x.ends, x.below = x.n + n, conv if x.conv is None else min(x.conv, conv), ends, below
        if children is not None:  # what the level below has under this path
            x.children, x.leaves, x.saved = x.children + children, x.leaves + leaves, x.saved + saved
    if stack[0].n or len(stack) > 1:
        while stack:
            yield from close()


NODES = ("kind string, conv_id long, depth long, parent_conv_id long, parent_node int, parent_top binary, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, below binary, top binary")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def level_nodes(rows: DataFrame, tails: DataFrame | None, level: int, segment: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of the paths of one level; `tails` has the tops of the level below."""
    spark = rows.sparkSession
    distinct = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("below").alias("below")).withColumn("key", F.sha2("path", 256))
    distinct = distinct.join(ends_of(rows), "key", "left")
    if tails is None:
        distinct = distinct.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
    else:
        distinct = distinct.join(tails.select(F.col("top").alias("below"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), "below", "left")
    distinct = cut_to_table(distinct.select("path", "n", "conv_id", "ends", "below", "children", "leaves", "saved"))
    tokens = distinct.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    shards = int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // TOKEN // shard + 1), SKELETON // 64))
    cut = SKELETON // shards * TOKEN  # nodes below are never split, so bounds of this length say all
    start = F.substring("path", 1, cut)
    ranged = cut_lineage(distinct.repartitionByRange(shards, start).sortWithinPartitions("path").withColumn("shard", F.spark_partition_id()))
    bounds = ranged.groupBy("shard").agg(F.min(start).alias("first"), F.max(start).alias("last")).orderBy("shard").collect()  # SKELETON tokens twice at most
    skeleton = Skeleton([(bytes(r["first"]), bytes(r["last"])) for r in bounds])
    shared = spark.sparkContext.broadcast(skeleton)

    def run(batches):
        made, names = [], [f.name for f in schema.fields]
        values = ((*(c.as_py() for c in row),) for batch in batches for row in zip(*batch.columns, strict=True))
        for row in walk(values, shared.value, level, segment):
            made.append(row)
            if len(made) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    schema = T.StructType.fromDDL(NODES)
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.dataType.simpleString()] for f in schema.fields]
    out = cut_to_table(ranged.drop("shard").mapInArrow(run, schema))
    sums = out.where("kind = 'skeleton'").groupBy("parent_node").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("conv"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"))
    whole = {r["parent_node"]: r for r in sums.collect()}  # a row for each node of the skeleton
    count = len(skeleton.parent)
    more, children, depth = [0] * count, [0] * count, [0] * count
    for k in range(1, count):
        depth[k] = depth[skeleton.parent[k]] + 1
        children[skeleton.parent[k]] += 1
    made = []
    for k in reversed(range(count)):
        if k not in whole:
            continue  # an empty table has no root
        r, up, is_top = whole[k], skeleton.parent[k], bool(level) and depth[k] == 1
        if k and not is_top:
            more[k] += (r["n"] - 1) * int.from_bytes(skeleton.token[k][16:], "big")
        if k:
            more[up] += more[k]
        below_top = bool(level) and depth[k] == 2
        kind = "root" if level and k == 0 else "top" if is_top else "node"
        made.append((kind, r["conv"], level * segment + depth[k] - bool(level), whole[up]["conv"] if k and not below_top else None, None, bytearray(skeleton.token[up]) if below_top else None, r["n"],
                     r["children"] + children[k], r["leaves"], r["saved"] + more[k], r["ends"] or EMPTY, None, bytearray(skeleton.token[k]) if is_top else None))
    both = out.where("kind <> 'skeleton'").unionByName(spark.createDataFrame(made, schema))
    convs = spark.createDataFrame([(k, r["conv"]) for k, r in whole.items()], "skeleton_node int, skeleton_conv long")
    tops = both.where("kind = 'top'")
    nodes = both.where("kind = 'node'")
    if level:  # those right under a top belong to the node it stands for, which lies in the level above
        top_tokens = spark.createDataFrame([(k, bytearray(t)) for k, t in enumerate(skeleton.token) if depth[k] == 1], "skeleton_node int, skeleton_top binary")
        nodes = nodes.join(F.broadcast(top_tokens), F.col("parent_node") == F.col("skeleton_node"), "left").withColumn("parent_top", F.coalesce("parent_top", "skeleton_top")).drop("skeleton_node", "skeleton_top")
    nodes = nodes.join(F.broadcast(convs), F.col("parent_node") == F.col("skeleton_node"), "left")
    return nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.when(F.col("parent_top").isNull(), F.col("skeleton_conv")))), tops


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty ones. Turns without a number come first, equal numbers go by role and a hash of
    the text; repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. A
    conversation of which nothing is left ends at the root. An empty table gives no rows, not even a root. Texts of any
    length are hashed whole. Other columns are not looked at.
    """
    spark = prepare(conversations.sparkSession)
    placed = cut_to_table(turns_in_order(conversations, id_col, turn_col, role_col, text_col))
    rows = paths(rebuilt(placed), segment)
    last = rows.agg(F.max("level")).first()[0]
    if last is None:
        return spark.createDataFrame([], NODES).select(RESULT)
    tails, levels = None, []
    for level in range(last, -1, -1):
        nodes, tails = level_nodes(rows.where(F.col("level") == level), tails, level, segment, shard)
        levels.append(cut_to_table(nodes) if last else nodes)
    out = [levels[-1].select(RESULT)]
    for nodes, above in zip(levels, levels[1:], strict=False):
        known = above.where("below IS NOT NULL").select(F.col("below").alias("parent_top"), F.col("conv_id").alias("top_conv"))
        out.append(nodes.join(known, "parent_top", "left").withColumn("parent_conv_id", F.coalesce("top_conv", "parent_conv_id")).select(RESULT))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole

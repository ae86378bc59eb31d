"""The conversation trie against a plain Python one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from runledger.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role, digest, text))
    convs = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in convs.items()}
    nodes = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(convs.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    saved, leaves, children = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in sorted(nodes, key=len, reverse=True):
        if path:
            saved[path] += (len(nodes[path]) - 1) * len(path[-1][1].encode())
            children[path[:-1]] += 1
        leaves[path] = leaves[path] or 1
        if path:
            saved[path[:-1]] += saved[path]
            leaves[path[:-1]] += leaves[path]
    smallest = {p: min(c for c, _ in m) for p, m in nodes.items()}
    return sorted((smallest[p], len(p), smallest[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest()) for p, m in nodes.items())


def chats(seed):
    """Shared first turns, equal conversations, ties, nulls, repeated rows, one long conversation, negative ids and gaps."""
    rng, rows = random.Random(seed), []
    for c in [*range(60), 97, 101, -1, -4, -5, -12]:
        for turn in range(rng.randint(0, 7)):
            rows.append((c, rng.choice([turn, turn, 3, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["ja", "nein", "é" * 3, "", None])))
    for c in (200, 205, 210, 215, 220):  # of one base each
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    for c in (300, 305):
        rows += [(c, t, "user", f"long {min(t, 14)}") for t in range(18)]
    return rows + rows[:5] + [(None, 1, "user", "nobody's")]


def collected(df):
    return sorted(tuple(r[c] for c in tries.RESULT) for r in df.collect())


@pytest.mark.parametrize(("segment", "shard"), [(1 << 16, 1 << 19), (1 << 16, 30), (6, 40)])
def test_trie(spark, segment, shard):
    rows = chats(segment)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"pos": F.lit(1), "path": F.lit("clash"), "depth": F.lit(9)})
    assert collected(tries.conversation_trie(df, segment=segment, shard=shard)) == brute(rows)


def test_hot_path(spark, monkeypatch):
    """A path of many conversations: its ids are hashed slice by slice, to the same hash."""
    monkeypatch.setattr(tries, "IDS", 7)
    rows = [(c, 0, "user", "hello") for c in range(5, 400, 5)] + [(c, t, "user", f"t{t}") for c in range(401, 420) for t in range(3)]
    assert collected(tries.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard=3)) == brute(rows)


def test_nothing(spark):
    assert tries.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tries.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_long_text(spark):
    rows = [(c, 0, "user", "x" * 3_000_000) for c in (10, 15, 20)]
    assert collected(tries.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)

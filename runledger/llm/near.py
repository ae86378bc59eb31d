"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures.

A document is the set of its shingles of `width` words (five by default; two in op7, as its contract says). Its signature has 64 MinHash values cut to 16 bits.
It is split into 13 chunks; two signatures that differ in at most 25 values have, by pigeonhole, a
chunk in which at most one value differs. So each chunk is indexed once per allowed error place, with
that value left out: 64 keys per document find every pair within the distance. At a Jaccard of 0.8 the
distance is 12.8 +- 3.2, so a pair of that similarity is beyond 25 about once in 10,000 times, a pair
of 0.85 never. Two low bits of each value make a 128-bit sketch that drops pairs found by chance.
Links are confirmed on whole sets.

Documents with equal sets are one class. Keys go through one shuffle as (key, class) and are read sorted, in a
stream that lets pass only keys of several classes, a few in a hundred. In a list of classes with a common key, each is compared with
three of them (smallest, largest, smallest by hash), not with all. Where a list then still holds several
components, links between these are looked for exactly: its members are joined by the rarest shingles
of their sets, with length and positional filters, and only across components. Nothing emits all pairs
of a list, and no list is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import broadcast_if_small, lean, mix64, pieces, prepare, ranges, words
from runledger.llm.components import components
from runledger.session import cut_to_table

NUM, DEN = 4, 5
WIDTH = 5  # words of a shingle
VALUES, CHUNKS, SKETCH_BITS = 64, 13, 32
ROW_BITS = 14  # rows of a piece; the other bits of a sort key are the leading ones of the shingle
CELLS = 1 << 20

_RNG = np.random.default_rng(7)
_FLIP = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = np.arange(VALUES) * CHUNKS // VALUES


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `width` words of each row, sorted, and the row offsets in them.

    A row of fewer words has all of them as its shingle, a row without words none.
    """
    h, _, _, at = words(data, offsets)
    n = np.diff(at)
    first, row = ranges(at[:-1], np.maximum(n - width + 1, np.minimum(n, 1)))
    s = h[first]
    for k in range(1, width):
        after = h[np.minimum(first + k, max(len(h) - 1, 0))]
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + np.where(n[row] > k, after, np.uint64(1)))
    packed = (row.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (s >> np.uint64(ROW_BITS))
    order = np.argsort(packed)
    p, g = packed[order], s[order]
    alike = p[1:] == p[:-1]
    if np.any(alike & (g[1:] != g[:-1])):  # equal in the leading bits alone
        order = np.lexsort((s, row))
        p, g = packed[order], s[order]
        alike = p[1:] == p[:-1]
    fresh = np.concatenate([[True], ~alike | (g[1:] != g[:-1])])[: len(g)]
    p, g = p[fresh], g[fresh]
    cuts = np.searchsorted(p, np.arange(len(offsets) - 1, dtype=np.uint64) << np.uint64(64 - ROW_BITS))
    return g, np.concatenate([cuts, [len(g)]])


def small_pieces(batch: pa.RecordBatch, column: str):
    for low in range(0, batch.num_rows, 1 << ROW_BITS):
        yield from pieces(batch.slice(low, 1 << ROW_BITS), column)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets: 64 numbers of 16 bits each."""
    x = (mix64(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, VALUES), np.uint16)
    for i in range(VALUES):
        least = np.minimum.reduceat((x ^ _FLIP[i]) * _TIMES[i], at[:-1])
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """One key per place: the chunk of the place without the value at the place."""
    parts = (sig.astype(np.uint64) + np.uint64(1)) * _PLACE
    sums = np.stack([parts[:, c == _CHUNK].sum(1, dtype=np.uint64) for c in range(CHUNKS)], 1)
    return mix64(sums[:, _CHUNK] - parts + np.arange(VALUES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _bits(sig: np.ndarray, bit: int) -> np.ndarray:
    return ((sig >> bit & 1).astype(np.uint64) << np.arange(VALUES, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _as_lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def scan(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """From rows (doc, th, text): doc, th, n, cls and cls2 (hash of the set), sketches, keys. No keys: an empty set."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in small_pieces(batch, "text"):
                sets, at = shingle_sets(data, offsets, width)
                n = np.diff(at)
                some = n > 0
                starts = np.concatenate([at[:-1][some], at[-1:]])
                hashes = np.zeros((4, part.num_rows), np.uint64)
                keys = np.zeros((0, VALUES), np.uint64)
                if some.any():
                    sig = signatures(sets, starts)
                    keys = chunk_keys(sig)
                    hashes[0, some] = np.add.reduceat(mix64(sets ^ np.uint64(0x51ED270B)), starts[:-1])
                    hashes[1, some] = np.add.reduceat(mix64(sets + np.uint64(0x2545F491)), starts[:-1])
                    hashes[2, some], hashes[3, some] = _bits(sig, 0), _bits(sig, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), *[pa.array(x.view(np.int64)) for x in hashes],
                     _as_lists(keys.ravel(), np.concatenate([[0], np.cumsum(some) * VALUES]))],
                    names=["doc", "th", "n", "cls", "cls2", "bits0", "bits1", "keys"])

    fields = [("th", T.LongType()), ("n", T.LongType()), ("cls", T.LongType()), ("cls2", T.LongType()), ("bits0", T.LongType()), ("bits1", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(lean(run), T.StructType([docs.schema["doc"], *(T.StructField(*f) for f in fields)]))


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Sets of the wanted classes, from the text of one document each (cls, doc, th)."""
    wanted = broadcast_if_small(cut_to_table(wanted.select("cls", F.col("doc").alias("w_doc"), F.col("th").alias("w_th"))))
    joined = docs.join(wanted, F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th"))).select("cls", "text")

    def run(batches):
        for batch in batches:
            for part, data, offsets in small_pieces(batch, "text"):
                sets, at = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([part.column(0), _as_lists(sets, at)], names=["cls", "tokens"])

    return joined.mapInArrow(lean(run), "cls long, tokens array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left, right = (sets.select(F.col("cls").alias(k), F.col("tokens").alias(f"{k}_tokens")) for k in "ab")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    fits = (num * F.size("a_tokens") <= den * F.size("b_tokens")) & (num * F.size("b_tokens") <= den * F.size("a_tokens"))
    return (pairs.join(left, "a").join(right, "b").where(fits)
            .where(den * both >= num * (F.size("a_tokens") + F.size("b_tokens") - both)).select("a", "b"))


def _stars(near: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each class with three classes of each of its lists."""
    reps = near.where(F.col("cls").isin(F.col("low"), F.col("high")) | (F.xxhash64("cls") == F.col("mixed")))
    reps = reps.select("key", F.col("cls").alias("r"), F.col("n").alias("r_n"), F.col("bits0").alias("r0"), F.col("bits1").alias("r1"))
    apart = F.bit_count(F.col("bits0").bitwiseXOR(F.col("r0"))) + F.bit_count(F.col("bits1").bitwiseXOR(F.col("r1")))
    fits = (num * F.col("n") <= den * F.col("r_n")) & (num * F.col("r_n") <= den * F.col("n"))
    return (near.join(reps, "key").where((F.col("cls") != F.col("r")) & fits & (apart <= SKETCH_BITS))
            .select(F.least("cls", "r").alias("a"), F.greatest("cls", "r").alias("b")).distinct())


def _across(near: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Links between components that share a list of three or more classes."""
    placed = near.where("many > 2").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    split = placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    members = cut_to_table(placed.join(split, "key", "left_semi").select("cls", "root").distinct())
    sets = cut_to_table(_sets_of(docs, classes.join(members, "cls", "left_semi"), width).join(members, "cls"))

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            cells += np.bincount(batch.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(cells[some])], names=["cell", "n"])

    cells = np.zeros(CELLS, np.int64)
    got = sets.select("tokens").mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one number per cell
    cells[got.column("cell").to_numpy()] = got.column("n").to_numpy()

    def prefix(batches):
        for batch in batches:
            lists = batch.column(1)
            tokens, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((tokens, cells[tokens & (CELLS - 1)], owner))
            length = n - (num * n + den - 1) // den + 1
            at, row = ranges(np.cumsum(n) - n, length)
            pos = at - (np.cumsum(n) - n)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(tokens[order][at]), pa.array(n[row], pa.int32()), pa.array(pos, pa.int32())],
                                             names=["cls", "root", "token", "n", "pos"])

    postings = sets.select("cls", "tokens", "root").mapInArrow(lean(prefix), "cls long, root long, token long, n int, pos int")
    shared = postings.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("token")
    postings = cut_to_table(postings.join(shared, "token", "left_semi"))
    a, b = (postings.select("token", *[F.col(c).alias(f"{k}_{c}") for c in ("cls", "root", "n", "pos")]) for k in "ab")
    most = 1 + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1
    found = a.join(b, (a.token == b.token) & (F.col("a_cls") < F.col("b_cls")) & (F.col("a_root") != F.col("b_root"))
                   & (num * F.col("a_n") <= den * F.col("b_n")) & (num * F.col("b_n") <= den * F.col("a_n"))
                   & ((num + den) * most >= num * (F.col("a_n") + F.col("b_n"))))
    return _linked(cut_to_table(found.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()), sets, num, den)


def _shared(postings: DataFrame) -> DataFrame:
    """The rows (key, cls) whose key another row has too. They come sorted by key; one row is held from batch to batch."""

    def run(batches):
        held = None  # the last row so far: key, class, whether it has been given
        for batch in batches:
            key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            keep = np.zeros(len(key), bool)
            same = key[1:] == key[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None and held[0] == key[0]:
                keep[0] = True
                if not held[2]:
                    yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["key", "cls"])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep])], names=["key", "cls"])
            held = int(key[-1]), int(cls[-1]), bool(keep[-1])

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "key long, cls long")


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """From rows (doc, th, text): doc, th, n, first. first: the smallest doc of the component.

    Null ids are never the smallest unless a component has no other. Empty sets are alone.
    """
    sigs = cut_to_table(scan(docs, width))
    full = sigs.where("n > 0")
    classes = cut_to_table(full.groupBy("cls", "cls2").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "th")).alias("m"), *[F.min(c).alias(c) for c in ("n", "bits0", "bits1")])
                           .select("cls", "m.doc", "m.th", "n", "bits0", "bits1"))
    chosen = full.join(classes.select(F.col("cls").alias("c"), F.col("doc").alias("d"), F.col("th").alias("t")),
                       (F.col("cls") == F.col("c")) & F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    listed = cut_to_table(_shared(chosen.select(F.explode("keys").alias("key"), "cls")))
    lists = (listed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min(F.xxhash64("cls")).alias("mixed"), F.count("*").alias("many"))
             .where("low <> high"))
    near = cut_to_table(listed.join(lists, "key").join(classes.select("cls", "n", "bits0", "bits1"), "cls"))
    stars = cut_to_table(_stars(near, num, den))
    wanted = classes.join(stars.select(F.col("a").alias("cls")).union(stars.select("b")).distinct(), "cls", "left_semi")
    links = cut_to_table(_linked(stars, cut_to_table(_sets_of(docs, wanted, width)), num, den))
    roots = components(links)
    more = cut_to_table(_across(near, roots, classes, docs, num, den, width))
    if more.head(1):
        roots = components(links.union(more))
    own = roots.join(classes, roots.node == classes.cls).groupBy("root").agg(F.min("doc").alias("first"))
    firsts = roots.join(own, "root").select(F.col("node").alias("cls"), "first")
    alone = classes.join(firsts, "cls", "left_anti").select("cls", F.col("doc").alias("first"))
    return (sigs.join(firsts.union(alone), "cls", "left")
            .select("doc", "th", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc")).alias("first")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are runs of other signs than blanks and \\x09-\\x0D, A-Z lower-cased; a text of fewer than
    `width` words has them all as its shingle. Null texts and texts without words are linked with nothing. Repeated rows are in one
    component and all get its id; kept is id = component_id, also where both are null. An empty table
    gives no rows; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    rows = near_duplicates(_keyed(docs, id_col, text_col), num, den, width)
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), F.col("doc").eqNullSafe(F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """`docs` with one document of each component, that of the smallest id. Empty documents all stay."""
    prepare(docs.sparkSession)
    rows = cut_to_table(near_duplicates(_keyed(docs, id_col, text_col), num, den, width))
    kept = rows.where((F.col("n") == 0) | F.col("doc").eqNullSafe(F.col("first"))).select(F.col("doc").alias("k_doc"), F.col("th").alias("k_th"), "n")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    out = packed.join(kept.distinct(), F.col("id").eqNullSafe(F.col("k_doc")) & (F.col("th") == F.col("k_th")))
    if kept.where("n > 0").groupBy("k_doc").count().where("count > 1").head(1):  # rows that share the id of a kept one
        out = out.where("n > 0").dropDuplicates(["id"]).union(out.where("n = 0"))
    return out.select("row.*")

"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words. Words are ranked by rarity; two lines with a Jaccard of at least
num/den share one of the rarest `n - ceil(n * num / den) + 1` words of each (its prefix). Lines that
share a prefix word are compared if their sizes and the places of that word leave room for the
threshold (length and positional filters) and if parity bitmaps of their words, which differ in at
most as many bits as the sets in words, do so too. What passes is verified on whole sets. A line goes if an earlier one in
(doc_id, line number, hash of the set) is that similar, whether or not that one stays.

Lines with equal sets are one class from the start, so a line that half of all documents share is one
class. A list of lines with a common prefix word is put in order and read in a stream, and each line
gives its earliest `FIRST` candidates of the list, one of which nearly always settles it. Lines that
stand after that and had more candidates are compared with all of them. Lists of words with more than
LIST occurrences are dealt out by line; lines standing in their part are then joined with the other parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import SPACE_WORDS, add_columns, broadcast_if_small, lean, mix64, pieces, prepare, ranges, words
from runledger.session import cut_to_table

NUM, DEN = 4, 5
COUNTERS, STRETCH = 1 << 22, 1 << 10
LIST = 8192
FIRST = 2
ONCE = 32  # rarity of a word that occurs once
SENT = 64 << 20  # bytes of a stored table that is sent to every task, at most


def _small(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df, size=SENT)


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of all rows: first byte, row, number in the row. A row has one line more than line ends."""
    ends = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, ends, "right") - 1
    starts = np.concatenate([offsets[:-1], ends + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    return starts, rows, np.arange(len(rows)) - np.searchsorted(rows, rows)


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the runs of `values` between neighbours of `ends`."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _cells(total: np.ndarray) -> pa.RecordBatch:
    """The cells that are not 0, as places in their stretch and counts; a task with few distinct words has few."""
    at = np.flatnonzero(total)
    bounds = np.searchsorted(at, np.arange(0, COUNTERS + 1, STRETCH))
    some = np.flatnonzero(np.diff(bounds))
    ends = np.concatenate([bounds[some], bounds[-1:]])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _bytes((at & (STRETCH - 1)).astype(np.uint16), ends), _bytes(total[at], ends)], names=["stretch", "cells", "counts"])


def _token_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Rarity of words: 32 times the logarithm of their count, counted in a fixed number of cells.

    Tasks give their counts in stretches of cells, which are added up stretch by stretch.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, data, offsets in pieces(batch, "text"):
                np.add.at(total, (words(data, offsets)[0] & np.uint64(COUNTERS - 1)).view(np.int64), np.uint32(1))
        yield _cells(total)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(k, np.zeros(STRETCH, np.int64))[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["stretch", "counts"])

    out = np.zeros((COUNTERS // STRETCH, STRETCH), np.int64)
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(count), "stretch int, cells binary, counts binary").repartition("stretch")
    for row in parts.mapInArrow(lean(add), "stretch int, counts binary").collect():  # COUNTERS numbers
        out[row["stretch"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(np.round(32 * np.log2(out.reshape(-1) + 1)), 1023).astype(np.int16)


def _ranked(h: np.ndarray, line: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Order of the words of each line, rarest first, each word once."""
    rank = rarity[(h & np.uint64(COUNTERS - 1)).view(np.int64)]
    if len(line) and line[-1] >= 1 << 22:
        order = np.lexsort((h, rank, line))
    else:
        packed = (line.astype(np.uint64) << np.uint64(42)) | (rank.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
        order = np.argsort(packed)
        p, g = packed[order], h[order]
        if np.any((p[1:] == p[:-1]) & (g[1:] != g[:-1])):
            order = np.lexsort((h, rank, line))
    g, owner = h[order], line[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return order[fresh]


def _sets(data, offsets, rarity):
    """Lines with words: line number, row, words (rarest first), offsets of the lines in them."""
    h, at, _, _ = words(data, offsets)
    starts, rows, numbers = split_lines(data, offsets)
    line = np.searchsorted(starts, at, "right") - 1
    order = _ranked(h, line, rarity)
    owner = line[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return numbers[owner[first]], rows[owner[first]], h[order], np.concatenate([first, [len(order)]])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values.view(np.int64) if values.itemsize == 8 else values))


def _lines(docs: DataFrame, rarity: np.ndarray, num: int, den: int, limit: int) -> DataFrame:
    """Per line: s1, s2 (hash of the set), doc, line, th, n (its size), bm0, bm1 (bitmap), prefix (list keys), places (in the line's order), hot (words whose lists are dealt out)."""
    shortest = -(-num // (den - num)) if num < den else 1 << 30  # sets of fewer words are only similar to equal ones

    def run(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                number, row, h, at = _sets(data, offsets, rarity)
                n = np.diff(at)
                length = np.where(n >= shortest, n - (num * n + den - 1) // den + 1, 0)
                values, owner = ranges(at[:-1], length)
                place = values - at[:-1][owner]
                shared = rarity[(h[values] & np.uint64(COUNTERS - 1)).view(np.int64)] > ONCE  # a word of one line has no partner
                values, owner, place = values[shared], owner[shared], place[shared]
                length = np.bincount(owner, minlength=len(n))
                some = len(n) > 0
                s1, s2 = (np.add.reduceat(mix64(h ^ np.uint64(salt)), at[:-1]) if some else np.zeros(0, np.uint64) for salt in (0x1234567, 0x89ABCDEF))
                bit = (h >> np.uint64(8)) & np.uint64(127)
                maps = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), at[:-1]) if some else np.zeros(0, np.uint64) for k in (0, 1)]
                keys = h[values]
                parts = np.ceil(2 ** (rarity[(keys & np.uint64(COUNTERS - 1)).view(np.int64)] / 32.0) / limit).astype(np.uint64)
                dealt = parts > 1
                keys = np.where(dealt, mix64(keys + np.uint64(0x9E3779B97F4A7C15) * (s1[owner] % parts + np.uint64(1))), keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), part.column(1).take(pa.array(row)),
                     pa.array(n, pa.int32()), *[pa.array(m.view(np.int64)) for m in maps], _lists(keys, length), _lists(place.astype(np.int32), length), _lists(h[values][dealt], np.bincount(owner[dealt], minlength=len(n)))],
                    names=["s1", "s2", "doc", "line", "th", "n", "bm0", "bm1", "prefix", "places", "hot"])

    longs, ints = T.LongType(), T.IntegerType()
    return docs.mapInArrow(lean(run), T.StructType([T.StructField("s1", longs), T.StructField("s2", longs), docs.schema["doc"], T.StructField("line", ints), T.StructField("th", longs), T.StructField("n", ints),
                                              T.StructField("bm0", longs), T.StructField("bm1", longs), T.StructField("prefix", T.ArrayType(longs)), T.StructField("places", T.ArrayType(ints)), T.StructField("hot", T.ArrayType(longs))]))


def _sets_of(docs: DataFrame, wanted: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Word sets of the wanted lines (doc, th, line, s1)."""
    per_doc = _small(cut_to_table(wanted.groupBy(F.col("doc").alias("w_doc"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct("line", "s1")).alias("lines"))))
    joined = docs.join(per_doc, F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th")))

    def run(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                number, row, h, at = _sets(data, offsets, rarity)
                lists = part.column(1)
                want = {(r, x["line"]): x["s1"] for r, xs in enumerate(lists.to_pylist()) for x in xs}
                pick = [i for i, key in enumerate(zip(row.tolist(), number.tolist(), strict=True)) if key in want]
                length = np.diff(at)[pick]
                values, _ = ranges(at[pick], length)
                yield pa.RecordBatch.from_arrays([pa.array([want[int(row[i]), int(number[i])] for i in pick], pa.int64()), _lists(h[values], length)], names=["s1", "tokens"])

    return joined.select("text", "lines").mapInArrow(lean(run), "s1 long, tokens array<bigint>")


def _candidates(key, n, pos, maps, num, den, first):
    """Within runs of one key: (later, earlier, more) for the earliest `first` partners of each that pass the filters."""
    kind = np.int32 if 2 * (num + den) * int(n.max(initial=0)) < 1 << 31 else np.int64
    n, rest = n.astype(kind), (n - pos).astype(kind)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    begin = np.repeat(starts, np.diff(np.concatenate([starts, [len(key)]])))
    earlier = np.arange(len(key)) - begin
    cuts = np.searchsorted(np.cumsum(earlier), np.arange(0, earlier.sum() + 1, 1 << 21), "left")
    for low, high in zip(cuts, np.concatenate([cuts[1:], [len(key)]]), strict=True):
        b, i = ranges(begin[low:high], earlier[low:high])
        a = i + low
        na, nb = n[a], n[b]
        ok = np.flatnonzero((num * na <= den * nb) & (num * nb <= den * na))  # most pairs fail here, so the rest is not worked out for them
        a, b, total = a[ok], b[ok], na[ok] + nb[ok]
        least = (num * total + num + den - 1) // (num + den)  # words in common
        ok = np.flatnonzero(np.minimum(rest[a], rest[b]) >= least)
        a, b, apart = a[ok], b[ok], (total - 2 * least)[ok]
        ok = np.bitwise_count(maps[0][a] ^ maps[0][b]).astype(np.int64) + np.bitwise_count(maps[1][a] ^ maps[1][b]) <= apart
        a, b = a[ok], b[ok]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        count = np.searchsorted(a, a, "right") - np.searchsorted(a, a)
        yield a[rank < first], b[rank < first], (count > first)[rank < first]


def _probe(postings: DataFrame, num: int, den: int, first: int) -> DataFrame:
    """Candidate pairs (a later than b, more) of lists, which come sorted by key."""

    def run(batches):
        held = None
        for batch in _with_end(batches):  # the last list of a batch may go on in the next
            if batch is not None:
                held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                other = np.flatnonzero(held.column(0).to_numpy() != held.column(0)[-1].as_py())
                done = int(other[-1]) + 1 if len(other) else 0
            else:
                done = held.num_rows if held is not None else 0
            if not done:
                continue
            part, held = _by_place(held.slice(0, done)), held.slice(done)
            column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
            maps = [column(c).to_numpy().view(np.uint64) for c in ("bm0", "bm1")]
            both = column("np").to_numpy()
            for a, b, more in _candidates(column("key").to_numpy(), both >> 32, both & 0xFFFFFFFF, maps, num, den, first):
                if len(a):
                    a, b = pa.array(a), pa.array(b)
                    yield pa.RecordBatch.from_arrays([column("doc").take(a), column("line").take(a), column("doc").take(b), column("line").take(b), pa.array(more)], names=["a_doc", "a_line", "b_doc", "b_line", "more"])

    doc, line = postings.schema["doc"].dataType, postings.schema["line"].dataType
    return postings.mapInArrow(lean(run), T.StructType([T.StructField("a_doc", doc), T.StructField("a_line", line), T.StructField("b_doc", doc), T.StructField("b_line", line), T.StructField("more", T.BooleanType())]))


def _size_and_place(n: Column, place: Column) -> Column:
    """Both numbers in one, as postings are shuffled and handed over by the million."""
    return F.shiftleft(n.cast("bigint"), 32).bitwiseOR(place.cast("bigint"))


def _by_place(lists: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of lists, which are together, in order of document and line; null documents first."""
    doc = lists.column(lists.schema.get_field_index("doc"))
    if pa.types.is_int64(doc.type):
        keys = (lists.column(lists.schema.get_field_index("line")).to_numpy(), doc.fill_null(-(2**63)).to_numpy(), lists.column(0).to_numpy())
        return lists.take(pa.array(np.lexsort(keys)))
    return lists.take(pc.sort_indices(lists, sort_keys=[(c, "ascending") for c in ("key", "doc", "line")], null_placement="at_start"))


def _with_end(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def _fits(num: int, den: int) -> Column:
    """The filters of a pair (a_, b_) of lines of one list."""
    na, nb = F.col("a_n"), F.col("b_n")
    least = F.ceil(num * (na + nb) / (num + den))
    apart = F.bit_count(F.col("a_bm0").bitwiseXOR(F.col("b_bm0"))) + F.bit_count(F.col("a_bm1").bitwiseXOR(F.col("b_bm1")))
    return (num * na <= den * nb) & (num * nb <= den * na) & (apart <= na + nb - 2 * least)


def duplicate_lines(docs: DataFrame, num: int = NUM, den: int = DEN, limit: int = LIST, first: int = FIRST) -> DataFrame:
    """From rows (doc, th, text): the lines that stay, as rows doc, th, line. Lines without words are not listed."""
    rarity = _token_counts(docs, "text")
    found = _lines(docs, rarity, num, den, limit)
    rest = [c for c in found.columns if c not in ("s1", "s2", "doc", "line")]
    classes = cut_to_table(found.groupBy("s1", "s2").agg(F.min(F.struct("doc", "line", *rest)).alias("first")).select("s1", "s2", "first.*"))
    postings = classes.select("doc", "line", "n", "bm0", "bm1", "places", F.posexplode("prefix").alias("at", "key"))
    postings = postings.select("key", _size_and_place(F.col("n"), F.get("places", "at")).alias("np"), "bm0", "bm1", "doc", "line")
    lists = postings.repartition("key").sortWithinPartitions("key")
    places = _probe(lists, num, den, first).groupBy("a_doc", "a_line", "b_doc", "b_line").agg(F.max("more").alias("more"))
    places = _small(cut_to_table(places))
    named = lambda k: classes.select(F.col("s1").alias(k), F.col("doc").alias(f"{k}_d"), F.col("line").alias(f"{k}_l"))
    same = lambda k: F.col(f"{k}_doc").eqNullSafe(F.col(f"{k}_d")) & (F.col(f"{k}_line") == F.col(f"{k}_l"))
    pairs = cut_to_table(_small(cut_to_table(places.join(named("a"), same("a")))).join(named("b"), same("b")).where("a <> b").select("a", "b", "more"))
    place = F.struct("doc", "line", "s1")

    def matched(pairs: DataFrame) -> DataFrame:
        """The later classes of the similar pairs."""
        members = _small(cut_to_table(pairs.select(F.col("a").alias("s1")).union(pairs.select("b")).distinct()))
        sets = cut_to_table(_sets_of(docs, classes.join(members, "s1", "left_semi").select("doc", "th", "line", "s1"), rarity))
        left, right = (sets.select(F.col("s1").alias(k), F.col("tokens").alias(f"{k}_tokens")) for k in "ab")
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        similar = den * both >= num * (F.size("a_tokens") + F.size("b_tokens") - both)
        return _small(cut_to_table(pairs.join(left, "a").join(right, "b").where(similar).select(F.col("a").alias("s1")).distinct()))

    def side(rows: DataFrame, k: str, key: str) -> DataFrame:
        return rows.select(F.explode(key).alias("key"), *[F.col(c).alias(f"{k}_{c}") for c in ("s1", "n", "bm0", "bm1")], place.alias(f"{k}_at"))

    gone = matched(pairs)
    further = None
    for key, standing in (("prefix", pairs.where("more").select(F.col("a").alias("s1")).distinct()), ("hot", classes.where(F.size("hot") > 0).select("s1"))):
        # Few are left, so it is their ids that travel and not the lists of all lines.
        standing = classes.join(_small(cut_to_table(standing.join(gone, "s1", "left_anti"))), "s1", "left_semi")
        left = _small(cut_to_table(side(standing, "a", key)))
        found = left.join(side(classes, "b", key), "key").where((F.col("b_at") < F.col("a_at")) & _fits(num, den)).select(F.col("a_s1").alias("a"), F.col("b_s1").alias("b"))
        further = found if further is None else further.union(found)
    further = cut_to_table(further.distinct().join(pairs, ["a", "b"], "left_anti"))
    if further.head(1):
        gone = _small(cut_to_table(gone.union(matched(further))))
    return classes.join(gone, "s1", "left_anti").select("doc", "th", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    r"""`docs` with repeated lines taken out of the text, and n_lines, n_removed, kept_sha256.

    Lines end at \n. Words are runs of other signs than blanks and \x09-\x0D, A-Z lower-cased. Lines
    without words stay; a null text stays null with 0 lines, an empty one has one line. Rows with the
    same id and text are one document here: the same lines go from each. Null ids come first. An empty
    table gives no rows. Other columns pass through, those named like a result are replaced.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    stay = duplicate_lines(narrow, num, den).groupBy(F.col("doc").alias("k_doc"), F.col("th").alias("k_th")).agg(F.collect_list("line").alias("k_lines"))
    results = ("n_lines", "n_removed", "kept_sha256")
    others = [c for c in docs.columns if c != text_col and c not in results]
    marked = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    joined = marked.join(stay, F.col("id").eqNullSafe(F.col("k_doc")) & (F.col("th") == F.col("k_th")), "left").select("row", "text", "k_lines")

    def cut(data, offsets, part):
        starts, rows, numbers = split_lines(data, offsets)
        ends = np.concatenate([starts[1:] - 1, offsets[-1:]])
        last = np.flatnonzero(np.concatenate([rows[1:] != rows[:-1], [True]])) if len(rows) else []
        ends[last] = offsets[rows[last] + 1] if len(rows) else []
        raw = data.tobytes()
        signs = np.concatenate([[0], np.cumsum(np.frombuffer(raw.translate(SPACE_WORDS.astype(np.uint8).tobytes()), np.uint8), dtype=np.int64)])
        worded = signs[ends] > signs[starts]
        null = part.column(part.schema.get_field_index("text")).is_null().to_pylist()
        texts, n_lines, n_removed, digests = [], [], [], []
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        for r, kept in enumerate(part.column(part.schema.get_field_index("k_lines")).to_pylist()):
            own = slice(bounds[r], bounds[r + 1])
            stays = ~worded[own]
            stays[kept or []] = True
            text = b"\n".join(raw[s:e] for s, e in zip(starts[own][stays].tolist(), ends[own][stays].tolist(), strict=True))
            texts.append(None if null[r] else text)
            n_lines.append(0 if null[r] else len(stays))
            n_removed.append(int((~stays).sum()))
            digests.append(hashlib.sha256(text).hexdigest())
        return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]

    out = add_columns(joined, "text", {"kept": T.StringType(), "n_lines": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}, cut, drop=("k_lines",))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in results], *results)

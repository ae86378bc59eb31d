"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts anywhere else too.

One suffix array of all documents fits no task, so equal strings are first brought together. Every
window of `length` bytes has one anchor: its smallest hashed run of `GRAM` bytes, the leftmost of
equals. Equal windows have equal anchors at the same place, so windows only have to be compared
within the same anchor, and an anchor that occurs once has no repeats. An occurrence of an anchor
owns a run of windows; the bytes of these are its snippet.

Equal snippets of an anchor are counted, and all their bytes are repeats. The different snippets of
an anchor that occurs again go, one of each, to buckets of bounded size. A bucket is one string: its
suffix array is made by two-stage sorting, and neighbours with a common prefix of `length` bytes are
repeats. An anchor with more than `most` different snippets (a passage that half of all documents
quote in their own context) is dealt out to several buckets; each bucket then also gives the
fingerprints of its different windows, one per kind, and kinds found in two buckets are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import _DOWN, BLOCK, add_columns, mix64, pieces, prefix_sums, prepare, ranges, text_buffer
from runledger.llm.suffixes import repeated
from runledger.session import cut_to_table

LENGTH, GRAM, MOST, BUCKET_BYTES = 200, 48, 8192, 4 << 20


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place of a block."""
    sums = prefix_sums(data)
    count = len(data) - size + 1
    return mix64((sums[size:] - sums[:-size]) * _DOWN[:count])


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash among the `width` from each place, leftmost of equals."""
    bits = np.uint64(BLOCK.bit_length())
    best = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    if done < width:
        best = np.minimum(best[: len(h) - width + 1], best[width - done: width - done + len(h) - width + 1])
    return (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor occurrences of rows of bytes: hash, row, place of the anchor, first window, number of windows, hash of the snippet."""
    out = []
    for low in range(0, max(len(data) - length + 1, 0), BLOCK - 2 * length):
        block = data[low: low + BLOCK - length]
        if len(block) < length:
            break
        h = _hashes(block, gram)
        at = _smallest(h, length - gram + 1)
        place = np.arange(len(at)) + low
        row = np.searchsorted(offsets, place, "right") - 1
        own = np.flatnonzero((place + length <= offsets[row + 1]) & (np.arange(len(at)) < BLOCK - 2 * length))
        if not len(own):
            continue
        a, s = at[own], own
        fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
        first, n = s[fresh], np.diff(np.concatenate([fresh, [len(own)]]))
        sums = prefix_sums(block)
        snippet = (sums[first + n - 1 + length] - sums[first]) * _DOWN[first]
        snippet = mix64(snippet + (a[fresh] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out.append((h[a[fresh]], row[own[fresh]], a[fresh] + low, first + low, n, snippet))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                h, row, _, first, n, snippet = anchors(data, offsets, length, gram)
                # In a periodic text one snippet follows itself again and again: such a run is one row.
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (snippet[1:] != snippet[:-1]) | (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1])
                at = np.flatnonzero(fresh)
                times = np.diff(np.concatenate([at, [len(h)]]))
                row = row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array(first[at] - offsets[row]), pa.array(n[at], pa.int32()), pa.array(times, pa.int32()), pa.array(snippet[at].view(np.int64))],
                    names=["anchor", "doc", "th", "first", "n", "times", "snippet"])

    longs = T.LongType()
    return docs.mapInArrow(run, T.StructType([T.StructField("anchor", longs), docs.schema["doc"], T.StructField("th", longs), T.StructField("first", longs),
                                              T.StructField("n", T.IntegerType()), T.StructField("times", T.IntegerType()), T.StructField("snippet", longs)]))


def _snippets(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted snippets, and what else is known of them."""
    per_doc = wanted.groupBy(F.col("doc").alias("w_doc"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct("bucket", "anchor", "dealt", "first", "n")).alias("lists"))
    joined = docs.join(per_doc, F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th")))

    def run(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                lists = part.column(part.schema.get_field_index("lists"))
                fields = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                start, n = fields.field("first").to_numpy() + offsets[row], fields.field("n").to_numpy().astype(np.int64)
                raw = data.tobytes()
                bytes_ = pa.array([raw[s: s + k] for s, k in zip(start.tolist(), (n + length - 1).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([fields.field("bucket"), fields.field("anchor"), fields.field("dealt"), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                                                  fields.field("first"), fields.field("n"), bytes_], names=["bucket", "anchor", "dealt", "doc", "th", "first", "n", "bytes"])

    return joined.select("doc", "th", "text", "lists").mapInArrow(run, T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("dealt", T.BooleanType()), docs.schema["doc"], docs.schema["th"],
        T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bytes", T.BinaryType())]))


def _compared(snippets: DataFrame, length: int) -> DataFrame:
    """Runs of windows of each snippet. kind null: they repeat in their bucket. Else one window of a dealt anchor, with its
    fingerprint; alone tells that it is the only one of its kind in the bucket."""

    def run(table):
        data, offsets = text_buffer(table.column("bytes"))
        n = table.column("n").to_numpy().astype(np.int64)
        place, owner = ranges(offsets[:-1], n)
        again, new = repeated(data, place, length)
        at = place - offsets[owner] + table.column("first").to_numpy()[owner]
        runs = np.flatnonzero(again)
        fresh = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1] + 1) | (owner[runs[1:]] != owner[runs[:-1]])])) if len(runs) else runs
        start, count = runs[fresh], np.diff(np.concatenate([fresh, [len(runs)]]))
        dealt = np.flatnonzero(table.column("dealt").to_numpy(zero_copy_only=False)[owner] & new)
        kinds = np.array([int.from_bytes(hashlib.blake2b(data[p: p + length].tobytes(), digest_size=8).digest(), "little") for p in place[dealt]], np.uint64)
        index = pa.array(np.concatenate([owner[start], owner[dealt]]))
        return pa.table([table.column("doc").take(index), table.column("th").take(index), pa.array(np.concatenate([at[start], at[dealt]])),
                         pa.array(np.concatenate([count, np.ones(len(dealt), np.int64)])),
                         pa.concat_arrays([pa.nulls(len(start), pa.int64()), pa.array(kinds.view(np.int64))]),
                         pa.array(np.concatenate([np.zeros(len(start), bool), ~again[dealt]]))], names=["doc", "th", "first", "n", "kind", "alone"])

    return snippets.groupBy("bucket").applyInArrow(run, T.StructType([snippets.schema["doc"], snippets.schema["th"], T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
                                                                      T.StructField("kind", T.LongType()), T.StructField("alone", T.BooleanType())]))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """From rows (doc, th, text): runs (doc, th, first, n) of windows whose bytes start elsewhere too."""
    found = cut_to_table(_anchors(docs, length, gram))
    again = (found.groupBy("anchor").agg(F.min("snippet").alias("low"), F.max("snippet").alias("high"), F.sum("times").alias("all_times"))
             .where("all_times > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    hits = cut_to_table(found.join(again, "anchor"))
    kinds = cut_to_table(hits.groupBy("anchor", "snippet").agg(F.sum("times").alias("times"), F.max("mixed").alias("mixed"), F.min(F.struct("doc", "th", "first", "n")).alias("one")))
    whole = hits.join(kinds.where("times > 1").select("anchor", "snippet"), ["anchor", "snippet"], "left_semi").select("doc", "th", "first", (F.col("n") * F.col("times").cast("long")).alias("n"))

    different = kinds.where("mixed").select("anchor", "snippet", "one.*")
    sizes = different.groupBy("anchor").agg(F.count("*").alias("many"))
    total = different.agg(F.sum(F.col("n") + length)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    parts = F.ceil(F.col("many") / most)
    wanted = cut_to_table(different.join(sizes, "anchor").select(
        "anchor", "doc", "th", "first", "n", (parts > 1).alias("dealt"),
        F.pmod(F.xxhash64("anchor", F.when(parts > 1, F.pmod("snippet", parts)).otherwise(0)), F.lit(buckets)).alias("bucket")))
    compared = cut_to_table(_compared(_snippets(docs, wanted, length), length))
    out = whole.union(compared.where("kind is null").select("doc", "th", "first", "n"))
    dealt = compared.where("kind is not null")
    if dealt.head(1):
        twice = dealt.groupBy("kind").count().where("count > 1").select("kind")
        out = out.union(dealt.where("alone").join(twice, "kind", "left_semi").select("doc", "th", "first", "n"))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay, binary).

    Texts are UTF-8 bytes, null is empty; no string crosses documents. A byte goes if a string of
    `length` bytes that covers it also starts anywhere else, in the same document included; strings are
    judged on the input. n_spans: maximal removed runs. Repeated rows are repeats of each other. Texts
    shorter than `length` stay. An empty table gives no rows. Other columns pass through, those named
    like a result are replaced.
    """
    prepare(docs.sparkSession)
    runs = repeated_windows(docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")), length, **options)
    per_doc = runs.groupBy(F.col("doc").alias("r_doc"), F.col("th").alias("r_th")).agg(F.collect_list(F.struct("first", "n")).alias("r_runs"))
    results = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    others = [c for c in docs.columns if c != text_col and c not in results]
    marked = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    joined = marked.join(per_doc, F.col("id").eqNullSafe(F.col("r_doc")) & (F.col("th") == F.col("r_th")), "left").select("row", "text", "r_runs")

    def cut(data, offsets, part):
        lists = part.column(part.schema.get_field_index("r_runs"))
        fields = lists.flatten()
        row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid()))
        start = fields.field("first").to_numpy() + offsets[row]
        end = start + fields.field("n").to_numpy() + length - 1
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change)[:-1] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        rows = offsets[:-1][np.diff(offsets) > 0]
        opens[rows] = gone[rows]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens)]
        n_removed, n_spans = (np.diff(x[offsets]) for x in sums)
        left = data[~gone].tobytes()
        cuts = offsets - sums[0][offsets]
        kept = [left[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())]

    out = add_columns(joined, "text", {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.BinaryType()}, cut, drop=("r_runs",))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in results], *results)

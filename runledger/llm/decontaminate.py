"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

A window is a run of `width` item words. A document can only contain it where it contains the
window's rarest shingle, so one shingle per window is the necessary prefix. Shingles are ranked by
how often they occur in all documents. Where a document has a window's prefix shingle, the place of
the shingle in the window fixes where the window would start; starts outside the document are dropped
(length and positional bounds), and the rest is verified word by word.

Items are taken in blocks of at most `block` windows. A block is small enough to be sent to every
task, and the documents are read once for the counts and once for the join, whatever their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import ALNUM_WORDS, add_columns, lean, mix64, pieces, prepare, ranges, words
from runledger.session import cut_to_table

WIDTH, SHINGLE, BLOCK_WINDOWS = 10, 3, 100_000
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; runs that cross rows are left to the position check."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        total += hashes[i: len(hashes) - k + 1 + i] * _ODD[i]
    return mix64(total + np.uint64(k))


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Distinct windows: words (hashes in order), items (the ids as strings, null is "")."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "text", 1 << 18):
                h, _, _, rows = words(data, offsets, ALNUM_WORDS)
                n = np.diff(rows)
                count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
                at, owner = ranges(rows[:-1], count)
                length = np.minimum(n[owner], width)
                values, _ = ranges(at, length)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(h[values].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), lists], names=["item", "words"])

    found = source.mapInArrow(lean(run), "item string, words array<bigint>")
    return found.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Block:
    """Some windows, ready for the join: prefix shingles by shingle length, and the words to verify."""

    def __init__(self, rows):
        self.items = [r["items"] for r in rows]
        self.lengths = np.array([len(r["words"]) for r in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.words = np.array([w for r in rows for w in r["words"]], np.int64).view(np.uint64)
        self.size = np.minimum(self.lengths, SHINGLE)  # shingle length of each window
        self.candidates = {}  # by shingle length: hash, window, place
        for k in range(1, SHINGLE + 1):
            owner = np.flatnonzero(self.size == k)
            if len(owner):
                at, run = ranges(self.starts[owner], self.lengths[owner] - k + 1)
                self.candidates[k] = (_shingles(self.words, k)[at], owner[run], at - self.starts[owner[run]])
        self.keys = {k: np.unique(c[0]) for k, c in self.candidates.items()}
        self.prefix = {}

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle."""
        for k, (h, owner, place) in self.candidates.items():
            order = np.lexsort((place, h, counts[k][np.searchsorted(self.keys[k], h)], owner))
            first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
            first = first[np.argsort(h[first], kind="stable")]
            self.prefix[k] = (h[first], owner[first], place[first])
        self.candidates = {}

    def matches(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of windows in rows of words: first word, window."""
        starts, windows = [], []
        for k, (key, owner, place) in self.prefix.items():
            h = _shingles(hashes, k)
            low = np.searchsorted(key, h)
            hit = np.flatnonzero(key[np.minimum(low, len(key) - 1)] == h)
            n = np.searchsorted(key, h[hit], "right") - low[hit]
            which, run = ranges(low[hit], n)
            start, window = hit[run] - place[which], owner[which]
            row = np.searchsorted(rows, hit[run], "right") - 1
            fits = (start >= rows[row]) & (start + self.lengths[window] <= rows[row + 1])
            start, window = start[fits], window[fits]
            for i in range(int(self.lengths.max(initial=0))):  # verify word by word, on what is left
                equal = np.ones(len(start), bool)
                live = np.flatnonzero(self.lengths[window] > i)
                equal[live] = hashes[start[live] + i] == self.words[self.starts[window[live]] + i]
                start, window = start[equal], window[equal]
            starts.append(start)
            windows.append(window)
        return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counts(docs: DataFrame, text_col: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    keys = block.keys

    def run(batches):
        total = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            for _, data, offsets in pieces(batch, "text"):
                h, _, _, _ = words(data, offsets, ALNUM_WORDS)
                for k, v in keys.items():
                    s = _shingles(h, k)
                    at = np.minimum(np.searchsorted(v, s), len(v) - 1)
                    total[k] += np.bincount(at[v[at] == s], minlength=len(v))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])], names=["k", "i", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    counts = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
    got = rows.toArrow()  # one number per shingle of the block
    for k in keys:
        own = got.column("k").to_numpy() == k
        counts[k][got.column("i").to_numpy()[own]] = got.column("n").to_numpy()[own]
    return counts


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  width: int = WIDTH, block: int = BLOCK_WINDOWS) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated.

    Words are runs of digits, letters and signs beyond ASCII, A-Z lower-cased. A window is `width`
    consecutive item words; an item of fewer words is one window. n_hit: words inside an occurrence.
    n_items: items with a window that occurs; items_sha256: of their ids as sorted, comma-joined strings.

    Null or empty texts have no words and are clean. Items without words match nothing; items with
    the same id are one item, a null id counts as "". Repeated documents are judged one by one. Empty
    tables give empty or clean results. Other columns pass through, clashing ones are replaced.
    """
    prepare(docs.sparkSession)
    windows = cut_to_table(item_windows(items, item_col, item_text_col, width))
    blocks = max(1, -(-windows.count() // block))
    part = F.pmod(F.xxhash64("words"), F.lit(blocks))
    out = docs.drop("_spans", "_items")
    for b in range(blocks):
        this = Block(windows.where(part == b).collect())  # about `block` windows
        this.rank(_counts(docs, text_col, this) if b or len(this.lengths) else {})

        def join(data, offsets, rows, this=this, first=b == 0):
            h, _, _, at = words(data, offsets, ALNUM_WORDS)
            start, window = this.matches(h, at)
            order = np.argsort(start, kind="stable")
            start, window = start[order], window[order]
            spans, items = [], []
            cuts = np.searchsorted(start, at)
            for r in range(len(at) - 1):
                own = slice(cuts[r], cuts[r + 1])
                spans.append(((start[own] - at[r]) << 8 | this.lengths[window[own]]).tolist())
                items.append(sorted({i for w in np.unique(window[own]) for i in this.items[w]}))
            if not first:
                old = rows.schema.get_field_index
                spans = [a + b for a, b in zip(rows.column(old("_spans")).to_pylist(), spans, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(rows.column(old("_items")).to_pylist(), items, strict=True)]
            return [pa.array(np.diff(at), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

        out = add_columns(out, text_col, {"n_words": T.LongType(), "_spans": T.ArrayType(T.LongType()), "_items": T.ArrayType(T.StringType())}, join)

    def finish(_, __, rows):
        hit, digest, count = [], [], []
        for n, spans, items in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("n_words", "_spans", "_items")), strict=True):
            mask = np.zeros(n + 1, np.int64)
            s = np.array(spans, np.int64)
            np.add.at(mask, s >> 8, 1)
            np.add.at(mask, (s >> 8) + (s & 255), -1)
            hit.append(int((np.cumsum(mask)[:n] > 0).sum()) if spans else 0)
            count.append(len(items))
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        return [pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]

    return add_columns(out, text_col, {"n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType()},
                       finish, drop=("_spans", "_items"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return decontaminate(docs, items, **options).where(~F.col("contaminated")).select(*docs.columns)

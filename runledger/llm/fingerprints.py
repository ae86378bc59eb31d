"""Document fingerprints: a homomorphic hash of the multiset of a text's parts.

A text is cut at line ends, and within a paragraph after a third of the words, picked by the hash of
the word and the one before, so that a change in one place leaves the other parts as they are. Each part is hashed to a wide vector: 128
lanes of +1 or -1, kept modulo 2**32, and 4 lanes of 64 random bits, kept modulo 2**64. A fingerprint
is the sum of the vectors of all parts. It does not depend on their order, and parts are put in or
taken out by adding or subtracting their vectors.

The narrow lanes of a difference have a mean square near the number of parts in which two texts
differ. So the likeness of two fingerprints is 1 - |x - y|^2 / (|x|^2 + |y|^2): 1 for equal texts,
near 0 for texts without a common part, with an error of about 0.1. Only equal wide lanes make it 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import mix64, prepare, segment_hashes, text_buffer, words

NARROW, WIDE, BLOCK_PARTS = 128, 4, 1 << 15
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 20_000


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every part of every row; the parts of a row hold all of its bytes."""
    h, starts, ends, _ = words(data, offsets)
    breaks = np.union1d(np.flatnonzero(data == 10), offsets)
    line = np.searchsorted(breaks, starts, "right")
    before = np.zeros(len(h), np.uint64)
    before[1:] = np.where(line[1:] == line[:-1], h[:-1], np.uint64(0))
    filled = offsets[:-1][np.diff(offsets) > 0]
    cuts = np.unique(np.concatenate([filled, np.flatnonzero(data == 10) + 1, ends[mix64(h + before * np.uint64(3)) % np.uint64(3) == 0]]))
    cuts = cuts[cuts < len(data)]
    bounds = np.concatenate([cuts, [len(data)]])
    return segment_hashes(data, bounds[:-1], bounds[1:]), np.searchsorted(offsets, cuts, "right") - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrow lanes (int32) and wide lanes (uint64) of each row."""
    rows = len(offsets) - 1
    narrow, wide = np.zeros((rows, NARROW), np.int64), np.zeros((rows, WIDE), np.uint64)
    h, row = parts(data, offsets)
    for low in range(0, len(h), BLOCK_PARTS):
        x, r = h[low: low + BLOCK_PARTS], row[low: low + BLOCK_PARTS]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        own = r[starts]
        seeds = np.stack([mix64(x + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, NARROW // 64 + 1)], 1)
        bits = np.unpackbits(seeds.view(np.uint8), axis=1)
        count = np.diff(np.concatenate([starts, [len(x)]]))
        narrow[own] += 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) - count[:, None]
        for k in range(WIDE):
            wide[own, k] += np.add.reduceat(mix64(x ^ (np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F % 2**64))), starts)
    return narrow.astype(np.int32), wide


def likeness(x: np.ndarray, y: np.ndarray, wide_x: np.ndarray, wide_y: np.ndarray) -> np.ndarray:
    """0 to 1, from the narrow lanes; 1 only where the wide lanes are equal."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    apart, total = ((x - y) ** 2).sum(1), (x ** 2).sum(1) + (y ** 2).sum(1)
    near = np.clip(1 - apart / np.maximum(total, 1e-9), 0, np.nextafter(1, 0)) * (total > 0)
    return np.where((wide_x == wide_y).all(1), 1.0, near)


def as_text(narrow: np.ndarray, wide: np.ndarray) -> list[str]:
    return [n.tobytes().hex() + w.tobytes().hex() for n, w in zip(narrow, wide, strict=True)]


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 4 * NARROW], np.int32), np.frombuffer(raw[4 * NARROW:], np.uint64)


def combine(fingerprint: str, other: str, sign: int = 1) -> str:
    """The fingerprint with all parts of another put in (sign 1) or taken out (sign -1)."""
    (a, c), (b, d) = from_text(fingerprint), from_text(other)
    return as_text((a + np.int32(sign) * b)[None], (c + d if sign > 0 else c - d)[None])[0]


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows (bucket, copy, doc, text) such that each row is followed, within its bucket, by its successor.

    Buckets are ranges of doc. The first row of each is also sent to the bucket before it, as a copy
    behind all others; that of the first bucket goes to the last.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = int(min(MOST_BUCKETS, max(1, -(-total // BUCKET_BYTES))))
    bounds = sorted(set(docs.approxQuantile("doc", [i / wanted for i in range(1, wanted)], 0.2 / wanted))) if wanted > 1 else []
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket_of(doc: pd.Series) -> pd.Series:
        return pd.Series(1 + np.searchsorted(cuts, doc.to_numpy()))

    bucket = F.when(F.col("doc").isNull(), 0).otherwise(bucket_of(F.coalesce("doc", F.lit(0).cast("long")))) if bounds else F.lit(0)
    placed = docs.withColumn("bucket", bucket).withColumn("th", F.xxhash64("text"))
    heads = placed.groupBy("bucket").agg(F.max(F.struct(F.col("doc").isNotNull().alias("has"), "doc", "th")).alias("head")).collect()  # one row per bucket
    heads = sorted(heads, key=lambda r: -r["bucket"])
    goes_to = {r["bucket"]: heads[k - 1]["bucket"] for k, r in enumerate(heads)}
    if not heads:
        return placed.select("bucket", F.lit(False).alias("copy"), "doc", "text")
    table = docs.sparkSession.createDataFrame([(r["bucket"], goes_to[r["bucket"]], r["head"]["doc"], r["head"]["th"]) for r in heads], "h_bucket int, h_to int, h_doc long, h_th long")
    lookup = F.broadcast(table)  # as many rows as buckets
    joined = placed.join(lookup, placed.bucket == lookup.h_bucket)
    is_head = F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("th") == F.col("h_th"))
    targets = F.when(is_head, F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(F.col("h_to").alias("bucket"), F.lit(True).alias("copy")))
                     ).otherwise(F.array(F.struct("bucket", F.lit(False).alias("copy"))))
    rows = joined.select("doc", "th", "text", F.explode(targets).alias("t")).select("t.*", "doc", "th", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("doc").desc_nulls_last(), F.col("th").desc()).select("bucket", "copy", "doc", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chars, fingerprint, and the same of its edited text, with the likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document. Documents are in descending order of id (null last), equal ids by text hash;
    after the last comes the first, and a single document is its own next. Null texts are empty. Equal
    texts have equal fingerprints; repeated rows are next to each other. An empty table gives no rows;
    other columns are not looked at.
    """
    prepare(docs.sparkSession)
    rows = _ordered(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([held, batch] if held is not None else [batch])
            copy, texts = table.column("copy").to_numpy(), table.column("text").to_pylist()
            texts = [t or "" for t in texts]
            emit = np.flatnonzero(~copy[:-1].astype(bool)).tolist()
            held = table.slice(table.num_rows - 1).combine_chunks().to_batches()[0]
            if not emit:
                continue
            edited = []
            for i in emit:
                cut = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            narrow, wide = fingerprints(*text_buffer(pa.array(texts, pa.string())))
            e_narrow, e_wide = fingerprints(*text_buffer(pa.array(edited, pa.string())))
            own = np.array(emit)
            yield pa.RecordBatch.from_arrays([
                table.column("doc").combine_chunks().take(pa.array(own)), pa.array([len(texts[i]) for i in emit], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(narrow[own], wide[own])), pa.array(as_text(e_narrow, e_wide)),
                pa.array(likeness(narrow[own], e_narrow, wide[own], e_wide)), pa.array(likeness(narrow[own], narrow[own + 1], wide[own], wide[own + 1]))],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Helpers of operators that work on Arrow batches: settings, text buffers, words as numbers.

Words are handled as 64-bit hashes of their bytes, made for a whole buffer at once: those of up to LONG bytes by a
sum of bytes times powers, longer ones by BLAKE2, since sums modulo 2**64 are alike for some pairs of long words that
follow a pattern. Two words of a text that nobody made for it are mistaken for each other with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.session import configure

BLOCK = 1 << 16  # bytes looked at together
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK, base), dtype=np.uint64)])


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)

SPACE_WORDS = np.ones(256, bool)  # words without space and \x09-\x0D
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORDS = np.zeros(256, bool)  # digits, letters, all beyond ASCII
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_TO_LOWER = LOWER.tobytes()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of this library, batches bounded in bytes, shuffle files of a job gone once it is done."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, after which the Python worker hands free memory back: workers stay for further tasks and stages."""

    def then_release(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return then_release


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows with A-Z lower-cased: hash, first byte, end, and the row offsets in them."""
    raw = data.tobytes()
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(raw.translate(letters.astype(np.uint8).tobytes()), np.int8)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]  # a word that goes on over the end of a row is two
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    lower = np.frombuffer(raw.translate(_TO_LOWER), np.uint8)
    return segment_hashes(lower, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end), which do not overlap and go up."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        low = starts[k]
        k2 = max(k + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        if ends[k2 - 1] - low <= BLOCK:
            sums = prefix_sums(data[low: ends[k2 - 1]])
            s, e = starts[k:k2] - low, ends[k:k2] - low
            out[k:k2] = (sums[e] - sums[s]) * _DOWN[s]
        k = k2
    for k in np.flatnonzero(ends - starts > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]: ends[k]], digest_size=8).digest(), "little")
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def prefix_sums(block: np.ndarray) -> np.ndarray:
    """Sums of byte times power up to each place of a block of at most BLOCK bytes."""
    sums = np.empty(len(block) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((block + np.uint64(1)) * _UP[: len(block)], out=sums[1:])
    return sums


def ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the runs start .. start + length - 1, and the run each belongs to."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(len(owner)) - first[owner] + starts[owner], owner


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `limit` bytes of text, or one row."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def add_columns(df: DataFrame, text_col: str, new: dict[str, T.DataType], build: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list], drop: tuple = ()) -> DataFrame:
    """`df` with columns that `build` makes of the text; columns of the same names are replaced."""
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in new.items()])

    def run(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, text_col):
                made = build(data, offsets, part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made],
                                                 names=names + list(new))

    return df.mapInArrow(lean(run), schema)


def broadcast_if_small(df: DataFrame, rows: int = 300_000, size: int = 16 << 20) -> DataFrame:
    """`df`, a stored table, to be sent to every task if it has at most `rows` rows in files of `size` bytes; else it is joined by a shuffle."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if stored <= size and df.count() <= rows else df

"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

One pass over the table keeps its usable vectors as integers x = floor(64 c) + 1000000, packed into rows of a
few thousand vectors, with exact sums S of every dimension. X is the matrix of the rows x - S / n. A step of the
bidiagonalisation is one Spark job: every task forms u = X w for its rows and adds up their part of z = X'u; d
numbers a task go through a shuffle, one vector of d numbers comes to the driver. Left vectors are never stored:
each is X w with w of d numbers, so that the products of two left vectors, which full reorthogonalisation
needs, are w'z. Right vectors are reorthogonalised twice against all earlier ones. The singular values and right
vectors of the small bidiagonal matrix give the deviations and components.

Steps end when the wanted components have residuals at rounding level and the variance that no step has seen is
below the last of them, so none can hide; after d steps at the latest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import prepare
from runledger.session import cut_to_table

SCALE = 64  # the 1000000 added to every entry cancels out wherever rows are centred
PACK = 1 << 20  # entries in a packed row, one vector at least
ROUNDING = 1e-13  # of the largest deviation: what a residual or a length of nothing comes to
LARGEST = 2**62  # entries beyond are held there


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: the rows that are not null and hold finite entries alone, their lengths, all their entries as double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    entries = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ends = np.cumsum(lengths)
    usable = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(usable), lengths[usable], entries[np.repeat(usable, lengths)]


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) of the entries as long."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -LARGEST, LARGEST).astype(np.int64)


def matrices(batches: Iterator[pa.RecordBatch], vector_col: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the numbers of their usable rows of d entries, and these rows as matrices of floor(64 c)."""
    for batch in batches:
        rows, lengths, entries = vectors(batch.column(batch.schema.get_field_index(vector_col)))
        fits = lengths == d
        yield batch, rows[fits], whole_numbers(entries[np.repeat(fits, lengths)]).reshape(-1, d)


def summed(df: DataFrame) -> np.ndarray:
    """Sum of the arrays in column `part`, place by place. One short row a place reaches the driver."""
    rows = df.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), object if rows and not isinstance(rows[0]["value"], float) else np.float64)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


class Packed:
    """The usable vectors of a table, centred when read."""

    def __init__(self, df: DataFrame, vector_col: str):
        vector = df.select(F.col(vector_col).alias("vector"))
        sizes = F.when(F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.size("vector"))
        common = vector.groupBy(sizes.alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
        self.n, self.d = (common["count"], common["d"]) if common else (0, 0)
        if self.n == 0:
            return
        d, most = self.d, max(1, PACK // self.d)

        def pack(batches):
            for _, _, x in matrices(batches, "vector", d):
                for k in range(0, len(x), most):
                    part = x[k: k + most]
                    narrow = part.astype(np.int16) if np.abs(part).max() < 2**15 else part
                    sums = part.sum(0) if narrow.dtype == np.int16 else [sum(column) for column in part.T.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([narrow.tobytes()], pa.binary()), pa.array([narrow.dtype.itemsize], pa.int32()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))],
                        names=["rows", "width", "sums"])

        self.table = cut_to_table(vector.mapInArrow(pack, "rows binary, width int, sums array<string>"))
        totals = summed(self.table.select(F.col("sums").cast("array<decimal(38,0)>").alias("part")))
        self.sums = [int(s) for s in totals]  # of floor(64 c)
        # the centre as a whole number and the rest, so that centring rounds once and hardly at all
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def added(self, of_rows, length: int) -> np.ndarray:
        """Sum of `of_rows(X)` over the centred matrices of all packed rows; it gives `length` numbers."""
        d, whole, rest, narrow = self.d, self.whole, self.rest, {2: np.int16, 8: np.int64}

        def run(batches):
            total = np.zeros(length)
            for batch in batches:
                for raw, width in zip(batch.column(0), batch.column(1), strict=True):
                    x = np.frombuffer(raw.as_buffer(), narrow[width.as_py()]).reshape(-1, d)
                    total += of_rows((x - whole).astype(np.float64) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

        return summed(self.table.select("rows", "width").mapInArrow(run, "part array<double>"))


def bidiagonalise(packed: Packed, most: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, their variances, the total variance) of the packed rows, at most `most`, falling."""
    d, n = packed.d, packed.n
    rng = np.random.default_rng(seed)
    V, W, Z = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # right vectors; left vectors are X W', X' of them Z
    alphas, betas, total = [], [], None

    def apart(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - V.T @ (V @ r)
        return r

    def fresh() -> np.ndarray:
        r = apart(rng.standard_normal(d))
        return r / np.linalg.norm(r)

    def product(w: np.ndarray) -> np.ndarray:
        def of_rows(x):
            u = x @ w
            return np.concatenate([x.T @ u, [u @ u, np.vdot(x, x)]])

        return packed.added(of_rows, d + 2)

    v, beta = fresh(), 0.0
    while True:
        w = v - beta * W[-1] if len(W) else v
        out = product(w)
        z, total = out[:d], out[d + 1]
        for _ in range(2):  # left vectors: their products are w'z
            c = W @ z
            w, z = w - W.T @ c, z - Z.T @ c
        alpha = np.sqrt(max(w @ z, 0.0))
        V, scale = np.vstack([V, v]), np.sqrt(total)
        if alpha <= ROUNDING * d * scale:  # X v lies within the earlier left vectors
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        W, Z = np.vstack([W, w]), np.vstack([Z, z])
        alphas.append(alpha)
        r = apart(z - alpha * v)
        beta = float(np.linalg.norm(r))
        k = len(alphas)
        p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        unseen = total - float(np.sum(s * s))
        settled = k >= min(most, d) and np.all(beta * np.abs(p[-1, :most]) <= ROUNDING * s[0])
        if k == d or total == 0 or unseen <= ROUNDING * total or (settled and unseen < s[min(most, d) - 1] ** 2):
            break
        if beta <= ROUNDING * d * scale:  # the vectors so far are closed under X'X: go on beside them
            v, beta = fresh(), 0.0
        else:
            v = r / beta
        betas.append(beta)
    keep = s[:most] ** 2 > ROUNDING * max(total, 1e-300)
    parts = (q[:most] @ V)[keep]
    return parts / np.linalg.norm(parts, axis=1, keepdims=True), s[:most][keep] ** 2 / n, total / n


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component up to `most`.

    Vectors that are null or hold null, NaN or infinite entries are left out, and so are those of another length
    than the most frequent one (the longer of two equally frequent): they have no place in the covariance.
    Entries whose floor(64 c) goes beyond 2**62 count as that. Repeated rows count as often as they are there
    and each gives its rows; a null id stays null. Directions without variance are no components, so an empty
    table, one vector or equal vectors give no rows. `deviation` is exact; where it does not fit a long it is null. Other columns
    are not looked at. The sign of a component is that of its largest entry in size, made positive.
    The driver holds three d x k matrices for d dimensions and k steps.
    """
    spark = prepare(df.sparkSession)
    df = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    schema = T.StructType([T.StructField(id_col, df.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    packed = Packed(df, "vector")
    if packed.n == 0:
        return spark.createDataFrame([], schema)
    parts, variances, total = bidiagonalise(packed, most)
    if len(parts) == 0:
        return spark.createDataFrame([], schema)
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    axes, m = (parts / np.sqrt(variances)[:, None]).T, len(parts)

    def moments(x):
        y = x @ axes
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    sums = packed.added(moments, m + m * m)
    mean = sums[:m] / packed.n
    error = float(np.abs(sums[m:].reshape(m, m) / packed.n - np.outer(mean, mean) - np.eye(m)).max())
    n, d, whole, rest, totals = packed.n, packed.d, packed.whole, packed.rest, packed.sums
    explained = variances / total

    def rows(batches):
        for batch, usable, x in matrices(batches, "vector", d):
            for k in range(0, len(x), 1024):
                part = x[k: k + 1024]
                whitened = ((part - whole).astype(np.float64) - rest) @ axes
                count = len(part)
                ids = batch.column(0).take(pa.array(np.repeat(usable[k: k + 1024], m)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, n, np.int64)),
                     deviations(part, n, totals).take(pa.array(np.repeat(np.arange(count), m))), pa.array(whitened.ravel()),
                     pa.array(np.tile(explained, count)), pa.array(np.full(count * m, error))], names=schema.names)

    return df.mapInArrow(rows, schema)


def deviations(x: np.ndarray, n: int, totals: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2 over the entries of each row; null beyond a long. The offset cancels out."""
    if n * max(abs(int(x.max())), abs(int(x.min())), 1) + max(map(abs, totals)) < 2**62:
        apart = n * x - np.array(totals, np.int64)
        about = np.square(apart.astype(np.float64)).sum(1)
        if not np.any(np.abs(about - 2.0**63) < 2.0**43):  # long arithmetic is modulo 2**64: right for all that fit
            return pa.array((apart * apart).sum(1), mask=about > 2.0**63)
    exact = (sum((n * a - s) ** 2 for a, s in zip(row, totals, strict=True)) for row in x.tolist())
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

"""What both classifiers share: folds, a bounded sample of labelled rows, Adam, scoring."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.arrow import add_columns, lean, prepare


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold` when divided by `folds`; a null id is the text ""."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_on_sample(network, docs: DataFrame, labels: DataFrame, label_col: str, folds: int, fold: int, most: int, id_col: str = "doc_id", text_col: str = "text", **settings):
    """`network` fitted on at most `most` texts with labels 0 or 1 that are not held out, a third of the rarer label where there are enough.

    The sample is that of the smallest id hashes, so it is the same in every run. Several labels of one
    id count as their largest; null labels and labels without a document count as none. One task holds
    the sample and trains; the driver gets the weights. Log-odds are shifted to how common the labels are
    among all that are not held out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds, fold)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    everyone = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        rarer = everyone.get(value, 0) <= everyone.get(1 - value, 0)
        some = known.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(most // 3 if rarer else most - most // 3)
        chosen = some if chosen is None else chosen.union(some)
    chosen = chosen.select(F.col(id_col).alias("l_id"), "label")
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen.l_id)  # at most `most` rows
    rows = rows.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), "label").repartition(1)

    def train(batches):
        sample = sorted((r["id"], r["text"], r["label"]) for batch in batches for r in batch.to_pylist())
        y = np.array([label for _, _, label in sample], np.float32)
        shift = np.log(everyone[1] / everyone[0]) - np.log(y.sum() / (len(y) - y.sum())) if 0 < y.sum() < len(y) else 0.0
        texts = [text.encode() for _, text, _ in sample]
        del sample
        network.fit(texts, y, float(shift), **settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network.__dict__)], pa.binary())], names=["weights"])

    fitted = rows.mapInArrow(lean(train), "weights binary").first()
    if fitted is None:  # no labelled documents
        return network.fit([], np.zeros(0, np.float32))
    network.__dict__.update(pickle.loads(fitted["weights"]))
    return network


class Adam:
    """Steps on a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression; the last is the constant. Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) / len(y) + decay * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def score_documents(docs: DataFrame, model, folds: int, fold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with held_out, score and predicted; `model(data, offsets)` gives the scores of rows of bytes."""
    prepare(docs.sparkSession)

    def run(data, offsets, _):
        score = np.clip(model(data, offsets).astype(np.float64), 0, 1)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    scored = add_columns(docs, text_col, {"score": T.DoubleType(), "predicted": T.IntegerType()}, run)
    return scored.withColumn("held_out", held_out(F.col(id_col), folds, fold))

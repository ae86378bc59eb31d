"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned vector. Learned filters look at 8 bytes every 4 bytes; a chunk of 512 bytes,
which starts every 256 bytes, takes the largest answer of each filter and a linear layer makes a logit
of them. Chunks cover the whole document. Mean, largest and smallest chunk logit are combined into one
probability by a logistic layer fitted on documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from runledger.llm.arrow import ranges
from runledger.llm.learn import Adam, fit_on_sample, logistic, score_documents, sigmoid

FOLDS, FOLD = 3, 1
DIM, STRIDE, HALF, FILTERS = 4, 4, 256, 24
PAD = 256
DRAWS = 40_000  # chunks of the sample that an epoch of training draws, each document as often as another


def halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half chunks of all rows (with the first bytes of what follows), and the row of each; an empty row has one."""
    n = np.maximum(1, -(-np.diff(offsets) // HALF))
    number, row = ranges(np.zeros(len(n), np.int64), n)
    at = (offsets[row] + number * HALF)[:, None] + np.arange(HALF + STRIDE)
    out = np.full(at.shape, PAD, np.int16)
    inside = at < offsets[row + 1][:, None]
    out[inside] = data[at[inside]]
    return out, row


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {"bytes": rng.normal(0, 0.5, (257, DIM)).astype(np.float32), "first": rng.normal(0, 0.3, (STRIDE * DIM, FILTERS)).astype(np.float32),
                  "second": rng.normal(0, 0.3, (STRIDE * DIM, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
                  "out": rng.normal(0, 0.3, FILTERS).astype(np.float32), "level": np.zeros(1, np.float32)}
        self.p["bytes"][PAD] = 0
        self.combine = np.array([1.0, 0, 0, 0])

    def answers(self, half: np.ndarray) -> np.ndarray:
        """Filter answers (half, place, filter)."""
        blocks = self.p["bytes"][half].reshape(len(half), HALF // STRIDE + 1, STRIDE * DIM)
        flat = blocks.reshape(-1, STRIDE * DIM)
        first = (flat @ self.p["first"]).reshape(len(half), -1, FILTERS)
        second = (flat @ self.p["second"]).reshape(len(half), -1, FILTERS)
        return first[:, :-1] + second[:, 1:]

    def pooled(self, half: np.ndarray) -> np.ndarray:
        return np.concatenate([self.answers(half[k: k + 1024]).max(1) for k in range(0, len(half), 1024)])

    def chunk_logits(self, pooled: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the chunks (two halves, or one where a row has no second) and their rows."""
        pair = np.maximum(pooled[:-1], pooled[1:])
        inner = row[:-1] == row[1:]
        single = np.concatenate([[True], row[1:] != row[:-1]]) & np.concatenate([row[1:] != row[:-1], [True]])
        best = np.concatenate([pair[inner], pooled[single]])
        rows = np.concatenate([row[:-1][inner], row[single]])
        order = np.argsort(rows, kind="stable")
        return (np.maximum(best + self.p["bias"], 0) @ self.p["out"] + self.p["level"][0])[order], rows[order]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        half, row = halves(data, offsets)
        logit, rows = self.chunk_logits(self.pooled(half), row)
        starts = np.searchsorted(rows, np.arange(len(offsets) - 1))
        return np.stack([np.add.reduceat(logit, starts) / np.diff(np.concatenate([starts, [len(rows)]])), np.maximum.reduceat(logit, starts), np.minimum.reduceat(logit, starts)], 1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.features(data, offsets) @ self.combine[:3] + self.combine[3])

    def fit(self, texts: list[bytes], y: np.ndarray, shift: float = 0.0, epochs: int = 6, draws: int = DRAWS, batch: int = 256, seed: int = 2) -> Network:
        if len(set(y.tolist())) < 2:
            self.combine = np.array([0, 0, 0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))])
            return self
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        half, row = halves(data, offsets)
        first = np.flatnonzero(np.concatenate([row[1:] == row[:-1], [False]]) | (np.concatenate([[True], row[1:] != row[:-1]])))
        weight = (1 / np.bincount(row[first]))[row[first]]  # documents count alike
        both = np.where(np.concatenate([row[1:] == row[:-1], [False]]), np.arange(len(row)) + 1, np.arange(len(row)))[first]
        rng, adam = np.random.default_rng(seed), Adam(self.p, 0.01)
        for epoch in range(epochs):
            adam.rate = 0.01 * 0.5 ** max(0, epoch - 2)
            order = rng.choice(len(first), min(len(first), draws), p=weight / weight.sum())
            for k in range(0, len(order), batch):
                pick = order[k: k + batch]
                self._step(np.concatenate([half[first[pick]], half[both[pick]]]), y[row[first[pick]]], adam)
        self.combine = logistic(self.features(data, offsets), y) + np.array([0.0, 0.0, 0.0, shift])
        return self

    def _step(self, half: np.ndarray, y: np.ndarray, adam: Adam) -> None:
        n, places = len(y), HALF // STRIDE
        answers = self.answers(half).reshape(2, n, places, FILTERS).transpose(1, 0, 2, 3).reshape(n, 2 * places, FILTERS)
        place = answers.argmax(1)
        best = np.take_along_axis(answers, place[:, None], 1)[:, 0] + self.p["bias"]
        live = np.maximum(best, 0)
        logit = live @ self.p["out"] + self.p["level"][0]
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        back = d[:, None] * self.p["out"] * (best > 0)
        rows = np.arange(n)[:, None] + n * (place // places)
        at = (place % places)[:, :, None] * STRIDE + np.arange(2 * STRIDE)
        seen = half[rows[:, :, None], at]  # the bytes under each filter's best place
        vectors = self.p["bytes"][seen].reshape(n, FILTERS, 2, STRIDE * DIM)
        grads = {"out": d @ live, "level": np.array([d.sum()], np.float32), "bias": back.sum(0),
                 "first": np.einsum("nf,nfv->vf", back, vectors[:, :, 0]), "second": np.einsum("nf,nfv->vf", back, vectors[:, :, 1])}
        to_vector = np.stack([back[:, :, None] * self.p["first"].T, back[:, :, None] * self.p["second"].T], 2).reshape(-1, DIM)
        flat = seen.reshape(-1)
        grads["bytes"] = np.stack([np.bincount(flat, to_vector[:, j], 257) for j in range(DIM)], 1).astype(np.float32)
        grads["bytes"][PAD] = 0
        adam.step(grads)


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, folds: int = FOLDS, fold: int = FOLD, draws: int = DRAWS) -> Network:
    """A network fitted on a sample of at most `most` labelled documents that are not held out, `draws` of their chunks an epoch."""
    return fit_on_sample(Network(), docs, labels, "quality", folds, fold, most, draws=draws)


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 4000, folds: int = FOLDS, fold: int = FOLD, draws: int = DRAWS) -> DataFrame:
    """`docs` with held_out, score (probability of quality 1) and predicted.

    Training is bounded by two parameters: at most `most` labelled documents, and `draws` chunks of them an epoch.

    Every whole text is scored, null and empty ones as a chunk of padding. Ids, languages and sources
    are not looked at. Without usable labels of both kinds every score is about the share of the labels there
    are, a third without any. Repeated rows get the same score; an empty table gives no rows. Other columns pass through,
    those named like a result are replaced.
    """
    return score_documents(docs, train(docs, labels, most, folds, fold, draws), folds, fold)

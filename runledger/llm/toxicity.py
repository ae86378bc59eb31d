"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a learned vector of the word (words of the training sample; others have none) plus
the mean of learned vectors of its character trigrams. A window is 48 words and starts every 36 words,
so windows overlap and cover the whole text. A recurrent layer runs over a window in each direction,
attention weighs its states, and a linear layer makes a logit of their mean and of the largest value of each.
The largest window logit of a document becomes its probability by a logistic layer fitted on documents.
Training also sees short toxic texts pasted into clean ones at any place, as a bad passage of a long text looks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from runledger.llm.arrow import LOWER, ranges, words
from runledger.llm.learn import Adam, fit_on_sample, logistic, score_documents, sigmoid

FOLDS, FOLD = 5, 0
WINDOW, STRIDE, DIM, HIDDEN, ATTEND = 48, 36, 12, 10, 8
TRIGRAMS = 1 << 12
BATCH = 2048
STRETCH_BYTES, STRETCH_WORDS = 1 << 20, 1 << 18  # of the sample looked at together
STEPS = 150  # training steps at least
SEEN, HIDE = 3, 0.2  # documents of the sample that hold a known word; share of words hidden in a training step


def trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of words of lower-cased bytes with an edge on both sides: number below TRIGRAMS, and word."""
    at, owner = ranges(starts, ends - starts)
    left = np.where(at > starts[owner], LOWER[data[np.maximum(at - 1, 0)]], 1).astype(np.int64)
    right = np.where(at + 1 < ends[owner], LOWER[data[np.minimum(at + 1, max(len(data) - 1, 0))]], 2)
    return ((left * 31 + LOWER[data[at]]) * 8191 + right.astype(np.int64) * 131) * 2654435761 % (1 << 32) >> 20, owner


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of every window; a row without words has an empty one."""
    n = np.diff(rows)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    number, row = ranges(np.zeros(len(n), np.int64), count)
    first = rows[row] + number * STRIDE
    return first, np.clip(rows[row + 1] - first, 0, WINDOW), row


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"chars": normal(0.1, TRIGRAMS, DIM), "attend": normal(0.3, 2 * HIDDEN, ATTEND), "query": normal(0.3, ATTEND), "out": normal(0.3, 2 * HIDDEN), "peak": normal(0.3, 2 * HIDDEN), "level": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"in_{way}": normal(0.4, DIM, 3 * HIDDEN), f"bias_{way}": np.zeros(3 * HIDDEN, np.float32), f"rec_{way}": normal(0.3, HIDDEN, 3 * HIDDEN)}
        self.vocabulary = np.zeros(0, np.uint64)
        self.p["words"] = np.zeros((1, DIM), np.float32)  # the last row stands for all other words
        self.scale = np.array([1.0, 0.0])

    def word_rows(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, len(self.vocabulary))

    def inputs(self, word_row: np.ndarray, gram: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words, and a last one of zeros for padding."""
        starts = np.searchsorted(owner, np.arange(len(word_row)))
        out = np.zeros((len(word_row) + 1, DIM), np.float32)
        if len(word_row):
            out[:-1] = np.add.reduceat(self.p["chars"][gram], starts) / np.bincount(owner)[:, None] + self.p["words"][word_row]
        return out

    def forward(self, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows of word ids (steps, windows)."""
        steps, n = ids.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        kept = {}
        for way, order, half in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            projected = vectors @ self.p[f"in_{way}"] + self.p[f"bias_{way}"]
            rec, h = self.p[f"rec_{way}"], np.zeros((n, HIDDEN), np.float32)
            for t in order:
                x, u = projected[ids[t]], h @ rec
                gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
                if keep:
                    kept[way, t] = (h, z, r, new, u[:, 2 * HIDDEN:])
                h = h + mask[t][:, None] * ((1 - z) * (new - h))
                states[t, :, half] = h
        hidden = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.p["attend"]).reshape(steps, n, ATTEND)
        energy = np.where(mask > 0, hidden @ self.p["query"], -30.0)
        weight = np.exp(energy - energy.max(0)) * mask
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        context = np.einsum("tn,tnh->nh", weight, states)
        place = np.where(mask[:, :, None] > 0, states, -2).argmax(0)
        peak = np.take_along_axis(states, place[None], 0)[0]
        return context @ self.p["out"] + peak @ self.p["peak"] + self.p["level"][0], (states, hidden, weight, context, place, peak, kept)

    def backward(self, vectors, ids, mask, cache, d):
        """Gradients of the parameters and of the input vectors."""
        states, hidden, weight, context, place, peak, kept = cache
        steps, n = ids.shape
        g = {"out": context.T @ d, "peak": peak.T @ d, "level": np.array([d.sum()], np.float32)}
        dc = d[:, None] * self.p["out"]
        ds = weight[:, :, None] * dc
        dw = np.einsum("tnh,nh->tn", states, dc)
        de = weight * (dw - (weight * dw).sum(0))
        g["query"] = np.einsum("tn,tna->a", de, hidden)
        dh = de[:, :, None] * self.p["query"] * (1 - hidden**2)
        g["attend"] = states.reshape(-1, 2 * HIDDEN).T @ dh.reshape(-1, ATTEND)
        ds = ds + (dh.reshape(-1, ATTEND) @ self.p["attend"].T).reshape(states.shape)
        ds[place, np.arange(n)[:, None], np.arange(2 * HIDDEN)] += d[:, None] * self.p["peak"]
        dv = np.zeros_like(vectors)
        for way, order, half in (("f", range(steps - 1, -1, -1), slice(0, HIDDEN)), ("b", range(steps), slice(HIDDEN, 2 * HIDDEN))):
            rec = self.p[f"rec_{way}"]
            d_rec, d_x, carry = np.zeros_like(rec), np.zeros((steps, n, 3 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in order:
                h, z, r, new, q = kept[way, t]
                total = carry + ds[t, :, half]
                inner = total * mask[t][:, None]
                d_new = inner * (1 - z) * (1 - new**2)
                d_z = inner * (h - new) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], 1)
                d_x[t] = np.concatenate([d_z, d_r, d_new], 1)
                d_rec += h.T @ d_u
                carry = total - inner * (1 - z) + d_u @ rec.T
            flat, used = d_x.reshape(-1, 3 * HIDDEN), ids.reshape(-1)
            by_word = np.stack([np.bincount(used, flat[:, j], len(vectors)) for j in range(3 * HIDDEN)], 1).astype(np.float32)
            g |= {f"rec_{way}": d_rec, f"bias_{way}": flat.sum(0), f"in_{way}": vectors.T @ by_word}
            dv += by_word @ self.p[f"in_{way}"].T
        return g, dv

    def window_logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, starts, ends, rows = words(data, offsets)
        distinct, first, ids = np.unique(h, return_index=True, return_inverse=True)
        gram, owner = trigrams(data, starts[first], ends[first])
        at, n, row = windows(rows)
        return self.logits_of(self.inputs(self.word_rows(distinct), gram, owner), ids, at, n), row

    def logits_of(self, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Logits of windows from the input vectors of distinct words (the last for padding) and the word ids."""
        out = np.empty(len(at), np.float32)
        for k in range(0, len(at), BATCH):
            place = at[k: k + BATCH] + np.arange(WINDOW)[:, None]
            mask = (np.arange(WINDOW)[:, None] < n[k: k + BATCH]).astype(np.float32)
            used = int(mask.sum(0).max()) or 1
            these = np.where(mask > 0, ids[np.minimum(place, max(len(ids) - 1, 0))], len(vectors) - 1) if len(ids) else np.full(place.shape, len(vectors) - 1)
            out[k: k + BATCH] = self.forward(vectors, these[:used], mask[:used])[0]
        return out

    def largest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit, row = self.window_logits(data, offsets)
        return np.maximum.reduceat(logit, np.searchsorted(row, np.arange(len(offsets) - 1)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.largest(data, offsets) * self.scale[0] + self.scale[1])

    def fit(self, texts: list[bytes], y: np.ndarray, shift: float = 0.0, epochs: int = 5, docs_a_batch: int = 64, seed: int = 4) -> Network:
        """Each step takes the windows of some documents that look worst so far; at first, that is by single words."""
        if len(set(y.tolist())) < 2:
            self.scale = np.array([0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))])
            return self
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        distinct, starts, ends, ids, rows = _words_of(data, offsets)
        count, toxic = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        for low, high in _stretches(rows, STRETCH_WORDS):  # words of each document once
            of = np.repeat(np.arange(high - low), np.diff(rows[low: high + 1]))
            pairs = np.unique(ids[rows[low]: rows[high]].astype(np.int64) * (high - low) + of)
            count += np.bincount(pairs // (high - low), minlength=len(distinct))
            toxic += np.bincount(pairs // (high - low), y[low + pairs % (high - low)], len(distinct))
        odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((count - toxic + 0.5) / (len(y) - y.sum() + 1))
        known = count >= SEEN
        odds = np.where(known, odds, 0).astype(np.float32)
        self.vocabulary = distinct[known]
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.05, (known.sum() + 1, DIM)).astype(np.float32)
        table[:-1, 0] = np.clip(odds[known], -2, 3) / 2
        table[-1] = 0
        self.p["words"] = table
        gram, owner = trigrams(data, starts, ends)
        word_row = self.word_rows(distinct)
        grams_of = np.bincount(owner)[:, None]
        at, n, row = windows(rows)
        padded = np.concatenate([ids, np.full(WINDOW, len(distinct), np.int32)])
        sums = np.concatenate([[0], np.cumsum(np.maximum(odds[ids], 0) ** 2)])
        suspicion = sums[at + n] - sums[at]
        del sums
        of_doc = np.searchsorted(row, np.arange(len(texts) + 1))
        adam = Adam(self.p, 0.01)
        rounds = max(epochs, -(-STEPS * docs_a_batch // len(texts)))  # small samples are gone through more often
        for epoch in range(rounds):
            adam.rate = 0.01 * 0.5 ** max(0, epochs * epoch // rounds - 1)
            if epochs * epoch // rounds >= 2:
                suspicion = self.logits_of(self.inputs(word_row, gram, owner), ids, at, n)
            order = rng.permutation(len(texts))
            for k in range(0, len(order), docs_a_batch):
                pick = []
                for i in order[k: k + docs_a_batch]:
                    own = np.arange(of_doc[i], of_doc[i + 1])
                    worst = own[np.argsort(-suspicion[own], kind="stable")[:1 if y[i] else 2]]
                    pick += [*worst, *([] if y[i] else rng.choice(own, 1))]
                pick = np.unique(pick)
                target = y[row[pick]]
                inside = np.arange(WINDOW)[:, None] < n[pick]
                these = np.where(inside, padded[np.minimum(at[pick] + np.arange(WINDOW)[:, None], len(padded) - 1)], len(distinct))
                these, target = pasted(these, n[pick], target, len(distinct), rng)
                mask = (these < len(distinct)).astype(np.float32)
                used, local = np.unique(these, return_inverse=True)
                real = used[used < len(distinct)]
                grams, owners = _lists_of(real, owner, len(distinct))
                shown = np.where(rng.random(len(real)) < HIDE, len(table) - 1, word_row[real])  # so that trigrams have to do as well
                vectors = self.inputs(shown, gram[grams], owners)
                local = np.where(these < len(distinct), local.reshape(these.shape), len(real))
                logit, cache = self.forward(vectors, local, mask, keep=True)
                d = ((sigmoid(logit) - target) / len(target)).astype(np.float32)
                g, dv = self.backward(vectors, local, mask, cache, d)
                dv = dv[:-1]
                per_gram = (dv / grams_of[real])[owners]
                g["chars"] = np.stack([np.bincount(gram[grams], per_gram[:, j], TRIGRAMS) for j in range(DIM)], 1).astype(np.float32)
                g["words"] = np.stack([np.bincount(shown, dv[:, j], len(table)) for j in range(DIM)], 1).astype(np.float32)
                g["words"][-1] = 0
                adam.step(g)
        largest = np.maximum.reduceat(self.logits_of(self.inputs(word_row, gram, owner), ids, at, n), of_doc[:-1])
        self.scale = logistic(largest[:, None], y) + np.array([0.0, shift])
        return self


def _stretches(offsets: np.ndarray, most: int):
    """Runs (first row, row behind) of rows with at most `most` items, or one row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a sample (hash, and first byte and end of one occurrence), number of each word in them, row offsets.

    Texts are gone through in stretches, so what is held of all of them at once is a hash and a number a word.
    """
    found, hashes, counts = None, [], []
    for low, high in _stretches(offsets, STRETCH_BYTES):
        h, starts, ends, rows = words(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low])
        hashes.append(h)
        counts.append(np.diff(rows))
        distinct, first = np.unique(h, return_index=True)
        own = (distinct, starts[first] + offsets[low], ends[first] + offsets[low])
        if found is not None:
            own = tuple(np.concatenate(pair) for pair in zip(found, own, strict=True))
            distinct, first = np.unique(own[0], return_index=True)  # the first occurrence of all stretches
            own = (distinct, own[1][first], own[2][first])
        found = own
    distinct, starts, ends = found
    ids = np.concatenate([np.searchsorted(distinct, h).astype(np.int32) for h in hashes])
    return distinct, starts, ends, ids, np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def pasted(these: np.ndarray, n: np.ndarray, target: np.ndarray, padding: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Windows (as columns of word ids) and labels, with more of both kinds: every toxic text of at most half a window at a
    random place among words of clean windows, and these words alone."""
    short, clean = np.flatnonzero((target > 0) & (n > 0) & (n <= WINDOW // 2)), np.flatnonzero((target == 0) & (n > 0))
    if not len(short) or not len(clean):
        return these, target
    made = np.full((WINDOW, 2 * len(short)), padding, these.dtype)
    for j, k in enumerate(short):
        around = np.concatenate([these[: n[c], c] for c in rng.choice(clean, WINDOW)])[:WINDOW]
        length = rng.integers(n[k], WINDOW + 1)
        place = rng.integers(0, length - n[k] + 1)
        made[:length, 2 * j] = np.concatenate([around[:place], these[: n[k], k], around[place: length - n[k]]])
        made[:length, 2 * j + 1] = around[:length]
    return np.concatenate([these, made], 1), np.concatenate([target, np.tile([1, 0], len(short)).astype(target.dtype)])


def _lists_of(wanted: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `owner` (sorted) of the wanted owners, and the number of the wanted owner."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return ranges(bounds[wanted], bounds[wanted + 1] - bounds[wanted])


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, folds: int = FOLDS, fold: int = FOLD) -> Network:
    """A network fitted on a sample of at most `most` labelled documents that are not held out."""
    return fit_on_sample(Network(), docs, labels, "toxic", folds, fold, most)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 4000, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """`docs` with held_out, score (probability of toxic 1) and predicted.

    All windows of every whole text are scored; null texts and texts without words have one empty
    window. Ids, languages and sources are not looked at. Without usable labels of both kinds every
    score is about the share of the labels there are, a third without any. Repeated rows get the same score; an empty table gives
    no rows. Other columns pass through, those named like a result are replaced.
    """
    return score_documents(docs, train(docs, labels, most, folds, fold), folds, fold)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    return score_toxicity(docs, labels, **options).where("predicted = 0").select(*docs.columns)

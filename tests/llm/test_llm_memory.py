"""What training and counting hold and hand over follows the words there are."""

import tracemalloc

import numpy as np

from runledger.llm import lines, toxicity
from runledger.llm.arrow import words


def _sample(docs=60, size=3000, seed=5):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, size) % 50_000).encode() for _ in range(docs)]
    texts[3], texts[7] = b"", b"one Two two"
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_words_of_a_sample_are_found_in_stretches(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH_BYTES", 40_000)
    data, offsets = _sample()
    h, starts, ends, rows = words(data, offsets)
    distinct, first, ids = np.unique(h, return_index=True, return_inverse=True)
    for got, want in zip(toxicity._words_of(data, offsets), (distinct, starts[first], ends[first], ids, rows), strict=True):
        assert np.array_equal(got, want)


def test_words_of_a_sample_hold_little_at_once(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH_BYTES", 40_000)
    data, offsets = _sample(120)
    tracemalloc.start()
    toxicity._words_of(data, offsets)
    stretches = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    np.unique(words(data, offsets)[0], return_index=True, return_inverse=True)
    whole = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stretches < whole / 2


def test_windows_of_a_sample_without_words():
    network = toxicity.Network().fit([b"", b" "], np.array([0, 1], np.float32))
    assert np.isfinite(network(np.zeros(0, np.uint8), np.array([0, 0]))).all()


def test_counts_of_few_words_are_few_bytes():
    total = np.zeros(lines.COUNTERS, np.uint32)
    places = np.array([0, 5, lines.STRETCH - 1, 7 * lines.STRETCH, lines.COUNTERS - 1])
    total[places] = [1, 2, 3, 70_000, 5]
    batch = lines._cells(total)
    assert batch.column(0).to_pylist() == [0, 7, lines.COUNTERS // lines.STRETCH - 1]
    back = np.zeros_like(total).reshape(-1, lines.STRETCH)
    for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        back[k][np.frombuffer(cells, np.uint16)] = np.frombuffer(counts, np.uint32)
    assert np.array_equal(back.reshape(-1), total)
    assert batch.nbytes < 1000  # a whole stretch has 4,096 bytes
    assert lines._cells(np.zeros_like(total)).num_rows == 0

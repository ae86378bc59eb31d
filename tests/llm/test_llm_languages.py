"""Language identification: n-grams against plain counting, held-out accuracy, odd rows."""

import random
import zlib

import brute
import numpy as np
import pytest
from compare import BASE
from pyspark.sql import functions as F

from runledger.llm import languages
from runledger.llm.queries import QUERIES


def letters_only(text):
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@pytest.mark.parametrize("text", ["Ab, c!", "ÀÉ 12 ß", "x", " ", "a b", "Z" * 5000, "word and, more. " * 300])
def test_grams(text, monkeypatch):
    """Counts of a text are those of its padded plain form, also when it is looked at in parts."""
    padded = f" {letters_only(text)} " if letters_only(text) else ""
    where, counts = languages.grams(text)
    assert counts.sum() == (3 * len(padded) - 3 if padded else 0)
    assert bytes(languages.plain(text).astype("<u4")).decode("utf-32-le") == padded
    for chars in (3, 7):
        monkeypatch.setattr(languages, "CHARS", chars)
        parts = languages.grams(text)
        assert parts[0].tolist() == where.tolist()
        assert parts[1].tolist() == counts.tolist()


def test_queries_answers(spark):
    """Held-out accuracy over the whole table, and every score against the plain formula."""
    sf = f"{BASE}/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op11_identify_languages"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {d["doc_id"] for d in held} == {k for k, r in out.items() if r["held_out"]}
    assert np.mean([out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_document_frequencies(spark):
    texts = ["ab ab", "b a", None, "", "12", "ab", "c" * 4000]
    n, df = languages.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text")
    want = np.zeros(languages.BUCKETS, int)
    for t in texts:
        want[languages.grams(t)[0]] += 1
    assert n == 4
    assert (df == want).all()


def rows_of(n):
    rng = random.Random(4)
    kinds = {"x": "abcd", "y": "cdef", "z": "wxyz"}
    return [(k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(4)) for _ in range(30)), lang, "s", 1) for k in range(n) for lang in [rng.choice("xxxxyyz")]]


def test_odd_rows(spark):
    rows = rows_of(300)
    rows += [(1000, None, "x", None, None), (1001, "", "x", None, None), (1002, "12 !?", "y", None, None), (None, rows[1][1], None, None, None), rows[2], rows[2],
             (1003, "wxyz " * 100_000, None, None, None)]
    df = spark.createDataFrame(rows, brute.TEXT_SCHEMA).repartition(3).withColumns({"score": F.lit("clash"), "label": F.lit(9), "l": F.lit(1), "id": F.lit("i")})
    out = languages.identify_languages(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["doc_id"] == 1003:
            assert r["lang_pred"] == "z"
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    twice = [(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 2]
    assert len(twice) == 3
    assert len(set(twice)) == 1
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.identify_languages(df).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = rows_of(200)
    lied = [(k, t, "q" if zlib.crc32(str(k).encode()) % 5 == 0 else lang, s, n) for k, t, lang, s, n in rows]
    answers = [sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify_languages(spark.createDataFrame(x, brute.TEXT_SCHEMA)).collect()) for x in (rows, lied)]
    assert answers[0] == answers[1]


def test_nothing(spark):
    empty = spark.createDataFrame([], brute.TEXT_SCHEMA)
    assert languages.identify_languages(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 9)], brute.TEXT_SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in languages.identify_languages(unlabelled).collect()] == [("und", 0.0)]
    alone = spark.createDataFrame([(k, "some text", "en", "s", 9) for k in range(9)], brute.TEXT_SCHEMA)
    assert {(r["lang_pred"], r["score"]) for r in languages.identify_languages(alone).collect()} == {("en", 1.0)}


def test_penalties_make_weights_zero():
    rows = [(np.array([0, 1]), np.array([0.99, 0.01], np.float32), 0), (np.array([2, 3]), np.array([0.99, 0.01], np.float32), 1)] * 20
    model = languages.Model(["a", "b"], np.ones(5))
    model.fit(rows, 3, 1.0, 0.7, 0.1)
    assert model.w[0, 0] > 0 > model.w[2, 0]
    assert (model.w[[1, 3, 4]] == 0).all()
    model.calibrate(rows, np.ones(2))
    assert 0.02 <= model.temperature <= 20

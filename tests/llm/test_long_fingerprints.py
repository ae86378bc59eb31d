"""Fingerprints of texts in which one part occurs more often than 16 bits hold."""

import numpy as np
import pytest

from runledger.llm import fingerprints

LONG, OTHER = "a line\n" * 65536, "not so\n" * 65536


def lanes(text):
    narrow, wide = fingerprints.fingerprints(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    return narrow, wide


def test_lanes_of_many_equal_lines():
    one, _ = lanes("a line\n")
    many, _ = lanes(LONG)
    assert (many.astype(np.int64) == 65536 * one.astype(np.int64)).all()
    whole, most, rest = (fingerprints.as_text(*lanes(t))[0] for t in (LONG, "a line\n" * 65530, "a line\n" * 6))
    assert fingerprints.combine(most, rest) == whole and fingerprints.combine(whole, rest, -1) == most


def test_likeness_of_long_texts(spark):
    rows = [(3, LONG), (2, "short and other"), (1, OTHER), (0, LONG)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A third of the lines is another text's: 1 - (1/3)^2 / (1 + (2/3)^2) with a short one.
    assert got[3]["near_edited"] == pytest.approx(12 / 13, abs=0.01)
    assert got[1]["near_next"] < 0.5 and got[0]["near_next"] == 1.0 and got[3]["fingerprint"] == got[0]["fingerprint"] != got[1]["fingerprint"]


def test_one_only_for_equal_wide_lanes():
    zero, ones = np.zeros((1, fingerprints.NARROW), np.int32), np.ones((1, fingerprints.NARROW), np.int32)
    wide, other = np.zeros((1, fingerprints.WIDE), np.uint64), np.ones((1, fingerprints.WIDE), np.uint64)
    assert fingerprints.likeness(zero, zero, wide, wide)[0] == 1 and fingerprints.likeness(zero, zero, wide, other)[0] == 0
    assert 0.99 < fingerprints.likeness(ones, ones, wide, other)[0] < 1

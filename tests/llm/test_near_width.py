"""Near duplicates by five-word shingles, and the pipeline's stage against a brute-force version."""

import os
import random
import sys

import brute
import pytest

from runledger.llm import near

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def components(rows, width):
    """Smallest id of the component of each row (id, text)."""
    sets = []
    for _, text in rows:
        w = brute.space_words(text)
        sets.append({tuple(w[i: i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))})
    best = [k for k, _ in rows]
    while True:
        after = [min([b, *(best[j] for j, t in enumerate(sets) if s and t and brute.similar(s, t))]) for s, b in zip(sets, best, strict=True)]
        if after == best:
            return best
        best = after


def texts(seed=5):
    """Groups of edited copies of 40 to 120 words, and texts of 0 to 6 words."""
    rng = random.Random(seed)
    out = [None, ""]
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            copy = list(base)
            for place in rng.sample(range(len(copy)), edits):
                copy[place] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    for n in range(1, 7):
        short = [f"s{n}-{i}" for i in range(n)]
        out += [" ".join(short), "  ".join(short).upper(), " ".join([*short[:-1], "other"])]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_components_by_width(spark, width):
    rows = texts()
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(frame(spark, rows), width=width).collect()}
    assert got == dict(zip([k for k, _ in rows], components(rows, width), strict=True))


def test_stage_judges_on_five_words(spark):
    """Four changes in 100 words: 91 of 107 two-word shingles are common, 76 of 116 five-word ones."""
    import corpus_pipeline as pipeline

    base = [f"w{i}" for i in range(100)]
    edited = [f"x{i}" if i in (20, 40, 60, 80) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join([*base[:-1], "end"]))]
    stage = dict(pipeline.STAGES)["near_duplicates"]
    assert {r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()} == {1, 2}
    assert {r["component_id"] for r in near.near_components(frame(spark, rows), width=2).collect()} == {1}


def test_stage(spark):
    import corpus_pipeline as pipeline

    rows = texts(6)
    stage = dict(pipeline.STAGES)["near_duplicates"]
    got = {r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()}
    five, two = ({k for (k, _), c in zip(rows, components(rows, w), strict=True) if k == c} for w in (5, 2))
    assert got == five != two

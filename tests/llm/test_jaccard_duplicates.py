"""The pipeline's near-duplicate stage against all pairs by brute force."""

import numpy as np
import pytest

import corpus_pipeline
from concord.llm import jaccard_duplicates
from concord.llm.near_duplicates import fingerprint

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(words, changes, rng):
    out = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        out[at] = f"changed{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.mark.parametrize("chunk", [1 << 17, 300])
def test_edited_copies_leave_the_corpus(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_duplicates, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows += [(100 * k + n, edited(words, c, rng), "s") for n, c in enumerate((0, 1, 2, 3, 4, 5, 12, 30))]
    # a chain: neighbours are alike, the ends are not; and a group of many copies
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    chain = [words[i : i + 150] for i in (0, 12, 24, 36, 48)]
    rows += [(5000 + n, " ".join(w), "s") for n, w in enumerate(chain)]
    rows += [(6000 + n, edited(words[::-1], 1, rng), "s") for n in range(100)]

    group = {i: i for i, _, _ in rows}
    far = 0
    for i, a, _ in rows:
        for j, b, _ in rows:
            if i < j and similarity(a, b) >= 0.8:
                far += (fingerprint(a) ^ fingerprint(b)).bit_count() > 2
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert far > 50  # out of reach of 2 bits
    other = "some text that nothing else in this corpus is like at all"
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "s"), (None, other, "s"), (None, other, "t"), (5000, other + " of five thousand rows", "s"), (9000, None, "s"), (9001, "", "s"), (9000, None, "s")], SCHEMA)
    got = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    kept = {r.doc_id for r in got}
    assert kept == set(group.values()) | {None, 9000}
    # of one id both texts stay, of rows without an id the one that is like no other, of equal rows one
    assert sorted(r.text or "" for r in got if r.doc_id in (None, 5000, 9000)) == sorted(["", other, other + " of five thousand rows", rows[[i for i, _, _ in rows].index(5000)][1]])
    assert 5004 not in kept and sum(i is not None and 6000 <= i < 7000 for i in kept) == 1

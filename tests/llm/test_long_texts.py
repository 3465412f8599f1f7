"""Texts of many megabytes next to short ones; the results of short texts do not change."""

import hashlib
import re

import numpy as np
import pytest

from concord.llm import byte_dedup, decontaminate, kernels, language_id, language_model, line_dedup, near_duplicates, quality_model

MB = 12


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(2)
    words = np.array([f"w{k}" for k in range(50_000)])
    out = " ".join(words[rng.integers(0, len(words), MB * 170_000)])
    return re.sub(r"((?:\S+ ){20})", lambda m: m.group(1).rstrip() + ".\n", out)


@pytest.fixture(scope="module")
def docs(spark, long_text, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "d")
    copied = long_text[5_000_000:5_000_400]
    spark.createDataFrame([(1, long_text, "en"), (2, f"short text before {copied} and after", "en"), (3, "x" * 300, "en")], "doc_id long, text string, lang string").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_pieces_give_the_same_hashes(long_text, monkeypatch):
    import pyarrow as pa

    texts = pa.array([long_text[:200_000], None, "a " + "b" * 5000 + " c"])
    whole = kernels.words(texts)
    monkeypatch.setattr(kernels, "PIECE", 1000)
    assert (kernels.words(texts).hash == whole.hash).all()
    code, value, first = decontaminate.canonical(texts)
    assert len(code) == first[-1] and (decontaminate.canonical(texts)[1] == value).all()


def test_long_texts_pass_through(spark, docs, long_text):
    got = {r.doc_id: r for r in byte_dedup.report(docs).collect()}
    data = long_text.encode()
    seen, gone = set(), 0
    for i in range(len(data) - 99):  # repeats within the long text, if any
        h = hash(data[i : i + 100])
        gone += h in seen
        seen.add(h)
    assert gone == 0 and got[1].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(data).hexdigest()
    assert (got[2].n_removed, got[2].n_spans) == (len(long_text[5_000_000:5_000_400].encode()), 1)
    assert got[3].n_removed == 299
    lines = {r.doc_id: r for r in line_dedup.dedup_report(docs).collect()}
    assert lines[1].n_units > 80_000 and lines[2].n_removed == 2
    fp = {r.doc_id: r.fingerprint for r in near_duplicates.near_duplicates(docs).collect()}
    assert int(fp[1], 16) == near_duplicates.fingerprint(long_text)
    scores = {r.doc_id: r for r in language_model.scores(docs).collect()}
    assert scores[1].n_tokens == len(long_text.split()) + 1
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(["abc def " * 40, "xyz"], ["en", "fr"], steps=3)).collect()} <= {"en", "fr"}
    item = " ".join(long_text[7_000_000:7_000_600].split()[1:40])
    found = decontaminate.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.coverage) for r in found] == [(1, 1.0)]
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id long, quality int")
    assert quality_model.score(docs, quality_model.fit(docs, labels, train_bytes=1 << 20)).count() == 3

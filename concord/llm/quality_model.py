"""Operator 8: quality classifier on random-indexing word vectors.

A word's vector is a sparse ternary random index vector of its hash bucket
plus the normalised sum of its neighbours' index vectors over the training
texts (its context vector). Vectors of the word, of its last three bytes and
of its shape are mean-pooled per document over the whole text. A two-layer
numpy network turns the pooled vector into a logit, which is divided by a
temperature fitted on a part of the sample that the network did not see.

Training reads at most ``train_docs`` labelled documents outside the held-out
fold (those with the smallest hash of their id), whole, on the driver; texts
that would pass ``train_bytes`` in all are left out, not cut. Scoring reads
whole texts.

Edge cases: null or empty text is the zero vector with count 0 and gets a
score like any other; without two classes of labels every score is the mean
label, 0.5 without labels; repeated ids each get their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bucket, documents, table, whole_texts
from concord.llm.kernels import U64, Words, chunks, doc_of, span_hash, prefix_hash, BYTE_CODE, words

DIM, BITS, NONZERO = 24, 14, 4
#: 0 lower case, 1 upper case, 2 digit, 3 mark, 4 from byte 128
KIND = np.full(256, 3, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 4


def index_vectors(seed: int = 3) -> np.ndarray:
    """A sparse ternary vector per bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, DIM), np.float32)
    rows = np.arange(1 << BITS)[:, None]
    out[rows, rng.integers(0, DIM, (1 << BITS, NONZERO))] = rng.choice([-1.0, 1.0], (1 << BITS, NONZERO))
    return out


def pieces(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word, of its last three bytes and of its shape."""
    shift = U64(64 - BITS)
    prefix = prefix_hash(BYTE_CODE[w.data])
    tail = span_hash(prefix, np.maximum(w.start, w.end - 3), w.end)
    shape = (KIND[w.data[w.start]] * 5 + KIND[w.data[w.end - 1]]) * 16 + np.minimum(w.end - w.start, 15)
    return (w.hash >> shift).astype(np.int64), (tail >> shift).astype(np.int64), shape


def context_vectors(texts: list[str], index: np.ndarray) -> np.ndarray:
    """Normalised sums of the two neighbours' index vectors on either side."""
    out = np.zeros_like(index)
    for s in range(0, len(texts), 64):
        w = words(pa.array(texts[s : s + 64], pa.string()), lower=False)
        b, doc = (w.hash >> U64(64 - BITS)).astype(np.int64), doc_of(w.first)
        for step in (1, 2):
            same = doc[step:] == doc[:-step]
            left, right = b[:-step][same], b[step:][same]
            np.add.at(out, left, index[right])
            np.add.at(out, right, index[left])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def pooled(column: pa.Array, index: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row per document: three mean vectors, their norms, the share of words equal to the one before, and the log of the count."""
    w = words(column, lower=False)
    n = len(column)
    count = np.diff(w.first)
    out = np.zeros((n, 3 * DIM + 5), np.float32)
    full = np.flatnonzero(count)
    if len(full):
        starts = w.first[:-1][full]
        for j, (rows, t) in enumerate(zip(pieces(w), (vectors, index, index), strict=True)):
            out[full, j * DIM : (j + 1) * DIM] = np.add.reduceat(t.take(rows, axis=0), starts, axis=0) / count[full, None]
            out[full, 3 * DIM + j] = np.linalg.norm(out[full, j * DIM : (j + 1) * DIM], axis=1)
        same = np.zeros(len(w.hash), np.float32)
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[starts] = 0
        out[full, 3 * DIM + 3] = np.add.reduceat(same, starts) / count[full]
    out[:, -1] = np.log1p(count)
    return out


def logit(x: np.ndarray, m: dict) -> np.ndarray:
    h = np.tanh((x - m["mean"]) / m["std"] @ m["W1"] + m["b1"])
    return h @ m["W2"] + m["b2"]


def train(texts: list[str], labels: list[int], hidden: int = 24, steps: int = 1200, seed: int = 5) -> dict:
    index = index_vectors()
    y = np.array(labels, float)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(labels)) < 2:
        return {"prior": prior}
    vectors = index + context_vectors(texts, index)
    x = np.concatenate([pooled(pa.array(texts[s : s + 64], pa.string()), index, vectors) for s in range(0, len(texts), 64)])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, fit = order[:cut], order[cut:]
    m = {"prior": prior, "vectors": vectors, "index": index, "mean": x[fit].mean(0), "std": x[fit].std(0) + 1e-3, "W1": rng.normal(0, 0.1, (x.shape[1], hidden)), "b1": np.zeros(hidden), "W2": rng.normal(0, 0.1, hidden), "b2": np.log((prior + 1e-3) / (1 - prior + 1e-3))}
    z = (x - m["mean"]) / m["std"]
    first, second = ({k: np.zeros_like(np.asarray(m[k], float)) for k in ("W1", "b1", "W2", "b2")} for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.choice(fit, min(64, len(fit)))
        h = np.tanh(z[rows] @ m["W1"] + m["b1"])
        d = (1 / (1 + np.exp(-(h @ m["W2"] + m["b2"]))) - y[rows]) / len(rows)
        dh = np.outer(d, m["W2"]) * (1 - h * h)
        g = {"W2": h.T @ d + 1e-3 * m["W2"], "b2": d.sum(), "W1": z[rows].T @ dh + 1e-3 * m["W1"], "b1": dh.sum(0)}
        for k in g:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            m[k] = m[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    raw = logit(x[held], m)
    loss = lambda t: np.logaddexp(0, -np.where(y[held] == 1, raw, -raw) / t).mean()
    m["temperature"] = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return m


def score(docs: DataFrame, m: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; only text is read for a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 18):
            if "W1" in m:
                p = 1 / (1 + np.exp(-np.clip(logit(pooled(batch.column(1), m["index"], m["vectors"]), m) / m["temperature"], -30, 30)))
            else:
                p = np.full(batch.num_rows, m["prior"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents(docs).select("doc_id", "text", (bucket(3) == 1).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_bytes: int = 64 << 20) -> dict:
    """Train on at most `train_docs` labelled rows outside the held-out fold, `train_bytes` of text in all."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket(3) != 1)).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_docs)
    # at most train_docs rows are broadcast
    usable = documents(docs).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    key = F.xxhash64("doc_id", "text")
    sample = usable.select(key.alias("key"), F.octet_length("text").alias("size"), "quality").distinct().orderBy("key", "quality").limit(train_docs).collect()
    rows = whole_texts(usable.select("doc_id", "text", "quality"), [(r.key, r.size, r.quality) for r in sample], "quality int", train_bytes)
    rows = sorted(rows, key=lambda r: (r.key, r.quality))
    return train([r.text for r in rows], [r.quality for r in rows])


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

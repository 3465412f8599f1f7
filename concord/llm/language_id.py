"""Operator 1: language identification with a byte convolutional network.

Bytes are folded into 64 classes, embedded, and passed through filters of
widths 2, 3 and 4, max pooling over fixed-length windows, and softmax. The
network is trained in numpy on a bounded sample of labelled documents: of each
language up to ``train_docs``, the ones with the smallest hash of their id, so
that a rare language is learned too; at most ``langs`` languages, the most
frequent ones. The driver takes the whole texts of the sample, up to
``train_bytes`` in all: texts that would pass it are left out, not cut. Whole
texts are scored: each is cut into windows of ``WINDOW`` bytes, and the mean
log-probability over its windows decides.

Filters are linear in the bytes under them, so at scoring time the response
of every byte pair is tabulated once; a position then costs one row gather.

Edge cases: null, empty or letterless text gets ``und`` with score 0; a
table without labelled rows gives ``und`` for all; rows with equal ids or
texts each get their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import bucket, documents, table, whole_texts
from concord.llm.kernels import chunks, text_bytes

WINDOW, CLASSES, EMBED, FILTERS, WIDTHS = 256, 64, 8, 12, (2, 3, 4)

#: 0 pads; a-z and A-Z 1-26; white space 27, digits 28, marks 29; bytes from 128 by their low five bits.
FOLD = np.full(256, 29, np.uint8)
FOLD[[*range(9, 14), 32]] = 27
FOLD[48:58] = 28
FOLD[65:91] = FOLD[97:123] = np.arange(1, 27)
FOLD[128:] = 32 + (np.arange(128, 256) & 31)


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes of all windows, padded with 0, and each text's first window."""
    data, at = text_bytes(column)
    count = -(-np.diff(at) // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    if len(at) == 2:  # one text, of any length
        out[: len(data)] = FOLD[data]
        return out.reshape(-1, WINDOW), first
    shift = np.repeat(first[:-1] * WINDOW - at[:-1], np.diff(at))
    out[np.arange(len(data)) + shift] = FOLD[data]
    return out.reshape(-1, WINDOW), first


def train(texts: list[str], labels: list[str], steps: int = 500, seed: int = 1) -> dict:
    """Weights of the network, by Adam on windows drawn from the texts."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, first = windows(pa.array(texts, pa.string()))
    y = np.repeat([langs.index(v) for v in labels], np.diff(first)) if len(texts) else np.zeros(0, int)
    w = {"E": rng.normal(0, 0.5, (CLASSES, EMBED)), "V": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))), "c": np.zeros(len(langs))}
    for k in WIDTHS:
        w[f"W{k}"], w[f"b{k}"] = rng.normal(0, (k * EMBED) ** -0.5, (k * EMBED, FILTERS)), np.zeros(FILTERS)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    by_lang = [np.flatnonzero(y == i) for i in range(len(langs))]
    by_lang = [(i, rows) for i, rows in enumerate(by_lang) if len(rows)]
    for step in range(1, steps + 1 if by_lang else 1):
        pick = np.concatenate([rng.choice(rows, 8) for _, rows in by_lang])
        b, t = x[pick], y[pick]
        # a random piece of each window is blanked, so that short texts are learned too
        b = np.where(np.arange(WINDOW) < rng.integers(24, WINDOW + 1, len(b))[:, None], b, 0)
        g = dict.fromkeys(w, 0.0)
        emb = w["E"][b]
        pooled, arg, cols = [], [], []
        for k in WIDTHS:
            col = np.concatenate([emb[:, i : WINDOW - k + 1 + i] for i in range(k)], axis=2)
            r = col @ w[f"W{k}"] + w[f"b{k}"]
            a = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, a[:, None], 1)[:, 0])
            arg.append(a)
            cols.append(col)
        h = np.concatenate(pooled, axis=1)
        z = np.maximum(h, 0) @ w["V"] + w["c"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(t)), t] -= 1
        p /= len(t)
        g["V"], g["c"] = np.maximum(h, 0).T @ p, p.sum(0)
        dh = (p @ w["V"].T) * (h > 0)
        g["E"] = np.zeros_like(w["E"])
        rows = np.arange(len(t))[:, None]
        for j, k in enumerate(WIDTHS):
            d, a = dh[:, j * FILTERS : (j + 1) * FILTERS], arg[j]
            taken = cols[j][rows, a]  # rows x filters x (k * embed)
            g[f"W{k}"], g[f"b{k}"] = np.einsum("bfe,bf->ef", taken, d), d.sum(0)
            back = np.einsum("bf,ef->bfe", d, w[f"W{k}"])
            for i in range(k):
                np.add.at(g["E"], b[rows, a + i], back[:, :, i * EMBED : (i + 1) * EMBED])
        for key in w:
            m[key] = 0.9 * m[key] + 0.1 * g[key]
            v[key] = 0.999 * v[key] + 0.001 * g[key] ** 2
            w[key] = w[key] - 0.01 * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return {"langs": langs, **w}


def tables(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Responses of every byte pair (widths 2, 3 and 4, and the end of width 4), and of every last byte of width 3."""
    e = w["E"]
    one = lambda k, i: e @ w[f"W{k}"][i * EMBED : (i + 1) * EMBED]
    two = lambda k, i: (one(k, i)[:, None] + one(k, i + 1)[None]).reshape(-1, FILTERS)
    return np.concatenate([two(2, 0) + w["b2"], two(3, 0) + w["b3"], two(4, 0) + w["b4"], two(4, 2)], axis=1).astype(np.float32), one(3, 2).astype(np.float32)


def log_probs(x: np.ndarray, w: dict, pair: np.ndarray, last: np.ndarray, step: int = 32) -> np.ndarray:
    """Log-probabilities of each language for each window."""
    out = np.empty((len(x), len(w["langs"])))
    n = FILTERS
    for s in range(0, len(x), step):
        b = x[s : s + step]
        key = (b[:, :-1].astype(np.int32) << 6) | b[:, 1:]
        r = pair.take(key, axis=0)  # windows x 255 x 4n
        body = r[:, :-2, : 3 * n]
        body[:, :, n : 2 * n] += last.take(b[:, 2:-1], axis=0)
        body[:, :, 2 * n :] += r[:, 2:, 3 * n :]
        h = body.max(axis=1)
        h[:, :n] = np.maximum(h[:, :n], r[:, -2:, :n].max(axis=1))
        h[:, n : 2 * n] = np.maximum(h[:, n : 2 * n], r[:, -2, n : 2 * n] + last[b[:, -1]])
        z = np.maximum(h, 0) @ w["V"] + w["c"]
        z -= z.max(1, keepdims=True)
        out[s : s + step] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def predict(docs: DataFrame, w: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only text is read for a prediction."""
    langs = w["langs"]
    pair, last = tables(w) if langs else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x, first = windows(batch.column(1))
            letters = np.array(batch.column(3).to_pylist(), bool)
            n = batch.num_rows
            best, score = np.zeros(n, int), np.zeros(n)
            use = np.flatnonzero(letters & (np.diff(first) > 0)) if langs else np.zeros(0, int)
            if len(use):
                total = np.zeros((len(x) + 1, len(langs)))
                np.cumsum(log_probs(x, w, pair, last), axis=0, out=total[1:])
                mean = (total[first[use + 1]] - total[first[use]]) / np.diff(first)[use, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[use], score[use] = p.argmax(1), p.max(1)
            known = np.isin(np.arange(n), use)
            names = [langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents(docs).select("doc_id", "text", (bucket(4) == 2).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def fit(docs: DataFrame, train_docs: int = 150, langs: int = 200, train_bytes: int = 64 << 20) -> dict:
    """Train on at most `train_docs` labelled rows of each of `langs` languages outside the held-out fold, `train_bytes` of text in all."""
    usable = documents(docs, "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(4) != 2))
    ranked = usable.select("lang", F.xxhash64("doc_id", "text").alias("key"), F.octet_length("text").cast("long").alias("size"))
    # the smallest hashes of a language; Spark keeps no more than these of each before it shuffles
    smallest = Window.partitionBy("lang").orderBy("key", "size")
    first = ranked.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= train_docs)
    # languages are many only where labels are wrong; in turn from each, so that the bytes are shared
    sample = first.orderBy("n", "lang", "key").limit(train_docs * langs).select("key", "size", "n", "lang").collect()
    rows = whole_texts(usable, [(r.key, r.size, r.lang) for r in sample], "lang string", train_bytes)
    rows = sorted(rows, key=lambda r: (r.key, r.lang))
    return train([r.text for r in rows], [r.lang for r in rows])


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))

"""Operator 6: language-model scores from a weighted backoff automaton.

The model is smoothed word trigrams. A state is a context seen in training:
the last two tokens, the last one, or none (the root). A state has an arc for
every token seen after it and a failure arc to the state without its oldest
token; weights are log-probabilities. With c the count of an n-gram, n that of
its context, and p' the weight of the token below, an arc weighs
(c + mu p') / (n + mu) and a failure arc mu / (n + mu); at the root a token
weighs (c + 1) / (N + V + 1). The weights of a state's tokens sum to one. A
document starts in the state of its start mark and ends with an end token.

The automaton grows with the corpus and is never collected or broadcast:

1. Scan tasks cut their documents into blocks of about ``BLOCK_BYTES``. A
   block tells its distinct n-grams, each with its count in the block's
   training documents, to the ``p`` parts of the key space: one row a block
   and part, keys sorted, as differences, compressed.
2. A part adds up the counts of each n-gram over all blocks, and gives a block
   those that differ from the block's own. An n-gram that no other block
   holds need not travel back.
3. These meet the block (made by the same scan again), which then holds the
   states and arcs that its documents can reach. One pass from left to right
   hands the state on from token to token and adds log-probabilities.

Tokens are known by 64 bits of a hash, longer n-grams by a number of bits that
grows with the corpus, so that at any size about one in 25,000 shares its key
with another (see ``width``). Blocks are made twice, so the rows must come in
the same order again: from files, or from a checkpoint.

Edge cases: null or empty text is the end token alone; without training
documents all counts are 0; repeated ids are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bucket, documents, parts, table, text_size
from concord.llm.kernels import U64, chunks, mix, words

BLOCK_BYTES, PART_BYTES = 8 << 20, 4 << 20
MU = (1000.0, 3.0)  # of contexts of one and of two tokens
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)


def planes(a: np.ndarray) -> bytes:
    """The bytes of whole numbers by significance, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unplaned(b: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).view(kind)[:, 0]


def sorted_pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and a count of each."""
    return planes(np.concatenate([np.diff(keys, prepend=U64(0)), counts.astype(U64)]))


def sorted_unpack(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = unplaned(b, 2 * n, "<u8")
    return np.cumsum(both[:n], dtype=U64), both[n:].astype(np.int64)


class Block(NamedTuple):
    ids: list[int | None]
    held: np.ndarray  # per document
    sizes: np.ndarray  # words per document
    tokens: np.ndarray  # hashes of all words


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """Blocks of a task with their numbers; batches: doc_id, text, held."""
    number = TaskContext.get().partitionId() << 32
    ids, held, sizes, tokens, size = [], [], [], [], 0
    for batch in chunks(batches, limit=BLOCK_BYTES >> 2):
        w = words(batch.column(1))
        ids += batch.column(0).to_pylist()
        held += batch.column(2).to_pylist()
        sizes.append(np.diff(w.first))
        tokens.append(w.hash)
        size += len(w.data)
        if size >= BLOCK_BYTES:
            yield number, Block(ids, np.array(held, bool), np.concatenate(sizes), np.concatenate(tokens))
            ids, held, sizes, tokens, size, number = [], [], [], [], 0, number + 1
    if ids:
        yield number, Block(ids, np.array(held, bool), np.concatenate(sizes), np.concatenate(tokens))


class Grams(NamedTuple):
    """The n-grams that end at each token of a block, ends included: keys[k] is (unigrams) or (bigrams, then trigrams)."""

    first: np.ndarray  # per document, its first token; one more at the end
    train: np.ndarray  # per token
    keys: tuple[np.ndarray, np.ndarray]
    inner: np.ndarray  # tokens that are not the first of their document: only those end a trigram


def width(text_bytes: int) -> int:
    """Bits of the keys of bigrams and trigrams; there are fewer than text_bytes / 2 of these."""
    return min(62, max(40, int(text_bytes).bit_length() + 13))


def grams(b: Block, bits: int) -> Grams:
    first = np.concatenate([[0], np.cumsum(b.sizes + 1)])
    t = np.full(int(first[-1]), END)
    place = np.ones(len(t), bool)
    place[first[1:] - 1] = False
    t[place] = b.tokens
    one = mix(t)
    before = np.empty_like(one)
    before[1:] = one[:-1]
    before[first[:-1]] = START
    two = mix(before * U64(0x9FB21C651E98DF25) + one)
    inner = np.ones(len(t), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    three = mix(two[at - 1] * U64(0xC2B2AE3D27D4EB4F) + one[at])
    rest = U64(65 - bits)
    long = np.concatenate([two >> rest << U64(1), three >> rest << U64(1) | U64(1)])
    return Grams(first, np.repeat(~b.held, b.sizes + 1), (one, long), inner)


def counted(g: Grams, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts in training documents, and each gram's index in them."""
    keys, at = np.unique(g.keys[k], return_inverse=True)
    train = g.train if k == 0 else np.concatenate([g.train, g.train[g.inner]])
    return keys, np.bincount(at[train], minlength=len(keys)), at


ROW = "p long, block long, n0 long, b0 binary, n1 long, b1 binary"


def _row(p: int, block: int, packed: list[tuple[int, bytes]]) -> pa.RecordBatch:
    row = [p, block, *(x for pair in packed for x in pair)]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], [x.split()[0] for x in ROW.split(", ")])


def told(docs: DataFrame, many: int, bits: int, orders: tuple[int, ...] = (0, 1)) -> DataFrame:
    """A ROW for each block and part of the key space: the block's n-grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in blocks(batches):
            g = grams(b, bits)
            found = {k: counted(g, k)[:2] for k in orders}
            cuts = {}
            for k, (keys, _) in found.items():
                part = ((keys >> U64((64, bits)[k] - 32)) * U64(many)) >> U64(32)
                cuts[k] = np.searchsorted(part, np.arange(many + 1, dtype=U64))
            for p in range(many):
                of = lambda k: slice(cuts[k][p], cuts[k][p + 1]) if k in found else slice(0, 0)  # noqa: E731, B023
                packed = [(of(k).stop - of(k).start, sorted_pack(found[k][0][of(k)], found[k][1][of(k)]) if k in found else b"") for k in (0, 1)]
                if packed[0][0] or packed[1][0]:
                    yield _row(p, number, [(int(n), x) for n, x in packed])

    return scan(docs).mapInArrow(run, ROW).repartition(many, "p")


def scan(docs: DataFrame) -> DataFrame:
    return documents(docs).select("doc_id", "text", (bucket(7) == 2).alias("held"))


def _added(rows: list[dict], k: int) -> tuple[np.ndarray, ...]:
    """Of all rows of a part: keys, counts, totals over all rows, and the end of each row."""
    both = [sorted_unpack(r[f"b{k}"], r[f"n{k}"]) for r in rows]
    keys, counts = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    at = np.flatnonzero(first)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(keys)))) if len(at) else 0
    return keys, counts, total, np.cumsum([r[f"n{k}"] for r in rows])


def vocabulary(docs: DataFrame, many: int) -> tuple[int, int]:
    """N and V of the training documents."""

    def run(t: pa.Table) -> pa.Table:
        keys, counts, total, _ = _added(t.to_pylist(), 0)
        return pa.table({"n": pa.array([int(counts.sum())]), "v": pa.array([len(np.unique(keys[total > 0]))])})

    row = told(docs, many, 40, (0,)).groupBy("p").applyInArrow(run, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return row[0], row[1]


def shared_counts(docs: DataFrame, many: int, bits: int) -> DataFrame:
    """A ROW for each block and part: the n-grams of the block whose count over all blocks is not the block's own, with that count."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out: dict[int, list[tuple[int, bytes]]] = {}
        for k in (0, 1):
            keys, counts, total, ends = _added(rows, k)
            for i, end in enumerate(ends):
                own = np.arange(end - rows[i][f"n{k}"], end)
                own = own[total[own] != counts[own]]
                out.setdefault(i, []).append((len(own), sorted_pack(keys[own], total[own])))
        found = [_row(rows[i]["p"], rows[i]["block"], x) for i, x in out.items() if x[0][0] or x[1][0]]
        return pa.Table.from_batches(found, _schema(ROW))

    return told(docs, many, bits).groupBy("p").applyInArrow(run, ROW)


def walk(c: tuple[np.ndarray, ...], first: np.ndarray, starts: int, n: int, v: int, mu: tuple[float, float] = MU) -> np.ndarray:
    """The log-probability of each token; c: counts of the unigram, bigram and trigram that end there, starts: documents in training.

    The state before a token is the longest context that training has; each
    token hands on the counts of the contexts that it ends.
    """
    last, last_two = np.empty(len(c[0])), np.empty(len(c[0]))
    last[1:], last_two[1:] = c[0][:-1], c[1][:-1]
    last[first[:-1]], last_two[first[:-1]] = starts, 0  # the start mark has no token before it
    weight = np.log10((c[0] + 1) / (n + v + 1))
    for context, count, m in ((last, c[1], mu[0]), (last_two, c[2], mu[1])):
        arc = np.log10((count + m * 10**weight) / (context + m))
        failure = np.log10(m / (context + m)) + weight
        weight = np.where(count > 0, arc, failure)
    return weight


PACKED = "block long, ids binary, missing binary, held binary, n_docs long, sizes binary, n_words long, distinct binary, n_tokens long, tokens binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed_blocks(docs: DataFrame) -> DataFrame:
    """One row a block; see PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in blocks(batches):
            distinct, at = np.unique(b.tokens, return_inverse=True)
            order = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")  # frequent first: small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            row = {
                "block": number, "ids": planes(np.array([x or 0 for x in b.ids], np.int64)), "missing": planes(np.array([x is None for x in b.ids], np.uint8)), "held": planes(b.held.astype(np.uint8)), "n_docs": len(b.ids),
                "sizes": planes(b.sizes.astype(np.int64)), "n_words": len(distinct), "distinct": planes(distinct[order]), "n_tokens": len(at), "tokens": planes(rank[at]),
            }
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row.values()], list(row))

    return scan(docs).mapInArrow(run, PACKED)


def _schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in fields.split(", "))])


def scores(docs: DataFrame, mu: tuple[float, float] = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    size = text_size(docs)
    many, bits = parts(size, PART_BYTES, 16 << 20, 1 << 14), width(size)
    dealt = parts(size, BLOCK_BYTES, 4 * BLOCK_BYTES, 1 << 14)
    n, v = vocabulary(docs, many)
    starts = docs.where(bucket(7) != 2).count()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            d, known = r["n_docs"], sorted(right.to_pylist(), key=lambda x: x["p"])
            tokens = unplaned(r["distinct"], r["n_words"], "<u8")[unplaned(r["tokens"], r["n_tokens"], "<u4")]
            b = Block([], unplaned(r["held"], d, "u1").astype(bool), unplaned(r["sizes"], d, "<i8"), tokens)
            g = grams(b, bits)
            counts = []
            for k in (0, 1):
                keys, count, at = counted(g, k)
                for x in known:  # counts that other blocks share in
                    own, total = sorted_unpack(x[f"b{k}"], x[f"n{k}"])
                    count[np.searchsorted(keys, own)] = total
                counts.append(count[at])
            c1, c2, c3 = counts[0], counts[1][: len(g.train)], np.zeros(len(g.train), np.int64)
            c3[g.inner] = counts[1][len(g.train) :]
            weight = walk((c1, c2, c3), g.first, starts, n, v, mu)
            sums = lambda x: pa.array(np.add.reduceat(x, g.first[:-1]))  # noqa: E731, B023  every document has its end
            ids = pa.array(unplaned(r["ids"], d, "<i8"), mask=unplaned(r["missing"], d, "u1").astype(bool))
            columns = [ids, pa.array(b.held), pa.array(b.sizes + 1), sums((c1 > 0).astype(np.int64)), pa.array(np.full(d, n, np.int64)), sums(np.log10((c1 + 1) / (n + v + 1))), sums(weight)]
            out.append(pa.RecordBatch.from_arrays(columns, schema=_schema(RESULT)))
        return pa.Table.from_batches(out, _schema(RESULT))

    return packed_blocks(docs).repartition(dealt, "block").groupBy("block").cogroup(shared_counts(docs, many, bits).repartition(dealt, "block").groupBy("block")).applyInArrow(run, RESULT)


def op6(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))

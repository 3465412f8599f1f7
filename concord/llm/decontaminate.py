"""Operator 5: benchmark decontamination by template canonicalisation.

Tokens lose their marks and case; numbers, names (a capital followed by no
other capital, at the head of a sentence too) and units (a unit word after a
number) become typed placeholders. Windows of ``WINDOW`` canonical tokens are
hashed and hash-joined with the benchmark's windows. A window with fewer than
``LITERALS`` words besides its placeholders says nothing and is hashed by its
values instead, so that tables of numbers match verbatim only.

The values behind the placeholders travel with each window: along one
alignment of a document with an item, the same item value must always stand
against the same document value. Windows with a value that stands against two
do not count. A document is contaminated by an item when its consistent
windows cover at least ``COVERAGE`` of the item's windows.

Before the join, tasks drop windows that miss a bitmap of the benchmark's
hashes; its size is fixed (``FILTER_BITS``), so it never grows with either
side, and the join decides.

Edge cases: null or empty texts have no windows; an item of fewer than
``WINDOW`` tokens is one window of its own length; an item without tokens
matches nothing; a row owns its windows, so null and repeated ids do not add
up; rows equal in id and text are one document, and one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import named, table
from concord.llm.kernels import BYTE_CODE, LOWER, SPACE, U64, chunks, doc_of, mix, prefix_hash, span_hash, spans_hash, text_bytes

WINDOW, COVERAGE, LITERALS = 8, 0.5, 2
FILTER_BITS = 22
BROADCAST_ROWS = 200_000  # more benchmark windows than these are joined by shuffling

NUMBER, NAME, UNIT = U64(0x11), U64(0x22), U64(0x33)

# Unit words
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l s sec min h hr hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches percent dollar dollars euro euros cent cents degree degrees".split()

KEEP = SPACE.copy()
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    KEEP[_lo:_hi] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    end = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return np.sort(span_hash(prefix_hash(BYTE_CODE[data]), end - [len(u) for u in UNITS], end))


UNIT_HASHES = _unit_hashes()


def canonical(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical token codes, the hashes of what stood there, and each text's first token."""
    raw, at = text_bytes(column)
    keep = KEEP[raw]
    data = raw[keep]
    cut = np.concatenate([[0], np.cumsum([np.count_nonzero(keep[a:b]) for a, b in zip(at, at[1:])])]).astype(np.int64)  # the texts' offsets in data
    inside = ~SPACE[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = cut[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge], stop[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, cut)
    value = spans_hash(LOWER[data], start, end)
    if not len(start):
        return value, value, first
    number = np.logical_or.reduceat((data >= 48) & (data < 58), start)  # what is between words is no digit
    head = data[start]
    after = data[np.minimum(start + 1, len(data) - 1)]
    capital = ((head >= 65) & (head < 91)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    name = capital & (np.add.reduceat(((data >= 65) & (data < 91)).astype(np.int32), start) <= 1)
    unit = np.zeros(len(start), bool)
    near = UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)] == value
    unit[1:] = near[1:] & number[:-1]
    code = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return code, value, first


def hashed_windows(code: np.ndarray, value: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of every n-token window that lies in one text."""
    if len(code) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    doc = doc_of(first)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])

    def folded(x: np.ndarray) -> np.ndarray:
        h = np.full(len(x) - n + 1, n, U64)
        for i in range(n):
            h = (h ^ x[i : len(x) - n + 1 + i]) * U64(0x9FB21C651E98DF25)
            h ^= h >> U64(29)
        return mix(h[at])

    words = np.concatenate([[0], np.cumsum(code > UNIT)])
    bare = words[at + n] - words[at] < min(LITERALS, n)
    h = folded(code)
    if bare.any():
        h[bare] = mix(folded(value)[bare] + U64(1))
    return h, at


def _rows(batch: pa.RecordBatch, code, value, first, h, at, n) -> pa.RecordBatch:
    """Rows of windows: id, row, hash, place in the text, and the values behind its placeholders."""
    doc = doc_of(first)[at]
    typed = code <= UNIT
    grid = at[:, None] + np.arange(n)
    taken = typed[grid]
    slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken.sum(1))]).astype(np.int32)), pa.array(value[grid][taken].view(np.int64)))
    ids, rows = (batch.column(batch.schema.get_field_index(c)).take(pa.array(doc)) for c in ("doc_id", "row"))
    return pa.RecordBatch.from_arrays([ids, rows, pa.array(h.view(np.int64)), pa.array(at - first[doc]), slots], ["id", "row", "hash", "pos", "slots"])


ROWS = "id long, row long, hash long, pos long, slots array<long>"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, irow, hash, ipos, islots, length (of the window) and n_windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            code, value, first = canonical(batch.column(batch.schema.get_field_index("text")))
            count = np.diff(first)
            for n in sorted({min(WINDOW, int(c)) for c in count if c}):
                h, at = hashed_windows(code, value, first, n)
                mine = np.minimum(count, WINDOW)[doc_of(first)[at]] == n
                out = _rows(batch, code, value, first, h[mine], at[mine], n)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, n, np.int32))], [*out.schema.names, "length"])

    found = named(items.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(run, ROWS + ", length int").distinct()
    count = found.groupBy("row").agg(F.countDistinct("hash").alias("n_windows"))
    return found.join(count, "row").select(F.col("id").alias("item_id"), F.col("row").alias("irow"), "hash", F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "length", "n_windows")


def candidate_windows(docs: DataFrame, lengths: list[int], bitmap: np.ndarray) -> DataFrame:
    """Windows of all documents whose hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            code, value, first = canonical(batch.column(batch.schema.get_field_index("text")))
            for n in lengths:
                h, at = hashed_windows(code, value, first, n)
                hit = bitmap[(h >> U64(64 - FILTER_BITS)).astype(np.int64)]
                if hit.any():
                    yield _rows(batch, code, value, first, h[hit], at[hit], n)

    return named(docs).mapInArrow(run, ROWS).withColumnRenamed("id", "doc_id")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, row (as in common.named), item_id, n_windows, n_matched and coverage of every contaminated pair."""
    bench = benchmark_windows(items)
    shift = 64 - FILTER_BITS
    # at most 2^FILTER_BITS / 64 rows reach the driver, however large the benchmark is
    bits = bench.select("length", F.shiftrightunsigned("hash", shift).alias("bit")).groupBy("length", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"), F.count("*").alias("n"))
    found = bits.collect()
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    for r in found:
        bitmap[r.word * 64 : r.word * 64 + 64] |= np.unpackbits(np.array([r.bits], "<i8").view(np.uint8), bitorder="little").astype(bool)
    hits = candidate_windows(docs, sorted({r.length for r in found}), bitmap)
    side = bench.drop("length")
    if sum(r.n for r in found) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    joined = hits.join(side, "hash").where(F.size("slots") == F.size("islots")).withColumn("shift", F.col("pos") - F.col("ipos"))
    aligned = joined.groupBy("doc_id", "row", "item_id", "irow", "shift").agg(F.max("n_windows").alias("n_windows"), F.collect_set(F.struct("hash", F.arrays_zip("islots", "slots").alias("pairs"))).alias("windows"))  # at most an item's own windows a row
    pairs = aligned.withColumn("against", F.array_distinct(F.flatten("windows.pairs")).getField("islots"))
    # item values that stand against two values of the document
    torn = F.filter("against", lambda v, i: F.array_position("against", v) != i + 1)
    kept = F.filter("windows", lambda w: ~F.arrays_overlap(w["pairs"]["islots"], F.col("torn"))).getField("hash")
    kept = pairs.withColumn("torn", torn).withColumn("hashes", kept)
    out = kept.groupBy("doc_id", "row", "item_id", "irow").agg(F.max("n_windows").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("hashes")))).cast("long").alias("n_matched"))
    return out.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= COVERAGE).drop("irow")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched and coverage of every contaminated pair."""
    return contaminated(docs, items).drop("row")


def op5(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

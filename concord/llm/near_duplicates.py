"""Operator 4: SimHash near-duplicates with pigeonring filtering.

Fingerprints are made per document in Arrow batches. Equal fingerprints are
folded into one representative before anything is compared. The 64 bits are
a ring of segments: 8, or more where the number of fingerprints asks for
wider keys (see ``segments_for``). If two fingerprints differ in at most
``DISTANCE`` bits, some chain of consecutive segments exists whose first l
segments differ in at most l * DISTANCE / segments bits, for every l. The
longest part of such a chain that allows no difference is the join key (one
row for each start of the ring); the cumulative budgets of the longer chains
prune the pairs of a key, and the full Hamming distance is checked last.

Keys with more than ``PAIRS_UP_TO`` distinct fingerprints are not paired.
For those, each fingerprint stands at every code within one bit of itself;
two fingerprints within two bits share such a code, and those that share one
are within two bits, so linking a code's members to its smallest one loses
and adds nothing and takes 65 rows a fingerprint, whatever the group's size.

Edge cases: null or empty text has fingerprint zero and is linked like any
other; repeated ids each get a row; rows without an id link their neighbours
like others, and a component's id is null only if all its ids are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import documents, durable, table
from concord.llm.graph import components
from concord.llm.kernels import chunks

DISTANCE, PAIRS_UP_TO, SHINGLE = 2, 64, 3
SEED = 42  # of XXH64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found)
    ends = [*accumulate(map(len, found), lambda a, b: a + b + 1)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    if n < shingle:
        return majority(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, n - shingle + 1))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 << 10):  # bounded memory for long texts
        bits = np.unpackbits(h[at : at + (255 << 10)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fp = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def budget(chain: int, segments: int) -> int:
    """Bits in which the first `chain` segments of a chain may differ."""
    return chain * DISTANCE // segments


def segments_for(fingerprints: int) -> int:
    """The fewest segments whose keys (24, 28 or 30 bits at 2 bits of distance) are as many as the fingerprints, 32 at most."""
    for segments in (8, 16):
        exact = max(n for n in range(1, segments + 1) if budget(n, segments) == 0)
        if fingerprints <= 1 << exact * (64 // segments):
            return segments
    return 32


def links(nodes: DataFrame, segments: int = 8) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within DISTANCE bits; nodes: rep, fp."""
    width = 64 // segments
    exact = max(n for n in range(1, segments + 1) if budget(n, segments) == 0)
    mask = (1 << width * exact) - 1
    turned = [F.col("fp") if not i else F.shiftrightunsigned("fp", width * i).bitwiseOR(F.shiftleft("fp", 64 - width * i)) for i in range(segments)]
    ring = nodes.select("rep", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), t.bitwiseAND(F.lit(mask)).alias("key"), t.alias("ring")) for i, t in enumerate(turned)])).alias("r")).select("rep", "fp", "r.*")
    sizes = ring.groupBy("start", "key").agg(F.count("*").alias("size")).where("size > 1")
    ring = durable(ring.join(sizes, ["start", "key"]))

    small = ring.where(F.col("size") <= PAIRS_UP_TO).select("start", "key", "rep", "ring")
    left, right = small.toDF("start", "key", "a", "x"), small.toDF("start", "key", "b", "y")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    within = F.col("a") < F.col("b")
    for n in range(exact + 1, segments + 1):
        part = differ if n == segments else differ.bitwiseAND(F.lit((1 << width * n) - 1))
        within &= F.bit_count(part) <= budget(n, segments)
    pairs = left.join(right, ["start", "key"]).where(within).select("a", "b")

    hot = ring.where(F.col("size") > PAIRS_UP_TO).select("rep", "fp").distinct()
    codes = hot.select("rep", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("code"))
    heads = codes.groupBy("code").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = codes.join(heads, "code").where("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = durable(fingerprints(docs))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # fingerprints are linked, not ids, so that one held by rows without an id links its neighbours too
    found = components(links(nodes.select(F.col("fp").alias("rep"), "fp"), segments_for(nodes.count())))
    grouped = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

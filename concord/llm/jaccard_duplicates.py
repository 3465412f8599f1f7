"""Near duplicates of the pipeline: five-word shingles, Jaccard similarity of 0.8 or more.

Operator 4 on 64-bit fingerprints of five-word shingles finds the candidates
that pigeonring keys can find (up to 2 bits). At a similarity of 0.8
fingerprints differ in 10 of 64 bits on average and in up to 17, and no chain
of segments with such budgets selects anything (at 12 bits a key of one
segment has 4 bits). So ``BANDS`` keys of ``ROWS`` minimum hashes each find
the rest: a pair at similarity s shares no key with probability
(1 - s^5)^32, 3 in a million at 0.8 and less above. Whatever found a pair,
its similarity is taken exactly, on the whole sets of shingles.

Texts with equal sets are folded first. Only pairs that can change the groups
are compared, and none of those is left out: first every text of a key with
the key's head, then, in keys whose texts are in several groups, every text
outside the head's group with all the others. For that the texts of a key are
dealt into chunks of about ``CHUNK`` shingles, and each chunk of the first
meets each chunk of the others in a task, so a large key is neither collected
nor written out in pairs.

Edge cases: null or empty text has the empty set, equal to all other empty
ones; a row is a document (see common.named), with or without an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import durable, named
from concord.llm.graph import components
from concord.llm.kernels import chunks, mix, window_hash, words
from concord.llm.near_duplicates import links, majority

SHINGLE, LEAST, BANDS, ROWS, CHUNK = 5, 0.8, 32, 5, 1 << 17
SALTS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = words(texts)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        out.append(np.unique(window_hash(w.hash[a:b], max(1, min(SHINGLE, b - a)))))
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of ROWS minimum hashes; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(SALTS), ~np.uint64(0))
    for at in range(0, len(shingles), 4096):  # bounded memory for long texts
        h = shingles[at : at + 4096, None] * SALTS
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in mix(least).reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc, row, digest (of the set), size (of the set), fp (fingerprint) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column(2))
            digest = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(s) for s in sets]
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), bands], ["doc", "row", "digest", "size", "fp", "bands"])

    return named(docs).mapInArrow(run, "doc long, row long, digest long, size long, fp long, bands array<long>")


def shared(sets: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set, how many elements it shares with each of the others."""
    joined = np.concatenate([*others, np.zeros(1, np.uint64)])
    at = np.concatenate([[0], np.cumsum([len(x) for x in others])]).astype(np.int64)
    for s in sets:
        hit = s[np.minimum(np.searchsorted(s, joined), len(s) - 1)] == joined if len(s) else np.zeros(len(joined), bool)
        hit[-1] = False
        total = np.concatenate([[0], np.cumsum(hit)])
        yield total[at[1:]] - total[at[:-1]]


def alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows whose texts reach LEAST; texts: row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ta"):
            for part in chunks(iter([batch]), "tb"):
                found = []
                for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    found.append(both >= LEAST * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    full = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(run, "a long, b long")


def _across(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of a chunk of texts outside the head's group with a chunk of all texts of a key; only of different groups."""
    a, b = (t.column("rep").to_numpy() for t in (left, right))
    ra, rb = (t.column("root").to_numpy() for t in (left, right))
    sa, sb = (shingle_sets(t.column("text").combine_chunks()) for t in (left, right))
    n = np.array([len(x) for x in sb], np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k, both in enumerate(shared(sa, sb)):
        hit = np.flatnonzero((both >= LEAST * (len(sa[k]) + n - both)) & (rb != ra[k]))
        out.append((np.full(len(hit), a[k]), b[hit]))
    x, y = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [])))
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def near_groups(docs: DataFrame) -> DataFrame:
    """doc, row, head_doc and head_row (the first row of the group in order of id and row) of every distinct row."""
    rows = durable(signatures(docs))
    # a node is a set of shingles, named by its first row
    first = rows.groupBy("digest").agg(F.min(F.struct("doc", "row", "size", "fp", "bands")).alias("n"))
    nodes = durable(first.select("digest", "n.doc", F.col("n.row").alias("rep"), "n.size", "n.fp", "n.bands"))
    sizes = lambda x, y: F.least(x, y) >= LEAST * F.greatest(x, y)  # noqa: E731  others cannot reach the similarity

    banded = nodes.select("rep", "doc", "size", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min(F.struct("doc", "rep", "size")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    banded = durable(banded.join(heads, "band"))
    stars = banded.where((F.col("rep") != F.col("head.rep")) & sizes(F.col("size"), F.col("head.size"))).select(F.col("rep").alias("a"), F.col("head.rep").alias("b"))
    pairs = durable(stars.union(links(nodes.select("rep", "fp"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = banded.select("rep").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = durable(named(docs).select(F.col("row").alias("rep"), "text").join(wanted, "rep", "left_semi").dropDuplicates(["rep"]))
    linked = durable(alike(pairs, texts))

    roots = components(linked).toDF("rep", "root")
    grouped = banded.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")).select("band", "rep", "size", "root", F.col("head.rep").alias("head"))
    head_root = grouped.where("rep = head").select("band", F.col("root").alias("head_root"))
    outside = F.col("root") != F.col("head_root")
    grouped = durable(grouped.join(head_root, "band").select("band", "rep", "size", "root", outside.alias("outside")))
    number = lambda total: F.ceil(total / F.lit(CHUNK)).cast("int")
    mixed = grouped.groupBy("band").agg(number(F.sum("size")).alias("all"), number(F.sum(F.when(F.col("outside"), F.col("size")))).alias("out")).where("out > 0")
    members = grouped.join(mixed, "band").join(texts, "rep")
    chunk = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = members.where("outside").select("band", chunk("out").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), "rep", "root", "text")
    right = members.select("band", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("i"), chunk("all").alias("j"), "rep", "root", "text")
    right = right.toDF("its_band", "its_i", "its_j", "rep", "root", "text")
    rest = durable(left.groupBy("band", "i", "j").cogroup(right.groupBy("its_band", "its_i", "its_j")).applyInArrow(_across, "a long, b long"))
    found = components(linked.union(rest)).toDF("rep", "root")

    named_nodes = durable(nodes.select("digest", "doc", "rep").join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    top = named_nodes.groupBy("root").agg(F.min(F.struct("doc", "rep")).alias("head"))
    by_digest = named_nodes.join(top, "root").select("digest", F.col("head.doc").alias("head_doc"), F.col("head.rep").alias("head_row"))
    return rows.select("doc", "row", "digest").distinct().join(by_digest, "digest").drop("digest")

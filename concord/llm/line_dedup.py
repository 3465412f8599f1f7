"""Operator 3: removal of repeated lines or paragraphs, with original offsets.

A unit of kind ``line`` ends at a line break or at the end of a sentence
(``.``, ``!`` or ``?`` and blanks), one of kind ``paragraph`` at an empty
line; units and their ends make up the whole text. Units are normalised
(letters and digits, lower case), digested to 128 bits, and grouped over all
documents. The occurrence with the smallest place (document's rank, row,
number of the unit) stays; all others are removed. Offsets are in characters
of the original.

1. Scan tasks work on blocks of about ``BLOCK_BYTES``. Of equal units of a
   block only the first is shuffled, the others are repeats already, so a
   unit that is in every document is one row a block.
2. Units are dealt by digest and sorted; all but the first of a digest are
   repeats. Tasks read the sorted rows as a stream and hold no group.
3. The repeats of a row meet again with its count of units.

Edge cases: null text is empty and has no units; units without a letter or
digit are never removed; a row owns its units, so null and repeated ids do
not mix texts (null ranks last, equal ids by a hash of the row); rows equal
in id and text are one document, each reported alike; empty tables give no
rows; columns of any name are kept by ``dedup_lines``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import named, table
from concord.llm.kernels import chunks

MIN_WORDS = 1
BLOCK_BYTES = 16 << 20
ENDS = {"line": re.compile(r"\n|[.!?]+[ \t]+"), "paragraph": re.compile(r"\n(?:[ \t]*\n)+")}
OTHER = regex.compile(r"[^\p{L}\p{N}]+")

SPAN = "struct<pos: int, start: long, end: long, words: int>"
FOUND = f"h1 long, h2 long, doc long, row long, doc_id long, n_units long, spans array<{SPAN}>"
_SPAN = pa.struct([("pos", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int32())])


def units_of(text: str, unit: str = "line") -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of every unit."""
    at = [0, *(m.end() for m in ENDS[unit].finditer(text))]
    if at[-1] < len(text):
        at.append(len(text))
    return [(a, b, OTHER.sub(" ", text[a:b].lower()).strip()) for a, b in zip(at, at[1:])]


def _batch(h, doc, row, doc_id, n_units, spans) -> pa.RecordBatch:
    h1, h2 = (pa.array(h[:, k], pa.int64()) if h is not None else pa.nulls(len(doc), pa.int64()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([h1, h2, pa.array(doc, pa.int64()), pa.array(row, pa.int64()), doc_id, n_units, spans], [x.split()[0] for x in FOUND.split(", ")[:6]] + ["spans"])


def _lists(sizes: np.ndarray, columns: list[np.ndarray]) -> pa.ListArray:
    kinds = [f.type for f in _SPAN]
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in _SPAN])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _block_rows(unit: str, min_words: int):
    """Of each block: a row for each document (its units and repeats within the block), and the first unit of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, digests, owner, spans, size = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, row, doc_id, n_units = (list(x) for x in zip(*docs, strict=True))
            d, r = np.array(doc, np.int64), np.array(row, np.int64)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            o = np.array(owner, np.int64)
            s = np.array(spans, np.int64).reshape(-1, 4)
            order = np.lexsort((s[:, 0], r[o], d[o], h[:, 1], h[:, 0]))
            h, o, s = h[order], o[order], s[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]).any(axis=1)
            head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            again = (d[o] != d[o[head]]) | (r[o] != r[o[head]]) | (s[:, 0] != s[head, 0])
            mine = np.flatnonzero(again)
            mine = mine[np.lexsort((s[mine, 0], o[mine]))]
            # every document, with the repeats that are known already
            yield _batch(None, d, r, pa.array(doc_id, pa.int64()), pa.array(n_units, pa.int64()), _lists(np.bincount(o[mine], minlength=len(d)), list(s[mine].T)))
            for a in range(0, int(first.sum()), 1 << 16):
                at = np.flatnonzero(first)[a : a + (1 << 16)]
                yield _batch(h[at], d[o[at]], r[o[at]], pa.array([doc_id[k] for k in o[at]], pa.int64()), pa.nulls(len(at), pa.int64()), _lists(np.ones(len(at), int), list(s[at].T)))

        for batch in chunks(batches, limit=BLOCK_BYTES):
            for doc, row, text, doc_id in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                found = units_of(text or "", unit)
                for k, (a, b, norm) in enumerate(found):
                    if norm and (n := norm.count(" ") + 1) >= min_words:
                        digests.append(xxhash.xxh128_digest(norm))
                        owner.append(len(docs))
                        spans.append((k, a, b, n))
                docs.append((doc, row, doc_id, len(found)))
                size += len(text or "")
            if size >= BLOCK_BYTES:
                yield from flush()
                docs, digests, owner, spans, size = [], [], [], [], 0
        if docs:
            yield from flush()

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are, and of the sorted units all but the first of a digest."""
    head = None  # (h1, h2, doc, row, pos) of the running digest's first unit
    for batch in batches:
        is_doc = batch.column(0).is_null()
        if is_doc.true_count:
            yield batch.filter(is_doc)
        batch = batch.filter(pa.compute.invert(is_doc))
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2, 3)] + [batch.column(6).flatten().field(0).to_numpy().astype(np.int64)], axis=1)
        if head is not None:
            keys = np.concatenate([head[None], keys])
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:, :2] != keys[:-1, :2]).any(axis=1)
        at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
        again = (keys[:, 2:] != keys[at, 2:]).any(axis=1)
        yield batch.filter(pa.array(again[len(keys) - batch.num_rows :]))
        head = keys[at[-1]]


REPORT = "doc long, row long, doc_id long, times long, n_units long, n_removed long, removed_words long, removed_chars long, longest_run long, removed string, starts array<long>, ends array<long>"


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The figures of each row's repeats, put in order."""
    for batch in batches:
        lists = batch.column(5)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        pos, start, end, words = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
        order = np.lexsort((pos, owner))
        owner, pos, start, end, words = (x[order] for x in (owner, pos, start, end, words))
        new = np.ones(len(pos), bool)  # equal rows report the same repeats
        new[1:] = (owner[1:] != owner[:-1]) | (pos[1:] != pos[:-1])
        owner, pos, start, end, words = (x[new] for x in (owner, pos, start, end, words))
        sizes = np.bincount(owner, minlength=len(lists))
        longest = np.zeros(len(lists), np.int64)
        if len(pos):
            head = np.ones(len(pos), bool)
            head[1:] = (owner[1:] != owner[:-1]) | (pos[1:] != pos[:-1] + 1)
            runs = np.flatnonzero(head)
            np.maximum.at(longest, owner[runs], np.add.reduceat(words, runs))
        sums = lambda x: pa.array(np.bincount(owner, x, len(lists)).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        named = [f"{a}-{b}" for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        texts = [",".join(named[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        made = [pa.array(sizes.astype(np.int64)), sums(words), sums(end - start), pa.array(longest), pa.array(texts, pa.string()), *(pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (start, end))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], [x.split()[0] for x in REPORT.split(", ")])


def repeated(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """REPORT of every distinct row; times: the number of rows equal to it."""
    found = named(docs).mapInArrow(_block_rows(unit, min_words), FOUND)
    # rows of documents have no digest; they are dealt by their own hash
    deal = [F.coalesce("h1", "row"), F.coalesce("h2", F.lit(0))]
    found = found.repartition(*deal).sortWithinPartitions("h1", "h2", "doc", "row", F.get("spans", F.lit(0))["pos"]).mapInArrow(_repeats, FOUND)
    gathered = found.groupBy("doc", "row").agg(F.max("doc_id").alias("doc_id"), F.count("n_units").alias("times"), F.max("n_units").alias("n_units"), F.flatten(F.collect_list("spans")).alias("spans"))  # at most the document's own
    return gathered.mapInArrow(_figures, REPORT)


def dedup_report(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Of every row: doc_id, n_units, n_removed, removed_words, removed_chars, longest_run (words of the longest run of removed neighbours) and removed ("start-end" of each removed unit)."""
    found = repeated(docs, unit, min_words).select("doc_id", "n_units", "n_removed", "removed_words", "removed_chars", "longest_run", "removed", "times")
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("times", "copy")


def dedup_lines(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated units removed from their texts; all other columns stay."""
    gone = repeated(docs, unit, min_words).where("n_removed > 0").select("doc", "row", F.struct("starts", "ends").alias("_gone"))
    rows = named(docs.select("doc_id", "text", F.struct("*").alias("_row")), "_row").drop("text", "doc_id").join(gone, ["doc", "row"], "left")
    # the stretches between the removed units
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("_gone.ends"))
    ends = F.concat(F.col("_gone.starts"), F.array(F.length("_row.text").cast("long")))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.call_function("substring", F.col("_row.text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(left)
    return rows.select(*[(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op3(spark, sf_dir):
    return dedup_report(table(spark, sf_dir, "documents"))


ORACLE = """
WITH u AS (SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) AS pos
           FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\\n|[.!?]+[ \\t]+)', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)),
v AS (SELECT * FROM u WHERE unit <> ''),
n AS (SELECT doc_id, pos, length(unit) AS len, trim(regexp_replace(lower(unit), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm,
             coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM v),
r AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words,
             norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS gone FROM n),
g AS (SELECT doc_id, sum(words) AS run FROM (SELECT doc_id, words, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM r WHERE gone) GROUP BY doc_id, island),
b AS (SELECT doc_id, max(run) AS longest_run FROM g GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(words) FILTER (gone), 0)::BIGINT AS removed_words, coalesce(sum(len) FILTER (gone), 0)::BIGINT AS removed_chars,
             coalesce(string_agg(start::BIGINT || '-' || (start + len)::BIGINT, ',' ORDER BY start) FILTER (gone), '') AS removed FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_words, 0) AS removed_words, coalesce(removed_chars, 0) AS removed_chars,
       coalesce(longest_run, 0)::BIGINT AS longest_run, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN b ON d.doc_id = b.doc_id
"""

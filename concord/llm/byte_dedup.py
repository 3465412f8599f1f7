"""Operator 9: removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``MATCH`` bytes over it also starts earlier, in a
document with a smaller id or before it in its own.

Every window of MATCH bytes has an anchor: the ``GRAM`` bytes in it with the
smallest hash. Equal windows have equal anchors, so windows meet under their
anchor's hash. Consecutive windows with one anchor make a context, about one
in 37 bytes.

1. Scan tasks work on blocks of about ``BLOCK_BYTES``. Of equal contexts in
   a block only the first is shuffled; the others are repeats already.
2. Contexts are dealt by anchor, sorted and read as a stream. Of equal
   contexts all but the first repeat (they are equal under two 64-bit hashes,
   of the anchor and of the whole context). An anchor with a single different
   context is done.
3. The bytes of the other contexts, which share an anchor but not all their
   bytes, are cut from the texts and dealt by anchor again. Their windows are
   put in suffix order with the common prefixes of neighbours. From each
   suffix the previous and the next smaller place in that order are found; the
   longer of the common prefixes with these two is its longest previous
   factor. A window whose factor reaches MATCH bytes repeats.
4. A document's repeats are merged and taken out of its bytes.

No anchor is held whole beyond ``MOST`` contexts: the windows of an anchor
with more are dealt one by one by their own hash, and the first place of each
stays. Anchors that are frequent in blocks (the edge of a passage that many
documents hold) are found before step 1 and their windows dealt like that at
once, so that they do not meet in one task.

Edge cases: null is the empty text; a row owns its spans, so null and
repeated ids do not mix texts: ids rank the rows (null last), equal ids by a
hash of the row; rows equal in id and text are one document (their places
coincide); empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import durable, named, parts, table, text_size
from concord.llm.kernels import BYTE_CODE, U64, chunks, mix, powers, prefix_hash, span_hash, text_bytes

MATCH, GRAM = 100, 28
BLOCK_BYTES = 16 << 20
OFTEN = 8  # contexts of one anchor in a block, from which a block reports the anchor
PIECE = 4 << 20  # bytes of one text that are looked at at once
GROUP_BYTES = 1 << 19  # context bytes that are put in suffix order at once
MOST = 2048  # contexts of one anchor that are put in suffix order


def contexts(data: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, text number, start in the text, windows) of each context."""
    wide = MATCH - GRAM + 1
    if len(data) < MATCH:
        return (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    prefix = prefix_hash(BYTE_CODE[data])
    down = powers(len(prefix))[1]
    gram = mix((prefix[GRAM:] - prefix[: len(data) - GRAM + 1]) * down[: len(data) - GRAM + 1])
    low = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)  # ties go to the left
    size = 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    anchor = (low & U64(0xFFFFFFFF)).astype(np.int64)  # of the window at each place
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    place = np.arange(len(anchor))
    valid = place + MATCH <= at[1:][doc]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new & valid)
    stop = new | ~valid
    ends = np.append(np.flatnonzero(stop), len(anchor))
    n = ends[np.searchsorted(ends, start, "right")] - start
    h = gram[anchor[start]]
    if len(hot):
        often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        each = n[often]
        first = np.cumsum(each) - each
        single = np.repeat(start[often], each) + np.arange(each.sum()) - np.repeat(first, each)
        g = span_hash(prefix, single, single + MATCH)
        start, h, n = np.concatenate([start[~often], single]), np.concatenate([h[~often], mix(g + np.repeat(h[often], each))]), np.concatenate([n[~often], np.ones(len(single), np.int64)])
    g = span_hash(prefix, start, start + n + MATCH - 1)
    return h, g, doc[start], start - at[doc[start]], n


def _blocks(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Contexts of about BLOCK_BYTES of text: h, g, doc, row, start, windows, sorted by these; and which are the first of equal ones."""
    held, size = [], 0

    def flush():
        nonlocal size
        h, g, doc, row, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        size = 0
        order = np.lexsort((s, row, doc, g, h))
        h, g, doc, row, s, n = (x[order] for x in (h, g, doc, row, s, n))
        return h, g, doc, row, s, n, _starts(h, g)

    for batch in chunks(batches):
        data, at = text_bytes(batch.column(2))
        doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # a long text goes piece by piece; every window lies in one of them
        for low in range(0, max(len(data), 1), PIECE) if len(at) == 2 else (0,):
            part = data[low : low + PIECE + MATCH - 1] if len(at) == 2 else data
            h, g, owner, s, n = contexts(part, np.array([0, len(part)]) if len(at) == 2 else at, hot)
            held.append((h, g, doc[owner], row[owner], s + low, n))
            size += len(part)
            if size >= BLOCK_BYTES:
                yield flush()
    if held:
        yield flush()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _again(first: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Rows that stand at another place than the first row of their run."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return ~first & np.logical_or.reduce([p != p[head] for p in place])


def _merged(doc: np.ndarray, row: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that touch or overlap, as one; a length has 16 bits."""
    order = np.lexsort((s, row, doc))
    doc, row, s, n = doc[order], row[order], s[order], n[order]
    if not len(doc):
        return doc, row, s, n
    end = s + n
    new = _starts(doc, row)
    new[1:] |= (s[1:] > end[:-1]) | (s[1:] >> 15 != s[:-1] >> 15)
    start = np.flatnonzero(new)
    return doc[start], row[start], s[start], np.maximum.reduceat(end, start) - s[start]


def often_anchors(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors that blocks hold often; see the module.

    Blocks report anchors with OFTEN or more different contexts, and an
    anchor is taken from OFTEN times the number of blocks on, so there are at
    most a block's contexts / OFTEN of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, _, _, _, _, first in _blocks(batches, np.zeros(0, U64)):
            anchor, count = np.unique(h[first], return_counts=True)
            keep = count >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(np.append(anchor[keep].view(np.int64), 0)), pa.array(np.append(count[keep], 0)), pa.array(np.append(np.zeros(keep.sum(), np.int64), 1))], ["h", "n", "blocks"])

    found = durable(docs.mapInArrow(run, "h long, n long, blocks long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")))
    blocks = found.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    rows = found.where((F.col("n") >= max(1, blocks) * OFTEN)).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(U64))


SPANS = "doc long, row long, at long, h long"  # at: start << 16 | length; h: the anchor of a context to compare, or null for a repeat


def _spans(doc, row, s, n, h=None) -> pa.RecordBatch:
    many = pa.array(h.view(np.int64)) if h is not None else pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array((s << 16) | n), many], ["doc", "row", "at", "h"])


def _first_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted contexts: repeats, and the first of each where its anchor has several. Holds one batch and one row."""
    kept, told = None, False  # the first row of the running context, and whether it has been given out

    for batch in batches:
        lone = batch.column(1).is_null()
        alone = batch.filter(lone)
        if alone.num_rows:
            yield pa.RecordBatch.from_arrays([alone.column(2), alone.column(3), alone.column(4), pa.nulls(alone.num_rows, pa.int64())], ["doc", "row", "at", "h"])
        batch = batch.filter(pa.compute.invert(lone))
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        more = kept is not None
        if more:
            rows = np.concatenate([kept[:, None], rows], axis=1)
        h, g, doc, row, at = rows
        first = _starts(h, g)
        again = _again(first, doc, row, at >> 16)
        heads = np.flatnonzero(first)
        near = h[heads][1:] == h[heads][:-1]
        several = np.append(near, False) | np.append(False, near)
        if more:  # an earlier context of its anchor may have shown that there are several
            several[0] &= not told
        yield _spans(doc[again], row[again], at[again] >> 16, at[again] & 0xFFFF)
        c = heads[several]
        yield _spans(doc[c], row[c], at[c] >> 16, at[c] & 0xFFFF, h[c])
        told = bool(several[-1]) or (more and len(heads) == 1 and told)
        kept = rows[:, heads[-1]]


def split_contexts(docs: DataFrame, hot: np.ndarray, tasks: int) -> DataFrame:
    """SPANS of all repeats that equal contexts show, and of the contexts to compare."""

    def first_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, g, doc, row, s, n, first in _blocks(batches, hot):
            again = _again(first, doc, row, s)
            d, r, at, many = _merged(doc[again], row[again], s[again], n[again])
            # repeats have no g; their h only deals them evenly
            h = np.concatenate([h[first], mix(at.view(U64) ^ mix(r.view(U64)))])
            g = pa.array(np.concatenate([g[first], np.zeros(len(d), U64)]).view(np.int64), mask=np.arange(len(h)) >= first.sum())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), g, pa.array(np.concatenate([doc[first], d])), pa.array(np.concatenate([row[first], r])), pa.array(np.concatenate([(s[first] << 16) | n[first], (at << 16) | many]))], ["h", "g", "doc", "row", "at"])

    found = docs.mapInArrow(first_of_block, "h long, g long, doc long, row long, at long")
    return found.repartition(tasks, "h").sortWithinPartitions("h", "g", "doc", "row", "at").mapInArrow(_first_of_all, SPANS)


def common_with_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Along the suffix order: the common prefix of each suffix with the previous one at a smaller place, 0 without one.

    common[i] is that of suffixes i - 1 and i. Pointers jump over larger
    places in rounds, with the least common prefix on their way.
    """
    at, low = np.arange(len(place)) - 1, common.copy()
    todo = np.arange(len(place))
    while True:
        todo = todo[at[todo] >= 0]
        todo = todo[place[at[todo]] >= place[todo]]
        if not len(todo):
            break
        over = at[todo]
        low[todo], at[todo] = np.minimum(low[todo], low[over]), at[over]
    return np.where(at >= 0, low, 0)


def longest_previous_factors(suffixes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest previous factor, up to the suffixes' width, of each; suffixes: rows of bytes in order, place: their places."""
    common = np.zeros(len(suffixes) + 1, np.int64)  # of neighbours
    differ = suffixes[1:] != suffixes[:-1]
    common[1:-1] = np.where(differ.any(axis=1), differ.argmax(axis=1), suffixes.shape[1])
    previous = common_with_smaller(place, common[:-1])
    following = common_with_smaller(place[::-1], common[::-1][:-1])[::-1]
    return np.maximum(previous, following)


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts and lone windows, sorted by h: the windows that repeat."""
    held, size, kept = [], 0, None

    def resolve(t: pa.Table) -> pa.RecordBatch:
        h, doc, row, s = (t.column(i).to_numpy() for i in range(4))
        joined = t.column("bytes").combine_chunks()
        data, at = np.frombuffer(joined.buffers()[2], np.uint8), np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
        many = np.diff(at) - MATCH + 1
        owner = np.repeat(np.arange(len(h)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        key = np.empty((len(owner), MATCH + 8), np.uint8)  # the anchor, then the suffix
        key[:, :8] = h[owner].astype(">i8").view(np.uint8).reshape(-1, 8)
        key[:, 8:] = np.lib.stride_tricks.sliding_window_view(data, MATCH)[at[:-1][owner] + within]
        doc, row, s = doc[owner], row[owner], s[owner] + within
        order = np.lexsort((s, row, doc))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(_starts(doc[order], row[order], s[order]))
        order = order[np.argsort(key.view(f"S{MATCH + 8}")[order, 0], kind="stable")]
        again = order[longest_previous_factors(key[order], place[order]) == MATCH + 8]  # the anchor's 8 bytes agree too
        return _spans(*_merged(doc[again], row[again], s[again], np.ones(len(again), np.int64)))

    for batch in batches:
        alone = batch.column(4).is_null()
        if alone.true_count:  # windows of anchors with over MOST contexts: a stream, of which the first of each stays
            rows = np.stack([c.to_numpy() for c in batch.filter(alone).columns[:4]])
            more = kept is not None
            rows = np.concatenate([kept[:, None], rows], axis=1) if more else rows
            first = _starts(rows[0])
            again = _again(first, *rows[1:])
            yield _spans(*_merged(*rows[1:, again], np.ones(int(again.sum()), np.int64)))
            kept = rows[:, np.flatnonzero(first)[-1]]
            batch = batch.filter(pa.compute.invert(alone))
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(4).nbytes
        if size < GROUP_BYTES:
            continue
        t = pa.Table.from_batches(held)
        h = t.column("h").to_numpy()
        end = int(np.searchsorted(h, h[-1]))
        held, size = t.slice(end).combine_chunks().to_batches(), t.slice(end).nbytes
        start = 0
        while start < end:  # whole anchors, about GROUP_BYTES at a time
            stop = max(int(np.searchsorted(h, h[start], "right")), min(end, start + GROUP_BYTES // (MATCH + 35)))
            stop = min(end, int(np.searchsorted(h, h[stop - 1], "right")))
            yield resolve(t.slice(start, stop - start))
            start = stop
    if held:
        yield resolve(pa.Table.from_batches(held))


def compare_contexts(texts: DataFrame, spans: DataFrame, tasks: int) -> DataFrame:
    """SPANS of the repeats among contexts that share an anchor, by longest previous factors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc", "row", "s", "bytes"]
        for batch in batches:
            for doc, row, text, todo in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = (text or "").encode()
                few = [x for x in todo if not x["many"]]
                starts = [x["at"] >> 16 for x in few]
                rows = [data[s : s + (x["at"] & 0xFFFF) + MATCH - 1] for s, x in zip(starts, few, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x["h"] for x in few], pa.int64()), pa.array([doc] * len(rows), pa.int64()), pa.array([row] * len(rows), pa.int64()), pa.array(starts, pa.int64()), pa.array(rows, pa.binary())], names)
                if len(few) == len(todo):
                    continue
                prefix = prefix_hash(BYTE_CODE[np.frombuffer(data, np.uint8)])
                for x in todo:
                    if x["many"]:
                        s = (x["at"] >> 16) + np.arange(x["at"] & 0xFFFF)
                        h = mix(span_hash(prefix, s, s + MATCH) + np.array([x["h"]]).view(U64))
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), row)), pa.array(s), pa.nulls(len(s), pa.binary())], names)

    todo = spans.where("h IS NOT NULL")
    big = todo.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("h", F.lit(True).alias("many"))
    todo = todo.join(big, "h", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    todo = todo.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "h", "many")).alias("todo"))  # at most the document's own
    # the same columns of the texts as in report(), so that one exchange of them serves both
    pieces = texts.join(todo, ["doc", "row"]).select("doc", "row", "text", "todo", "doc_id").mapInArrow(cut, "h long, doc long, row long, s long, bytes binary")
    return pieces.repartition(tasks, "h").sortWithinPartitions("h", "doc", "row", "s").mapInArrow(_factors, SPANS)


def remaining(data: bytes, spans: list[int]) -> tuple[list[tuple[int, int]], bytes]:
    """Merged removed runs, and the bytes that stay."""
    runs: list[list[int]] = []
    for x in sorted(spans):
        s, e = x >> 16, min((x >> 16) + (x & 0xFFFF) + MATCH - 1, len(data))
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        elif s < e:
            runs.append([s, e])
    edges = [0, *(x for r in runs for x in r), len(data)]
    return [(s, e) for s, e in runs], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts by doc and row, and doc and row with the list of their repeats (as in SPANS)."""
    texts = named(docs)
    tasks = parts(text_size(docs))
    spans = durable(split_contexts(texts, often_anchors(texts), tasks))
    repeats = spans.where("h IS NULL").select("doc", "row", "at").union(compare_contexts(texts, spans, tasks).select("doc", "row", "at"))
    return texts, repeats.groupBy("doc", "row").agg(F.collect_list("at").alias("spans"))  # at most the document's own bytes


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                runs, kept = remaining(data, spans or [])
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts, spans = repeated_spans(docs)
    return texts.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans", "doc", "row").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))

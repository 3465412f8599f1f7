"""Operator 13: runs of repeated words by Crochemore's partition refinement.

A run is a stretch of consecutive words with smallest period q, `exponent`
times q words or more and `least` words or more, that no neighbouring word
extends. ``find_runs`` gives every text's runs and the text without the
repeats: a word goes if any run holds it after that run's first q words.

Positions of equal factors of length 1, 2, 3, ... form classes. The classes of
one length are refined to the next by looking, for each class that was split
off last, at the positions before its members; of the parts of a class the
largest is left out, so that a position is looked at only as often as the class
it is in halves. Neighbouring members of a class at a distance of the factor
length are squares of a primitive root, and the squares of one period at
consecutive places are one run. All documents of a bounded batch are refined
together in numpy; nothing is shuffled.

A word of a run of e periods occurs e times in it, so words that are rarer in
their document end a stretch; stretches are cut again until none changes, and
only what is left is refined. That loses no run.

Edge cases: null and empty texts have no runs and an empty rest; words are
compared exactly, as they are written; ties, repeated rows and null doc_ids
need no rule, as every row stands alone; an empty table gives no rows; other
columns are dropped. A text larger than a batch is a batch of its own, with
some 100 bytes of memory for each of its words that stay in a stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import documents
from concord.llm.kernels import chunks

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def stretches(codes: np.ndarray, doc: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each place) of the words that can be in a run: each occurs `exponent` times in its stretch, and stretches have `least` words."""
    at, part = np.arange(len(codes)), doc
    while len(at):
        key = part.astype(np.int64) * (int(codes.max()) + 1) + codes[at]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[inverse] >= exponent
        new = np.ones(len(at), bool)  # where a stretch begins, among the kept
        new[1:] = (part[1:] != part[:-1]) | ~keep[:-1] | ~keep[1:]
        label = np.cumsum(new)
        size = np.bincount(label[keep], minlength=label[-1] + 1)
        keep &= size[label] >= least
        if keep.all() and label[-1] == len(np.unique(part)):
            return at, label
        at, part = at[keep], label[keep]
    return at, part


class Classes:
    """Classes of positions by the factor of a length that starts there, for texts that each end in a position of its own class.

    A class is a segment of `order` and a linked list by place, so that taking
    members out costs as much as there are members taken out.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        sorted_codes = codes[self.order]
        head = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
        self.place = np.empty(n, np.int32)
        self.place[self.order] = np.arange(n, dtype=np.int32)
        self.n_classes = len(head)
        self.first = np.zeros(2 * n + 1, np.int32)  # a class's segment of order
        self.size = np.zeros(2 * n + 1, np.int32)
        self.first[: len(head)], self.size[: len(head)] = head, np.diff(np.r_[head, n])
        self.of = np.empty(n, np.int32)
        self.of[self.order] = np.repeat(np.arange(len(head), dtype=np.int32), self.size[: len(head)])
        self.next = np.full(n, -1, np.int32)
        self.before = np.full(n, -1, np.int32)
        same = self.of[self.order[1:]] == self.of[self.order[:-1]]
        self.next[self.order[:-1][same]] = self.order[1:][same]
        self.before[self.order[1:][same]] = self.order[:-1][same]
        self.taken = np.zeros(n, bool)  # scratch
        self.since = np.ones(n, np.int32)  # from which factor length a position has its next one
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []  # places and periods

    def _link(self, a: np.ndarray, b: np.ndarray, length: int) -> None:
        """b becomes the next member after a; what a's distance was until this length tells whether a square stood there."""
        gap = self.next[a] - a
        found = (self.next[a] >= 0) & (self.since[a] <= gap) & (gap < length)
        self.squares.append((a[found], gap[found]))
        self.next[a] = b
        self.since[a] = length

    def refine(self, small: np.ndarray, length: int) -> np.ndarray:
        """From factors of length - 1 to `length`: `small` are the members of the classes split off last; gives those of the classes split off now."""
        p = small[small > 0] - 1
        p = p[self.size[self.of[p]] > 1]
        if not len(p):
            return p
        old, successor = self.of[p], self.of[p + 1]
        by = np.lexsort((p, successor, old))
        p, old, successor = p[by], old[by], successor[by]
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_group = new_old | np.r_[True, successor[1:] != successor[:-1]]
        head = np.flatnonzero(new_group)
        size = np.diff(np.r_[head, len(p)])
        whole = size == self.size[old[head]]  # no split: all members go the same way
        if whole.any():
            stay = ~np.repeat(whole, size)
            p, old, new_old, new_group = p[stay], old[stay], new_old[stay], new_group[stay]
            if not len(p):
                return p
            head = np.flatnonzero(new_group)
            size = np.diff(np.r_[head, len(p)])
        start = np.flatnonzero(new_old)  # of each class that is split
        klass, moved = old[start], np.diff(np.r_[start, len(p)])

        # the moved members leave their lists: a chain of neighbours closes at both ends
        by = np.lexsort((p, old))
        q, q_old = p[by], old[by]
        after = self.next[q]
        chain = np.r_[True, (q[1:] != after[:-1]) | (q_old[1:] != q_old[:-1])]
        left, right = self.before[q[chain]], after[np.r_[np.flatnonzero(chain)[1:] - 1, len(q) - 1]]
        has_left, has_right = left >= 0, right >= 0
        self._link(left[has_left], right[has_left], length)
        self.before[right[has_right]] = left[has_right]
        following = np.r_[p[1:], -1].astype(np.int32)
        following[np.r_[head[1:] - 1, len(p) - 1]] = -1
        self._link(p, following, length)
        self.before[p] = np.where(new_group, -1, np.r_[-1, p[:-1]])

        # they take the head of their class's segment, in exchange for the members that stand there
        slot = np.repeat(self.first[klass] - start, moved) + np.arange(len(p), dtype=np.int32)
        limit = np.repeat(self.first[klass] + moved, moved)
        there = self.order[slot]
        was = self.place[p]
        self.taken[was] = True
        leaving = ~self.taken[slot]
        self.taken[was] = False
        free = was[was >= limit]
        stayers = there[leaving]
        self.order[free], self.place[stayers] = stayers, free
        self.order[slot], self.place[p] = p, slot

        # classes of the groups; the rest keeps the old one
        made = self.n_classes + np.arange(len(head), dtype=np.int32)
        self.n_classes += len(head)
        self.of[p] = np.repeat(made, size)
        self.first[made], self.size[made] = slot[head], size
        self.first[klass] += moved
        self.size[klass] -= moved

        # all parts but the largest of each class go on
        parent = np.repeat(np.arange(len(start)), np.diff(np.r_[np.searchsorted(head, start), len(head)]))
        best = np.lexsort((-size, parent))
        largest = best[np.r_[True, parent[best][1:] != parent[best][:-1]]]
        rest_is_larger = self.size[klass] >= size[largest]
        drop = np.zeros(len(head), bool)
        drop[largest[~rest_is_larger]] = True
        out = [p[~np.repeat(drop, size)]]
        rest = klass[~rest_is_larger & (self.size[klass] > 0)]
        if len(rest):
            n = self.size[rest]
            out.append(self.order[np.repeat(self.first[rest] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
        return np.concatenate(out).astype(np.int32)

    def finish(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, periods) of all squares of primitive roots with a period of at most `length`."""
        gap = self.next - np.arange(len(self.next), dtype=np.int32)
        found = (self.next >= 0) & (self.since <= gap) & (gap <= length)
        self.squares.append((np.flatnonzero(found), gap[found]))
        return tuple(np.concatenate(x) for x in zip(*self.squares, strict=True))


def runs_of(codes: np.ndarray, doc: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run in a row of words; runs do not cross documents. Places number the row."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(codes):
        return none
    at, part = stretches(codes, doc, exponent, least)
    if not len(at):
        return none
    # each stretch ends in a position of its own class
    new = np.r_[True, part[1:] != part[:-1]]
    slot = np.arange(len(at)) + np.cumsum(new) - 1
    row = np.full(slot[-1] + 2, -1, np.int64)
    row[slot] = codes[at]
    ends = np.flatnonzero(row < 0)
    row[ends] = codes.max() + 1 + np.arange(len(ends))
    classes = Classes(row)
    longest = int(np.diff(np.r_[-1, ends]).max()) // exponent
    small = np.arange(len(row), dtype=np.int32)
    length = 1
    while len(small) and length < longest:
        length += 1
        small = classes.refine(small, length)
    place, period = classes.finish(max(length, longest))
    by = np.lexsort((place, period))
    place, period = place[by].astype(np.int64), period[by].astype(np.int64)
    if not len(place):
        return none
    new = np.r_[True, (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(place)] - 1
    period = period[head]
    length = place[tail] - place[head] + 2 * period
    keep = length >= np.maximum(least, exponent * period)
    back = np.full(len(row), -1, np.int64)
    back[slot] = at
    start, length, period = back[place[head]][keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, batch_bytes: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, runs by start and period, and the collapsed text of every row; see the module."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=batch_bytes):
            words = [WORD.findall(x or "") for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in words])
            first = np.r_[0, np.cumsum(sizes)]
            flat = pa.chunked_array([pa.array(x, pa.string()) for x in words]).combine_chunks() if first[-1] else pa.array([], pa.string())
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if first[-1] else np.zeros(0, np.int64)
            start, length, period = runs_of(codes, np.repeat(np.arange(len(words)), sizes), exponent, least)
            of = np.searchsorted(first, start, "right") - 1
            edge = np.zeros(first[-1] + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            text = [" ".join(x) for x in words]
            for d in np.unique(of).tolist():
                kept = np.flatnonzero(~gone[first[d] : first[d + 1]])
                text[d] = " ".join(map(words[d].__getitem__, kept.tolist()))
            entries = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            offsets = pa.array(np.searchsorted(of, np.arange(len(words) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, entries), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return documents(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents of the contract: where h = crc32(doc_id) ends in 0, the words from a on repeat the p words at a."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    n, a, p = F.size("_words"), F.col("_a"), F.col("_p")
    planted = F.transform("_words", lambda x, i: F.when(i < a, x).otherwise(F.get("_words", a + (i - a) % p)))
    docs = documents(docs).withColumn("_words", F.when((h % 10 == 0) & F.col("text").isNotNull(), words))
    docs = docs.withColumn("_a", F.when(n > 0, (g % n).cast("int"))).withColumn("_p", F.when(n > 0, (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")))
    return docs.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op13(spark, sf_dir):
    from concord.llm.common import table

    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    rank = F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period))
    best = F.array_max(rank)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    start, length, period = -best["col2"], best["length"], -best["col3"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

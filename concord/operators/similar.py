"""Exact similarity join of short strings by blocks of pairs (J-16).

The ratio of two strings is 2 M / (la + lb) with M characters in common order,
so a ratio over `least` bounds the characters that only one of them has: `gone`
and `new`. A string of `a` belongs to one class of lengths, a string of `b`
visits each class that it can reach; both are dealt there into cells of bounded
size, and each pair of cells is one group, so every pair of strings whose
lengths allow the ratio meets exactly once. In a group

* small bitmaps of the letters, counted, bound all its pairs at once: no more than
  `gone` letters of one are missing in the other,
* the pairs that pass are bounded by larger bitmaps of 4-grams: a deleted character
  spoils four at most, an inserted one three, and what stays is shifted by no
  more than `gone` back and `new` ahead, so longer strings are held block by
  block against windows of the other,
* those that pass are bounded by the same 4-grams almost without collisions,
* then by their common length, first from the beginning of one string and then
  whole, all that are left for one string at once,
* and what is left is compared exactly.

None of these loses a pair. A string is shuffled once for each cell that it meets,
not once for each of its substrings; its bitmaps are made in the groups.
"""

from __future__ import annotations

import difflib
import math
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 1.15  # lengths of one class lie within this factor
GRAM = 4
BLOCKS = ((250, 1), (1000, 4), (math.inf, 8))  # strings below these lengths are held in so many blocks
FILL = 12  # bits for each gram of a window
SLOTS = 64  # for each gram of a window, in the bound after that
LETTERS = ((70, 4), (150, 8), (math.inf, 16))  # strings below these lengths have so many words of bits for their letters
BEGIN = 0.34  # the part of a string that is compared first
ROWS, CHARACTERS = 8192, 4 << 20  # of a cell
PARTS, PART = 8, 1024  # the strings that visit a class are dealt into so many cells, if they are that many rows, so that its work spreads
TILE = (16, 2048)  # strings of either cell that are held against each other at once
MADE = 1 << 24  # bits that are set at once
TINY = 1e-9
MIX = np.uint64(0x9E3779B97F4A7C15)
KEY = ["cls", "x_cell", "y_cell"]
PAIRS = "a_id long, b_id long, ratio double"


class Layout(NamedTuple):
    """Of a class: least and greatest length, blocks, characters, bits and slots of a block, bits for letters."""

    low: float
    high: float
    blocks: int
    size: int
    bits: int
    slots: int
    letters: int


@cache
def _layout(cls: int, least: float) -> Layout:
    low, high = STEP**cls * (1 - 1e-6), STEP ** (cls + 1) * (1 + 1e-6) + 1
    blocks, words = (next(k for below, k in of if high < below) for of in (BLOCKS, LETTERS))
    size = math.ceil(high / blocks)
    window = size + (2 * (1 - least) * high if blocks > 1 else 0)
    return Layout(low, high, blocks, size, 64 * math.ceil(FILL * window / 64), 1 << min(24, math.ceil(SLOTS * window).bit_length()), 64 * words)


def _hashed(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Hashes of the (value, occurrence) pairs of each range of the values, with the range's place; `most` ranges at once. Ranges may overlap."""
    sizes, shift = np.maximum(ends - begins, 0), np.uint64(40)
    after, at = np.cumsum(sizes), 0
    while at < len(begins):
        to = at + max(1, min(most, int(np.searchsorted(after[at:], (after[at - 1] if at else 0) + MADE // 16, "right"))))
        n = sizes[at:to]
        row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum())
        keys = values[place + np.repeat(begins[at:to] - (np.cumsum(n) - n), n)] >> (np.uint64(64) - shift) | row.astype(np.uint64) << shift
        keys.sort()  # within a range equal values stand together; ranges keep their places
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        mixed = ((keys & (np.uint64(1) << shift) - np.uint64(1)) + (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)) * MIX
        yield slice(at, to), row, mixed ^ mixed >> np.uint64(32)
        at = to


def _bitmap(row: np.ndarray, hashes: np.ndarray, rows: int, bits: int) -> np.ndarray:
    made = np.zeros((rows, bits), bool)
    made[row, hashes % np.uint64(bits)] = True
    return np.packbits(made, axis=1).view(np.uint64)


class Cell:
    """Texts of a cell with their code points, bitmaps and slots; `windows`: each block's are of where the grams of the other's block can stand."""

    def __init__(self, rows: pa.Table, layout: Layout, least: float, windows: bool):
        self.ids, self.texts = rows["id"].to_pylist(), rows["text"].to_pylist()
        self.n = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32)
        self.begins = np.cumsum(self.n) - self.n
        values = self.codes.astype(np.uint64) * MIX
        values ^= values >> np.uint64(29)
        made = [_bitmap(row, h, at.stop - at.start, layout.letters) for at, row, h in _hashed(values, self.begins, self.begins + self.n, MADE // layout.letters)]
        self.letters = np.ascontiguousarray(np.concatenate(made).T)
        values = np.zeros(max(len(self.codes) - GRAM + 1, 0), np.uint64)  # those over the end of a text are in no range
        for k in range(GRAM):
            values = (values ^ self.codes[k : k + len(values)]) * MIX
            values ^= values >> np.uint64(29)
        back = ahead = np.zeros(len(self.n), np.int64)
        if windows:
            back, ahead = (np.maximum(np.floor(x), 0).astype(np.int64) + 1 for x in (layout.high - least * (layout.high + self.n) / 2, self.n - least * (layout.low + self.n) / 2))
        last, at = np.maximum(self.n - GRAM + 1, 0)[:, None], np.arange(layout.blocks) * layout.size
        begins = np.minimum(np.maximum(at - back[:, None], 0), last)
        ends = np.minimum(at + layout.size + ahead[:, None], last)
        ends[:, -1:] = last
        made, slots = [], []
        for at, row, h in _hashed(values, (self.begins[:, None] + begins).ravel(), (self.begins[:, None] + ends).ravel(), max(1, MADE // layout.bits)):
            made.append(_bitmap(row, h, at.stop - at.start, layout.bits))
            slots.append(((h >> np.uint64(20)) % np.uint64(layout.slots)).astype(np.int32) + ((at.start + row) % layout.blocks * layout.slots).astype(np.int32))
        self.grams, self.slots = np.concatenate(made).reshape(len(self.n), -1), np.concatenate(slots)
        self.slots_end = np.cumsum((ends - begins).clip(0).sum(axis=1))


def _dealt(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Rows that are few bytes but much work, over four times the tasks that a shuffle has (adaptive execution would put them in one)."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _class(n: Column, more: float = TINY) -> Column:
    return F.greatest(F.floor(F.log(n) / math.log(STEP) + more), F.lit(0)).cast("int")


def _common(least: float, n: np.ndarray, m: int) -> np.ndarray:
    """Characters that strings of these lengths have in common order at least."""
    return np.ceil(least / 2 * (n + m) - TINY).astype(np.int64)


def _lost(least: float, n: np.ndarray, m: int) -> np.ndarray:
    """Grams of the first that the second lacks at most; -1 where the lengths rule out the ratio."""
    common = _common(least, n, m)
    gone, new = n - common, m - common
    return np.where((gone >= 0) & (new >= 0), GRAM * gone + (GRAM - 1) * new, -1)


def _alike(x: Cell, ids: np.ndarray, y: str, least: float, part: float) -> np.ndarray:
    """Those of the ids whose text can have enough in common with y, by the first part of y.

    As in `text.common_length` a text is bits of a number; here the texts stand beside each other in one number, a free bit after each.
    What follows the first p characters of y has no more in common with what follows i characters of x than the shorter of both is long.
    """
    n, p = x.n[ids], math.ceil(part * len(y))
    common = _common(least, n, len(y))
    width = min(int(n.max()), p + int((n - common).max())) | 7  # beyond, too few characters of x are left; with the free bit these are whole bytes
    at = np.arange(width)
    held = np.where(at < n[:, None], x.codes[np.minimum(x.begins[ids][:, None] + at, len(x.codes) - 1)], 0)
    number = lambda bits: int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")
    full = number(np.ones(held.shape, bool))
    masks = {c: number(held == ord(c)) for c in set(y[:p])}
    v = full
    for c in y[:p]:
        u = v & masks[c]
        v = ((v + u) | (v ^ u)) & full
    left = np.unpackbits(np.frombuffer(v.to_bytes(len(ids) * (width + 1) // 8, "little"), np.uint8).reshape(len(ids), -1), axis=1, count=width, bitorder="little")
    reached = np.zeros((len(ids), width + 1), np.int32)
    np.cumsum(left == 0, axis=1, out=reached[:, 1:])
    reached += np.minimum(np.maximum(n[:, None] - np.arange(width + 1), 0), len(y) - p).astype(np.int32)
    return ids[reached.max(axis=1) >= common]


class Matcher(difflib.SequenceMatcher):
    """The same matches; characters that are popular in b, or not in it, begin none, so only the places of the others are gone through. b is set first."""

    begin = np.zeros(1, bool)

    def set_seq2(self, b: str) -> None:
        super().set_seq2(b)
        self.begin = np.zeros(sys.maxunicode + 1, bool)  # the characters that can begin a match
        self.begin[[ord(c) for c in self.b2j]] = True

    def set_seq1(self, a: str) -> None:
        super().set_seq1(a)
        self.places = np.flatnonzero(self.begin.take(np.frombuffer(a.encode("utf-32-le"), np.uint32))).tolist()

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        a, b = self.a, self.b
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        i, j, size, ends, before = alo, blo, 0, {}, -1
        for at in self.places[bisect_left(self.places, alo) : bisect_left(self.places, ahi)]:
            ends, longer, before = ends if at == before + 1 else {}, {}, at
            for to in self.b2j[a[at]]:
                if to >= bhi:
                    break
                if to >= blo:
                    k = longer[to] = ends.get(to - 1, 0) + 1
                    if k > size:
                        i, j, size = at - k + 1, to - k + 1, k
            ends = longer
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        return difflib.Match(i, j, size)

    def ratio_from(self, common: int) -> float:
        """The ratio, or 0 if its matches have less than `common` characters: it ends once those found and the stretches still open are too few."""
        got, free, stretches = 0, min(len(self.a), len(self.b)), [(-min(len(self.a), len(self.b)), 0, len(self.a), 0, len(self.b))]
        while stretches:
            size, alo, ahi, blo, bhi = heappop(stretches)
            i, j, k = self.find_longest_match(alo, ahi, blo, bhi)
            got, free = got + k, free + size
            for left, right, low, high in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
                if left < right and low < high:
                    free += min(right - left, high - low)
                    heappush(stretches, (-min(right - left, high - low), left, right, low, high))
            if got + free < common:
                return 0.0
        return 2.0 * got / (len(self.a) + len(self.b))


def _near(x: Cell, y: Cell, layout: Layout, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Places in y, and those in x that letters and grams allow, in order."""
    most, less = np.floor(x.n * (1 - least / 2) + 1e-6).astype(np.int32), np.floor(least / 2 * y.n).astype(np.int32)
    missing, lacks = ~y.letters, ~y.grams
    few, end = max(1, (1 << 17) // x.grams.shape[1]), layout.blocks * layout.slots  # the end stands for what is beyond a text's last gram, and is in every table
    table, sizes = np.zeros(end + 1, bool), np.diff(x.slots_end, prepend=0)
    table[end] = True
    slots = np.full((len(x.n), max(1, int(sizes.max()))), end, np.int32)
    slots[np.arange(slots.shape[1]) < sizes[:, None]] = x.slots
    for at in range(0, len(y.n), TILE[0]):
        found: list[list[np.ndarray]] = [[] for _ in y.n[at : at + TILE[0]]]
        for to in range(0, len(x.n), TILE[1]):
            limit = most[to : to + TILE[1]] - less[at : at + TILE[0], None]  # of letters; one too many at most
            lost, both, part, count = (np.zeros(limit.shape, t) for t in (np.int32, np.uint64, np.uint8, np.uint8))
            for k in range(0, len(missing), 3):  # as many words as a byte can count
                for w in range(k, min(k + 3, len(missing))):
                    np.bitwise_count(np.bitwise_and(x.letters[w, to : to + TILE[1]], missing[w, at : at + TILE[0], None], out=both), out=count if w > k else part)
                    if w > k:
                        part += count
                lost += part
            for j, passes in enumerate(lost <= limit, at):
                ids = np.flatnonzero(passes) + to
                for k in range(0, len(ids), few):
                    some = ids[k : k + few]
                    own = x.grams[some]
                    own &= lacks[j]
                    found[j - at].append(some[np.add.reduce(np.bitwise_count(own), axis=1, dtype=np.uint32) <= _lost(least, x.n[some], y.n[j])])
        for j, each in enumerate(found, at):
            ids = np.concatenate(each) if each else np.empty(0, np.int64)
            if len(ids):
                held = y.slots[y.slots_end[j - 1] if j else 0 : y.slots_end[j]]
                table[held] = True
                few_slots = max(1, (1 << 18) // slots.shape[1])
                ids = np.concatenate([some[slots.shape[1] - np.count_nonzero(table.take(slots[some]), axis=1) <= _lost(least, x.n[some], y.n[j])] for some in (ids[k : k + few_slots] for k in range(0, len(ids), few_slots))])
                table[held] = False
                if len(ids):
                    yield j, ids


def _meet(least: float, first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pairs of two cells; `first`: of each string of the second only the one with the smallest id of the first."""

    def found(a: pa.Table, b: pa.Table) -> Iterator[tuple[int, int, float]]:
        layout = _layout(a["cls"][0].as_py(), least)
        x, y = Cell(a.sort_by("id"), layout, least, False), Cell(b, layout, least, True)
        for j, ids in _near(x, y, layout, least):
            text, at, step, over, matcher = y.texts[j], 0, 32, False, None
            while at < len(ids) and not (first and over):
                some, at, step = ids[at : at + step], at + step, min(4 * step, max(32, (1 << 18) // len(text)))
                for part in (BEGIN, 1):
                    some = _alike(x, some, text, least, part) if len(some) else some
                for i, common in zip(some.tolist(), _common(least, x.n[some], len(text)).tolist(), strict=True):
                    if matcher is None:
                        matcher = Matcher()
                        matcher.set_seq2(text)
                    matcher.set_seq1(x.texts[i])
                    r = matcher.ratio_from(common)
                    if r > least:
                        yield x.ids[i], y.ids[j], r
                        over = True
                        if first:
                            break

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = list(found(a, b)) if len(a) and len(b) else []
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a_id", "b_id", "ratio"])

    return run


def _sides(a: DataFrame, b: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The strings of either side by the KEY of each group that they take part in."""
    n, factor = F.length("text"), (2 - least) / least
    x, y = (df.where("text <> ''").select("id", "text") for df in (a, b))
    x = x.withColumn("cls", _class(n))
    y = y.withColumn("cls", F.explode(F.sequence(_class(n / factor, -TINY), _class(n * factor))))
    rows = F.count("id")  # with the id, Spark shuffles the texts once for this and for the sides
    cells = lambda df, to, least: df.groupBy("cls").agg(F.ceil(F.greatest(rows / ROWS, F.sum(n) / CHARACTERS, least)).cast("int").alias(to))
    many = F.broadcast(cells(x, "x_cells", F.lit(0.0)).join(cells(y, "y_cells", F.least(rows / PART, F.lit(PARTS))), "cls"))  # a row for each class: the logarithm of the greatest length

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        cell = F.pmod(F.xxhash64("id"), F.col(f"{own}_cells")).cast("int").alias(f"{own}_cell")
        return df.join(many, "cls").select("cls", "id", "text", cell, F.explode(F.sequence(F.lit(0), F.col(f"{other}_cells") - 1)).alias(f"{other}_cell"))

    return side(x, "x", "y"), side(y, "y", "x")


def similar_pairs(a: DataFrame, b: DataFrame, least: float = 0.9, first: bool = False) -> DataFrame:
    """a_id, b_id, ratio of all pairs of texts with a ratio over `least` (0.5 at least); both sides have id and text, an id and a text once.

    Null and empty texts take no part. With `first` some pairs may be left out, but of each b_id never the one with the smallest a_id.
    """
    if not 0.5 <= least < 1:
        raise ValueError("least must be from 0.5 to below 1")
    x, y = (_dealt(df, *KEY).groupBy(*KEY) for df in _sides(a, b, least))
    return x.cogroup(y).applyInArrow(_meet(least, first), PAIRS)

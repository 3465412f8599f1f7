"""Searches of a span among the word windows of a text (C-07, W-10): bounds of all windows at once, the measure itself for few."""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.text import audit_key, common_length, places

SEED = 3  # characters of a seed; a ratio over 0.85 spoils too many longer ones to ask for any


class Words:
    """The words of a text with one space between, as character codes, and where each begins and ends."""

    def __init__(self, text: str):
        words = text.split()
        self.text = " ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.codes = _codes(self.text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _seeds(codes: np.ndarray) -> np.ndarray:
    """A number for each run of SEED characters; code points have 21 bits, so equal numbers are equal runs."""
    n = max(len(codes) - SEED + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(SEED):
        out = (out << np.uint64(21)) | codes[i : i + n].astype(np.uint64)
    return out


@lru_cache(2)
def _words(text: str) -> tuple[Words, np.ndarray]:
    """A text serves all its spans that follow each other in a batch."""
    w = Words(text)
    return w, _seeds(w.codes)


def _counts_before(marks: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(marks)])


def has_close_window(span: str, text: str, least: float = 0.85) -> bool:
    """C-07: whether a window of as many words as the span, or the whole shorter text, has a ratio over `least` with it.

    Three bounds fall on all windows at once, each from running totals over the text: the lengths; the seeds of the window that
    the span holds, of which a character that only the window has spoils SEED and one that only the span has SEED - 1; the
    characters in common. Common subsequences and then the ratio decide the windows that are left, best first.
    """
    have, seeds = _words(text)
    n, size = len(span.split()), len(span)
    if not n or not len(have.start):
        return False
    k = min(n, len(have.start))
    start, end = have.start[: len(have.start) - k + 1], have.end[k - 1 :]
    width = end - start
    need = np.floor(least * (size + width) / 2 - 1e-6).astype(np.int64) + 1  # characters that the blocks of such a ratio hold
    at = np.flatnonzero((need <= size) & (need <= width))
    asked = width - SEED + 1 - SEED * (width - need) - (SEED - 1) * (size - need)
    if len(at) and (asked[at] > 0).any():
        held = _counts_before(np.isin(seeds, _seeds(_codes(span))))
        last = np.maximum(end[at] - SEED + 1, start[at])
        at = at[held[last] - held[start[at]] >= asked[at]]
    if not len(at):
        return False
    shared = np.zeros(len(at), np.int64)
    for c, times in zip(*np.unique(_codes(span), return_counts=True), strict=True):
        before = _counts_before(have.codes == c)
        shared += np.minimum(before[end[at]] - before[start[at]], times)
    good = shared >= need[at]
    at, shared = at[good], shared[good]
    marks = places(span)
    for i in at[np.argsort(-shared / (size + width[at]), kind="stable")]:
        window = have.text[start[i] : end[i]]
        if common_length(span, window, marks) >= need[i] and difflib.SequenceMatcher(None, span, window).ratio() > least:
            return True
    return False


def has_alike_window(span: str, text: str, least: float = 0.9) -> bool:
    """W-10: whether a window of as many tokens as the span has a Jaccard of at least `least` with its distinct tokens.

    A place counts for the windows that hold it and not the place before of the same token, so the distinct tokens of all windows,
    and those that are in the span, are two running totals over the text.
    """
    s, t = span.split(" "), text.split(" ")
    n, k = len(t), len(s)
    own = set(s)
    if k > n or not any("a" <= c <= "z" for c in span):
        return False
    last: dict[str, int] = {}
    before = np.empty(n, np.int64)
    mine = np.fromiter((w in own for w in t), bool, n)
    for j, w in enumerate(t):
        before[j] = last.get(w, -1)
        last[w] = j
    if sum(w in last for w in own) < least * len(own):
        return False
    j = np.arange(n)
    first = np.maximum(np.maximum(before + 1, j - k + 1), 0)  # windows first..j hold place j as their first of its token

    def distinct(of: np.ndarray) -> np.ndarray:
        steps = np.bincount(first[of], minlength=n + 1) - np.bincount(j[of] + 1, minlength=n + 1)
        return np.cumsum(steps)[: n - k + 1]

    both = distinct(mine)
    return bool((both >= least * (len(own) + distinct(np.ones(n, bool)) - both)).any())


@F.pandas_udf(T.BooleanType())
def _close(span: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([bool(a and b) and has_close_window(a, b) for a, b in zip(span, text, strict=True)], dtype=bool)


def grep_verify(snippet: Column, text: Column) -> Column:
    """C-07: substring of the audit keys, else a window of as many words with a ratio over 0.85."""
    s, t = audit_key(snippet), audit_key(text)
    asked = ~t.contains(s) & (s != "")  # only these rows carry their texts to Python
    return F.when((s == "") | s.isNull() | t.isNull(), False).when(t.contains(s), True).otherwise(_close(F.when(asked, s), F.when(asked, t)))


def window_jaccard(span: Column, text: Column, least: float = 0.9) -> Column:
    """W-10: some window of as many tokens as the span has a Jaccard of at least `least`; the span needs a letter. Null is no match."""

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and has_alike_window(x, y, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    return alike(span, text)

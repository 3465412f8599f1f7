"""Windows of long sources by tokens (X-14, C-19, H-08, H-09).

Each text is tokenised once in an Arrow task by a public tokeniser, whose
vocabulary file every executor has; its token offsets map characters to tokens
and back, so every window is a slice of the text and never ends inside a
character. Rows stand alone: nothing is shuffled.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.nulls import is_absence_claim
from concord.functions.text import locate_span

# Fixed values
GAP = "\n\n[...gap in source...]\n\n"
BUDGET = 20_000  # tokens of a source that is shown whole
RADIUS = 500  # tokens
CHARACTERS = 4  # of a token, for seeking
CELL = 32_767  # characters of a spreadsheet cell
NEEDLES = (200, 80)  # characters of a span that are looked for

PIECE = 256  # characters that are tokenised at once, at least
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

_state: dict[str, object] = {}


class Tokens:
    """A text's tokens as places in it; with `enough` only so many first ones, and some more, as a longer text has.

    The text is tokenised in pieces that begin with a space between two ASCII letters or digits: byte-level
    BPE splits there whatever stands on either side, so pieces and the whole have the same tokens.
    """

    def __init__(self, vocabulary: str, text: str, enough: int | None = None):
        if vocabulary not in _state:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _state[vocabulary] = Tokenizer.from_file(vocabulary)
        self.text, self.starts, self.ends = text, [], []
        at, step = 0, len(text) if enough is None else max(PIECE, CHARACTERS * enough)
        while at < len(text) and (enough is None or len(self.starts) <= enough):
            cut = SAFE.search(text, at + step) if at + step < len(text) else None
            end = cut.start() if cut else len(text)
            offsets = _state[vocabulary].encode(text[at:end], add_special_tokens=False).offsets
            self.starts += [at + a for a, _ in offsets]
            self.ends += [at + b for _, b in offsets]
            at = end

    def __len__(self) -> int:
        return len(self.starts)

    def cut(self, first: int, last: int) -> str:
        """The text of tokens first to last - 1."""
        first, last = max(first, 0), min(last, len(self))
        return self.text[self.starts[first] : self.ends[last - 1]] if first < last else ""

    def before(self, place: int) -> int:
        """How many tokens begin before a character."""
        return bisect_left(self.starts, place)


def paragraph_start(text: str, place: int) -> int:
    """H-09: after the last blank line before a place, else after the last line break, else 0; it keeps the blank line's second break."""
    at = text.rfind("\n\n", 0, max(place, 0))
    return (at if at >= 0 else text.rfind("\n", 0, max(place, 0))) + 1


def paragraph_end(text: str, place: int) -> int:
    """H-09: the next blank line from a place on, else the next line break, else the end."""
    found = (at for at in (text.find("\n\n", place), text.find("\n", place)) if at >= 0)
    return next(found, len(text))


def union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            start, end = out[-1][0], max(end, out.pop()[1])
        out.append((start, end))
    return out


def source_window(text: str, spans: list[str | None], vocabulary: str, budget: int = BUDGET, radius: int = RADIUS, tokens: Tokens | None = None) -> tuple[str, bool, int]:
    """X-14: (text to show, whether it is a window, its tokens): the paragraphs around the spans, joined by gaps and cut at the budget."""
    tokens = tokens or Tokens(vocabulary, text, budget)
    if len(tokens) <= budget:
        return text, False, len(tokens)
    around = []
    for span in filter(None, spans):
        needle = span[: NEEDLES[0]]
        at = text.find(needle)
        if at < 0 and len(span) >= NEEDLES[1]:
            at = text.find(span[: NEEDLES[1]])
        if at >= 0:
            reach = radius * CHARACTERS
            around.append((paragraph_start(text, at - reach), paragraph_end(text, min(len(text), at + len(needle) + reach))))
    if not around:
        return tokens.cut(0, budget), True, budget
    shown = Tokens(vocabulary, GAP.join(text[a:b] for a, b in union(around)), budget)
    return (shown.text if len(shown) <= budget else shown.cut(0, budget)), True, min(len(shown), budget)


def token_window(text: str, place: int, vocabulary: str, radius: int, tokens: Tokens | None = None) -> str:
    """H-08: `radius` tokens on either side of the token at a place."""
    tokens = tokens or Tokens(vocabulary, text)
    centre = tokens.before(place)
    return tokens.cut(centre - radius, centre + radius + 1)


def head_window(text: str, vocabulary: str, characters: int, tokens: Tokens | None = None) -> str:
    """H-08: the first tokens, one for each four characters allowed, and no more characters than that."""
    most = max(1, characters // CHARACTERS)
    return (tokens or Tokens(vocabulary, text, most)).cut(0, most)[:characters]


def with_source_windows(rows: DataFrame, vocabulary: str, budget: int = BUDGET, radius: int = RADIUS) -> DataFrame:
    """X-14: rows with source_text and spans (an array) get window, windowed and n_tokens; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source_text", "spans"))
            made = [source_window(t or "", s or [], vocabulary, budget, radius) for t, s in zip(text, spans, strict=True)]
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "window", "windowed", "n_tokens"])

    return rows.mapInArrow(run, _schema(rows, "window string, windowed boolean, n_tokens long"))


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), more])


def with_audit_windows(rows: DataFrame, vocabulary: str, budget: int = BUDGET, radii: tuple[int, ...] = (RADIUS, 300), cell: int = CELL) -> DataFrame:
    """C-19: rows with source_text, value, span and spans (of all arms) get strategy and window.

    full_text: the source is within the budget and a cell. pass2_window: it is over the
    budget, so the window of all spans is shown. absence_fallback_head: the value claims
    absence. arm_span_window: tokens around the row's own span, at the first radius that
    fits a cell. missing_span_fallback_head: the span is missing or not found.
    """
    marked = rows.withColumn("_absent", F.coalesce(is_absence_claim(F.col("value")), F.lit(True))).withColumn("_at", F.coalesce(locate_span(F.col("source_text"), F.col("span")), F.lit(-1)))

    def one(text: str, spans: list[str | None], absent: bool, at: int) -> tuple[str, str]:
        tokens = Tokens(vocabulary, text, budget)  # all of them, unless the text is shown in part
        shown, windowed, _ = source_window(text, spans, vocabulary, budget, radii[0], tokens)
        if windowed:
            return "pass2_window", shown
        if len(text) <= cell:
            return "full_text", text
        if absent:
            return "absence_fallback_head", head_window(text, vocabulary, cell, tokens)
        if at >= 0:
            tries = (token_window(text, at, vocabulary, r, tokens) for r in radii)
            return "arm_span_window", next((w for w in tries if len(w) <= cell), token_window(text, at, vocabulary, radii[-1], tokens)[:cell])
        return "missing_span_fallback_head", head_window(text, vocabulary, cell, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans, absent, at = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source_text", "spans", "_absent", "_at"))
            made = [one(t or "", s or [], a, p) for t, s, a, p in zip(text, spans, absent, at, strict=True)]
            keep = batch.num_columns - 2
            columns = [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *columns], [*batch.schema.names[:keep], "strategy", "window"])

    return marked.mapInArrow(run, _schema(rows, "strategy string, window string"))

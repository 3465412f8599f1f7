"""Text expressions (X-01..X-26, F-06, F-10, F-15..F-18, SRC-25): pure Column functions, and the few Arrow UDFs."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no content in free-text comparison
STOP_WORDS = "a an and are as at be been being but by can did do does for from had has have in is it its of on or our that the their these this those to was were will with within without".split()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value evaluated once, as the variable of a lambda."""
    return F.transform(F.array(value), f)[0]


def collapse(v: Column) -> Column:
    """X-04: white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))


def title_key(v: Column) -> Column:
    """X-01: letters, digits, `_` and single spaces, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " "))


def tokens(v: Column) -> Column:
    """X-08: the set of white-space tokens, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(v), r"(?U)\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """X-08: similarity of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def content_tokens(v: Column) -> Column:
    """X-09: runs of two or more ASCII letters that are no stop words."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(v), F.lit("([a-z]+)"), 1)), lambda x: (F.length(x) >= 2) & ~x.isin(STOP_WORDS))


def has_ellipsis(v: Column) -> Column:
    """F-06: a snippet bridged by an ellipsis."""
    return F.coalesce(v.rlike(r"\.\.\.|…"), F.lit(False))


def is_truncated(v: Column) -> Column:
    """F-10: no closing mark at the end."""
    return ~F.rtrim(v).rlike(r"[.?!>]$")


def first_rule(v: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """F-15 / F-16 / H-31: the name of the first rule whose pattern is found."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(v.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def keyword_category(v: Column, rules: list[dict], other: str = "ambiguous") -> Column:
    """F-15: rules {name, regex?, keywords?, exclusions?} in order; a regex suppresses its rule's keywords."""
    text, out = F.lower(F.coalesce(v, F.lit(""))), F.lit(other)
    for r in reversed(rules):
        if r.get("regex"):
            hit = text.rlike(r["regex"])
        else:
            hit = F.lit(False)
            for k in r.get("keywords", []):
                hit |= text.contains(k.lower())
            for x in r.get("exclusions", []):
                hit &= ~text.contains(x.lower())
        out = F.when(hit, r["name"]).otherwise(out)
    return out


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """F-18."""
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def _accents() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without their marks."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def surname(author: Column) -> Column:
    """X-11: the last word, or the first where the last is one or two letters (initials); plain letters, `Unknown` without any."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.translate(author, *_accents()), r"[^A-Za-z0-9\- ]", ""), " +", " "))
    words = F.split(plain, " ")
    return F.when(F.coalesce(plain, F.lit("")) == "", "Unknown").when((F.size(words) > 1) & (F.length(F.element_at(words, -1)) <= 2), F.get(words, F.lit(0))).otherwise(F.element_at(words, -1))


def first_author(authors: Column) -> Column:
    """X-11 of the first name of a JSON array."""
    return surname(F.get(F.from_json(authors, "array<string>"), F.lit(0)))


def first_author_list(authors: Column) -> Column:
    """X-11 of a `;` list: what stands before the first comma, at most 30 characters, a dash without a name."""
    name = F.trim(F.split_part(F.split_part(authors, F.lit(";"), F.lit(1)), F.lit(","), F.lit(1)))
    return F.when(F.coalesce(name, F.lit("")) == "", "—").otherwise(F.substring(name, 1, 30))


def canonical_filename(label: Column, authors: Column, year: Column) -> Column:
    """X-12: label, surname of the first author (of a JSON array) and year."""
    return F.concat(F.coalesce(F.nullif(label, F.lit("")), F.lit("EE-000")), F.lit("_"), first_author(authors), F.lit("_"), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("XXXX")), F.lit(".pdf"))


def fitted_text(text: Column, title: Column, abstract: Column, limit: int = 32000) -> Column:
    """X-13: title and abstract, then the text; a text that does not fit is cut before its references where these begin in time, else at the limit, and at the last sentence end if that is in its last fifth."""
    head = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v, F.lit("\n\n"))).otherwise("")
    header = F.concat(head("Title", title), head("Abstract", abstract))
    room = F.lit(limit) - F.length(header)
    refs = F.call_function("regexp_instr", text, F.lit(r"(?im)^(?:#{1,4}\s+)?(?:references|bibliography|acknowledgements?)\b")) - 1
    cut = F.when((refs >= 0) & (refs <= room), F.regexp_replace(F.call_function("left", text, refs), r"\s+$", "")).otherwise(F.call_function("left", text, room))

    def body(b: Column) -> Column:
        last = F.length(b) - F.locate(" .", F.reverse(b)) - 1
        return F.when((F.locate(" .", F.reverse(b)) > 0) & (last > F.length(b) * 0.8), F.call_function("left", b, last + 1)).otherwise(b)

    return F.when(room <= 0, F.call_function("left", header, F.lit(limit))).when(F.length(text) <= room, F.concat(header, text)).otherwise(F.concat(header, let(cut, body)))


def locate_span(text: Column, span: Column) -> Column:
    """X-15: 0-based place in the text; -1 if none. Tried in order: the first 200 characters of the span, its first 80, the first 60 of its parts between ellipses (longest first), and windows of 60 characters."""
    at = lambda needle: F.nullif(F.call_function("locate", needle, text), F.lit(0))
    left = lambda v, n: F.call_function("left", v, F.lit(n))
    n = F.length(span)
    none = F.array().cast("array<int>")
    parts = F.filter(F.transform(F.split(span, r"\s*\.\.\.\s*"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) >= 60)
    parts = F.array_sort(F.transform(parts, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    by_part = F.transform(parts, lambda p: at(left(p["x"], 60)))
    by_window = F.when(n > 60, F.transform(F.sequence(F.lit(0), n - 61, F.lit(20)), lambda s: at(F.substring(span, s + 1, F.lit(60))))).otherwise(none)
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    found = F.coalesce(at(left(span, 200)), F.when(n >= 80, at(left(span, 80))), first(by_part), first(by_window))
    return F.when(F.coalesce(span, F.lit("")) == "", -1).otherwise(F.coalesce(found - 1, F.lit(-1)))


def context(text: Column, at: Column, length: Column, width: int = 200) -> Column:
    """X-16 / X-17: characters around a place."""
    start = F.greatest(at - width, F.lit(0))
    return F.when(at >= 0, F.substring(text, start + 1, length + 2 * width))


def windows_around(text: Column, starts: Column, width: int) -> Column:
    """X-14: merged [start, end) intervals of `width` characters around sorted places, joined by an ellipsis line."""
    spans = F.transform(F.array_sort(starts), lambda s: F.struct(F.greatest(s - width, F.lit(0)).alias("s"), F.least(s + width, F.length(text)).alias("e")))
    kind = "array<struct<s:int,e:int>>"
    merged = F.aggregate(spans.cast(kind), F.array().cast(kind), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).e >= x.s), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1).s.alias("s"), F.greatest(F.element_at(acc, -1).e, x.e).alias("e"))))).otherwise(F.concat(acc, F.array(x))).cast(kind))
    return F.array_join(F.transform(merged, lambda x: F.substring(text, x.s + 1, x.e - x.s)), "\n[...]\n")


def thinking(v: Column) -> Column:
    """X-18."""
    return F.trim(F.regexp_extract(v, r"(?s)<think>(.*?)</think>", 1))


def strip_fence(v: Column) -> Column:
    """X-19."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(v), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```$", ""))


def shorten(v: Column, n: int) -> Column:
    """X-20 / X-24: cut with an ellipsis."""
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n), F.lit("..."))).otherwise(v)


def token_estimate(v: Column) -> Column:
    """X-21: a quarter of the characters, rounded up."""
    return F.ceil(F.length(v) / 4)


def snippet_match(text: Column, snippet: Column) -> Column:
    """X-22: exact, normalised, or a token overlap of at least 0.8."""
    own = tokens(snippet)
    share = F.size(F.array_intersect(own, tokens(text))) / F.greatest(F.size(own), F.lit(1))
    return F.when(text.contains(snippet), "exact").when(collapse(text).contains(collapse(snippet)), "normalized").when(share >= 0.8, "token_overlap").otherwise("none")


def prompt(template: str, **parts: Column) -> Column:
    """X-23: a template with {name} holes filled by columns."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.coalesce(parts[name].cast("string"), F.lit("(not available)"))]
    return F.concat(*out, F.lit(rest))


def flag_reason(language: Column, kind: Column) -> Column:
    """X-25."""
    return F.concat_ws("; ", F.when(language != "English", F.concat(F.lit("Non-English: "), language)), F.when(kind != "full_manuscript", F.concat(F.lit("Content type: "), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))))


def links(doi: Column, pmid: Column, title: Column) -> Column:
    """X-26: array of structs; missing ones are left out."""
    made = F.array(
        F.when(doi.isNotNull(), F.struct(F.lit("doi").alias("kind"), F.concat(F.lit("https://doi.org/"), doi).alias("url"))),
        F.when(pmid.isNotNull(), F.struct(F.lit("pubmed").alias("kind"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid).alias("url"))),
        F.struct(F.lit("scholar").alias("kind"), F.concat(F.lit("https://scholar.google.com/scholar?q="), F.url_encode(title)).alias("url")),
    )
    return F.filter(made, lambda x: x.isNotNull())


def is_pdf(content: Column) -> Column:
    """SRC-25: the magic bytes."""
    return F.hex(F.substring(content, 1, 4)) == "25504446"


def strip_controls(v: Column) -> Column:
    """H-27."""
    return F.regexp_replace(v, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X-02: similarity of two strings as matching-block ratio."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def common_length(x: str, y: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, all of x at once in the bits of a number; no ratio can have more characters in common."""
    if masks is None:
        masks = places(x)
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def places(x: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(x):
        out[c] = out.get(c, 0) | 1 << i
    return out


@F.pandas_udf(T.StringType())
def _nfkc(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def audit_key(v: Column) -> Column:
    """X-03: straight quotes and dashes, NFKC where not ASCII, glued dots split, collapsed, lower case."""
    v = F.translate(v, "‘’“”–—", "''\"\"--")
    v = F.when(v.rlike(r"[^\x00-\x7F]"), _nfkc(v)).otherwise(v)
    return collapse(F.regexp_replace(v, r"(?U)(?<=\w)\.(?=\w)", " "))


@F.pandas_udf(T.StringType())
def closest(v: pd.Series, options: pd.Series) -> pd.Series:
    """C-14: the closest of the options with a ratio of at least 0.4."""
    return pd.Series([(difflib.get_close_matches(x or "", list(o) if o is not None else [], 1, 0.4) or [None])[0] for x, o in zip(v, options, strict=True)], dtype="object")

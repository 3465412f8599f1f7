"""Value normalisation, pair scores and agreement (X-05..X-10, N-01..N-04, A-11..A-15, T-10, H-07, H-29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.nulls import is_null_synonym
from concord.functions.text import collapse, content_tokens, jaccard


def digits_only(v: Column) -> Column:
    """N-01: all digits as one number, else the trimmed value."""
    d = F.regexp_replace(v, r"[^0-9]", "")
    return F.when(d == "", F.trim(v)).otherwise(F.coalesce(F.nullif(F.ltrim(d, F.lit("0")), F.lit("")), F.lit("0")))


def leading_number(v: Column) -> Column:
    """N-02."""
    return F.regexp_extract(F.replace(F.trim(v), F.lit(","), F.lit("")), r"^-?\d+(?:\.\d+)?", 0).try_cast("double")


def number_in(value: Column, span: Column, tolerance: Column) -> Column:
    """N-03: some number of the span is within the tolerance; 0 compares whole numbers."""
    x = leading_number(value)
    found = F.transform(F.regexp_extract_all(F.replace(span, F.lit(","), F.lit("")), F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda y: y.try_cast("double"))
    return F.coalesce(F.exists(found, lambda y: F.abs(y - x) <= tolerance), F.lit(False))


def prefix_of(v: Column, options: Column) -> Column:
    """X-06: the only option that starts with the value in any case, else the value."""
    hits = F.filter(options, lambda o: F.lower(o).startswith(F.lower(v)))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(v)


def canonical(v: Column, options: Column) -> Column:
    """X-05: exact, then case-insensitive, then the unique part before a parenthesis, else as it is."""
    v = F.trim(v)
    same = F.filter(options, lambda o: F.lower(o) == F.lower(v))
    head = F.filter(options, lambda o: o.startswith(F.concat(v, F.lit(" "))) | (o == v))
    opened = F.filter(head, lambda o: F.trim(F.regexp_extract(o, r"^(.+?)\s*\(", 1)) == v)
    return F.when(F.array_contains(options, v), v).when(F.size(same) > 0, F.element_at(same, -1)).when((F.size(head) == 1) & (F.size(opened) == 1), F.get(opened, F.lit(0))).otherwise(v)


def normalised(v: Column, kind: Column | None = None, options: Column | None = None) -> Column:
    """X-07: an array (null for absence): several values for `multi`, else one. kind: categorical, multi, numeric, raw or text (all text without one)."""
    if kind is None:
        return F.when(~is_null_synonym(v), F.array(collapse(v)))
    options = F.array().cast("array<string>") if options is None else F.coalesce(options, F.array().cast("array<string>"))
    parts = F.filter(F.transform(F.split(v, ";"), lambda x: F.trim(x)), lambda x: ~is_null_synonym(x))
    several = F.array_sort(F.array_distinct(F.transform(parts, lambda x: canonical(x, options))))
    one = F.when(kind == "numeric", digits_only(v)).when(kind == "raw", F.trim(F.regexp_replace(v, r"(?U)\s+", " "))).when(kind.isin("categorical", "multi"), canonical(v, options)).otherwise(collapse(v))
    return F.when(is_null_synonym(v), None).when((kind == "multi") & v.contains(";"), F.when(F.size(several) > 0, several)).otherwise(F.array(one))


def pair_score(a: Column, b: Column, kind: Column) -> Column:
    """X-10 on normalised arrays: MATCH, MISMATCH or AMBIGUOUS."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    closed = kind.isin("categorical", "multi")
    # values are collapsed, so a blank parts their tokens; two texts without a common token have a Jaccard of 0
    apart = ~F.arrays_overlap(F.split(F.lower(x), " "), F.split(F.lower(y), " "))
    return (
        F.when(a.isNull() & b.isNull(), "MATCH").when(a.isNull() | b.isNull(), "MISMATCH")
        .when((F.size(a) > 1) | (F.size(b) > 1), F.when(F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), "MATCH").when(~F.arrays_overlap(a, b), "MISMATCH").otherwise("AMBIGUOUS"))
        .when(x == y, "MATCH").when(closed, "MISMATCH")
        .when(x.contains(y) | y.contains(x), "MATCH").when(apart, "MISMATCH").otherwise("AMBIGUOUS")
    )


def free_text_match(value: Column, span: Column, least: float = 0.3) -> Column:
    """H-07: Jaccard of content tokens."""
    a, b = content_tokens(value), content_tokens(span)
    return (F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= least)


def kappa_columns(score: Column) -> list[Column]:
    """A-11..A-13 as aggregates of a score column: n, n_match, n_mismatch, n_ambiguous, percent_agreement, kappa and its 95 % interval.

    For 0 < p < 1 kappa is 1 - 1 / (2 p (1 - p)) * (1 - p); all equal gives 1, all different 0, none null.
    """
    match, mismatch = F.count_if(score == "MATCH"), F.count_if(score == "MISMATCH")
    n = match + mismatch
    p = F.try_divide(match.cast("double"), n)
    chance = p * p + (1 - p) * (1 - p)
    kappa = F.when(n == 0, None).when(match == n, 1.0).when(match == 0, 0.0).otherwise((p - chance) / (1 - chance))
    error = F.when((n <= 1) | (match == n) | (match == 0), 0.0).otherwise(F.sqrt(p * (1 - p) / (n * (1 - chance) * (1 - chance))))
    return [
        n.alias("n"), match.alias("n_match"), mismatch.alias("n_mismatch"), F.count_if(score == "AMBIGUOUS").alias("n_ambiguous"),
        F.round(p, 6).alias("percent_agreement"), F.round(kappa, 6).alias("kappa"),
        F.round(kappa - 1.96 * error, 6).alias("ci_lower"), F.round(kappa + 1.96 * error, 6).alias("ci_upper"),
    ]


def kappa_band(kappa: Column) -> Column:
    """A-15."""
    return F.when(kappa >= 0.8, "high").when(kappa >= 0.6, "medium").when(kappa.isNotNull(), "low").otherwise("none")


def stable_seed(*parts: Column, below: int = 1 << 32) -> Column:
    """T-10: the first 32 bits of a SHA-256 over the joined parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8), 16, 10).cast("long") % below


def shown(v: Column, digits: int = 3) -> Column:
    """H-29: a number, or N/A."""
    return F.when(v.isNull() | F.isnan(v), "N/A").otherwise(F.format_number(v, digits))

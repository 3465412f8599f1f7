"""Text verification (C-06..C-08, C-14, C-15, J-23, J-24, W-10, X-22, F-11..F-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.nulls import is_audit_absence, is_null_synonym
from concord.functions.spans import grep_verify, window_jaccard
from concord.functions.text import closest, collapse, has_ellipsis, let
from concord.functions.values import free_text_match, number_in, prefix_of


def precheck(triples: DataFrame) -> DataFrame:
    """C-06: span_present, span_in_source, span_match_method, value_in_span, span_length of (value, span, source_text, field_type, tolerance)."""
    span, source, value = collapse(F.coalesce("span", F.lit(""))), collapse(F.coalesce("source_text", F.lit(""))), F.coalesce("value", F.lit(""))
    present = F.length(F.regexp_replace(F.coalesce("span", F.lit("")), r"(?U)^\s+|\s+$", "")) >= 10
    asked = (span != "") & (source != "") & ~source.contains(span)  # only these rows carry their texts to Python
    alike = window_jaccard(F.when(asked, span), F.when(asked, source))
    method = F.when((span == "") | (source == ""), "none").when(source.contains(span), "exact_substring").when(alike, "jaccard_fallback").otherwise("none")
    inside = (
        F.when(F.col("field_type") == "numeric", number_in(value, F.coalesce("span", F.lit("")), F.col("tolerance")))
        .when(F.col("field_type") == "categorical", (collapse(value) != "") & span.contains(collapse(value)))
        .otherwise(free_text_match(value, F.coalesce("span", F.lit(""))))
    )
    out = triples.withColumn("span_present", present).withColumn("span_match_method", method)
    return out.withColumn("span_in_source", F.col("span_match_method") != "none").withColumn("value_in_span", F.coalesce(inside, F.lit(False))).withColumn("span_length", F.length(F.coalesce("span", F.lit(""))))


def short_circuit(flags: DataFrame) -> DataFrame:
    """F-12."""
    return flags.withColumn("short_circuit", F.col("span_in_source") & F.col("value_in_span"))


def contained(snippets: DataFrame, texts: DataFrame, key: str, snippet: str, text: str) -> DataFrame:
    """J-24: snippets that their own document holds after collapsing."""
    return snippets.join(texts, key).where(collapse(F.col(text)).contains(collapse(F.col(snippet))))


def contained_anywhere(snippets: DataFrame, texts: DataFrame, snippet: str, text: str) -> DataFrame:
    """J-24 over all pairs: each snippet with every text that holds it after collapsing.

    The words of a snippet between its first and last are whole words of a
    text that holds it. One window of up to three of them is the join key; on
    the texts' side all windows are. Snippets under three words have no such
    window: one of their runs of four characters is the key, or the whole
    snippet if it is shorter, and on the texts' side all runs are. Only hashes
    are shuffled with the keys. An empty snippet is in every text. `contains`
    decides each pair.
    """
    split = lambda c: F.split(c, " ")
    split_chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    own = F.slice(split(F.col("_s")), 2, F.greatest(F.size(split(F.col("_s"))) - 2, F.lit(0)))
    s = snippets.withColumn("_s", collapse(F.col(snippet))).where("_s IS NOT NULL").withColumn("_own", own).withColumn("_sk", F.xxhash64("_s"))
    t = texts.withColumn("_t", collapse(F.col(text))).where("_t IS NOT NULL").withColumn("_tk", F.xxhash64("_t"))

    def windows(w: Column, n: int) -> Column:
        of = lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), of)).otherwise(F.array().cast("array<long>"))

    by_size = F.when(F.size("_own") >= 3, F.array_min(windows(F.col("_own"), 3))).when(F.size("_own") >= 1, F.array_min(windows(F.col("_own"), 1)))
    keys = s.select("_sk", by_size.alias("_key")).where("_key IS NOT NULL").distinct()
    of_text = let(split(F.col("_t")), lambda w: F.array_distinct(F.concat(windows(w, 3), windows(w, 1))))
    found = t.select("_tk", F.explode(of_text).alias("_key")).join(keys, "_key").select("_tk", "_sk").distinct()
    long_ones = t.join(found, "_tk").join(s, "_sk")
    short = s.where(F.size("_own") == 0)
    chars = lambda c, n: let(split_chars(F.col(c)), lambda w: windows(w, n))
    n = F.least(F.length("_s"), F.lit(4))
    of_snippet = F.array_min(F.when(n == 4, chars("_s", 4)).when(n == 3, chars("_s", 3)).when(n == 2, chars("_s", 2)).otherwise(chars("_s", 1)))
    short_keys = short.where("_s <> ''").select("_sk", of_snippet.alias("_key")).distinct()
    of_chars = let(split_chars(F.col("_t")), lambda w: F.array_distinct(F.concat(*[windows(w, k) for k in (1, 2, 3, 4)])))
    met = t.select("_tk", F.explode(of_chars).alias("_key")).join(short_keys, "_key").select("_tk", "_sk").distinct()
    short_ones = t.join(met, "_tk").join(short, "_sk")
    every = short.where("_s = ''").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    in_all = t.withColumn("_part", F.pmod("_tk", F.lit(64)).cast("int")).join(every, "_part")
    columns = [*snippets.columns, *texts.columns]
    pairs = long_ones.select(*columns, "_t", "_s").unionByName(short_ones.select(*columns, "_t", "_s")).unionByName(in_all.select(*columns, "_t", "_s"))
    return pairs.where(F.col("_t").contains(F.col("_s"))).select(*columns)


def audit(spans: DataFrame) -> DataFrame:
    """C-08: audit_state of (value, source_snippet, tier, paper_text, semantic boolean from a scorer); a missing answer verifies nothing."""
    snippet = F.trim(F.coalesce("source_snippet", F.lit("")))
    passed = (F.col("tier") == 4) | grep_verify(F.col("source_snippet"), F.col("paper_text"))
    state = (
        F.when(is_audit_absence(F.col("value")), "verified").when((snippet != "") & has_ellipsis(snippet), "invalid_snippet").when(snippet == "", "flagged")
        .when(~F.coalesce("semantic", F.lit(False)), "flagged").when(passed, "verified").otherwise("contested")
    )
    return spans.withColumn("audit_state", state)


def parts_of(values: DataFrame, value: str = "value") -> DataFrame:
    """JS-04: one row for each `;`-separated part that is not absent."""
    return values.withColumn("part", F.explode(F.filter(F.transform(F.split(value, ";"), lambda x: F.trim(x)), lambda x: ~is_null_synonym(x))))


def field_bleed(values: DataFrame, enums: DataFrame) -> DataFrame:
    """J-23: parts that are no value of their own field but one of another; enums: field_name, enum_value."""
    parts = parts_of(values)
    stray = parts.join(enums.select("field_name", F.col("enum_value").alias("part")), ["field_name", "part"], "left_anti")
    return stray.join(enums.select(F.col("field_name").alias("other_field"), F.col("enum_value").alias("part")), "part").where("other_field <> field_name")


def field_issues(values: DataFrame, fields: DataFrame, size_field: str = "sample_size") -> DataFrame:
    """C-14: the rows of `values` with part, issue and closest (the suggestion) for every broken rule.

    `fields` has field_name and options (array; null where the field takes any value) and must be small enough to broadcast, as a
    specification is. Unknown field names; parts of a `;` list that are neither an option nor the word before a space in one; sizes
    that are no whole number. NOT_FOUND and NR are good for any known field.
    """
    known = fields.select("field_name", "options", F.lit(True).alias("_known"))
    names = fields.agg(F.array_sort(F.collect_set("field_name")).alias("_names"))  # one row
    rows = values.join(F.broadcast(known), "field_name", "left").crossJoin(F.broadcast(names))
    unknown, value = F.col("_known").isNull(), F.col("value")
    given = ~unknown & ~value.isin("NOT_FOUND", "NR")
    parts = F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.filter(parts, lambda p: ~F.exists("options", lambda o: (o == p) | F.startswith(o, F.concat(p, F.lit(" ")))))
    issue = lambda part, text: F.struct(part.alias("part"), F.lit(text).alias("issue"))
    no_size = (F.col("field_name") == size_field) & ~value.rlike(r"^\s*[+-]?\d+(?:_\d+)*\s*$")
    found = F.concat(
        F.when(unknown, F.array(issue(F.col("field_name"), "unknown field name"))).otherwise(F.array().cast("array<struct<part:string,issue:string>>")),
        F.when(given & F.col("options").isNotNull(), F.transform(bad, lambda p: issue(p, "invalid categorical value"))).otherwise(F.array().cast("array<struct<part:string,issue:string>>")),
        F.when(given & no_size, F.array(issue(value, "non-numeric size"))).otherwise(F.array().cast("array<struct<part:string,issue:string>>")),
    )
    rows = rows.withColumn("_i", F.explode(found)).select(*values.columns, "_i.part", "_i.issue", F.when(unknown, F.col("_names")).otherwise(F.col("options")).alias("_options"))
    # the closest of few distinct pairs, not of all rows
    asked = rows.where("issue <> 'non-numeric size'").select("part", "_options").distinct().withColumn("closest", closest(F.col("part"), F.col("_options")))
    return rows.join(asked, ["part", "_options"], "left").select(*values.columns, *[c for c in ("part", "issue", "closest") if c not in values.columns])


def normalise_categories(values: DataFrame, enums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C-15: (values with unambiguous prefixes completed, the changes)."""
    options = enums.groupBy("field_name").agg(F.array_sort(F.collect_set("enum_value")).alias("options"))
    out = values.join(options, "field_name", "left").withColumn("new_value", F.when(F.col("options").isNull(), F.col("value")).otherwise(prefix_of(F.col("value"), F.col("options")))).drop("options")
    return out.drop("value").withColumnRenamed("new_value", "value"), out.where(~F.col("value").eqNullSafe(F.col("new_value")))

"""Decisions: resolution, validation, application (C-02..C-05, V-02..V-04, V-09, M-06..M-10, SRC-28, H-12, SC-01, SC-03, SC-09, SC-13, U-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.latest import orphans


def dual_pass(pass1: Column, pass2: Column) -> Column:
    """C-02: both include, both exclude, else flagged."""
    return F.when((pass1 == "include") & (pass2 == "include"), "ABSTRACT_SCREENED_IN").when((pass1 == "exclude") & (pass2 == "exclude"), "ABSTRACT_SCREENED_OUT").otherwise("ABSTRACT_SCREEN_FLAGGED")


def verifier_override(status: Column, verifier: Column) -> Column:
    """C-03: a verifier that disagrees flags what was screened in."""
    return F.when((status == "ABSTRACT_SCREENED_IN") & (verifier == "exclude"), "ABSTRACT_SCREEN_FLAGGED").otherwise(status)


def full_text(decision: Column, verifier: Column, past: Column) -> Column:
    """C-04: papers past the stage keep their status (null here)."""
    return F.when(past, None).when(decision == "FT_EXCLUDE", "FT_SCREENED_OUT").when((decision == "FT_ELIGIBLE") & (verifier == "FT_FLAGGED"), "FT_FLAGGED").when(decision == "FT_ELIGIBLE", "FT_ELIGIBLE").otherwise("FT_FLAGGED")


def expanded_status(decision: Column, verifier: Column) -> Column:
    """C-05 / SC-01 / Q-21: include without a verifier is in; unknown is out."""
    return F.when(decision == "flagged", "ABSTRACT_SCREEN_FLAGGED").when((decision == "include") & (verifier.isNull() | (verifier == "include")), "ABSTRACT_SCREENED_IN").when(decision == "include", "ABSTRACT_SCREEN_FLAGGED").otherwise("ABSTRACT_SCREENED_OUT")


def errors(rows: DataFrame, known: DataFrame, key: str, decision: str, allowed: list[str], needs_note: list[str] = (), note: str = "note") -> DataFrame:
    """V-02..V-04: one row for each broken rule: unknown id, bad decision, missing note, repeated id."""
    bad = [
        rows.join(known.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("unknown id").alias("error")),
        rows.where(~F.coalesce(F.col(decision).isin(allowed), F.lit(False))).select(F.col(key).cast("string").alias("key"), F.lit("bad decision").alias("error")),
        rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).cast("string").alias("key"), F.lit("repeated").alias("error")),
    ]
    if needs_note:
        bad.append(rows.where(F.col(decision).isin(list(needs_note)) & (F.trim(F.coalesce(note, F.lit(""))) == "")).select(F.col(key).cast("string").alias("key"), F.lit("note missing").alias("error")))
    out = bad[0]
    for b in bad[1:]:
        out = out.union(b)
    return out


def apply_decisions(spans: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """M-07 / M-09: (spans with decided states and corrected values, papers with no unresolved span)."""
    d = decisions.select(*keys, F.col("decision").alias("_d"), F.col("correction").alias("_c"))
    out = spans.join(d, keys, "left")
    state = F.when(F.col("_d").isin("ACCEPT", "CORRECT"), "verified").when(F.col("_d") == "REJECT_VALUE", "rejected_value").otherwise(F.col("audit_status"))
    out = out.withColumn("audit_status", state).withColumn("value", F.when(F.col("_d") == "CORRECT", F.col("_c")).otherwise(F.col("value"))).drop("_d", "_c")
    open_ = F.count_if(~F.col("audit_status").isin("verified", "rejected_value"))
    return out, out.groupBy("paper_id").agg(open_.alias("unresolved")).where("unresolved = 0").select("paper_id")


def wide_to_long(rows: DataFrame, key: str) -> DataFrame:
    """SRC-28 / SNK-08: {field}_correction columns to (key, field_name, correction), blanks dropped."""
    columns = [c for c in rows.columns if c.endswith("_correction")]
    long = rows.select(key, *columns).unpivot(key, columns, "field_name", "correction")
    return long.withColumn("field_name", F.regexp_replace("field_name", "_correction$", "")).where(F.trim(F.coalesce("correction", F.lit(""))) != "")


def dispositions(papers: DataFrame, decided: DataFrame, final: list[str]) -> DataFrame:
    """M-10: proceed or exclude; finished papers are skipped."""
    d = decided.select("id", F.col("disposition").alias("_d"), F.col("exclude_reason").alias("_r"))
    free = ~F.col("status").isin(final)
    out = papers.join(d, "id", "left").withColumn("pdf_exclusion_reason", F.when(free & (F.col("_d") == "EXCLUDE"), F.col("_r")).otherwise(F.col("pdf_exclusion_reason")))
    return out.withColumn("status", F.when(free & (F.col("_d") == "EXCLUDE"), "PDF_EXCLUDED").otherwise(F.col("status"))).drop("_d", "_r").select(*papers.columns)


def cleanup_plan(spans: DataFrame, extractions: DataFrame) -> DataFrame:
    """M-06: what a clean-up would remove, by field (the dry run)."""
    # an extraction's spans are in one task already, so counting them by field there needs neither a shuffle nor a set of all extractions
    held = orphans(spans, extractions).groupBy("extraction_id", "field_name").agg(F.count("*").alias("n"))
    return held.groupBy("field_name").agg(F.sum("n").alias("n_spans"), F.count("extraction_id").alias("n_extractions"))


def slot_coverage(slots: Column, n: int) -> Column:
    """U-05: missing, repeated and out-of-range slots."""
    want = F.sequence(F.lit(1), F.lit(n))
    return F.struct(F.array_except(want, slots).alias("missing"), (F.size(slots) != F.size(F.array_distinct(slots))).alias("repeated"), F.array_except(slots, want).alias("out_of_range"))


def drift(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """V-09 / SC-13: keys whose values differ, null-safe."""
    a, b = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return a.join(b, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def retry(items: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """SC-03 / ST-04: items whose key is not in the fact yet."""
    return items.join(present.select(*keys).distinct(), keys, "left_anti")

"""Review queues, progress, costs and remaining helpers (A-06, A-09, A-10, A-31, A-37, A-40, A-42, A-43, A-45..A-51, A-53, A-56, C-17..C-20, C-22, F-09, F-14, F-17, J-17, J-21, J-22, V-03, H-03, H-08..H-12, H-17..H-19, H-26, H-31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.nulls import is_null_synonym
from concord.operators.latest import latest
from concord.operators.reports import SEVERITY, ranked


def quality_flagged(papers: DataFrame) -> DataFrame:
    """F-09: not English, or no full manuscript; nulls drop out, as in SQL."""
    return papers.where((F.col("language") != "English") | (F.col("content_type") != "full_manuscript"))


def effective_path(papers: DataFrame, assets: DataFrame) -> DataFrame:
    """F-14 / J-10: the newest asset's path, else the paper's own; one row a paper."""
    newest = assets.groupBy("paper_id").agg(F.max_by("path", "id").alias("asset_path"))
    return papers.join(newest, papers.id == newest.paper_id, "left").withColumn("effective_path", F.coalesce("asset_path", "pdf_path")).drop("paper_id")


def page_class(rows: DataFrame, kinds: list[str], languages: list[str]) -> DataFrame:
    """F-17: unknown kinds and languages become `other`; confidence is clamped."""
    return rows.withColumn("content_type", F.when(F.col("content_type").isin(kinds), F.col("content_type")).otherwise("other")).withColumn("language", F.when(F.col("language").isin(languages), F.col("language")).otherwise("other")).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))


def flagged_papers(papers: DataFrame, decisions: DataFrame, verifications: DataFrame, status: str) -> DataFrame:
    """J-22: papers of a status with their first decision and their latest verification."""
    first = decisions.where("pass = 1").groupBy("paper_id").agg(F.max_by(F.struct("decision", "rationale"), "id").alias("d"))
    last = verifications.groupBy("paper_id").agg(F.max_by(F.struct("decision", "rationale"), "id").alias("v"))
    out = papers.where(F.col("status") == status).join(first.withColumnRenamed("paper_id", "id"), "id", "left").join(last.withColumnRenamed("paper_id", "id"), "id", "left")
    return out.select(*papers.columns, F.col("d.decision").alias("decision"), F.col("d.rationale").alias("rationale"), F.col("v.decision").alias("verifier"), F.col("v.rationale").alias("verifier_rationale"))


def merge_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-06."""
    return a.unionByName(b, allowMissingColumns=True)


def progress(papers: DataFrame, done: DataFrame, rate_in: float, rate_out: float) -> DataFrame:
    """A-09 / A-10: done, remaining and cost, in millions of tokens."""
    n = papers.agg(F.count("*").alias("n"))
    d = done.agg(F.count_distinct("paper_id").alias("done"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    both = n.join(d)  # one row each
    return both.withColumn("remaining", F.col("n") - F.col("done")).withColumn("cost", F.round(F.col("input_tokens") / 1e6 * rate_in + F.col("output_tokens") / 1e6 * rate_out, 6))


def stale_count(extractions: DataFrame, current_hash: str) -> DataFrame:
    """A-06."""
    return extractions.where(F.col("schema_hash") != current_hash).agg(F.count_distinct("paper_id").alias("n"))


def feasibility(verdicts: DataFrame, targets: DataFrame) -> DataFrame:
    """A-31: what each target cell has and lacks; targets: verdict, arm, want."""
    have = verdicts.groupBy("verdict", "arm").agg(F.count("*").alias("have"))
    return targets.join(have, ["verdict", "arm"], "left").fillna(0, ["have"]).withColumn("short", F.greatest(F.col("want") - F.col("have"), F.lit(0)))


def model_agreement(rows: DataFrame, item: str, models: list[str]) -> DataFrame:
    """A-37: the share of items on which each pair of models says the same."""
    wide = rows.groupBy(item).agg(*[F.max(F.when(F.col("model") == m, F.col("verdict"))).alias(m) for m in models])
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = wide.agg(*[F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("agreement")) for a, b in pairs])))


def paper_documents(spans: DataFrame) -> DataFrame:
    """A-40: a paper's spans as one ordered array."""
    return spans.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(ranked(F.col("audit_status"), SEVERITY).alias("r"), "field_name", "value", "audit_status"))).alias("spans"))


def review_queue(spans: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """C-17 / T-04 / T-05: spans that are not verified, worst first, then tier (99 if unknown) and name."""
    out = spans.where(F.col("audit_status") != "verified")
    out = out.withColumn("tier", F.lit(99)) if tiers is None else out.join(tiers.select("field_name", "tier"), "field_name", "left").withColumn("tier", F.coalesce("tier", F.lit(99)))
    return out.orderBy(ranked(F.col("audit_status"), SEVERITY), "tier", "field_name", "paper_id")


def unresolved(spans: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """A-42 / H-14: papers with unverified spans and no decision."""
    return spans.where(F.col("audit_status") != "verified").join(adjudicated, ["paper_id", "field_name"], "left_anti").agg(F.count_distinct("paper_id").alias("n"))


def queue_counts(rows: DataFrame, column: str, null_name: str = "unknown", last: str | None = None) -> DataFrame:
    """A-43 / A-47 / A-48: counts, one name ahead of the rest, nulls under their own name."""
    name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(null_name))
    return rows.groupBy(name.alias(column)).agg(F.count("*").alias("n")).orderBy(F.col(column) != "ambiguous", F.col(column) == (last or null_name), column)


def queue_summary(worst: DataFrame, *keys: str) -> DataFrame:
    """A-49 / A-50 / A-51."""
    return worst.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("worst") == s).alias(s) for s in SEVERITY])


def run_summary(runs: DataFrame) -> DataFrame:
    """A-45 / SNK-06: counters from facts, and whether they add up."""
    return runs.groupBy("run_id").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")).withColumn("valid", F.col("succeeded") + F.col("failed") == F.col("attempted"))


def coverage(wide: DataFrame, fields: list[str]) -> DataFrame:
    """A-53: filled cells and share of each column."""
    one = wide.agg(F.count("*").alias("_n"), *[F.count_if(~is_null_synonym(F.col(f))).alias(f) for f in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("filled"), F.try_divide(F.col(f), F.col("_n")).alias("share")) for f in fields])))


def budget_check(wanted: DataFrame, available: DataFrame, limit: float) -> DataFrame:
    """A-56: wanted models by name or `name:tag` prefix, their memory against a limit."""
    names = wanted.select(F.explode(F.array(F.col("name"))).alias("want")).distinct()
    # a name is wanted as it is, or by the part before its tag
    bare = F.regexp_extract("name", "^([^:]*):", 1)
    keyed = available.withColumn("_id", F.monotonically_increasing_id()).withColumn("want", F.explode(F.array_distinct(F.array("name", F.when(F.col("name").contains(":"), bare).otherwise(F.col("name"))))))
    hit = keyed.join(names, "want", "left_semi").dropDuplicates(["_id"])
    return hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("gb"), F.lit(0.0)).alias("gb")).withColumn("fits", F.col("gb") <= limit)


def judge_inputs(wide: DataFrame, arms: list[str]) -> DataFrame:
    """C-18 / H-21: one row a (paper, field, arm) with its slot, for cells with two or more arms."""
    long = wide.unpivot(["paper_id", "field_name"], arms, "arm", "value").where("value IS NOT NULL")
    enough = long.groupBy("paper_id", "field_name").agg(F.count("*").alias("n_arms")).where("n_arms >= 2")
    return long.join(enough, ["paper_id", "field_name"])


def with_verdict_type(verdicts: DataFrame, ratings: DataFrame) -> DataFrame:
    """J-17 / H-05: the field type of each verdict; one type a field, the smallest name."""
    return verdicts.join(ratings.groupBy("paper_id", "field_name").agg(F.min("field_type").alias("field_type")), ["paper_id", "field_name"])


def with_flags(ratings: DataFrame, flags: DataFrame) -> DataFrame:
    """J-21: a missing flag is false."""
    return ratings.join(flags, ["paper_id", "field_name"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def source_windows(rows: DataFrame, whole: int, head: int) -> DataFrame:
    """C-19 / H-08: whole text, a window around the span, or the head, by length and whether the span was found."""
    strategy = F.when(F.length("source_text") <= whole, "whole").when(F.col("at") >= 0, "window").otherwise("head")
    text = F.when(F.length("source_text") <= whole, F.col("source_text")).when(F.col("at") >= 0, F.substring("source_text", F.greatest(F.col("at") - F.lit(whole // 2), F.lit(0)) + 1, F.lit(whole))).otherwise(F.substring("source_text", 1, head))
    return rows.withColumn("strategy", strategy).withColumn("window", text)


def backfill(known: DataFrame, rows: DataFrame, key: str, status: Column) -> DataFrame:
    """C-20 / H-18: rows that are not known yet, with a derived status; of rows with one key the last wins."""
    return latest(rows, [key], ["ord"]).join(known.select(key), key, "left_anti").withColumn("status", status)


def stray_field(values: DataFrame, known: list[str]) -> DataFrame:
    """C-22: rows under a field that is not in the specification, with the likely cause."""
    bad = values.where(~F.col("field_name").isin(known))
    return bad.withColumn("cause", F.when(F.col("field_name").rlike(r"^field_\d+$"), "unnamed column").when(F.trim("field_name") == "", "empty name").otherwise("unknown field"))


def snippets_by_arm(arms: DataFrame, order: list[str]) -> DataFrame:
    """H-03: all arms' snippets of each cell in columns."""
    return arms.groupBy("paper_id", "field_name").agg(*[F.max(F.when(F.col("arm") == a, F.col("snippet"))).alias(a) for a in order])


def paper_label(authors: Column, year: Column, paper_id: Column) -> Column:
    """H-10: the last word of the first author and the year; authors are a JSON array or a `;` list; the id where there is no author."""
    listed = F.from_json(authors, "array<string>")
    first = F.when(listed.isNotNull(), F.get(listed, F.lit(0))).otherwise(F.split_part(authors, F.lit(";"), F.lit(1)))
    name = F.regexp_extract(first, r"(\S+)\s*$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", paper_id.cast("string")).otherwise(F.concat(name, F.lit(" "), F.coalesce(year.cast("string"), F.lit("None"))))


def with_defaults(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """H-11: type and tier of each field, `free_text` and 99 where unknown."""
    return rows.join(fields.select("field_name", "field_type", "tier"), "field_name", "left").fillna({"field_type": "free_text", "tier": 99})


def extractor_of(path: Column) -> Column:
    """H-26: the one letter after the last underscore of a file name, upper-cased; any other name fails the action."""
    letter = F.regexp_extract(path, r"_(\p{L})(?:\.[^./\\]*)?$", 1)
    return F.when(letter != "", F.upper(letter)).otherwise(F.raise_error(F.concat(F.lit("no extractor in the file name "), path)))


def limit_for(name: Column, rules: list[tuple[str, int]], other: int = 600) -> Column:
    """H-31: the limit of the first pattern that matches a name."""
    out = F.lit(other)
    for pattern, limit in reversed(rules):
        out = F.when(name.rlike(pattern), limit).otherwise(out)
    return out

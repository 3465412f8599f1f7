"""Counts, cross-tabs, flow, percentiles, gates, pivots (A-01..A-04, A-08..A-10, A-21..A-56, C-16, C-22, T-01..T-05, V-01, V-05, V-08)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord import lifecycle as L
from concord.functions.nulls import is_populated
from concord.operators.scan import place, running

BINS = 4096  # of nearest_rank

# Rating and verdict domains
LEVEL1 = ["EQUIVALENT", "PARTIAL", "DIVERGENT"]
LEVEL2 = ["GRANULARITY", "SELECTION", "OMISSION", "CONTRADICTION", "FABRICATION"]
VERDICTS = ["SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED"]


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """A-01."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pipeline_stats(papers: DataFrame) -> DataFrame:
    """A-02: one pass."""
    named = {"screened_in": ["ABSTRACT_SCREENED_IN"], "screened_out": ["ABSTRACT_SCREENED_OUT"], "flagged": ["ABSTRACT_SCREEN_FLAGGED"], "parsed": ["PARSED"], "extracted": ["EXTRACTED"], "audited": L.INCLUDED}
    return papers.agg(F.count("*").alias("total"), *[F.count_if(F.col("status").isin(v)).alias(k) for k, v in named.items()])


def prisma_flow(papers: DataFrame) -> DataFrame:
    """A-03: the flow in one aggregate row."""
    s = F.col("status")
    n = lambda *v: F.count_if(s.isin(*v))
    reached = lambda before: F.count_if(~s.isin(before))
    out = papers.agg(
        F.count("*").alias("identified"), (reached(L.BEFORE_SCREENING) + n("ABSTRACT_SCREENED_OUT", "ABSTRACT_SCREEN_FLAGGED")).alias("screened"), n("ABSTRACT_SCREENED_OUT").alias("excluded"),
        n("ABSTRACT_SCREEN_FLAGGED").alias("screen_flagged"), n("PDF_EXCLUDED").alias("pdf_excluded"), F.count_if((s == "PDF_EXCLUDED") & (F.col("pdf_exclusion_reason") == "INACCESSIBLE")).alias("not_retrieved"),
        reached(L.BEFORE_FULL_TEXT).alias("full_text_retrieved"), n("FT_SCREENED_OUT").alias("ft_screened_out"), n("FT_FLAGGED").alias("ft_flagged"), n("EXTRACT_FAILED").alias("extract_failed"),
        n(*L.INCLUDED).alias("included"), n("REJECTED").alias("rejected"), F.count_if((s == "REJECTED") & F.lower("rejected_reason").contains("low_yield")).alias("low_yield_rejected"),
        F.count_if(~s.isin(*L.INCLUDED, *L.EXCLUDED)).alias("in_progress"),
    )
    return out


def prisma_by_source(papers: DataFrame) -> DataFrame:
    """A-03: records, exclusions of files and included studies by source."""
    s = F.col("status")
    return papers.groupBy("source").agg(F.count("*").alias("n"), F.count_if(s == "PDF_EXCLUDED").alias("pdf_excluded"), F.count_if(s.isin(*L.INCLUDED)).alias("included"))


def ft_split(papers: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """A-03: full-text exclusions that a person decided, and those of the first screening alone."""
    out = papers.where("status = 'FT_SCREENED_OUT'").join(adjudicated.select(F.col("paper_id").alias("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
    return out.agg(F.count("*").alias("ft_screened_out"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("adjudicated"), F.count_if(F.col("_hit").isNull()).alias("primary_only"))


def prisma_reconcile(flow: DataFrame, by_source: DataFrame) -> DataFrame:
    """V-01: the boxes must add up to the records that the sources were counted to hold, and parts must not exceed their wholes."""
    total = F.col("excluded") + F.col("pdf_excluded") + F.col("ft_screened_out") + F.col("rejected") + F.col("included") + F.col("in_progress")
    counted = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"), F.coalesce(F.sum("included"), F.lit(0)).alias("counted_included"))
    checks = [F.col("counted") == total, F.col("counted_included") == F.col("included"), F.col("not_retrieved") <= F.col("pdf_excluded"), F.col("screened") <= F.col("identified"), F.col("low_yield_rejected") <= F.col("rejected")]
    rows = flow.join(counted)  # one row each
    return rows.select("counted", total.alias("accounted"), (F.col("counted") - total).alias("discrepancy"), F.size(F.filter(F.array(*checks), lambda c: ~c)).alias("n_broken"), reduce(lambda a, b: a & b, checks).alias("valid"))


def reasons(papers: DataFrame, status: str, column: str) -> DataFrame:
    """A-04."""
    return papers.where(F.col("status") == status).groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("No reason given")).alias("reason")).agg(F.count("*").alias("n"))


def model_counts(extractions: DataFrame) -> DataFrame:
    """A-08."""
    return extractions.groupBy("model").agg(F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_extractions"))


def list_text(rows: DataFrame, name: str, n: str) -> DataFrame:
    """H-28: `A (n=x), B (n=y) and C (n=z)`."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("o"), F.col(name).alias("name"), F.col(n).alias("n")))), lambda x: F.concat(x["name"], F.lit(" (n="), x["n"].cast("string"), F.lit(")")))
    one = rows.agg(parts.alias("p"))
    return one.select(F.when(F.size("p") < 2, F.array_join("p", "")).otherwise(F.concat(F.array_join(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at("p", -1))).alias("text"))


def crosstab(df: DataFrame, keys: list[str], column: str, values: list[str], total: str = "total") -> DataFrame:
    """A-21..A-24, A-27, A-54: counts by a fixed list of values, zero where there is none, and their sum."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count_if(F.col(column).isin(values)).alias(total))


def level1_table(ratings: DataFrame) -> DataFrame:
    """A-21 with the share of EQUIVALENT and its flag."""
    out = crosstab(ratings, ["field_name"], "level1", LEVEL1)
    pct = F.round(100.0 * F.col("EQUIVALENT") / F.col("total"), 1)
    return out.withColumn("pct_eq", pct).withColumn("flag", F.when(pct >= 90, "HIGH_EQ").when(pct <= 10, "LOW_EQ").otherwise(""))


def verdict_sets(verdicts: DataFrame) -> DataFrame:
    """A-27 / A-50: verdicts by arm, by field type, and by (field, arm), in one grouping-sets pass."""
    sets = [[verdicts.arm], [verdicts.field_type], [verdicts.field_name, verdicts.arm], []]
    out = verdicts.groupingSets(sets, verdicts.arm, verdicts.field_type, verdicts.field_name)
    return out.agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], F.grouping_id().cast("int").alias("grouping"))


def bfilter(ratings: DataFrame) -> DataFrame:
    """F-13 / A-25: high, or medium with a flag; trip rate by risk over cells."""
    cells = ratings.groupBy("paper_id", "field_name").agg(F.max(F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)).alias("r"), F.bool_or("tripped").alias("flag"))
    keep = (F.col("r") == 2) | ((F.col("r") == 1) & F.col("flag"))
    return cells.groupBy(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("r") + 1).alias("risk")).agg(F.count("*").alias("n"), F.count_if("flag").alias("tripped"), F.count_if(keep).alias("kept"), F.round(100.0 * F.count_if("flag") / F.count("*"), 1).alias("trip_rate"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, ps: list[int]) -> DataFrame:
    """A-32: the value at the half-even rank of (n - 1) * p / 100, of a numeric column.

    Each group's range is cut into BINS equal bins that are counted; only the
    values of the bins that hold a wanted rank are then ranked one by one, so
    that no group is gathered or sorted whole.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    share = F.coalesce(F.try_divide((F.col("_v") - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0))
    binned = rows.join(ends, keys).select(*keys, "_v", "n", F.floor(share * BINS).alias("_bin"))
    w = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS + 1 rows a group
    bins = binned.groupBy(*keys, "_bin", "n").agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(w), F.lit(0)))
    rank = lambda p: F.bround(F.lit(p) / 100.0 * (F.col("n") - 1))
    here = lambda p: (F.col("_before") <= rank(p)) & (rank(p) < F.col("_before") + F.col("_in"))
    wanted = bins.where(reduce(lambda a, b: a | b, [here(p) for p in ps])).select(*keys, "_bin", "_before")
    tally = binned.join(wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", "_before", "n", "_v").agg(F.count("*").alias("_in"))
    upto = F.col("_before") + F.sum("_in").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    run = tally.withColumn("_upto", upto)
    return run.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_upto") > rank(p), F.col("_v"))).alias(f"p{p}") for p in ps])


def length_stats(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A-33: mean, median, sample deviation (0 for one row), least and most characters, and words."""
    n = F.length(text)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.round(F.coalesce(F.stddev_samp(n), F.lit(0.0)), 6).alias("stdev"), F.min(n).alias("least"), F.max(n).alias("most"))


def histogram(df: DataFrame, value: Column, edges: list[int]) -> DataFrame:
    """A-34: counts of [edge, next edge); empty buckets are zero."""
    names = [f"{a}-{b}" if b is not None else f"{a}+" for a, b in zip(edges, [*edges[1:], None], strict=True)]
    cut = [(value >= a) & ((value < b) if b is not None else F.lit(True)) for a, b in zip(edges, [*edges[1:], None], strict=True)]
    one = df.agg(*[F.count_if(c).alias(n) for n, c in zip(names, cut, strict=True)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("n")) for i, n in enumerate(names)])))


def verification_rate(spans: DataFrame, keys: list[str]) -> DataFrame:
    """A-35."""
    return spans.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("audit_status") == "verified").alias("verified"), F.round(F.count_if(F.col("audit_status") == "verified") / F.count("*"), 6).alias("rate"))


# Audit states from worst
SEVERITY = ["invalid_snippet", "flagged", "contested", "pending", "verified"]


def worst_state(spans: DataFrame, key: str = "extraction_id") -> DataFrame:
    """A-41 / A-52: the worst state, and `n STATE, ...` from worst to best."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("audit_status"))
    each = spans.groupBy(key, rank.alias("r"), "audit_status").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "n", "audit_status"))), lambda x: F.concat_ws(" ", x.n.cast("string"), F.upper(x.audit_status))), ", ")
    return each.groupBy(key).agg(F.min_by("audit_status", "r").alias("worst"), text.alias("summary"), F.sum("n").alias("n_spans"))


def evidence_wide(current: DataFrame, fields: list[str]) -> DataFrame:
    """C-16: value, confidence and state of each field in columns, one row a paper."""
    cell = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    return current.groupBy("paper_id").agg(*[cell(f, c).alias(f"{f}_{n}") for f in fields for c, n in (("flag", "value"), ("confidence", "confidence"), ("audit_status", "state"))])


def field_coverage(current: DataFrame, least: int) -> DataFrame:
    """A-36: papers with fewer than `least` spans."""
    return current.groupBy("paper_id").agg(F.count("*").alias("n_fields")).where(F.col("n_fields") < least)


def low_yield(current: DataFrame, least: int = 4, value: str = "value") -> DataFrame:
    """A-39: papers with fewer than `least` populated fields; absence values do not count."""
    return current.groupBy("paper_id").agg(F.count_if(is_populated(F.col(value))).alias("n_populated")).where(F.col("n_populated") < least)


def top(df: DataFrame, key: str, n: int, ties: list[Column]) -> DataFrame:
    """T-01 / T-02: largest counts first (sort and limit in one operator)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *ties).limit(n)


def id_order(column: str) -> list[Column]:
    """T-03: numbers first by value, then text."""
    number = F.col(column).try_cast("bigint")
    return [number.asc_nulls_last(), F.col(column)]


def ranked(column: Column, order: list[str]) -> Column:
    """T-04 / T-05: the place in a list, 99 if it is not there."""
    at = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(at > 0, at).otherwise(99)


def group_rank(df: DataFrame, group: str, item: str) -> DataFrame:
    """W-04: groups by size and name, items (whole numbers, unique in a group) within.

    Sizes are ranked by a scan, names within a size, and items by a scan within the group, so a large group is not sorted in one
    task; only groups of one size are.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("group_n"))
    larger = running(sizes.groupBy("group_n").agg(F.count("*").alias("_groups")).withColumn("_order", -F.col("group_n")), "_order", {"_up_to": F.col("_groups")})
    ahead = larger.select("group_n", (F.col("_up_to") - F.col("_groups")).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("group_n").orderBy(group))
    ranked = sizes.join(ahead, "group_n").select(group, "group_n", (F.col("_ahead") + within).alias("group_rank"))
    return place(df, item, "item_rank", [group]).join(ranked, group)


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A-44: one aggregate row, turned into (gate, passed)."""
    one = df.agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(F.col(k), F.lit(False)).alias("passed")) for k in checks])))


def violations(df: DataFrame, rules: dict[str, Column], key: list[str] | None = None) -> DataFrame:
    """V-05 / V-06 / V-08: rows against each rule, and repeated keys, as (rule, n)."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])))
    if key:
        out = out.union(df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit("unique").alias("rule"), F.count("*").alias("n")).select("rule", "n"))
    return out


def duration(runs: DataFrame) -> DataFrame:
    """A-55: seconds, and seconds per success (0 without one)."""
    s = F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")
    return runs.withColumn("seconds", s).withColumn("per_success", F.coalesce(F.try_divide(s, F.nullif(F.col("succeeded"), F.lit(0))), F.lit(0.0)))

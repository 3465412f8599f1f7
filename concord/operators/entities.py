"""Entity resolution of two citation sources (C-01, J-15, J-16, JS-06, SC-02, SC-05..SC-07, SNK-01, U-03, U-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import title_key
from concord.operators.latest import cascade
from concord.operators.similar import similar_pairs


def stable_key(doi: Column, pmid: Column, title: Column) -> Column:
    """SC-02."""
    return F.coalesce(F.nullif(doi, F.lit("")), F.nullif(pmid, F.lit("")), title)


def keyed(citations: DataFrame) -> DataFrame:
    return citations.withColumn("doi_key", F.lower(F.trim("doi"))).withColumn("title_key", F.nullif(title_key(F.col("title")), F.lit("")))


def exact_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """C-01, exact phase: every row of b with a_ord, the smallest ordinal of a it matches, by DOI, then PMID, then title; `hit` names the key."""
    side = keyed(a).select(F.col("ord").alias("a_ord"), "doi_key", "pmid", "title_key")
    return cascade(keyed(b), side, ["doi_key", "pmid", "title_key"], "a_ord")


def fuzzy_matches(a: DataFrame, b: DataFrame, least: float = 0.9) -> DataFrame:
    """C-01 / J-16, fuzzy phase: ord and a_ord of all titles with a ratio over `least`; the smallest ordinal of a wins. See `similar`: no pair is lost."""
    prep = lambda df: keyed(df).where("title_key <> ''").select("ord", "title_key")
    # equal titles are one row on either side, however many records have them
    once = lambda df: prep(df).groupBy("title_key").agg(F.min("ord").alias("id")).withColumnRenamed("title_key", "text")
    pairs = similar_pairs(once(a), once(b), least, first=True)
    best = pairs.groupBy("b_id").agg(F.min("a_id").alias("a_ord"), F.min_by("ratio", "a_id").alias("ratio"))
    titles = once(b).join(best, F.col("id") == F.col("b_id")).select(F.col("text").alias("title_key"), "a_ord", "ratio")
    return prep(b).join(titles, "title_key").select("ord", "a_ord", "ratio")


def merge(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """JS-06: a's records, nulls filled from the first matching record of b (rows of b carry a_ord)."""
    fill = b.where("a_ord IS NOT NULL").groupBy("a_ord").agg(F.min_by(F.struct(*fields), "ord").alias("_b"))
    out = a.join(fill, a.ord == fill.a_ord, "left")
    return out.select(*[F.coalesce(a[c], F.col(f"_b.{c}")).alias(c) if c in fields else a[c] for c in a.columns])


def deduplicate(a: DataFrame, b: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """C-01: (unique records, rows of b that matched, with a_ord). Exact keys first, then fuzzy titles on the rest, then b among itself by its keys."""
    exact = exact_matches(a, b)
    rest = exact.where("a_ord IS NULL").select(*b.columns)
    fuzzy = fuzzy_matches(a, rest)
    matched = exact.where("a_ord IS NOT NULL").select(*b.columns, "a_ord").unionByName(rest.join(fuzzy.select("ord", "a_ord"), "ord").select(*b.columns, "a_ord"))
    fresh = keyed(rest.join(fuzzy, "ord", "left_anti"))
    for key in ("doi_key", "pmid", "title_key"):
        heads = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("_head"))
        fresh = fresh.join(heads, key, "left").where("_head IS NULL OR _head = ord").drop("_head")
    unique = merge(a, matched, fields).unionByName(fresh.select(*a.columns))
    return unique, matched


def key_coverage(citations: DataFrame) -> DataFrame:
    """SC-06."""
    d, p = F.coalesce(F.col("doi") != "", F.lit(False)), F.coalesce(F.col("pmid") != "", F.lit(False))
    return citations.agg(F.count_if(d & ~p).alias("doi_only"), F.count_if(p & ~d).alias("pmid_only"), F.count_if(d & p).alias("both"), F.count_if(~d & ~p).alias("neither"))


def add_new(known: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-01: incoming rows whose key is not known, the first of each key; rows without a key are all new."""
    keyless = incoming.where(F.col(key).isNull())
    fresh = incoming.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*").unionByName(keyless)


def missing(wanted: DataFrame, on_disk: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """SC-07: wanted, not on disk, with the last failure."""
    return wanted.join(on_disk, key, "left_anti").join(log.groupBy(key).agg(F.max_by("reason", "seq").alias("reason")), key, "left").withColumn("reason", F.coalesce("reason", F.lit("not attempted")))

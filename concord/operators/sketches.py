"""A-46: sketches of distinct values and of quantiles that are stored by run and merged later.

A run's sketches are one row a group, of bounded size, whatever the run holds;
merging reads those rows alone. A theta sketch also counts what two groups share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS = 14  # 2^14 registers: a relative standard error of about 0.7 %
KLL_K = 800  # a rank error of about 0.4 %
THETA_BITS = 14


def sketched(rows: DataFrame, keys: list[str], item: str, number: str) -> DataFrame:
    """One row a group: n (rows), hll and theta of `item`, kll of `number`. Nulls enter no sketch; a group without numbers has a null kll."""
    # the functions of distinct values take text; a double is what quantiles are of
    text = F.col(item).cast("string")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(text, HLL_BITS).alias("hll"), F.theta_sketch_agg(text, THETA_BITS).alias("theta"),
        F.kll_sketch_agg_double(F.col(number).cast("double"), KLL_K).alias("kll"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches of finer groups, or of several runs, as those of `keys`; the same as if all rows had been sketched at once, within the error."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_BITS).alias("theta"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"))


def estimates(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """n_distinct (by hll), and q50, q95 and so on by kll, null without numbers."""
    some = F.kll_sketch_get_n_double("kll") > 0
    quantile = lambda p: F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(p)))
    return sketches.select("*", F.hll_sketch_estimate("hll").alias("n_distinct"), *[quantile(p).alias(f"q{round(100 * p)}") for p in shares]).drop("hll", "theta", "kll")


def rank_of(sketch: Column, value: Column) -> Column:
    """The share of numbers at or below a value."""
    return F.kll_sketch_get_rank_double(sketch, value)


def shared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct items that the groups of two sketched sides have in common, and that either has."""
    both = a.select(*keys, F.col("theta").alias("_a")).join(b.select(*keys, F.col("theta").alias("_b")), keys)
    size = lambda v: F.theta_sketch_estimate(v)
    return both.select(*keys, size(F.theta_intersection("_a", "_b")).alias("n_shared"), size(F.theta_union("_a", "_b", THETA_BITS)).alias("n_either"))

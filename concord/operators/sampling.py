"""Seeded samples and permutations (T-06..T-13, W-03, W-05, W-08, W-09, C-19, C-24, C-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.scan import place


def hash_rank(seed: int, *parts: Column) -> Column:
    """A place in a seeded order that does not depend on partitions."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def smallest(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """The k smallest rows of each key: each task keeps its own k first, so that a hot key is k rows a task."""
    local = df.withColumn("_p", F.spark_partition_id())
    cut = lambda d, by: d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= k).drop("_r")
    return cut(cut(local, [*keys, "_p"]).drop("_p"), keys)


def stratified(df: DataFrame, strata: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """T-06: k rows of each stratum."""
    return smallest(df.withColumn("_h", hash_rank(seed, *[F.col(s) for s in strata], F.col(key))), strata, "_h", k).drop("_h")


def under_supplied(df: DataFrame, strata: list[str], k: int) -> DataFrame:
    """T-07: strata with fewer than k rows."""
    return df.groupBy(*strata).agg(F.count("*").alias("n")).where(F.col("n") < k)


def fraction(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """T-08: max(1, int(n * share)) rows, the first in seeded order.

    Rows are counted by the first four digits of their hash. Whole classes
    below the last wanted row are taken by a filter; only its class is sorted.
    """
    rows = df.withColumn("_h", hash_rank(seed, F.col(key))).withColumn("_c", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    classes = sorted((r["_c"], r["n"]) for r in rows.groupBy("_c").agg(F.count("*").alias("n")).collect())  # 65,536 at most
    wanted, seen, last = max(1, int(sum(n for _, n in classes) * share)), 0, -1
    for c, n in classes:
        if seen + n >= wanted:
            last = c
            break
        seen += n
    edge = rows.where(F.col("_c") == last).orderBy("_h").limit(max(0, wanted - seen))
    return rows.where(F.col("_c") < last).unionByName(edge).drop("_h", "_c")


def shuffled(sample: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """W-03: row ids 1..n in seeded order: a scan over 60 bits of the hash, and the whole hash among the few that share them."""
    h = hash_rank(seed, F.col(key))
    placed = place(sample.withColumn("_h", h).withColumn("_o", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")), "_o", "row_id")
    same = Window.partitionBy("_o")
    return placed.withColumn("row_id", F.col("row_id") - F.count("*").over(same) + F.row_number().over(same.orderBy("_h", key))).drop("_h", "_o")


def is_monotonic(df: DataFrame, order: str, value: str) -> DataFrame:
    """W-05: whether the order, a unique whole number, leaks the sequence of the values; each row meets the one before it by its place."""
    rows = place(df.select(order, value), order, "_p").select("_p", F.col(value).alias("_v"))
    earlier = rows.select((F.col("_p") + 1).alias("_p"), F.col("_v").alias("_u"))
    return rows.join(earlier, "_p").agg(F.coalesce(F.bool_and(F.col("_v") > F.col("_u")), F.lit(True)).alias("monotonic"))


def permutation(arms: Column, seed: Column) -> Column:
    """T-11: an array of arms in seeded order; its inverse is element_at(permutation, slot)."""
    return F.transform(F.array_sort(F.transform(arms, lambda a: F.struct(F.sha2(F.concat_ws("|", seed.cast("string"), a), 256).alias("h"), a.alias("a")))), lambda s: s.a)


def round_robin(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """W-08: the k first rows, one of each key in turn."""
    each = smallest(df, [key], order, k)
    return each.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).orderBy("rn", key).limit(k)


def first_strata(df: DataFrame, key: str, strata: list[tuple[str, Column, int]], order: str) -> DataFrame:
    """W-09: n rows of each stratum in turn, without those already chosen; at most seven strata."""
    chosen = None
    for name, where, n in strata:
        left = df.where(where) if chosen is None else df.where(where).join(chosen.select(key), key, "left_anti")
        now = left.orderBy(order).limit(n).withColumn("stratum", F.lit(name))
        chosen = now if chosen is None else chosen.unionByName(now)
    return chosen


def examples(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """T-13: the first row of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def leaks(df: DataFrame, columns: list[str], forbidden: list[str]) -> DataFrame:
    """C-24: rows that show a forbidden string."""
    text = F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]))
    hit = F.lit(False)
    for x in forbidden:
        hit |= text.contains(x.lower())
    return df.where(hit)


def precision(sample: DataFrame, key: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """C-25: the share of correct rows per class after unblinding."""
    return sample.join(key, on).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("precision"))

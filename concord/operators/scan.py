"""Running totals and places in a global order, at any size and skew (W-02, W-04, W-06, W-07).

A 64-bit order is read as digits of BITS bits. Rows are summed by all digits but
the last, these sums by all but the last two, and so on; each level adds up what
is before it within its parent. So no task ever orders more than 2^BITS rows or
sums, whatever the values are and however many rows a key has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def _joined(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """a with the `names` columns of b; a null key is a key."""
    right = b.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *names)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return a.join(right, same).drop(*[f"_r{i}" for i in range(len(keys))])


def running(df: DataFrame, order: str, sums: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """`seen` (rows so far, this one included) and running sums in the order of a whole number that is unique within keys.

    Repeated numbers are taken together: their rows have the totals behind the last of them. Rows without a number come last, with
    null totals. A null adds nothing to a sum.
    """
    keys, names = list(keys), ["seen", *sums]
    place = F.col(order).cast("long")
    rows = df.select("*", place.alias("_d0"), F.shiftright(place, BITS).alias("_d1"), F.lit(1).cast("long").alias("_seen"), *[v.alias(f"_{k}") for k, v in sums.items()])
    total = [F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(f"_{n}") for n in names]
    levels = [rows.where("_d1 IS NOT NULL").groupBy(*keys, "_d1").agg(*total)]
    depth = -(-64 // BITS)
    for i in range(2, depth):
        above = levels[-1].withColumn(f"_d{i}", F.shiftright(f"_d{i - 1}", BITS))
        levels.append(above.groupBy(*keys, f"_d{i}").agg(*total))

    def before(level: DataFrame, i: int, parent: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, *parent).orderBy(f"_d{i}").rowsBetween(Window.unboundedPreceding, -1)
        return level.select("*", *[F.coalesce(F.sum(f"_{n}").over(w), F.lit(0)).alias(f"_e_{n}") for n in names])

    done = before(levels[-1], depth - 1, [])
    for i in range(depth - 2, 0, -1):
        up = f"_d{i + 1}"
        here = before(levels[i - 1].withColumn(up, F.shiftright(f"_d{i}", BITS)), i, [up])
        outer = done.select(*keys, up, *[F.col(f"_e_{n}").alias(f"_o_{n}") for n in names])
        both = _joined(here, outer, [*keys, up], [f"_o_{n}" for n in names])
        done = both.select(*keys, f"_d{i}", *[(F.col(f"_o_{n}") + F.col(f"_e_{n}")).alias(f"_e_{n}") for n in names])
    so_far = Window.partitionBy(*keys, "_d1").orderBy("_d0").rangeBetween(Window.unboundedPreceding, 0)
    out = _joined(rows.where("_d1 IS NOT NULL"), done, [*keys, "_d1"], [f"_e_{n}" for n in names])
    own = [F.coalesce(F.sum(f"_{n}").over(so_far), F.lit(0)) for n in names]
    placed = out.select(*df.columns, *[(F.col(f"_e_{n}") + x).alias(n) for n, x in zip(names, own, strict=True)])
    return placed.unionByName(rows.where("_d1 IS NULL").select(*df.columns), allowMissingColumns=True)


def place(df: DataFrame, order: str, name: str, keys: list[str] = ()) -> DataFrame:
    """The place of each row, from 1, in the order of a whole number that is unique within keys; null without a number."""
    return running(df, order, {}, keys).withColumnRenamed("seen", name)

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge; root is the smallest node that it reaches.

    A round joins each node with its smallest neighbour only, so it moves a
    few rows an edge, and the number of rounds is logarithmic in the size of
    a component. Each round is checkpointed. No edges give no rows.
    """
    pair = lambda big, small: F.struct(F.greatest(big, small).alias("u"), F.least(big, small).alias("v"))
    now = durable(edges.where(F.col(a) != F.col(b)).select(pair(F.col(a), F.col(b)).alias("e")).select("e.*").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pair(F.col("v"), F.col("m")), pair(F.col("u"), F.col("m")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = durable(small)
        if (new := mark(now)) == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

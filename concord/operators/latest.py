"""Latest-version, pending and orphan selection (J-01..J-10, W-01, W-02, W-11, SRC-17, F-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.scan import place

TASK_ROWS = 1 << 18


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """J-03..J-05: the last row of each key by `order`, in one aggregation without a self-join."""
    place = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), place).alias("r")).select("r.*")


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W-11: the first row of each key by `order`."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def stale(extractions: DataFrame, current_hash: str) -> DataFrame:
    """J-03 / A-06: papers whose latest extraction has another schema hash."""
    return latest(extractions, ["paper_id"], ["id"]).where(F.col("schema_hash") != current_hash)


def pending(papers: DataFrame, done: DataFrame, key: str = "id", other: str = "paper_id") -> DataFrame:
    """J-06: rows without a partner; an explicit anti-join, so that it can be shuffled."""
    return papers.join(done.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by a key over so many tasks that one has about TASK_ROWS, however large the table is; later steps by this key need no other shuffle."""
    tasks = -(-rows.select(key).count() // TASK_ROWS)
    return rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def orphans(spans: DataFrame, extractions: DataFrame) -> DataFrame:
    """J-07: spans of extractions that are not the latest of their paper."""
    heads = extractions.groupBy("paper_id").agg(F.max("id").alias("extraction_id")).select("extraction_id")
    return dealt(spans, "extraction_id").join(heads, "extraction_id", "left_anti")


def childless(heads: DataFrame, children: DataFrame, key: str = "extraction_id") -> DataFrame:
    """J-08."""
    return heads.join(children.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def current_spans(extractions: DataFrame, spans: DataFrame) -> DataFrame:
    """J-01 with J-03: one span per (paper, field) of each paper's latest extraction; the newest span wins (Q-1)."""
    heads = latest(extractions, ["paper_id"], ["id"]).select(F.col("id").alias("extraction_id"), "paper_id")
    return latest(heads.join(spans, "extraction_id"), ["paper_id", "field_name"], ["span_no"])


def labelled(papers: DataFrame, order: str = "id") -> DataFrame:
    """W-02: ee_label from the id, and ee_seq, the place in the ordered set."""
    return place(papers, order, "ee_seq").withColumn("ee_label", F.format_string("EE-%03d", F.col(order)))


def cascade(df: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """J-15: left joins by several keys, the first key that hits wins; `hit` names it. The smallest value of a key is taken.

    Rows without a key join by a key of their own that hits nothing, so that they do not meet in one task.
    """
    out = df
    lone = F.concat(F.lit("\x00"), F.xxhash64(*df.columns).cast("string"))
    for k in keys:
        side = lookup.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(F.col(k).alias(f"_{k}")).agg(F.min(value).alias(f"_by_{k}"))
        out = out.withColumn(f"_{k}", F.coalesce(F.nullif(F.col(k), F.lit("")), lone)).join(side, f"_{k}", "left").drop(f"_{k}")
    found = F.coalesce(*[F.col(f"_by_{k}") for k in keys])
    hit = F.coalesce(*[F.when(F.col(f"_by_{k}").isNotNull(), k) for k in keys])
    return out.withColumn(value, found).withColumn("hit", hit).drop(*[f"_by_{k}" for k in keys])

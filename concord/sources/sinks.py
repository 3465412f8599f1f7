"""Sinks (SNK-02..SNK-17): versioned snapshots, appends, one-file reports, text per paper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_in_place(spark: SparkSession, staged: str, target: str) -> None:
    """The one file of a staged folder under its final name, in one step: a reader sees the old file or the new one. The folder goes."""
    jvm, src, fs = _fs(spark, staged)
    part = next(x.getPath() for x in fs.listStatus(src) if x.getPath().getName().startswith("part-"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, jvm.org.apache.hadoop.fs.Path(target), options)
    fs.delete(src, True)


def version(spark: SparkSession, root: str) -> int:
    """The published version of a table, 0 without one."""
    _, p, fs = _fs(spark, f"{root}/CURRENT")
    return int(spark.read.text(f"{root}/CURRENT").first()[0]) if fs.exists(p) else 0


def publish(frames: dict[str, DataFrame], root: str) -> int:
    """SNK-02 / SNK-04 / SNK-16: all frames under a new version, then the pointer; empty children are refused."""
    spark = next(iter(frames.values())).sparkSession
    n = version(spark, root) + 1
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={n}")
        if not spark.read.parquet(f"{root}/{name}/version={n}").limit(1).count():
            raise ValueError(f"{name} is empty; version {n} is not published")
    spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/_next")
    put_in_place(spark, f"{root}/_next", f"{root}/CURRENT")
    return n


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/version={version(spark, root)}")


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """SNK-03 / SNK-05 / SNK-06."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def checked_append(df: DataFrame, known: DataFrame, keys: list[str], path: str) -> None:
    """SNK-07: fails if a key repeats, in itself or against what is there."""
    again = df.select(*keys).unionByName(known.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if again.limit(1).count():
        raise ValueError(f"repeated keys {keys}")
    df.write.mode("append").parquet(path)


def verdict_rows(results: DataFrame) -> DataFrame:
    """SNK-05 / H-23: one row for each verdict of a result's array, unions flattened to nullable columns."""
    return results.select(*[c for c in results.columns if c != "verdicts"], F.inline("verdicts"))


def pair_rows(ratings: DataFrame) -> DataFrame:
    """SNK-04 / V-08 / H-22: the pairs a < b of each rating's arms."""
    pairs = F.flatten(F.transform("arms", lambda a: F.transform(F.filter("arms", lambda b: b > a), lambda b: F.struct(a.alias("arm_a"), b.alias("arm_b")))))
    return ratings.select("rating_id", F.inline(pairs))


def report_csv(df: DataFrame, path: str) -> None:
    """SNK-09 / SNK-11: one CSV file at `path`, written under another name and renamed; undefined numbers are empty.

    A report is one file by definition, so its rows go through one task. A write that fails leaves the file that was there.
    """
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    folder, name = path.rsplit("/", 1)
    staged = f"{folder}/_staged_{name}_{uuid.uuid4().hex}"
    try:
        clean.coalesce(1).write.csv(staged, header=True, escape='"')
        put_in_place(df.sparkSession, staged, path)
    finally:
        _, left, fs = _fs(df.sparkSession, staged)
        fs.delete(left, True)


def report_json(df: DataFrame) -> DataFrame:
    """SNK-10."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def text_per_paper(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """SNK-13: one Markdown text a paper."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("markdown"))


# Stages that people review, and what goes either way
REVIEW_STAGES = ["abstract_adjudication", "ft_adjudication", "pdf_acquisition", "pdf_quality", "extraction_audit"]
DIRECTIONS = ["queue", "decisions"]


def artifact_name(review: str, stage: str, direction: str, extension: str) -> str:
    """SNK-17."""
    for value, known in ((stage, REVIEW_STAGES), (direction, DIRECTIONS)):
        if value not in known:
            raise ValueError(f"{value!r} is none of {', '.join(known)}")
    return f"{review}_{stage}_{direction}.{extension}"


def methods_text(flow: DataFrame) -> DataFrame:
    """SNK-14."""
    return flow.select(F.format_string("We identified %d records, screened %d, excluded %d, assessed %d full texts and included %d studies.", "identified", "screened", "excluded", "full_text_retrieved", "included").alias("text"))


def export_all(frames: dict[str, DataFrame], folder: str) -> None:
    """SNK-15."""
    for name, df in frames.items():
        report_csv(df, f"{folder}/{name}.csv")

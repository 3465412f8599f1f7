"""Exactly-once appends (ST-01, ST-02, ST-04): batches of a stream under a ledger.

A log at `path` has its rows at ``data/batch=<b>/bucket=<k>`` and a ledger with a
row for each committed batch and the buckets it wrote. A batch first writes all
its rows, replacing what an earlier attempt left, then its ledger row, in one
task and one rename; readers take the rows of batches in the ledger alone. So a
batch that dies between the two is invisible and is written again, and one that
comes again after its commit does nothing. Keys that are there already are
looked up in the buckets of the batch's own keys, not in the whole log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "stream string, batch long, buckets array<int>, n_rows long"


def committed(spark: SparkSession, path: str, stream: str | None = None) -> DataFrame:
    rows = spark.read.schema(f"{LEDGER}, entry string").parquet(f"{path}/ledger")
    return rows.where(F.col("buckets").isNotNull()) if stream is None else rows.where(F.col("buckets").isNotNull() & (F.col("stream") == stream))


def create(spark: SparkSession, path: str, schema: str) -> None:
    """An empty log, unless there is one."""
    spark.createDataFrame([], f"{schema}, batch string, bucket int").write.mode("ignore").partitionBy("batch", "bucket").parquet(f"{path}/data")
    spark.createDataFrame([("", -1, None, 0)], LEDGER).withColumn("entry", F.lit("start")).coalesce(1).write.mode("ignore").partitionBy("entry").parquet(f"{path}/ledger")


def read_log(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of all committed batches; with `buckets`, of these alone (partitions are pruned)."""
    data = spark.read.schema(f"{schema}, batch string, bucket int").parquet(f"{path}/data")
    if buckets is not None:
        data = data.where(F.col("bucket").isin(buckets))
    return data.join(committed(spark, path).select(F.col("entry").alias("batch")), "batch", "left_semi").drop("batch", "bucket")


def append_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], schema: str, stream: str = "stream", n_buckets: int = 64, before_commit: Callable[[int], None] = lambda b: None) -> bool:
    """Add the rows whose key is new, one of each; False if the batch was committed before. `before_commit` is for tests of failures."""
    spark, entry = batch.sparkSession, f"{stream}-{batch_id}"
    if committed(spark, path, stream).where(F.col("batch") == batch_id).limit(1).count():
        return False
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    rows = batch.select(*columns, F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int").alias("bucket")).persist()
    try:
        buckets = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # n_buckets at most
        known = read_log(spark, path, schema, buckets).select(*keys)
        new = rows.dropDuplicates(keys).join(known, keys, "left_anti")
        new.select(*columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={entry}")
        n = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/data/batch={entry}").count()
    finally:
        rows.unpersist()
    before_commit(batch_id)
    line = spark.createDataFrame([(stream, batch_id, buckets, n)], LEDGER).coalesce(1)
    line.write.mode("overwrite").parquet(f"{path}/ledger/entry={entry}")
    return True


def append_stream(events: DataFrame, path: str, keys: list[str], schema: str, checkpoint: str, stream: str = "stream", n_buckets: int = 64, before_commit: Callable[[int], None] = lambda b: None) -> StreamingQuery:
    """Append a stream's rows by key, each once, over restarts and failures. A stream name belongs to one checkpoint."""
    create(events.sparkSession, path, schema)
    write = lambda batch, b: append_batch(batch, b, path, keys, schema, stream, n_buckets, before_commit)
    return events.writeStream.foreachBatch(lambda batch, b: (write(batch, b), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""A corpus pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and
returns a frame with the columns of docs; the last returns pieces of packed
sequences. A row is a document, whatever its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import decontaminate, jaccard_duplicates, packing, quality_rules, secrets
from concord.llm.common import LAST, durable, named, shared_folder

#: Keys up to this number (16 MB of two longs) go to all executors; more are joined by shuffling
BROADCAST_KEYS = 1 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject, and from the others the boilerplate lines of their host."""
    return quality_rules.clean(docs)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (doc, row) is not in gone."""
    gone = durable(gone.select("doc", "row").distinct())
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rows = named(docs.select("doc_id", "text", F.struct("*").alias("_row")), "_row").select("doc", "row", "_row")
    return rows.join(gone, ["doc", "row"], "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each group of near duplicates (five-word shingles, Jaccard 0.8 or more), in order of id; of equal rows one."""
    groups = durable(jaccard_duplicates.near_groups(docs))
    gone = groups.where("doc <> head_doc OR row <> head_row")
    again = named(docs).groupBy("doc", "row").agg(F.count("*").alias("n")).where("n > 1")
    kept = without(docs, gone)
    again = durable(again.join(gone.select("doc", "row"), ["doc", "row"], "left_anti").select("doc", "row"))
    alone = kept.join(again, ["doc", "row"], "left_anti").select("_row.*")
    one = kept.join(again, ["doc", "row"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc", "row").orderBy(F.lit(0)))).where("_n = 1").select("_row.*")
    return alone.unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "row")).select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The near-duplicate, secret and packing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run_dir = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{run_dir}/{k}-{name}")
            docs = spark.read.parquet(f"{run_dir}/{k}-{name}")
    return docs

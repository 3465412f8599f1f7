"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that an operator reads; all others are pruned."""
    return docs.select("doc_id", "text", *more)


def bucket(n: int, of: str = "doc_id") -> Column:
    """crc32 of the column's text form, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")), F.lit(n))


#: Stands for a null id where rows are ranked: after all others.
LAST = (1 << 63) - 1


def named(docs: DataFrame, *more: str) -> DataFrame:
    """doc (the id as a rank, LAST for null), row, text and doc_id of every row.

    A row is a document: it owns its units, windows and spans by (doc, row),
    where row is a hash of id and text, so null and repeated ids do not mix
    texts. Ids only rank; rows of one rank follow in the order of their hash.
    Rows that are equal in id and text are one document.
    """
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text", "doc_id", *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session in one process may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def text_size(docs: DataFrame) -> int:
    """Bytes of text in all documents, in one scan."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts(total: int, each: int = 8 << 20, large: int = 256 << 20, many: int = 2000) -> int:
    """Into how many parts a shuffle of `total` bytes goes: of `each` bytes up to `many` parts, beyond that larger ones, up to `large`."""
    return max(1, min(-(-total // each), many), -(-total // large))


def whole_texts(docs: DataFrame, sample: list[tuple], label: str, most: int) -> list:
    """key, text and label of the sampled rows, each once: (key, size, label) in order of preference, with key the hash of id and text.

    Texts are taken whole; those that would pass `most` bytes in all are left out.
    """
    kept, room = [], most
    for key, size, value in sample:
        if size <= room:
            kept.append((key, value))
            room -= size
    name = label.split()[0]
    keys = docs.sparkSession.createDataFrame(kept, f"key long, {label}").distinct()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text", *([name] if name in docs.columns else []))
    return rows.join(F.broadcast(keys), [c for c in ("key", name) if c in rows.columns]).select("key", "text", name).dropDuplicates(["key", name]).collect()  # at most the sample

"""Rows of several tables that appear together or not at all (SNK-02, SNK-04, SC-11): a data source with a two-phase commit.

A row of the written frame is one unit. Each of its columns is a table: a struct
is one row of it, an array of structs several, at least one. Tasks write their
units' rows to files of all tables, under names that readers pass over until the
task is done. Then one file that lists the tasks' files is moved into place, and
all of it is visible; an action that fails before leaves nothing to read, and
takes its files away. Files of tasks that ran twice are in no list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from concord import lifecycle as L


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # table and file name


class UnitWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.name = options["path"], options.get("commit") or uuid.uuid4().hex
        if not self.name.replace("-", "").isalnum():
            raise ValueError(f"{self.name!r} names no commit")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.root)
        file, open_ones = f"part-{self.name}-{uuid.uuid4().hex}.parquet", {}
        try:
            for batch in iterator:
                for table, column in zip(batch.schema.names, batch.columns, strict=True):
                    if pa.types.is_list(column.type):
                        if column.null_count or 0 in column.value_lengths().to_pylist():
                            raise ValueError(f"a unit without {table}")
                        column = column.flatten()
                    if column.null_count:
                        raise ValueError(f"a unit without {table}")
                    rows = pa.RecordBatch.from_struct_array(column)
                    if table not in open_ones:
                        fs.create_dir(f"{root}/{table}")
                        open_ones[table] = pq.ParquetWriter(f"{root}/{table}/_{file}", rows.schema, filesystem=fs)
                    open_ones[table].write_batch(rows)
            for w in open_ones.values():
                w.close()
            for table in open_ones:
                fs.move(f"{root}/{table}/_{file}", f"{root}/{table}/{file}")
        except BaseException:
            self._delete([(t, f"_{file}") for t in open_ones] + [(t, file) for t in open_ones])
            raise
        return Written([(table, file) for table in open_ones])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.root)
        fs.create_dir(f"{root}/commits")
        if fs.get_file_info(f"{root}/commits/{self.name}.parquet").type != pafs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.name} is committed already")
        files = [x for m in messages if m for x in m.files]
        listed = pa.table({"table": pa.array([t for t, _ in files], pa.string()), "file": pa.array([f for _, f in files], pa.string())})
        pq.write_table(listed, f"{root}/commits/_{self.name}", filesystem=fs)
        fs.move(f"{root}/commits/_{self.name}", f"{root}/commits/{self.name}.parquet")

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([x for m in messages if m for x in m.files])

    def _delete(self, files: list[tuple[str, str]]) -> None:
        fs, root = _filesystem(self.root)
        for table, file in files:
            if fs.get_file_info(f"{root}/{table}/{file}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/{table}/{file}")


class Units(DataSource):
    """Format `units`, append only. Options: the path, and `commit`, a name that can be committed once (a new one if there is none)."""

    @classmethod
    def name(cls) -> str:
        return "units"

    def writer(self, schema, overwrite: bool) -> UnitWriter:
        if overwrite:
            raise ValueError("units are appended")
        for f in schema.fields:
            kind = getattr(f.dataType, "elementType", f.dataType)
            if kind.typeName() != "struct":
                raise ValueError(f"{f.name} is neither a struct nor an array of structs")
        return UnitWriter(dict(self.options))


def write_units(units: DataFrame, root: str, commit: str | None = None) -> None:
    units.sparkSession.dataSource.register(Units)
    w = units.write.format("units").mode("append")
    (w.option("commit", commit) if commit else w).save(root)


def read_units(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """The rows of a table in all commits. Files are told apart by name, in the scan; a list of names is small beside its files."""
    listed = spark.read.schema("table string, file string").parquet(f"{root}/commits").where(F.col("table") == table).select("file")
    rows = spark.read.schema(schema).parquet(f"{root}/{table}").select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(listed, rows["_file"] == listed["file"], "left_semi").drop("_file")


def acquisitions(papers: DataFrame, files: DataFrame, at: str, waiting: str = "ABSTRACT_SCREENED_IN") -> DataFrame:
    """SC-11: one unit (assets, status_events) for each waiting paper with a file `<id>.pdf`: path and hash, and the step to PDF_ACQUIRED.

    `files` has path and sha256, as of `readers.pdf_files`; of several files of one paper the first path is taken. Papers that have
    moved on are in no unit, so a run that comes again adds nothing once its status events are folded.
    """
    if f"{waiting}>PDF_ACQUIRED" not in L.EDGES:
        raise ValueError(f"no step from {waiting} to PDF_ACQUIRED")
    named = files.withColumn("_id", F.regexp_extract("path", r"(?:^|/)(\d+)\.pdf$", 1).try_cast("long")).where("_id IS NOT NULL")
    first = named.groupBy("_id").agg(F.min_by(F.struct("path", "sha256"), "path").alias("_f"))
    hits = papers.where(F.col("status") == waiting).join(first, F.col("id") == F.col("_id"))
    return hits.select(
        F.struct(F.col("id").alias("paper_id"), F.col("_f.path").alias("pdf_path"), F.col("_f.sha256").alias("pdf_hash")).alias("assets"),
        F.struct(F.col("id").alias("paper_id"), F.lit("PDF_ACQUIRED").alias("to_status"), F.lit(at).cast("timestamp").alias("at")).alias("status_events"),
    )

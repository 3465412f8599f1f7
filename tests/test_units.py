"""Units of several tables: all of them or nothing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from concord.sources import readers
from concord.sources import units as U

HEADS, SPANS = "id long, model string", "id long, field string"


def made(spark, n, children=lambda i: 1 + i % 3):
    rows = [((i, "m"), [(i, f"f{k}") for k in range(children(i))]) for i in range(n)]
    return spark.createDataFrame(rows, "heads struct<id: long, model: string>, spans array<struct<id: long, field: string>>").repartition(4)


def test_headers_and_children(spark, tmp_path):
    root = str(tmp_path / "u")
    U.write_units(made(spark, 20), root, "first")
    assert U.read_units(spark, root, "heads", HEADS).count() == 20
    assert sorted((r.id, r.field) for r in U.read_units(spark, root, "spans", SPANS).collect()) == sorted((i, f"f{k}") for i in range(20) for k in range(1 + i % 3))
    with pytest.raises(Exception, match="committed already"):
        U.write_units(made(spark, 5), root, "first")
    U.write_units(made(spark, 5), root)
    U.write_units(made(spark, 5).limit(0), root)
    assert U.read_units(spark, root, "heads", HEADS).count() == 25


def test_a_unit_without_children_stops_all(spark, tmp_path):
    root = str(tmp_path / "u")
    U.write_units(made(spark, 3), root)
    with pytest.raises(Exception, match="without spans"):
        U.write_units(made(spark, 40, lambda i: int(i != 17)), root)
    assert U.read_units(spark, root, "heads", HEADS).count() == 3
    (tmp_path / "u" / "heads" / "part-lost.parquet").write_bytes(next((tmp_path / "u" / "heads").glob("part-*.parquet")).read_bytes())
    assert U.read_units(spark, root, "heads", HEADS).count() == 3  # a file that no commit lists
    with pytest.raises(Exception, match="neither a struct"):
        U.write_units(spark.range(3), root)


def test_acquisitions(spark, tmp_path):
    folder, root = tmp_path / "pdfs", str(tmp_path / "u")
    folder.mkdir()
    for name in ("1.pdf", "2.pdf", "x3.pdf", "4.pdf"):
        (folder / name).write_bytes(b"%PDF-1.4 " + name.encode())
    papers = spark.createDataFrame([(1, "ABSTRACT_SCREENED_IN"), (2, "PARSED"), (3, "ABSTRACT_SCREENED_IN"), (4, "ABSTRACT_SCREENED_IN"), (5, None)], "id long, status string")
    U.write_units(U.acquisitions(papers, readers.pdf_files(spark, str(folder), 0), "2026-01-02 03:04:05"), root)
    assets = U.read_units(spark, root, "assets", "paper_id long, pdf_path string, pdf_hash string").collect()
    assert {(r.paper_id, r.pdf_path.rsplit("/", 1)[1], r.pdf_hash) for r in assets} == {(i, f"{i}.pdf", hashlib.sha256(b"%PDF-1.4 " + f"{i}.pdf".encode()).hexdigest()) for i in (1, 4)}
    steps = U.read_units(spark, root, "status_events", "paper_id long, to_status string, at timestamp")
    assert {(r.paper_id, r.to_status) for r in steps.collect()} == {(1, "PDF_ACQUIRED"), (4, "PDF_ACQUIRED")}
    after = papers.join(steps.select(F.col("paper_id").alias("id"), "to_status"), "id", "left").select("id", F.coalesce("to_status", "status").alias("status"))
    assert U.acquisitions(after, readers.pdf_files(spark, str(folder), 0), "2026-01-02 03:04:05").count() == 0

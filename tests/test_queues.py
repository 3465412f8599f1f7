"""Queues and helpers on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from concord.operators import queues as Q


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_paths_take_one_asset(spark):
    papers = spark.createDataFrame([(1, "own"), (2, "own2")], "id long, pdf_path string")
    assets = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, paper_id long, path string")
    assert rows(Q.effective_path(papers, assets), "id", "effective_path") == [(1, "b"), (2, "own2")]


def test_flags_drop_nulls(spark):
    df = spark.createDataFrame([(1, "English", "full_manuscript"), (2, "German", "full_manuscript"), (3, None, "abstract"), (4, None, None)], "id long, language string, content_type string")
    assert rows(Q.quality_flagged(df), "id") == [(2,), (3,)]


def test_flagged_papers(spark):
    papers = spark.createDataFrame([(1, "F"), (2, "F"), (3, "G")], "id long, status string")
    d = spark.createDataFrame([(1, 1, 1, "include", "r"), (2, 1, 2, "exclude", "s")], "id long, paper_id long, pass int, decision string, rationale string")
    v = spark.createDataFrame([(1, 1, "include", "a"), (2, 1, "exclude", "b")], "id long, paper_id long, decision string, rationale string")
    assert rows(Q.flagged_papers(papers, d, v, "F"), "id", "decision", "verifier") == [(1, "include", "exclude"), (2, None, None)]


def test_progress_and_budget(spark):
    done = spark.createDataFrame([(1, 1000000, 500000), (2, None, None)], "paper_id long, input_tokens long, output_tokens long")
    r = Q.progress(spark.range(5), done, 2.0, 8.0).first()
    assert (r.done, r.remaining, r.cost) == (2, 3, 6.0)
    models = spark.createDataFrame([("a:7b", 5.0), ("ab:1", 9.0), ("b", 2.0)], "name string, gb double")
    r = Q.budget_check(spark.createDataFrame([("a",), ("b",)], "name string"), models, 6.0).first()
    assert (r.n, r.gb, r.fits) == (2, 7.0, False)


def test_queue_order_and_summary(spark):
    spans = spark.createDataFrame([(1, "b", "x", "flagged"), (1, "a", "x", "contested"), (2, "a", "x", "invalid_snippet"), (2, "b", "x", "verified")], "paper_id long, field_name string, value string, audit_status string")
    got = [(r.paper_id, r.field_name) for r in Q.review_queue(spans).collect()]
    assert got == [(2, "a"), (1, "b"), (1, "a")]
    decided = spark.createDataFrame([(2, "a")], "paper_id long, field_name string")
    assert Q.unresolved(spans, decided).first().n == 1
    counts = Q.queue_counts(spark.createDataFrame([("b",), ("ambiguous",), (None,), ("a",), ("b",)], "c string"), "c")
    assert [(r.c, r.n) for r in counts.collect()] == [("ambiguous", 1), ("a", 1), ("b", 2), ("unknown", 1)]


def test_agreement_and_coverage(spark):
    votes = spark.createDataFrame([(1, "m", "x"), (1, "n", "x"), (2, "m", "x"), (2, "n", "y")], "item long, model string, verdict string")
    assert Q.model_agreement(votes, "item", ["m", "n"]).first().agreement == 0.5
    wide = spark.createDataFrame([(1, "x", "NR"), (2, None, "y")], "id long, f string, g string")
    assert rows(Q.coverage(wide, ["f", "g"])) == [("f", 1, 0.5), ("g", 1, 0.5)]
    assert rows(Q.judge_inputs(spark.createDataFrame([(1, "f", "a", "b"), (2, "f", "a", None)], "paper_id long, field_name string, x string, y string"), ["x", "y"]), "paper_id", "arm") == [(1, "x"), (1, "y")]


def test_workbook_and_labels(spark):
    df = spark.createDataFrame([('["J Smith", "Doe"]', 2001, 1), ("A. van Meyer ; Doe", 1999, 2), ("[]", 2000, 3), ("", 2000, 4), (None, 2000, 5)], "authors string, year int, id long")
    assert {r.id: r.l for r in df.select("id", Q.paper_label(F.col("authors"), F.col("year"), F.col("id")).alias("l")).collect()} == {1: "Smith 2001", 2: "Meyer 1999", 3: "3", 4: "4", 5: "5"}
    name = lambda p: spark.createDataFrame([(p,)], "p string").select(Q.extractor_of(F.col("p")).alias("e")).first().e
    assert name("x/EE_review_b.csv") == "B" == name("form_B.xlsx") == name("a.b_B")
    for bad in ("x/EE_review_ab.csv", "form.xlsx", "form_1.xlsx", "form_.xlsx"):
        with pytest.raises(Exception, match="no extractor"):
            name(bad)

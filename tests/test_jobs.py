"""Smaller jobs on hand-built rows."""

from pyspark.sql import functions as F

from concord.operators import jobs as B


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_paged_source(spark):
    source = B.paged_source("pages_of_numbers", "page int, n int", lambda o: list(range(int(o.get("pages", 1)))), lambda k: ((k, i) for i in range(3)))
    B.register(spark, source)
    df = spark.read.format("pages_of_numbers").option("pages", 2).load()
    assert rows(df) == [(p, i) for p in range(2) for i in range(3)]


def test_rejection_and_adjudication(spark):
    papers = spark.createDataFrame([(1, "AI_AUDIT_COMPLETE", None, "d1", "t1"), (2, "PARSED", None, None, "t2"), (3, "ABSTRACT_SCREEN_FLAGGED", None, None, "t3")], "id long, status string, rejected_reason string, doi string, title string")
    out = B.reject(papers, spark.createDataFrame([(1, "bad"), (2, "bad")], "id long, reason string"))
    assert rows(out, "id", "status") == [(1, "REJECTED"), (2, "PARSED"), (3, "ABSTRACT_SCREEN_FLAGGED")]
    d = spark.createDataFrame([(1, None, "t3", "ABSTRACT_SCREENED_IN"), (2, "none", "nothing", "ABSTRACT_SCREENED_IN")], "ord long, doi string, title string, to_status string")
    moved, lost = B.adjudicate(papers, d, ["doi", "title"])
    assert rows(moved.where("id = 3"), "status") == [("ABSTRACT_SCREENED_IN",)] and rows(lost, "ord") == [(2,)]


def test_expressions(spark):
    df = spark.createDataFrame([("one\n\ntwo three", 8)], "t string, at int")
    assert df.select(B.snap_paragraph(F.col("t"), F.col("at")).alias("s")).first().s == 4  # the second break of the blank line stays
    df = spark.createDataFrame([("ABSTRACT_SCREENED_IN", ["include", "include"]), ("ABSTRACT_SCREENED_IN", ["exclude", "exclude"])], "s string, d array<string>")
    assert [r.x for r in df.select(B.rescreened(F.col("s"), F.col("d")).alias("x")).collect()] == ["ABSTRACT_SCREENED_IN", "ABSTRACT_SCREEN_FLAGGED"]
    assert B.spec_hash({"b": 1, "a": [2]}) == B.spec_hash({"a": [2], "b": 1})


def test_repair_and_isolation(spark):
    sp = spark.createDataFrame([(1, "a ... b"), (2, "fine"), (3, None), (4, "x ... y")], "id long, source_snippet string")
    model = lambda bad: bad.withColumn("source_snippet", F.when(F.col("id") == 1, "mended").otherwise(F.col("source_snippet")))
    assert rows(B.repaired(sp, model)) == [(1, "mended"), (2, "fine"), (3, None), (4, "")]
    got = B.isolated(spark.createDataFrame([(1,), (0,)], "x long"), lambda r: {"y": 10 // r["x"]}, "x long, y double, error string")
    assert rows(got.where("error IS NOT NULL"), "x") == [(0,)] and rows(got.where("error IS NULL"), "x", "y") == [(1, 10.0)]


def test_undecided_votes(spark):
    votes = spark.createDataFrame([(1, "f", "a", 2), (1, "f", "b", 2), (2, "f", "a", 3), (2, "f", "b", 1), (3, "f", "a", 1)], "paper_id long, field_name string, norm string, n long")
    assert rows(B.votes_json(votes)) == [(1, "f", '{"a":2,"b":2}')]


def test_updates_take_the_last(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "id long, ord long, v string")
    assert rows(B.updated(table, changes, "id", ["v"])) == [(1, "y"), (2, "b")]

"""The clean-up of orphaned spans in tasks of bounded size."""

from concord.operators import imports as I
from concord.operators import latest as J


def test_tasks_grow_with_the_spans_and_not_their_size(spark, monkeypatch):
    spans = spark.range(4000).selectExpr("id % 500 AS extraction_id", "concat('f', id % 3) AS field_name")
    extractions = spark.range(500).selectExpr("id", "id % 100 AS paper_id")
    monkeypatch.setattr(J, "TASK_ROWS", 100, raising=False)
    assert J.orphans(spans, extractions).rdd.getNumPartitions() == 40
    got = {(r.field_name, r.n_spans, r.n_extractions) for r in I.cleanup_plan(spans, extractions).collect()}
    rows = [(i % 500, f"f{i % 3}") for i in range(4000) if i % 500 < 400]
    assert got == {(f, sum(g == f for _, g in rows), len({e for e, g in rows if g == f})) for f in ("f0", "f1", "f2")}

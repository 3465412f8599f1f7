"""Sketches that are stored and merged, against exact figures."""

import pytest
from pyspark.sql import functions as F

from concord.operators import sketches as K


@pytest.fixture(scope="module")
def rows(spark):
    n = spark.range(60_000)
    return n.select((F.col("id") % 6).alias("run"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("arm"), (F.col("id") * 7919 % 20_011).alias("item"), F.sqrt("id").alias("x"))


def test_stored_and_merged(spark, rows, tmp_path):
    for r in range(6):  # a run stores its own sketches, the last ones are added later
        K.sketched(rows.where(F.col("run") == r), ["run", "arm"], "item", "x").write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    got = {r.arm: r for r in K.estimates(K.merged(stored, ["arm"])).collect()}
    exact = {r.arm: r for r in rows.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("item").alias("d")).collect()}
    for arm, e in exact.items():
        assert got[arm].n == e.n and abs(got[arm].n_distinct - e.d) <= 0.03 * e.d
        for p, q in ((0.5, got[arm].q50), (0.95, got[arm].q95)):
            rank = rows.where((F.col("arm") == arm) & (F.col("x") <= q)).count() / e.n
            assert abs(rank - p) < 0.02
    assert {(r.arm, r.n) for r in K.merged(stored, ["arm"]).select("arm", "n").collect()} == {(a, e.n) for a, e in exact.items()}


def test_shared(rows):
    a = K.sketched(rows.where("item < 9000").select(F.lit(1).alias("k"), "item", "x"), ["k"], "item", "x")
    b = K.sketched(rows.where("item >= 6000").select(F.lit(1).alias("k"), "item", "x"), ["k"], "item", "x")
    got = K.shared(a, b, ["k"]).first()
    assert abs(got.n_shared - 3000) < 0.06 * 3000 and abs(got.n_either - 20_011) < 0.03 * 20_011
    assert abs(a.select(K.rank_of(F.col("kll"), F.lit(1e9)).alias("r")).first().r - 1.0) < 1e-9


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, None), ("b", 2, 5.0)], "k string, item long, x double")
    got = {r.k: r for r in K.estimates(K.merged(K.sketched(df, ["k"], "item", "x"), ["k"])).collect()}
    assert (got["a"].n, got["a"].n_distinct, got["a"].q50) == (2, 1, None) and (got["b"].n_distinct, got["b"].q50) == (1, 5.0)
    assert K.estimates(K.merged(K.sketched(df.limit(0), ["k"], "item", "x"), ["k"])).count() == 0

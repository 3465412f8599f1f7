"""Words to an inverted index and back."""

from pyspark.sql import functions as F

from concord.sources import readers


def test_inverted_index(spark):
    rows = [(["b", "a", "b", "é", "a", "b"],), (["x"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "w array<string>").select(readers.inverted_index(F.col("w")).alias("i"))
    assert [r.i for r in df.collect()] == [{"a": [1, 4], "b": [0, 2, 5], "é": [3]}, {"x": [0]}, None, None]
    assert [r.t for r in df.select(readers.inverted_abstract(F.col("i")).alias("t")).collect()][:2] == ["b a b é a b", "x"]

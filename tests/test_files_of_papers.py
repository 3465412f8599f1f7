"""Files whose numbers have more than three digits."""

from concord.queries import QUERIES
from concord import review_queries  # noqa: F401  registers its queries


def test_numbers_over_999_keep_all_digits(spark, tmp_path):
    ids = [7, 100, 999, 1000, 1199, 2207]
    spark.createDataFrame([(i, f"title {i}\nrest") for i in ids], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.file, r.title) for r in QUERIES["files_of_papers"](spark, str(tmp_path)).collect()}
    assert got == {i: (f"EE-{i % 1200:03d}_Smith_2020.pdf", f"title {i % 1200}" if i % 1200 in ids else None) for i in ids}

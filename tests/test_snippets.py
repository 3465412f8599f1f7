"""Snippets against all texts, by brute force."""

from concord.queries import QUERIES

ITEMS = [(1, "The quick  brown fox jumps over"), (2, "row one two"), (3, "tiny"), (4, "two words"), (5, None), (6, ""), (7, "alpha beta gamma delta"), (41, "the QUICK brown fox jumps over"), (8, "not anywhere in these texts at all"), (9, "a"), (10, "é"), (11, "ow"), (12, "x j"), (13, "xal"), (14, "QUICK"), (15, "y w"), (16, "😀"), (17, "日本"), (18, "zq"), (19, "  "), (20, "s, two")]
TEXTS = [(1, "see: the quick brown\nfox jumps overboard"), (2, "the quick brown fox jumps over"), (3, "arrow one twofold"), (4, "a tinyish thing, two wordsmiths"), (5, None), (6, ""), (7, "xalpha beta gamma deltas"), (7, "xalpha beta gamma deltas"), (80, "alpha beta gamma"), (None, "Row one two"), (81, "déjà 😀😀 日本語"), (82, "é")]


def test_every_pair_is_compared(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    low = lambda x: " ".join(x.split()).lower()
    want = [(d, i) for d, t in TEXTS for i, s in ITEMS if t is not None and s is not None and low(s) in low(t)]
    got = [tuple(r) for r in QUERIES["snippet_exact"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(d is not None and d % 40 != i % 40 for d, i in want)

"""Normalisation, scores, kappa and absence rules, with the expected values of §2.16 and FIXTURES F1-F3."""

import math

import pytest
from pyspark.sql import functions as F

from concord.functions import nulls as N
from concord.functions import spans as SP
from concord.functions import text as X
from concord.functions import values as V


def one(spark, col, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(col.alias("r")).first().r


@pytest.mark.parametrize(("a", "b"), [("Hello, World!  ", "hello world"), ("A.B.C", "abc"), ("Été  à Nîmes", "été à nîmes")])
def test_title_key(spark, a, b):
    assert one(spark, X.title_key(F.col("v")), v=a) == b


@pytest.mark.parametrize(("v", "want"), [("", True), (" N/R ", True), ("not_found", True), ("NR;x", False), ("0", False)])
def test_null_synonym(spark, v, want):
    assert one(spark, N.is_null_synonym(F.col("v")), v=v) is want


def test_absence_vocabularies_differ(spark):
    assert one(spark, N.is_audit_absence(F.col("v")), v="nr") is False
    assert one(spark, N.is_audit_absence(F.col("v")), v="NR") is True
    assert one(spark, N.is_absence_claim(F.col("v")), v="nr") is True
    assert one(spark, N.human_value(F.col("v")), v=" nr ") is None
    assert one(spark, N.csv_value(F.col("v")), v="NR") == "NR"


@pytest.mark.parametrize(("v", "want"), [("4 pigs, 5", "45"), ("007", "7"), ("000", "0"), (" none here ", "none here")])
def test_digits_only(spark, v, want):
    assert one(spark, V.digits_only(F.col("v")), v=v) == want


OPTIONS = ["2 (Task autonomy)", "3 (Conditional)", "Research Paper (A)", "Research Note (B)"]


@pytest.mark.parametrize(("v", "want"), [("2", "2 (Task autonomy)"), ("2 (TASK AUTONOMY)", "2 (Task autonomy)"), ("Research", "Research"), ("new", "new")])
def test_canonical(spark, v, want):
    assert one(spark, V.canonical(F.col("v"), F.col("o")), v=v, o=OPTIONS) == want


def score(spark, a, b, kind="text", options=()):
    df = spark.createDataFrame([(a, b, list(options))], "a string, b string, o array<string>")
    k = F.lit(kind)
    df = df.select(V.normalised(F.col("a"), k, F.col("o")).alias("a"), V.normalised(F.col("b"), k, F.col("o")).alias("b"))
    return df.select(V.pair_score(F.col("a"), F.col("b"), k).alias("s")).first().s


@pytest.mark.parametrize(("a", "b", "kind", "want"), [
    (None, "NR", "text", "MATCH"), ("x", None, "text", "MISMATCH"), ("Small sample", "Limited sample size and short follow-up", "text", "AMBIGUOUS"),
    ("Short follow-up", "Brief follow-up period", "text", "AMBIGUOUS"), ("short", "a SHORT  text", "text", "MATCH"), ("one", "two", "text", "MISMATCH"),
    ("a; b", "B; A", "multi", "MISMATCH"), ("a; b", "b; a", "multi", "MATCH"), ("a; b", "a", "multi", "AMBIGUOUS"), ("a;b", "c", "multi", "MISMATCH"), ("n=4", "4", "numeric", "MATCH"), ("Review", "review", "categorical", "MISMATCH"),
])
def test_pair_score(spark, a, b, kind, want):
    assert score(spark, a, b, kind) == want


@pytest.mark.parametrize(("match", "mismatch", "ambiguous", "kappa"), [(10, 0, 0, 1.0), (0, 10, 0, 0.0), (7, 3, 0, 0.285714), (8, 2, 0, 0.375), (0, 0, 5, None), (1, 9, 0, -4.0)])
def test_kappa(spark, match, mismatch, ambiguous, kappa):
    rows = [("MATCH",)] * match + [("MISMATCH",)] * mismatch + [("AMBIGUOUS",)] * ambiguous
    r = spark.createDataFrame(rows, "s string").agg(*V.kappa_columns(F.col("s"))).first()
    assert (r.n, r.n_ambiguous) == (match + mismatch, ambiguous)
    if kappa is None:
        assert r.kappa is None
    else:
        assert math.isclose(r.kappa, kappa, abs_tol=1e-6)
        assert r.ci_lower <= r.kappa <= r.ci_upper
        p = match / (match + mismatch)
        if 0 < p < 1:
            assert math.isclose(r.kappa, 1 - 1 / (2 * p), abs_tol=1e-6)


def test_number_in_span(spark):
    assert one(spark, V.number_in(F.col("v"), F.col("s"), F.lit(0.0)), v="1,200", s="we saw 1,200 cases") is True
    assert one(spark, V.number_in(F.col("v"), F.col("s"), F.lit(0.0)), v="20", s="20.5 cm") is False
    assert one(spark, V.number_in(F.col("v"), F.col("s"), F.lit(0.5)), v="20", s="20.5 cm") is True
    assert one(spark, V.number_in(F.col("v"), F.col("s"), F.lit(0.5)), v="none", s="20.5 cm") is False


def test_grep_verify(spark):
    text = "This is a randomized controlled trial with 20 patients. The STAR robot was used for autonomous suturing."
    rows = [("randomized controlled trial", True), ("The “STAR” robot", True), ("The STAR robots was used for autonomous suturing", True), ("", False), ("nothing of the kind was seen", False), (None, False)]
    df = spark.createDataFrame([(s, text, w) for s, w in rows], "s string, t string, w boolean")
    got = df.select("s", "w", SP.grep_verify(F.col("s"), F.col("t")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_text_helpers(spark):
    assert one(spark, X.thinking(F.col("v")), v="a <think> x\ny </think> b") == "x\ny"
    assert one(spark, X.strip_fence(F.col("v")), v="```json\n{}\n```") == "{}"
    assert one(spark, X.shorten(F.col("v"), 3), v="abcdef") == "abc..."
    assert one(spark, X.has_ellipsis(F.col("v")), v="a ... b") is True
    assert one(spark, X.prompt("Title: {t}. Abstract: {a}", t=F.col("v"), a=F.lit(None)), v="x") == "Title: x. Abstract: (not available)"
    got = one(spark, X.windows_around(F.col("v"), F.array(F.lit(2), F.lit(4), F.lit(20)), 3), v="abcdefghijklmnopqrstuvwxyz")
    assert got == "abcdefg\n[...]\nrstuvw"

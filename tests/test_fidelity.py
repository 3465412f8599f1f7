"""Values that the survey's reference expects, and operators against plain Python."""

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from concord import lifecycle as L
from concord.functions import nulls as N
from concord.functions import text as X
from concord.operators import agreement as A
from concord.operators import entities as E
from concord.operators import jobs as B
from concord.operators import reports as R
from concord.operators import sampling as S
from concord.operators import scan
from concord.operators import verify as C


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i long, v {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_absence(spark):
    claims = ["NR", " na ", "Not Found", "N/A", "not_found", "Not Reported", "", "  ", None, "N/R", "none", "Not discussed", "value"]
    assert values(spark, N.is_absence_claim(F.col("v")), claims) == [True] * 9 + [False] * 4
    filled = ["Original Research", "STAR", "NR", "No comparison reported", "NOT_FOUND", None, "", "   ", " NR ", "nr", "Not assessable"]
    assert values(spark, N.is_populated(F.col("v")), filled) == [True, True, False, False, False, False, False, False, False, True, False]


def test_low_yield(spark):
    df = spark.createDataFrame([(1, v) for v in ("a", "b", "NR", None)] + [(2, v) for v in ("a", "b", "c", "d")] + [(3, "")], "paper_id long, value string")
    assert sorted((r.paper_id, r.n_populated) for r in R.low_yield(df, 4).collect()) == [(1, 2), (3, 0)]


def test_surnames(spark):
    names = ["Smith", "John Smith", "Lukas A", "Doe AB", "Müller", "Garcia-Lopez", "", None, "O'Brien", " . "]
    assert values(spark, X.surname(F.col("v")), names) == ["Smith", "Smith", "Lukas", "Doe", "Muller", "Garcia-Lopez", "Unknown", "Unknown", "OBrien", "Unknown"]
    assert values(spark, X.first_author(F.col("v")), ['["Lukas A", "Chen B"]', None, "[]", "no json"]) == ["Lukas", "Unknown", "Unknown", "Unknown"]
    assert values(spark, X.canonical_filename(F.lit("EE-001"), F.col("v"), F.lit(2020)), ['["Lukas A"]']) == ["EE-001_Lukas_2020.pdf"]


def test_fitted_text(spark):
    none = F.lit(None).cast("string")
    assert values(spark, X.fitted_text(F.col("v"), F.lit("Title"), F.lit("Abstract")), ["This is a short paper."]) == ["Title: Title\n\nAbstract: Abstract\n\nThis is a short paper."]
    body = "Introduction section content. " * 200 + "\n## References\n\n[1] Foo et al. 2024\n"
    (got,) = values(spark, X.fitted_text(F.col("v"), none, none, 2000), [body])
    assert "References" not in got and got.startswith("Introduction") and got.endswith("content.") and len(got) <= 2000
    (got,) = values(spark, X.fitted_text(F.col("v"), none, none, 7000), [body + "x" * 9000])
    assert got == ("Introduction section content. " * 199).rstrip()
    (got,) = values(spark, X.fitted_text(F.col("v"), F.lit("My Title"), F.lit("My Abstract"), 500), ["x" * 50_000])
    assert len(got) == 500 and "My Title" in got and "My Abstract" in got
    assert values(spark, X.fitted_text(F.col("v"), F.lit("t" * 50), none, 20), ["abc"]) == ["Title: " + "t" * 13]


def test_span_places(spark):
    text = "Some  text\n" + "".join(chr(97 + i % 26) + str(i) for i in range(200)) + " end."
    cases = [(text[30:60], 30), (text[20:120] + "zzz", 20), ("short ... " + text[40:120], 40), ("z" * 40 + text[100:300], 100), ("absent", -1), ("", -1), (None, -1)]
    df = spark.createDataFrame([(i, text, s) for i, (s, _) in enumerate(cases)], "i int, t string, s string")
    got = [r.x for r in df.select("i", X.locate_span(F.col("t"), F.col("s")).alias("x")).orderBy("i").collect()]
    assert got[:3] == [30, 20, 40] and got[4:] == [-1, -1, -1]
    assert text[got[3] :].startswith(cases[3][0][60 * (len("z" * 40) // 60) + 40 :][: 20])


def test_a_missing_answer_verifies_nothing(spark):
    df = spark.createDataFrame([("v", "some words here", 1, "some words here", None), ("v", "some words here", 1, "some words here", True), ("NR", "", 1, "x", None)], "value string, source_snippet string, tier int, paper_text string, semantic boolean")
    assert [r.audit_state for r in C.audit(df).collect()] == ["flagged", "verified", "verified"]


@pytest.mark.parametrize("width", [3, 4096])
def test_fold_of_long_histories(spark, monkeypatch, width):
    monkeypatch.setattr(L, "RANGE", width)
    rng = random.Random(4)
    rows = [(p, s, rng.choice(L.STATUSES), rng.random() < 0.05) for p in range(5) for s in rng.sample(range(300 if p else 12), 12 if p == 0 else 60)]
    want = {}
    for p, _, to, force in sorted(rows):
        status, done, bad = want.get(p, ("INGESTED", 0, 0))
        ok = force or f"{status}>{to}" in L.EDGES
        want[p] = (to, done + 1, bad) if ok else (status, done, bad + 1)
    got = L.fold_status(spark.createDataFrame(rows, "paper_id long, seq long, to_status string, override boolean")).collect()
    assert {r.paper_id: (r.status, r.applied, r.rejected) for r in got} == want


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(scan, "BITS", 8)
    rng = random.Random(2)
    rows = [(i, rng.random() * 10, rng.random() < 0.1) for i in rng.sample(range(1000), 60)]
    got = A.progress(spark.createDataFrame(rows, "i long, s double, f boolean"), "i", F.col("s"), F.col("f"), 100).orderBy("i").collect()
    rows.sort()
    for k, r in enumerate(got):
        mean = statistics.mean(x for _, x, _ in rows[: k + 1])
        assert (r.seen, r.failures) == (k + 1, sum(f for *_, f in rows[: k + 1])) and abs(r.mean - mean) < 1e-9 and abs(r.to_go - mean * (99 - k)) < 1e-6
    stops = A.checkpoints(spark.createDataFrame(rows, "i long, s double, f boolean"), "i", F.col("s"), F.col("f"), 100, 20, 0.0, 1e9).collect()
    assert [r.seen for r in stops] == [20, 40, 60] and {r.abort for r in stops} <= {"failure rate", None}


@pytest.mark.parametrize("bins", [1, 5, 4096])
def test_nearest_rank(spark, monkeypatch, bins):
    monkeypatch.setattr(R, "BINS", bins)
    rng = random.Random(1)
    rows = [(k, round(rng.gauss(0, 5), rng.choice([0, 2]))) for k in "abc" for _ in range({"a": 200, "b": 3, "c": 1}[k])] + [("d", 4.0)] * 9 + [("a", None)]
    got = {r.k: r for r in R.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0, 50, 95, 100]).collect()}
    for k in "abcd":
        own = sorted(v for n, v in rows if n == k and v is not None)
        assert (got[k].n, got[k].p0, got[k].p50, got[k].p95, got[k].p100) == (len(own), *(own[round(p / 100 * (len(own) - 1))] for p in (0, 50, 95, 100)))


def test_fraction_is_exact(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    ranked = [r.k for r in df.orderBy(S.hash_rank(42, F.col("k"))).collect()]
    assert {r.k for r in S.fraction(df, "k", 0.1).collect()} == set(ranked[:300])
    assert S.fraction(df.limit(3), "k", 0.01).count() == 1


def test_priorities(spark):
    df = spark.createDataFrame([(i, "ABSTRACT_SCREENED_IN" if i < 5 else "ABSTRACT_SCREENED_OUT") for i in range(60)], "id long, status string")
    got = [r.priority for r in B.priorities(df).orderBy("id").collect()]
    assert got[:5] == [1] * 5 and (got.count(2), got.count(3)) == (30, 25)


def titles(seed, n, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 10))) for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)], rng


def misspelt(title, k, rng):
    out = title.split()
    for i in rng.sample(range(len(out)), k):
        at = rng.randrange(len(out[i]))
        out[i] = out[i][:at] + rng.choice("qxz") + out[i][at + 1 :]
    return " ".join(out)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_fuzzy_titles_with_misspelt_words(spark, k):
    a, rng = titles(3, 200, 8)
    b = [misspelt(t, k, rng) for t in a]
    want = {}
    for j, y in enumerate(b):
        hits = [i for i, x in enumerate(a) if difflib.SequenceMatcher(None, x, y).ratio() > 0.9]
        if hits:
            want[j] = min(hits)
    frame = lambda ts: spark.createDataFrame([(i, t, None, None) for i, t in enumerate(ts)], "ord long, title string, doi string, pmid string")
    got = {r.ord: r.a_ord for r in E.fuzzy_matches(frame(a), frame(b)).collect()}
    assert got == want and len(want) > 150


def test_deduplicate_against_plain_python(spark):
    a, rng = titles(5, 40, 7)
    left = [(i, t, f"10.1/{i}" if i % 2 else None, str(i) if i % 3 == 0 else None, None) for i, t in enumerate(a)]
    right = [(0, "Other title altogether and quite new", "10.1/1", None, "x"), (1, "Another one of its own kind", None, "6", "y"), (2, a[8].upper() + ".", None, None, "z"), (3, misspelt(a[10], 1, rng), None, None, "w"), (4, "a new record nobody has", "10.9/9", None, "v"), (5, "a new record nobody has", None, None, "u")]
    schema = "ord long, title string, doi string, pmid string, abstract string"
    unique, matched = E.deduplicate(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["doi", "pmid", "abstract"])
    assert {(r.ord, r.a_ord) for r in matched.collect()} == {(0, 1), (1, 6), (2, 8), (3, 10)}
    got = {(r.title, r.abstract) for r in unique.collect()}
    assert len(got) == 41 and {(a[1], "x"), (a[6], "y"), (a[8], "z"), (a[10], "w"), ("a new record nobody has", "v")} <= got

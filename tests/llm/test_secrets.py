"""Candidates, offsets, the dictionary and the forest of the secret scan."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.llm import secrets

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 6
TEXTS = [
    (1, f'{PROSE}\ntoken = "{KEY}" {PROSE} token = "{KEY}"'), (2, f'secret="{KEY}";token="AKIA{KEY[:16].upper()}" and key:sk_live_aBcDeFgHiJkLmNoPqRsTuVwX'), (3, None), (4, ""), (5, PROSE), (6, "Donaudampfschifffahrtsgesellschaft " * 3),
    (None, f"api_key={KEY}=="), (1, "https://some-internal-service-host.example.com/?t=" + KEY), (7, "ünïcödé é " * 30 + f"password: {KEY} " + "x" * 20), (8, "é" + "abcdefghijklmnop" * 40), (9, f"{KEY} " * 1300),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "src", len(t or ""), "x", "y") for i, t in TEXTS], "doc_id long, text string, source string, n_chars long, _row string, c string").repartition(3).cache()


def test_every_run_at_its_own_place(docs):
    got = docs.select("doc_id", F.explode(secrets.candidates(F.col("text"))).alias("c")).select("doc_id", "c.*").collect()
    want = Counter((i, m.start(), m.group(), t[: m.start()].split(m.group())[-1][-9:] if i == 7 else "") for i, t in TEXTS for m in re.finditer(secrets.RUN, t or ""))
    assert Counter((r.doc_id, r.start, r.secret) for r in got) == Counter((i, s, x) for i, s, x, _ in want.elements())
    first = next(r for r in got if r.doc_id == 7)
    assert first.before.endswith("password: ") and first.after.startswith(" ")


def test_prefix_sums(spark):
    n = [1, 2, 511, 512, 513, 1500]
    rows = spark.createDataFrame([([k % 7 for k in range(m)],) for m in n], "x array<long>").select("x", secrets.prefix_sums(F.col("x")).alias("s")).collect()
    assert all(r.s == [sum(r.x[:k]) for k in range(len(r.x))] for r in rows)


def test_findings_and_masks(spark, docs):
    got = secrets.scored(docs).where(F.col("score") >= secrets.THRESHOLD).collect()
    real = Counter((r.doc_id, r.start) for r in got if r.secret.rstrip("=") == KEY)
    text = lambda i: [t for k, t in TEXTS if k == i]
    for i in (1, 2, None, 7):
        for t in text(i):
            assert all(real[i, m.start()] for m in re.finditer(KEY, t) if i != 1 or "token" in t), i
    assert not [r for r in got if r.doc_id in (5, 6, 8)]
    found = Counter()
    for r in got:
        found[r.doc_id, r.start, len(r.secret)] += 1
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r.text is None or (r.n_chars == len(r.text) and (KEY not in r.text or r.doc_id in (1, 9)))
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[3] is None and kept[4] == "" and kept[5] == PROSE and kept[6] == dict(TEXTS)[6]
    assert kept[7] == "ünïcödé é " * 30 + f"password: {secrets.MASK} " + "x" * 20
    assert kept[2].startswith(f'secret="{secrets.MASK}";token="{secrets.MASK}" and key:')
    assert secrets.redact(docs.limit(0)).count() == 0


def test_forest_removes_false_positives(spark, docs):
    marks = secrets.dictionary(docs)
    held = secrets.labelled_findings(spark, 4800).exceptAll(secrets.labelled_findings(spark, 3200))
    score = secrets.forest(secrets.labelled_findings(spark, 3200), marks)
    made = secrets.features(F.col("secret"), F.col("before"), F.col("after"), F.col("path"), marks)
    got = held.select("label", F.struct(*[v.alias(k) for k, v in made.items()]).alias("f")).select("label", score(F.col("f")).alias("p")).collect()
    assert sum((r.p >= 0.5) == (r.label == 1) for r in got) >= 0.97 * len(got)


def test_dictionary_counts_all_documents(spark):
    df = spark.createDataFrame([("common words here",), ("Common words",), (None,), ("rare",)], "text string")
    marks = secrets.dictionary(df)
    slot = {r.w: r.s for r in spark.createDataFrame([("common",), ("words",), ("here",), ("rare",), ("absent",)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(secrets.DICTIONARY_SLOTS)).alias("s")).collect()}
    assert [marks[slot[w]] for w in ("common", "words", "here", "rare", "absent")] == [1, 1, 0, 0, 0]

"""Running totals in a global order against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators import reports as R
from concord.operators import scan as S


def expected(rows):
    """rows: key, order, x; the totals of each (key, order)."""
    out, so_far = {}, {}
    for k, o, x in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        n, t = so_far.get(k, (0, 0))
        so_far[k] = out[k, o] = (n + 1, t + (x or 0))
    return out


@pytest.mark.parametrize("bits", [4, 16])
def test_running(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "BITS", bits)
    rng = random.Random(bits)
    spread = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, 2**32 - 1, -(2**32)]
    rows = [("hot", i, rng.choice([None, i % 7])) for i in range(-40, 160)] + [(k, o, 1) for k in ("few", None) for o in spread] + [(f"k{i}", rng.getrandbits(62), 3) for i in range(5)]
    rows += [("hot", None, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, x long").repartition(5)
    got = S.running(df, "o", {"t": F.col("x")}, ["k"]).collect()
    assert len(got) == len(rows)
    assert {(r.k, r.o): (r.seen, r.t) for r in got if r.o is not None} == expected(rows)
    assert [(r.seen, r.t) for r in got if r.o is None] == [(None, None)]


def test_no_keys_ties_and_empty(spark):
    df = spark.createDataFrame([(5, 1), (5, 2), (9, 3)], "o long, x long")
    assert sorted((r.o, r.x, r.seen, r.t) for r in S.running(df, "o", {"t": F.col("x")}).collect()) == [(5, 1, 2, 3), (5, 2, 2, 3), (9, 3, 3, 6)]
    assert S.running(df.limit(0), "o", {"t": F.col("x")}).collect() == []
    assert [r.n for r in S.place(spark.range(200_000, 0, -1), "id", "n").where("n <> id").collect()] == []


def test_group_rank(spark):
    rng = random.Random(3)
    rows = [("hot", i) for i in range(300)] + [(f"g{g}", i) for g in range(20) for i in rng.sample(range(1000), 1 + g % 4)]
    df = spark.createDataFrame(rows, "g string, i long")
    sizes = {g: sum(r[0] == g for r in rows) for g, _ in rows}
    rank = {g: n for n, g in enumerate(sorted(sizes, key=lambda g: (-sizes[g], g)), 1)}
    want = sorted((g, i, sizes[g], rank[g], 1 + sum(a == g and b < i for a, b in rows)) for g, i in rows)
    assert sorted((r.g, r.i, r.group_n, r.group_rank, r.item_rank) for r in R.group_rank(df, "g", "i").collect()) == want

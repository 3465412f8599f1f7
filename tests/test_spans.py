"""Window searches against every window."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from concord.functions import spans as S

WORDS = ["robot", "trial", "of", "the", "suture", "a", "patients", "autonomous", "zażółć", "x1", "level", "study"]


def every_ratio(span, text, least=0.85):
    have, n = text.split(), len(span.split())
    if not n or not have:
        return False
    windows = [" ".join(have[i : i + n]) for i in range(max(1, len(have) - n + 1))]
    return any(difflib.SequenceMatcher(None, span, w).ratio() > least for w in windows)


def every_jaccard(span, text, least=0.9):
    s, t = span.split(" "), text.split(" ")
    if not any("a" <= c <= "z" for c in span):
        return False
    own = set(s)
    windows = [set(t[i : i + len(s)]) for i in range(len(t) - len(s) + 1)]
    return any(len(own & w) >= least * len(own | w) for w in windows)


def changed(rng, words):
    out = list(words)
    for _ in range(rng.randrange(0, 1 + len(out) // 3)):
        i, kind = rng.randrange(len(out)), rng.randrange(4)
        if kind == 0:
            out[i] = out[i][:-1] + "q"
        elif kind == 1:
            out.insert(i, rng.choice(WORDS))
        elif kind == 2 and len(out) > 1:
            del out[i]
        else:
            out[i] = rng.choice(WORDS)
    return out


@pytest.mark.parametrize(("seed", "length"), [(s, n) for s in range(3) for n in (3, 12, 40, 90)])
def test_windows_against_all(seed, length):
    rng = random.Random(seed * 100 + length)
    seen = {True: 0, False: 0}
    for _ in range(60):
        text = [rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choices("abcdeé ", k=4)).strip() or "b" for _ in range(rng.randrange(1, 150))]
        at = rng.randrange(len(text))
        span, text = " ".join(changed(rng, text[at : at + length])), " ".join(text)
        assert S.has_close_window(span, text) == every_ratio(span, text)
        assert S.has_alike_window(span, text) == every_jaccard(span, text)
        seen[every_ratio(span, text)] += 1
    assert min(seen.values()) > 0


@pytest.mark.parametrize(("span", "text"), [("a", ""), ("a", "a"), ("abc def", "abc"), ("\x1c", "a b"), ("a  b", "a b"), ("123 456", "123 456 789"), ("the the the the", "the the the the the"), ("é" * 300, "é" * 299 + "e")])
def test_edges(span, text):
    assert S.has_close_window(span, text) == every_ratio(span, text)
    assert S.has_alike_window(span, text) == every_jaccard(span, text)


def test_long_text_is_searched_by_bounds():
    rng = random.Random(5)
    letters = "etaoinshrdlu"
    text = " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(200_000))
    words = text.split()
    close, far = " ".join(w[:-1] + "z" if i % 4 == 0 else w for i, w in enumerate(words[150_000:150_030])), " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    begin = time.perf_counter()
    assert S.has_close_window(close, text) and not S.has_close_window(far, text)
    assert S.has_alike_window(" ".join(words[150_000:150_029]) + " zz", text) and not S.has_alike_window(far, text)
    assert time.perf_counter() - begin < 30


def test_columns(spark):
    df = spark.createDataFrame([("a b c", "x a b c y"), (None, "a"), ("a", None), ("Robot trials", "the robot trial."), ("", "a")], "s string, t string")
    assert [r.g for r in df.select(S.grep_verify(F.col("s"), F.col("t")).alias("g")).collect()] == [True, False, False, True, False]
    assert [r.g for r in df.select(S.window_jaccard(F.col("s"), F.col("t")).alias("g")).collect()] == [True, False, False, False, False]
    assert df.limit(0).select(S.grep_verify(F.col("s"), F.col("t")), S.window_jaccard(F.col("s"), F.col("t"))).count() == 0

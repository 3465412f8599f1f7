"""Scores against an automaton of dictionaries that is walked token by token."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from concord.llm import language_model as LM

START, END = ("start",), ("end",)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


class Automaton:
    """States are contexts; arcs[state][token] and fail[state] are log10 weights."""

    def __init__(self, rows):
        grams = [Counter() for _ in range(3)]
        contexts = [Counter() for _ in range(3)]
        for i, t in rows:
            if not held(i):
                w = [START, *tokens(t)]
                for at in range(1, len(w)):
                    for n in range(min(3, at + 1)):
                        grams[n][tuple(w[at - n : at + 1])] += 1
                        contexts[n][tuple(w[at - n : at])] += 1
        self.known = grams[0]
        self.n, self.v = sum(grams[0].values()), len(grams[0])
        self.arcs, self.fail = {}, {}
        for n in range(3):
            for gram, c in grams[n].items():
                state, token = gram[:-1], gram[-1]
                if n == 0:
                    weight = (c + 1) / (self.n + self.v + 1)
                else:
                    mu, lower = LM.MU[n - 1], 10 ** self.weight(state[1:], token)
                    weight = (c + mu * lower) / (contexts[n][state] + mu)
                    self.fail[state] = math.log10(mu / (contexts[n][state] + mu))
                self.arcs.setdefault(state, {})[token] = math.log10(weight)

    def weight(self, state, token):
        total = 0.0
        while True:
            if token in self.arcs.get(state, {}):
                return total + self.arcs[state][token]
            if not state:
                return total + math.log10(1 / (self.n + self.v + 1))
            total += self.fail.get(state, 0.0)
            state = state[1:]

    def score(self, text):
        state, total = (START,), 0.0
        for t in tokens(text):
            total += self.weight(state, t)
            state = (*state, t)[-2:]
            while state and state not in self.fail:
                state = state[1:]
        return total


def corpus(n=60):
    rng = np.random.default_rng(3)
    vocabulary = [f"W{k}" for k in range(40)]
    rows = [(i, " ".join(vocabulary[k] for k in np.minimum(rng.geometric(0.15, rng.integers(1, 60)), 39))) for i in range(n)]
    return rows + [(100, rows[0][1]), (101, rows[0][1] + " never seen words"), (None, rows[1][1]), (None, None), (102, ""), (103, " \n"), (7, rows[2][1]), (7, rows[2][1])]


@pytest.mark.parametrize("files", [1, 5])
def test_scores_against_a_walk(spark, monkeypatch, tmp_path, files):
    monkeypatch.setattr(LM, "PART_BYTES", 1000)
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(files).write.parquet(str(tmp_path / "d"))
    got = LM.scores(spark.read.parquet(str(tmp_path / "d"))).collect()
    a = Automaton(rows)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((a.known[(x,)] + 1) / (a.n + a.v + 1)) for x in w)
        want[i, held(i), len(w), sum(a.known[(x,)] > 0 for x in w), a.n, round(base, 6), round(a.score(t), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_weights_of_a_state_sum_to_one():
    a = Automaton(corpus())
    every = [x for (x,) in a.known]
    for state in [(), *list(a.fail)[:40]]:
        rest = 10 ** (a.weight(state, "unknown") if state else math.log10(1 / (a.n + a.v + 1)))
        assert math.isclose(sum(10 ** a.weight(state, t) for t in every) + rest, 1, rel_tol=1e-9)


def test_no_training_documents(spark):
    ids = [i for i in range(100) if held(i)][:3]
    df = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    got = LM.scores(df).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert LM.scores(df.limit(0)).count() == 0

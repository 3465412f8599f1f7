"""Operators 11 to 13 against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm.bpe import Vocabulary, decode, encode, op12
from concord.llm.divergence import audit, shares, squeeze, unsqueeze
from concord.llm.periodic_runs import find_runs, op13, runs_of

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
WORDS = Vocabulary(VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, source string, row long, kept string"


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- 11


def plain_audit(rows, least, top):
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    n, df, groups = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = letters.findall((text or "").translate(low))
        n.setdefault((lang, source), Counter()).update(found)
        df.setdefault(lang, Counter()).update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        own = Counter()
        for s in sources:
            own.update(n[lang, s])

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(own)
        for s in sources:
            mine = p(n[lang, s])
            pairs = [(sum(abs(mine[t] - x) for t, x in p(n[lang, o]).items()), o) for o in sources if o != s]
            terms = [(mine[t] - q[t], t) for t in kept if n[lang, s][t] and mine[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)}
    return out


@pytest.mark.parametrize(("room", "slice_terms"), [((1, 1), 3), ((2, 2), 5), ((4, 256), 8192)])
def test_op11_rotation_equals_brute_force(spark, room, slice_terms):
    r = random.Random(7)
    vocabulary = ["the", "The", "été", "Été", "zwei", "x", "日本", "a", "b", "c", "d", "e", "f", "g", "😀k"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randrange(12))) + ". 12, x_y", r.choice(["en", "fr"]), f"s{min(r.randrange(12), r.randrange(12))}", i, "k") for i in range(160)]
    rows += [(None, None, None, None, 1, "k"), (None, "", "en", "only empty", 1, "k"), (3, "lonely words here", "xx", "one", 1, "k"), (3, "lonely", "yy", "one", 1, "k"), (3, "", "yy", None, 1, "k")] + rows[:4] * 2
    got = [tuple(x) for x in audit(spark.createDataFrame(rows, SCHEMA), least=4, top=3, room=room, slice_terms=slice_terms).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(rows, 4, 3)


def test_op11_empty_table_and_long_text(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "word and other words, " * 150_000, "en", "a", 1, ""), (2, "word", "en", "b", 1, "")]
    got = audit(spark.createDataFrame(rows, SCHEMA), least=1)
    assert {tuple(x) for x in got.collect()} == plain_audit(rows, 1, 50)


def test_op11_shares_are_exact_and_vectors_come_back():
    r = random.Random(1)
    for total in (7, 10**9 + 7, 8 * 10**15, 10**17):
        counts = np.array([r.randrange(min(total, 9 * 10**15)) for _ in range(50)], np.int64)
        assert shares(counts, total).tolist() == [1 + 1_000_000_000 * (int(c) + 5) // total for c in counts]
    ids, n = np.array([1, 4, 5, 8000]), np.array([1, 2**40, 3, 9 * 10**15])
    assert [x.tolist() for x in unsqueeze(squeeze(ids, n))] == [ids.tolist(), n.tolist()]


# --- 12


def ids_of(text):
    return np.asarray(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_op12_equals_the_library_on_all_documents(spark):
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {x.doc_id: x for x in op12(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        ids = ids_of(text)
        back = LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids) // 4, sha(ids), sha(back))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aabcdeht in's\t\n.é1日-", max_size=60), st.just("<|endoftext|>")), max_size=4).map("".join))
def test_op12_equals_the_library_on_any_text(text):
    ids = WORDS.encode([text])[0]
    assert ids == ids_of(text)
    assert WORDS.decode(ids) == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_op12_words_meet_in_the_trie_in_any_order():
    words = sorted({"low", "lower", "lowest", "new", "newer", "newest", "wide", "widest", "lo", "l"})
    fresh = Vocabulary(VOCABULARY)
    assert {w.decode(): ids for w, ids in fresh.traverse(sorted(x.encode() for x in words))} == {w: ids_of(w) for w in words}


def test_op12_edge_cases(spark):
    long_word, long_text = "abcab" * 60_000, "Some words again, and more. " * 120_000
    rows = [(None, None, "", "", 1, ""), (1, "", "", "", 1, ""), (1, "same", "", "", 1, ""), (1, "same", "", "", 1, ""), (2, "�bad<|endoftext|>", "", "", 1, ""), (3, long_word, "", "", 1, ""), (4, long_text, "", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = decode(encode(docs, VOCABULARY), VOCABULARY).collect()
    assert sorted((x.doc_id or 0, sha(bytes(x.ids)), sha(x.text)) for x in got) == sorted((r[0] or 0, sha(ids_of(r[1] or "")), sha(r[1] or "")) for r in rows)
    assert encode(docs.limit(0), VOCABULARY).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "text long, ids binary"), VOCABULARY).collect()[0].text == ""


# --- 13


def plain_runs(words, exponent=4, least=6):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            size = k - start + q
            if size >= max(least, exponent * q) and not any(words[start : start + size - d] == words[start + d : start + size] for d in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_op13(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=50), min_size=1, max_size=4), st.integers(2, 5), st.integers(1, 8))
def test_op13_refinement_equals_brute_force(docs, exponent, least):
    codes, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    want, at = [], 0
    for words in docs:
        want += [(s + at, size, q) for s, size, q in plain_runs(words, exponent, least)]
        at += len(words)
    assert sorted(zip(*(x.tolist() for x in runs_of(codes, doc, exponent, least)), strict=True)) == sorted(want)


def test_op13_equals_brute_force_on_planted_runs():
    r, found = random.Random(3), 0
    for _ in range(500):
        n = r.randrange(8, 300)
        words = [r.randrange(40) for _ in range(n)]
        for _ in range(r.randrange(3)):
            a, p = r.randrange(n), r.randrange(1, 9)
            words = [w if not a <= i < a + 5 * p else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = plain_runs(words)
        found += len(want)
        assert list(zip(*(x.tolist() for x in runs_of(np.array(words), np.zeros(n, np.int64))), strict=True)) == want
    assert found > 200


def test_op13_equals_brute_force_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {tuple(x) for x in op13(spark, SF).collect()} == {plain_op13(x.doc_id, x.text) for x in docs}


def test_op13_edge_cases(spark):
    long_text = "a b c " * 20_000 + "end"
    rows = [(None, None, "", "", 1, ""), (1, "", "", "", 1, ""), (2, " \t\n ", "", "", 1, ""), (3, "ha " * 9 + "ho", "", "", 1, ""), (3, "ha " * 9 + "ho", "", "", 1, ""), (4, long_text, "", "", 1, ""), (5, "a b a b a b a", "", "", 1, "")]
    got = {x.doc_id: x for x in find_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(x) for x in got[3].runs] == [(0, 9, 1)] and got[3].collapsed == "ha ho"
    assert [tuple(x) for x in got[4].runs] == [(0, 60_000, 3)] and got[4].collapsed == "a b c end"
    assert not got[5].runs and not got[None].runs and got[None].collapsed == "" == got[1].collapsed == got[2].collapsed
    assert [tuple(x) for x in find_runs(spark.createDataFrame(rows[-1:], SCHEMA), exponent=3).first().runs] == [(0, 7, 2)]
    assert find_runs(spark.createDataFrame([], SCHEMA)).count() == 0

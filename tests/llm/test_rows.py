"""Rows, not ids, own units, spans and windows: null and repeated ids against brute force."""

import hashlib
import re

import numpy as np
import pytest
import regex

from concord.llm import byte_dedup, decontaminate, line_dedup
from concord.llm.common import named

WORDS = [a + b for a in "ka lo mi ru te vo zu ny".split() for b in "ba de fi go hu".split()]


def passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + ("." if i % 9 == 8 else "") for i, k in enumerate(rng.integers(0, len(WORDS), n)))


P, Q = passage(1), passage(2)
ROWS = [
    (1, P), (None, P + " " + passage(3)), (None, passage(4)), (2, passage(5) + " " + P), (2, passage(6)), (None, Q), (None, Q + "\n" + passage(7)), (3, Q), (3, Q), (None, None), (None, ""),
    (4, f"Short.\n\nAlone here.\nShort.\n{passage(8)}\nShort."), (5, "ab " * 200 + P), (5, "x" * 250), (6, "ünïcödé " * 40 + Q), (7, "...\n\n!!! ???\n"), (8, "Short. " * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, "c") for i, t in ROWS], "doc_id long, text string, _row string, row long, doc string, pos int, spans string").repartition(4).cache()


def ranked(docs):
    """(rank, doc_id, text) of every distinct row, in order."""
    return sorted({((r.doc, r.row), r.doc_id, r.text) for r in named(docs).collect()}, key=lambda x: x[0])


def removed_units(docs, unit):
    seen, out = set(), {}
    for rank, doc_id, text in ranked(docs):
        text, spans = text or "", []
        ends = [0, *(m.end() for m in line_dedup.ENDS[unit].finditer(text))]
        ends += [len(text)] if ends[-1] < len(text) else []
        for a, b in zip(ends, ends[1:]):
            key = regex.sub(r"[^\p{L}\p{N}]+", " ", text[a:b].lower()).strip()
            if key and key in seen:
                spans.append((a, b))
            seen.add(key)
        out[doc_id, text] = len(ends) - 1, spans
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
@pytest.mark.parametrize("block", [1, 16 << 20])
def test_units_against_brute_force(docs, monkeypatch, unit, block):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    want = removed_units(docs, unit)
    got = line_dedup.dedup_report(docs, unit).collect()
    assert sorted((str(r.doc_id), r.n_units, r.n_removed, r.removed_chars, r.removed) for r in got) == sorted(
        (str(i), n, len(s), sum(b - a for a, b in s), ",".join(f"{a}-{b}" for a, b in s)) for i, t in ROWS for n, s in [want[i, t or ""]])
    clean = line_dedup.dedup_lines(docs, unit)
    assert clean.columns == docs.columns
    left = lambda t, s: "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in s))
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(i), str(None if t is None else left(t, want[i, t][1]))) for i, t in ROWS)


def test_longest_run(spark):
    rows = [(1, "One two. Three four. Five.\n\n"), (2, "One two! New. Three four?\n--\nFive. Six.")]
    got = {r.doc_id: r for r in line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].n_removed, got[2].removed_words, got[2].longest_run) == (3, 5, 2)
    assert line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def removed_bytes(docs):
    seen, out = {}, {}
    for rank, doc_id, text in ranked(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen.setdefault(b[i : i + 100], (rank, i)) != (rank, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc_id, text or ""] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("often", "most"), [(8, 2048), (1, 1), (50, 1), (50, 2048)])
def test_bytes_against_brute_force(docs, monkeypatch, often, most):
    monkeypatch.setattr(byte_dedup, "OFTEN", often)
    monkeypatch.setattr(byte_dedup, "MOST", most)
    want = removed_bytes(docs)
    got = byte_dedup.report(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *want[i, t or ""]) for i, t in ROWS)
    assert want[None, passage(4)][1] == want[2, passage(6)][1] == 0  # other rows of their ids hold repeats


def test_longest_previous_factors():
    rng = np.random.default_rng(1)
    for t in range(60):
        n = int(rng.integers(1, 40))
        text = rng.integers(97, 99, n + 12).astype(np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(text, 6)[:n]
        place = rng.permutation(n) if t % 2 else rng.integers(0, n // 2 + 1, n)
        order = sorted(range(n), key=lambda i: (bytes(rows[i]), place[i]))
        common = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
        want = [max([common(rows[i], rows[j]) for j in range(n) if place[j] < place[i]], default=0) for i in order]
        assert list(byte_dedup.longest_previous_factors(rows[order], place[order])) == want


def test_windows_of_other_rows_do_not_add_up(spark):
    item = "Counting the sheep of a large farm is not a good way to measure how tired the old shepherd has become tonight after work"
    words = item.split()
    a, b = " ".join(words[:12]), " ".join(words[11:])
    for ids in ((None, None), (7, 7)):
        df = spark.createDataFrame(list(zip(ids, (a, b))), "doc_id long, text string")
        assert decontaminate.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
    whole = spark.createDataFrame([(None, item), (None, a), (7, b), (7, item)], "doc_id long, text string")
    got = decontaminate.contamination(whole, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "None"]


def templates(text):
    """(code, value) of every token, written plainly: words, and placeholders for numbers, names and units."""
    out, before = [], False
    for raw in re.findall(r"[^ \t-\r]+", re.sub(r"[^A-Za-z0-9\x80-\U0010ffff \t-\r]", "", text or "")):
        value = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
        number = bool(re.search("[0-9]", raw))
        name = bool(re.match("[A-Z]", raw)) and len(re.findall("[A-Z]", raw)) == 1
        code = "<number>" if number else "<unit>" if before and value in decontaminate.UNITS else "<name>" if name else value
        out.append((code, value))
        before = number
    return out


def windows_of(tokens, n):
    for i in range(len(tokens) - n + 1):
        part = tokens[i : i + n]
        bare = sum(not c.startswith("<") for c, _ in part) < min(decontaminate.LITERALS, n)
        yield i, tuple(v if bare else c for c, v in part) + (bare,), [v for c, v in part if c.startswith("<")]


def contaminated_pairs(texts, items):
    found = []
    for i, text in texts:
        tokens = templates(text)
        for k, item in items:
            it = templates(item)
            if not it:
                continue
            n = min(decontaminate.WINDOW, len(it))
            mine, seen = list(windows_of(it, n)), set()
            shifts = {}
            for p, key, slots in windows_of(tokens, n):
                for q, other, islots in mine:
                    if key == other:
                        shifts.setdefault(p - q, []).append((key, islots, slots))
            for hits in shifts.values():
                against = {}
                for _, islots, slots in hits:
                    for a, b in zip(islots, slots):
                        against.setdefault(a, set()).add(b)
                seen |= {key for key, islots, _ in hits if all(len(against[a]) == 1 for a in islots)}
            total = len({key for _, key, _ in mine})
            if len(seen) >= decontaminate.COVERAGE * total:
                found.append((i, k, total, len(seen)))
    return sorted(found)


def test_decontamination_against_brute_force(spark):
    items = [
        (1, "A train leaves Springfield at 9 with 120 passengers and travels 300 km before it stops near Shelbyville for a short rest of 20 minutes"),
        (2, "Tom has 5 apples. Ann gives Tom 7 pears. Tom eats 5 apples. How many are left for Ann and Tom after 5 days"), (3, "4 5 6 7 8 9 10 11 12 13"), (4, "tiny Item"), (5, None), (6, ""),
    ]
    other = items[1][1].replace("Tom", "Bob").replace("Ann", "Eve")
    texts = [
        (1, f"{passage(20)} {items[0][1]} {passage(21)}"), (2, items[0][1].replace("Springfield", "Ogdenville").replace("9 with 120", "7 with 85").replace("km", "miles")), (3, other.replace("5", "8")),
        (4, other.replace("5 apples. A", "4 apples. A")), (5, "4 5 6 7 8 9 10 11 12 13"), (6, " ".join(map(str, range(200)))), (7, "1 2 3 9 " * 60), (8, "a tiny Thing"), (9, "a tiny Item"), (10, items[0][1].upper()),
        (11, None), (12, ""), (13, " ".join(items[1][1].split()[:12])), (14, passage(22)), (15, "Tom has 5 apples. " * 5),
    ]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, row int, hash string")
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in got) == contaminated_pairs(texts, items)
    assert {(1, 1), (2, 1), (3, 2), (5, 3), (9, 4)} <= {(r.doc_id, r.item_id) for r in got}
    assert not {(7, 3), (14, 1), (14, 2)} & {(r.doc_id, r.item_id) for r in got}


def test_op4_rows_without_an_id_link_their_neighbours(spark, monkeypatch):
    """Steps of two bits: the middle fingerprint is held by null ids alone."""
    from concord.llm import near_duplicates

    rows = [(1, 0xF0F0), (None, 0xF0F3), (2, 0xF0FF), (7, 1 << 60), (None, 0xFF << 40), (None, 0x7F << 40)]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(near_duplicates, "fingerprints", lambda docs: frame)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert got == {(i, f"{fp:016x}"): {1: 1, 2: 1, 7: 7}.get(i, 1 if fp == 0xF0F3 else None) for i, fp in rows}

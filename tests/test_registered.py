"""Registered queries without SQL against plain Python, over their whole tables."""

import difflib
import random
import re
import unicodedata
from collections import Counter

import pytest

from concord.functions.nulls import AUDIT_ABSENCE
from concord.functions.text import STOP_WORDS
from concord.queries import QUERIES

FLAT = lambda t: re.sub(r"\s+", " ", t).strip().lower()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(8)
    vocabulary = "the robot “STAR” sutures 5 pigs in 12.5 minutes with A.B. tools and 1,200 stitches, not discussed NR of näive über".split()
    docs = []
    for i in range(60):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 5))]
        docs.append((i, "\n".join(lines) if i else "", "en", "s", 1))
    docs += [(100, "NR", "en", "s", 1), (101, "12.5 minutes of suturing\nThe end", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    kinds = ["click", "clicks", "view; purchse", "NR", "log in", "", "sign-up ; view", "zzz"]
    events = [(i, None, i % 5, rng.choice(kinds), 1.0, "{}") for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{root}/events.parquet")
    return str(root), docs, events


def triple(i, text):
    line = text.split("\n")[0]
    span = line.upper() if i % 4 == 0 else line + " zzzz qqqq" if i % 4 == 1 else line
    return line[:12], span, ("categorical", "numeric", "free_text")[i % 3]


def content(t):
    return {w for w in re.findall("[a-z]+", t.lower()) if len(w) >= 2 and w not in STOP_WORDS}


def test_precheck_flags(spark, tables):
    root, docs, _ = tables
    want = Counter()
    for i, text, *_ in docs:
        value, span, kind = triple(i, text)
        s, source = FLAT(span), FLAT(text)
        method = "none"
        if s and source:
            if s in source:
                method = "exact_substring"
            elif re.search("[a-z]", s):
                have, own = source.split(" "), s.split(" ")
                windows = [have[k : k + len(own)] for k in range(len(have) - len(own) + 1)]
                if any(len(set(own) & set(w)) >= 0.9 * len(set(own) | set(w)) for w in windows):
                    method = "jaccard_fallback"
        if kind == "numeric":
            m = re.match(r"-?\d+(?:\.\d+)?", value.strip().replace(",", ""))
            inside = bool(m) and any(float(x) == float(m.group()) for x in re.findall(r"-?\d+(?:\.\d+)?", span.replace(",", "")))
        elif kind == "categorical":
            inside = FLAT(value) != "" and FLAT(value) in s
        else:
            a, b = content(value), content(span)
            inside = bool(a and b) and len(a & b) / len(a | b) >= 0.3
        want[i, kind, len(span.strip()) >= 10, method, method != "none", inside, len(span), method != "none" and inside] += 1
    got = QUERIES["precheck_flags"](spark, root).collect()
    assert Counter((r.doc_id, r.field_type, r.span_present, r.span_match_method, r.span_in_source, r.value_in_span, r.span_length, r.short_circuit) for r in got) == want


def audit_key(t):
    for a, b in zip("‘’“”–—", "''\"\"--"):
        t = t.replace(a, b)
    return FLAT(re.sub(r"(?<=\w)\.(?=\w)", " ", unicodedata.normalize("NFKC", t)))


def test_audit_states(spark, tables):
    root, docs, _ = tables
    want = {}
    for i, text, *_ in docs:
        value, span, _ = triple(i, text)
        snippet = "" if i % 7 == 0 else span + "..." if i % 7 == 1 else span
        s, t = audit_key(snippet), audit_key(text)
        found = bool(s) and (s in t or any(difflib.SequenceMatcher(None, s, " ".join(t.split()[k : k + len(s.split())])).ratio() > 0.85 for k in range(max(1, len(t.split()) - len(s.split()) + 1))))
        if value in AUDIT_ABSENCE:
            want[i] = "verified"
        elif snippet.strip() and ("..." in snippet or "…" in snippet):
            want[i] = "invalid_snippet"
        elif not snippet.strip() or i % 6 == 0:
            want[i] = "flagged"
        else:
            want[i] = "verified" if i % 5 == 4 or found else "contested"
    assert {r.doc_id: r.audit_state for r in QUERIES["audit_states"](spark, root).collect()} == want


def test_field_issues(spark, tables):
    root, _, events = tables
    enums = {"f1": ["click", "view"], "f2": ["purchase"], "f3": ["login"], "f4": ["logout"], "f5": ["click"], "f6": ["view"], "f0": ["purchase", "signup"]}
    want = Counter()
    for i, _, _, kind, *_ in events:
        field, value = f"f{i % 7}", "NR" if i % 11 == 0 else kind
        for part in (x.strip() for x in value.split(";")):
            if part.lower() not in ("", "nr", "n/r", "not reported", "not_found", "none", "n/a") and part not in enums[field]:
                close = difflib.get_close_matches(part, sorted(enums[field]), 1, 0.4)
                want[field, part, close[0] if close else None] += 1
    got = QUERIES["field_issues"](spark, root).collect()
    assert Counter({(r.field_name, r.part, r.closest): r.n for r in got}) == want

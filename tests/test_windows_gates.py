"""Source windows by tokens, imports that apply whole or not at all, and the rules of values and workbooks."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.operators import gates as G
from concord.operators import jobs as B
from concord.operators import verify as C
from concord.operators import windows as W

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def long_text(seed, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(n))


def plain_window(text, spans, budget, radius):
    if count(text) <= budget:
        return text, False
    marks = [False] * (len(text) + 1)  # characters that are shown; the borders of the windows are joined by hand
    ranges = []
    for span in spans:
        at = text.find(span[:200]) if span else -1
        if at < 0 and span and len(span) >= 80:
            at = text.find(span[:80])
        if at < 0:
            continue
        a, b = max(0, at - 4 * radius), min(len(text), at + len(span[:200]) + 4 * radius)
        before = text[:a]
        a = before.rindex("\n\n") + 1 if "\n\n" in before else before.rindex("\n") + 1 if "\n" in before else 0
        after = text[b:]
        b = b + after.index("\n\n") if "\n\n" in after else b + after.index("\n") if "\n" in after else len(text)
        ranges.append((a, b))
        marks[a:b] = [True] * (b - a)
        if a and marks[a - 1] is False and any(e == a for _, e in ranges):
            marks[a] = True
    if not ranges:
        return None, True
    pieces, at = [], 0
    starts = sorted({a for a, _ in ranges})
    while at < len(text):
        if marks[at]:
            end = at
            while end < len(text) and marks[end]:
                end += 1
            pieces.append(text[at:end])
            at = end
        else:
            at += 1
    assert starts
    return W.GAP.join(pieces), True


@pytest.mark.parametrize("seed", range(6))
def test_source_windows_by_tokens(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for i in range(30):
        text = long_text(100 * seed + i, r.randrange(5, 700))
        spans = [text[(p := r.randrange(len(text))) : p + r.choice([10, 90, 300])] for _ in range(r.randrange(4))] + [None, "", "nowhere to be found"]
        if r.random() < 0.3:
            spans.append(text[:120] + "#" * 100)  # found by its first 80 characters
        rows.append((i, text, spans))
        want[i] = plain_window(text, spans, 300, 12)
    got = W.with_source_windows(spark.createDataFrame(rows, "id long, source_text string, spans array<string>"), VOCABULARY, 300, 12).collect()
    windows = 0
    for x in got:
        shown, windowed = want[x.id]
        assert x.windowed == windowed
        windows += windowed
        if shown is None:
            assert x.source_text.startswith(x.window) and x.n_tokens == 300
        elif count(shown) <= 300:
            assert (x.window, x.n_tokens) == (shown, count(shown))
        else:
            assert shown.startswith(x.window) and x.n_tokens == 300 and count(x.window) in range(299, 302)
    assert windows > 5


def test_windows_of_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", ["a"]), (3, "short é", None)], "id long, source_text string, spans array<string>")
    assert [(x.window, x.windowed, x.n_tokens) for x in W.with_source_windows(rows, VOCABULARY).orderBy("id").collect()] == [("", False, 0), ("", False, 0), ("short é", False, count("short é"))]
    assert W.with_source_windows(rows.limit(0), VOCABULARY).count() == 0


def test_token_windows_follow_the_offsets():
    text = long_text(1)
    offsets = LIBRARY.encode(text, add_special_tokens=False).offsets
    for place in (0, 1, 57, len(text) // 2, len(text) - 1):
        centre = sum(a < place for a, _ in offsets)
        shown = offsets[max(0, centre - 5) : centre + 6]
        assert W.token_window(text, place, VOCABULARY, 5) == (text[shown[0][0] : shown[-1][1]] if shown else "")
    assert W.head_window(text, VOCABULARY, 80) == text[: offsets[19][1]][:80]
    assert W.token_window("日本語😀" * 20, 41, VOCABULARY, 3) in "日本語😀" * 20


def test_audit_strategies(spark):
    text = long_text(3, 900)
    span = text[2000:2100]
    rows = [
        (1, "short text", "x", "short", ["short"]),
        (2, text, "NR", None, [None]),
        (3, text, "x", span, [span]),
        (4, text, "x", "not there", ["not there"]),
        (5, text * 3, "x", span, [span, None]),
        (6, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, source_text string, value string, span string, spans array<string>")
    got = {x.id: x for x in W.with_audit_windows(df, VOCABULARY, count(text) + 10, (30, 10), 600).collect()}
    assert {i: x.strategy for i, x in got.items()} == {1: "full_text", 2: "absence_fallback_head", 3: "arm_span_window", 4: "missing_span_fallback_head", 5: "pass2_window", 6: "full_text"}
    assert got[2].window == W.head_window(text, VOCABULARY, 600) and text.startswith(got[2].window)
    assert got[3].window in text and len(got[3].window) <= 600 and text.index(got[3].window) <= 2000 < text.index(got[3].window) + len(got[3].window)
    assert got[5].window == W.source_window(text * 3, [span], VOCABULARY, count(text) + 10, 30)[0] and span[:20] in got[5].window


def test_first_tokens_of_a_long_text_without_the_rest():
    """Pieces have the tokens of the whole, and a budget does not tokenise a text to its end."""
    odd = "don't stop  a\n\nb é à 日本 x y  z 12 a1 b2 <|endoftext|> tail's end \t q " * 40
    for text in (long_text(2, 900), odd, odd.replace(" ", ""), "", "a", "a b"):
        offsets = LIBRARY.encode(text, add_special_tokens=False).offsets
        for enough in (0, 1, 50, 400, 10**6):
            tokens = W.Tokens(VOCABULARY, text, enough)
            got = list(zip(tokens.starts, tokens.ends, strict=True))
            assert got == offsets[: len(got)] and (len(got) > enough or len(got) == len(offsets))
    assert len(W.Tokens(VOCABULARY, long_text(2, 900) * 20, 50)) < 1000


@pytest.mark.parametrize("at", [0, 1, 3, 4, 5, 8, 13, 14, 30, 99])
def test_paragraphs_snap_on_both_sides(spark, at):
    for text in ("one\n\ntwo three\nfour\n\n\nfive", "one\ntwo\nthree", "no break at all", "", "\n\nx"):
        row = spark.range(1).select(B.snap_paragraph(F.lit(text), F.lit(at)).alias("a"), B.snap_paragraph_end(F.lit(text), F.lit(at)).alias("b")).first()
        assert (row.a, row.b) == (W.paragraph_start(text, at), W.paragraph_end(text, at) if at < len(text) else len(text)), (text, at)


DECISIONS = "paper_id string, field_name string, decision string"


def test_an_import_applies_whole_or_not_at_all(spark):
    done = spark.createDataFrame([("9", "f")], "paper_id string, field_name string")
    keys = ["paper_id", "field_name"]
    good = [("1", "f", "AGREE"), ("2", "f", "DISAGREE"), ("9", "f", None), ("3", "f", None), ("3", "f", "AGREE")]
    rows, errors = G.pair_decisions(spark.createDataFrame(good, DECISIONS), done, keys)
    assert sorted(x.paper_id for x in rows.collect()) == ["1", "2", "3"] and errors.count() == 0
    for bad, why in ((("4", "f", "MAYBE"), "invalid decision"), (("4", "f", " "), "invalid decision"), (("1", "f", "AGREE"), "duplicate"), (("9", "f", "AGREE"), "duplicate")):
        frame = spark.createDataFrame([*good, bad], DECISIONS)
        rows, errors = G.pair_decisions(frame, done, keys)
        assert [x.error for x in errors.collect()] == [why]
        with pytest.raises(Exception, match="import refused, errors: 1, first: "):
            rows.collect()
        with pytest.raises(Exception, match="import refused"):
            rows.count()
        assert G.pair_decisions(frame, done, keys, "empty")[0].count() == 0


def test_a_refused_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    errors = rows.where("k = 7").selectExpr("k", "'bad' AS error")
    with pytest.raises(Exception, match="import refused"):
        G.only_if_clean(rows, errors).write.parquet(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.parquet"))
    G.only_if_clean(rows, errors.limit(0)).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1000


def test_workbook_rules(spark):
    schema = "paper_id string, kind string, setting string, key_limitation string, sq string"
    options, known = {"kind": ["Review", "Original Research"], "setting": ["In Vivo", "Ex vivo"]}, spark.createDataFrame([("EE-001",), ("EE-002",)], "paper_id string")
    check = lambda *rows: sorted((x.paper_id, x.error, x.part or "") for x in G.workbook_problems(spark.createDataFrame(rows, schema), options, {"key_limitation": "sq"}, known).collect())
    assert check((" EE-001 ", "review", "in vivo; EX VIVO", "small", "quote"), ("EE-002", "NR", " ", None, None), ("EE-001", None, "nr", "NR", None)) == []
    assert check(("EE-003", "Review", None, None, None)) == [("EE-003", "unknown paper", "")]
    assert check(("EE-1", "Review", None, None, None)) == [("EE-1", "label", ""), ("EE-1", "unknown paper", "")]
    assert check(("EE-001", "Editorial", "in vivo; cadaver;", None, None)) == [("EE-001", "value of kind", "Editorial"), ("EE-001", "value of setting", ""), ("EE-001", "value of setting", "cadaver")]
    assert check(("EE-001", None, None, "small", " NR ")) == [("EE-001", "quote of key_limitation", "")]
    empty = spark.createDataFrame([], schema)
    assert [x.error for x in G.workbook_problems(empty, options, {"key_limitation": "sq"}).collect()] == ["no rows"]


def test_field_rules(spark):
    fields = spark.createDataFrame([("autonomy", ["1 (No autonomy)", "2 (Task autonomy)"]), ("kind", ["Review", "Original Research"]), ("sample_size", None), ("free", None)], "field_name string, options array<string>")
    values = [
        ("autonomy", "2"), ("autonomy", "2 (Task autonomy); 1"), ("autonomy", "2 (Tas"), ("autonomy", "3"), ("kind", "Reviews; Original Research;"), ("kind", "review"), ("kind", "NR"), ("kind", "NOT_FOUND"),
        ("sample_size", " 12 "), ("sample_size", "-3"), ("sample_size", "12 pigs"), ("sample_size", "1.5"), ("sample_size", "NR"), ("free", "anything; at all"), ("kindd", "Review"), ("zzzz", "NR"),
    ]
    got = sorted((x.field_name, x.part, x.issue, x.closest) for x in C.field_issues(spark.createDataFrame(values, "field_name string, value string"), fields).collect())
    assert [g[:3] for g in got] == [
        ("autonomy", "2 (Tas", "invalid categorical value"), ("autonomy", "3", "invalid categorical value"), ("kind", "Reviews", "invalid categorical value"), ("kind", "review", "invalid categorical value"),
        ("kindd", "kindd", "unknown field name"), ("sample_size", "1.5", "non-numeric size"), ("sample_size", "12 pigs", "non-numeric size"), ("zzzz", "zzzz", "unknown field name"),
    ]
    closest = {g[1]: g[3] for g in got}
    assert closest["2 (Tas"] == "2 (Task autonomy)" and closest["Reviews"] == "Review" == closest["review"] and closest["kindd"] == "kind" and closest["zzzz"] is None


def test_decorated_rationales(spark):
    df = spark.createDataFrame([(1, "why", 0.5), (2, "why", 0.0), (3, "why", None), (4, None, 0.25), (5, None, None)], "id long, r string, c double")
    assert [x.d for x in df.orderBy("id").select(B.decorated(F.col("r"), F.col("c")).alias("d")).collect()] == ["why [confidence: 0.5]", "why", "why", " [confidence: 0.25]", None]

"""Operators on hand-built rows with exact expected values."""

import pytest
from pyspark.sql import functions as F

from concord import lifecycle as L
from concord.operators import agreement as A
from concord.operators import entities as E
from concord.operators import imports as I
from concord.operators import latest as J
from concord.operators import reports as R
from concord.operators import sampling as S
from concord.operators import verify as C
from concord.sources import readers, responses, sinks
from concord.streaming import streams


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_fold_skips_illegal_edges(spark):
    events = spark.createDataFrame([
        (1, 1, "ABSTRACT_SCREENED_IN", False), (1, 2, "EXTRACTED", False), (1, 3, "PDF_ACQUIRED", False),
        (2, 1, "EXTRACTED", True), (2, 2, "AI_AUDIT_COMPLETE", False), (3, 1, "REJECTED", False),
    ], "paper_id long, seq long, to_status string, override boolean")
    assert rows(L.fold_status(events)) == [(1, "PDF_ACQUIRED", 2, 1), (2, "AI_AUDIT_COMPLETE", 2, 0), (3, "INGESTED", 0, 1)]


def test_gate_keeps_the_partial_order(spark):
    df = spark.createDataFrame([(s,) for s in L.STATUSES], "status string")
    assert rows(df.where(L.passes_gate(F.col("status"), "PARSED"))) == sorted((s,) for s in L.GATE_LEVELS)


def test_latest_and_orphans(spark):
    ex = spark.createDataFrame([(1, 9, "a"), (2, 9, "b"), (3, 8, "a")], "id long, paper_id long, schema_hash string")
    sp = spark.createDataFrame([(1, "f", 1), (2, "f", 1), (2, "f", 2), (3, "g", 1)], "extraction_id long, field_name string, span_no int")
    assert rows(J.latest(ex, ["paper_id"], ["id"]), "id") == [(2,), (3,)]
    assert rows(J.stale(ex, "a"), "id") == [(2,)]
    assert rows(J.orphans(sp, ex)) == [(1, "f", 1)]
    assert rows(J.current_spans(ex, sp), "paper_id", "span_no") == [(8, 1), (9, 2)]
    papers = spark.createDataFrame([(8,), (7,)], "id long")
    assert rows(J.pending(papers, ex)) == [(7,)]


def test_labels_are_global(spark):
    df = J.labelled(spark.range(1, 9001).where("id % 2 = 1"))
    assert rows(df.where("id in (1, 4097, 8999)"), "id", "ee_seq", "ee_label") == [(1, 1, "EE-001"), (4097, 2049, "EE-4097"), (8999, 4500, "EE-8999")]


def test_prisma_reconciles(spark):
    data = [(i, s, "NON_ENGLISH", None, f"s{i % 2}") for i, s in enumerate(["ABSTRACT_SCREENED_OUT"] * 4 + ["AI_AUDIT_COMPLETE"] * 3 + ["PDF_EXCLUDED"] * 2 + ["FT_SCREENED_OUT"])]
    papers = spark.createDataFrame(data, "id long, status string, pdf_exclusion_reason string, rejected_reason string, source string")
    flow = R.prisma_flow(papers)
    r = R.prisma_reconcile(flow, R.prisma_by_source(papers)).first()
    assert (r.counted, r.discrepancy, r.n_broken, r.valid) == (10, 0, 0, True)
    r = R.prisma_reconcile(flow, R.prisma_by_source(papers.where("id > 0"))).first()
    assert (r.discrepancy, r.n_broken, r.valid) == (-1, 1, False)
    r = R.prisma_reconcile(flow, R.prisma_by_source(papers.where("id <> 5"))).first()
    assert (r.n_broken, r.valid) == (2, False)


CONSENSUS = {"EE-001": (["x"] * 4, "UNANIMOUS"), "EE-002": (["x"] * 3 + ["y"], "MAJORITY"), "EE-003": (["x", "x", "y", "y"], "NO_CONSENSUS"), "EE-004": (["30", None, "30", None], "UNANIMOUS"), "EE-005": (["x", None, None, None], "INSUFFICIENT"), "EE-006": (["Da Vinci", "da vinci", "DA VINCI", "Raven"], "MAJORITY")}


def test_consensus(spark):
    data = [(i, p, "ABCD"[k], "f", v, 0) for i, (p, (values, _)) in enumerate(CONSENSUS.items()) for k, v in enumerate(values)]
    human = spark.createDataFrame(data, "id long, paper_id string, extractor string, field_name string, value string, ts long")
    assert rows(A.consensus(human), "paper_id", "status") == sorted((p, s) for p, (_, s) in CONSENSUS.items())


def test_alignment_covers_the_union_of_fields(spark):
    arms = spark.createDataFrame([("local", 0, 1, "a", "x"), ("openai", 1, 1, "b", "NR"), ("local", 0, 2, "a", "x")], "arm string, arm_ord int, paper_id long, field_name string, value string")
    assert rows(A.scores(arms, ["local", "openai"]), "paper_id", "field_name", "score") == [(1, "a", "MISMATCH"), (1, "b", "MATCH")]


def test_distribution_status(spark):
    data = [("c", "x")] * 10 + [("l", "x")] * 19 + [("l", "y")] + [("o", "x")] * 9 + [("c", "NR")] * 5
    got = A.distribution(spark.createDataFrame(data, "k string, value string"), ["k"])
    assert rows(got, "k", "n_values", "status") == [("c", 10, "COLLAPSED"), ("l", 20, "LOW_VARIANCE"), ("o", 9, "OK")]
    with pytest.raises(ValueError, match="collapsed"):
        A.assert_no_collapse(got)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 9, 3, 3]], "v double").withColumn("k", F.lit(1))
    r = R.nearest_rank(df, ["k"], "v", [0, 50, 95, 100]).first()
    assert (r.p0, r.p50, r.p95, r.p100) == (1.0, 3.0, 9.0, 9.0)


CITED = "ord long, pmid string, doi string, title string, abstract string, year int"


def test_dedup(spark):
    a = spark.createDataFrame([(0, "1", "10.1/A", "Alpha robots in the operating room", None, None), (1, "12345", None, "Beta study", "kept", 2001), (2, None, None, "A Title, with marks.", None, None)], CITED)
    b = spark.createDataFrame([(10, None, "10.1/a", "other", "filled", 2023), (11, "12345", None, "other two", "no", 1999), (12, None, None, "a title with marks", None, None), (13, None, None, "Alpha robot in the operating room", None, None), (14, None, "10.1/new", "Gamma", None, None), (15, None, "10.1/NEW", "Gamma delta", None, None)], CITED)
    got = {r.ord: (r.a_ord, r.hit) for r in E.exact_matches(a, b).collect()}
    assert got[10] == (0, "doi_key") and got[11] == (1, "pmid") and got[12] == (2, "title_key") and got[13] == (None, None)
    unique, matched = E.deduplicate(a, b, ["abstract", "year"])
    assert rows(unique, "ord", "abstract", "year") == [(0, "filled", 2023), (1, "kept", 2001), (2, None, None), (14, None, None)]
    assert rows(matched, "ord") == [(10,), (11,), (12,), (13,)]
    empty = a.limit(0)
    assert E.deduplicate(empty, b.where("ord = 14"), ["abstract"])[0].count() == 1
    assert E.deduplicate(a, empty, ["abstract"])[0].count() == 3


def test_precheck(spark):
    text = "Methods. A total of 20 patients were  enrolled in the trial."
    data = [("20", "total of 20 patients", text, "numeric", 0.0), ("robot", None, text, "free_text", 0.0), ("x", "  ", text, "free_text", 0.0), ("patients", "A TOTAL of 20 patients were enrolled", text, "categorical", 0.0), ("trial", "nothing shared whatsoever", "other words only", "free_text", 0.0)]
    got = C.precheck(spark.createDataFrame(data, "value string, span string, source_text string, field_type string, tolerance double")).collect()
    assert [(r.span_present, r.span_match_method, r.value_in_span) for r in got] == [(True, "exact_substring", True), (False, "none", False), (False, "none", False), (True, "exact_substring", True), (True, "none", False)]


def test_audit_states(spark):
    text = "The STAR robot was used for autonomous suturing."
    data = [("NR", None, 1, text, False), ("x", "The ... suturing", 1, text, True), ("x", "", 1, text, True), ("x", "STAR robot", 1, text, True), ("x", "absent words entirely", 1, text, True), ("x", "absent words entirely", 4, text, True), ("x", "STAR robot", 1, text, False)]
    got = C.audit(spark.createDataFrame(data, "value string, source_snippet string, tier int, paper_text string, semantic boolean")).collect()
    assert [r.audit_state for r in got] == ["verified", "invalid_snippet", "flagged", "verified", "contested", "verified", "flagged"]


def test_field_checks(spark):
    enums = readers.enum_dimension(spark, {"f": ["Animal", {"value": "Human (in vivo)"}], "g": ["Review"]})
    values = spark.createDataFrame([("f", "Animal; Review"), ("f", "anim"), ("f", "NR")], "field_name string, value string")
    assert rows(C.field_bleed(values, enums), "part", "other_field") == [("Review", "g")]
    fields = enums.groupBy("field_name").agg(F.collect_set("enum_value").alias("options"))
    assert ("anim", "Animal") in rows(C.field_issues(values, fields), "part", "closest")
    fixed, changed = C.normalise_categories(values, enums)
    assert rows(changed, "value", "new_value") == [("anim", "Animal")]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 3).withColumn("arm", F.col("id") % 2)
    a, b = (rows(S.stratified(df.repartition(n), ["v", "arm"], "id", 4), "id") for n in (2, 7))
    assert a == b and len(a) == 24
    assert S.under_supplied(df.where("id < 9"), ["v", "arm"], 2).count() == 3
    sample = S.shuffled(S.stratified(df, ["v", "arm"], "id", 4), "id")
    assert sorted(r.row_id for r in sample.collect()) == list(range(1, 25))
    assert S.is_monotonic(sample, "row_id", "id").first().monotonic is False
    arms = spark.createDataFrame([(7, ["a", "b", "c"])], "s long, arms array<string>").select(S.permutation(F.col("arms"), F.col("s")).alias("p")).first().p
    assert sorted(arms) == ["a", "b", "c"]
    chosen = S.first_strata(df, "id", [("one", F.col("v") == 0, 2), ("two", F.col("arm") == 0, 2)], "id")
    assert rows(chosen, "stratum", "id") == [("one", 0), ("one", 3), ("two", 2), ("two", 4)]


def test_import_rules(spark):
    known = spark.createDataFrame([(1,), (2,)], "id long")
    bad = spark.createDataFrame([(1, "ACCEPT", ""), (1, "CORRECT", ""), (3, "maybe", "x")], "id long, decision string, note string")
    assert rows(I.errors(bad, known, "id", "decision", ["ACCEPT", "CORRECT"], ["CORRECT"])) == [("1", "note missing"), ("1", "repeated"), ("3", "bad decision"), ("3", "unknown id")]
    wide = spark.createDataFrame([(1, "a", " "), (2, None, "b")], "id long, f_correction string, g_correction string")
    assert rows(I.wide_to_long(wide, "id")) == [(1, "f", "a"), (2, "g", "b")]
    mapped, unmapped = L.map_decisions(spark.createDataFrame([("reject",), ("what",)], "decision string"))
    assert rows(mapped) == [("REJECT_VALUE",)] and rows(unmapped) == [("what",)]


def test_responses(spark):
    data = [(1, '{"fields": [{"field_name": "a", "value": 3}]}'), (2, '```json\n[{"field": "b", "value": null}]\n```'), (3, '{"c": "x", "d": null}'), (4, "no json"), (5, '{"field_name": "e", "value": "y", "confidence": 0.5, "tier": 2}')]
    got = responses.spans(spark.createDataFrame(data, "id long, response string"))
    assert [(r.id, r.field_name, r.value) for r in got.orderBy("id", "ordinal").collect()] == [(1, "a", "3"), (2, "b", "NR"), (3, "c", "x"), (3, "d", "NR"), (4, None, None), (5, "e", "y")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    good, bad = readers.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a long")
    assert rows(good) == [(1,), (2,)] and bad.count() == 1
    index = spark.createDataFrame([({"world": [1], "hello": [0, 2]},)], "i map<string,array<int>>")
    assert index.select(readers.inverted_abstract(F.col("i")).alias("r")).first().r == "hello world hello"
    root = str(tmp_path / "store")
    assert sinks.publish({"heads": spark.range(2), "spans": spark.range(3)}, root) == 1
    assert sinks.publish({"heads": spark.range(5), "spans": spark.range(1)}, root) == 2
    assert sinks.read(spark, root, "heads").count() == 5
    with pytest.raises(ValueError, match="empty"):
        sinks.publish({"heads": spark.range(1), "spans": spark.range(0)}, root)
    assert sinks.version(spark, root) == 2
    assert readers.boolean_query([["a b", "c"], ["d"]], (2000, 2001)) == '("a b" OR c) AND (d) AND 2000:2001[dp]'


def test_streaming_fold_equals_batch(spark, tmp_path):
    data = [(p, i, L.STATUSES[(p * i) % 15], i % 7 == 0) for p in range(6) for i in range(12)]
    events = spark.createDataFrame(data, "paper_id long, seq long, to_status string, override boolean")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.fold_status(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("folded")) == rows(L.fold_status(events))

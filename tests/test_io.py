"""Readers, sinks and streams over small files."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from concord import lifecycle as L
from concord.operators import jobs as B
from concord.operators import queues as Q
from concord.operators import sampling as S
from concord.sources import readers, sinks
from concord.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_catalogue_registers_views(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "papers.parquet"))
    assert readers.catalogue(spark, str(tmp_path), ["papers"])["papers"].count() == 3
    assert spark.sql("SELECT max(id) FROM papers").first()[0] == 2


def test_csv_json_and_decisions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    assert rows(readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, text string")) == [(1, 'two\nlines, "quoted"'), (2, None)]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\nnot json\n{"id": 2}\n{"id": "word"}\n')
    good, bad = readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id int, v string")
    assert rows(good) == [(1, "x"), (2, None)] and rows(bad) == [("not json",), ('{"id": "word"}',)]
    (tmp_path / "d.json").write_text('{"review": "r",\n "decisions": [{"id": 1, "decision": "ACCEPT"}, {"id": 2, "decision": null}]}')
    d = readers.read_decisions(spark, str(tmp_path / "d.json"), "review string, decisions array<struct<id: int, decision: string>>")
    assert rows(d.select(F.inline("decisions"))) == [(1, "ACCEPT"), (2, None)]


def test_pdf_files_are_checked(spark, tmp_path):
    (tmp_path / "EE-001_Smith_2020.pdf").write_bytes(b"%PDF" + b"0" * 11_000)
    (tmp_path / "EE-002_Doe_2021.pdf").write_bytes(b"%PDF" + b"0" * 100)
    (tmp_path / "x.pdf").write_bytes(b"<html>" + b"0" * 11_000)
    files = readers.pdf_files(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.valid, len(r.sha256)) for r in files.collect()) == [("EE-001_Smith_2020.pdf", True, 64), ("EE-002_Doe_2021.pdf", False, 64), ("x.pdf", False, 64)]
    papers = spark.createDataFrame([(1, "one"), (2, "two")], "id long, title string")
    assert rows(readers.file_papers(files, papers), "id", "title") == [(1, "one"), (2, "two"), (None, None)]


def test_specs_rules_and_sheets(spark):
    with pytest.raises(ValueError):
        readers.check_spec([{"name": "a", "tier": 2}], (2000, 2010))
    with pytest.raises(ValueError):
        readers.check_spec([{"name": "a", "tier": 1}], (2011, 2010))
    readers.check_spec([{"name": "a", "tier": 1}], (2010, 2010))
    assert len(B.rules_from({"categories": [{"name": "x", "regex": "a"}, {"name": "y", "keywords": ["b"]}]})) == 2
    with pytest.raises(ValueError):
        B.rules_from({"categories": [{"name": "x"}]})
    sheet = spark.createDataFrame([(1, "Review", None), (2, " id ", "value"), (3, "7", "x"), (4, "8", None)], "_row int, a string, b string")
    out = B.workbook_rows(sheet)
    assert out.columns == ["id", "value"] and rows(out) == [("7", "x"), ("8", None)]


def test_scorer_and_isolation(spark):
    df = spark.range(6).repartition(2)
    got = readers.scorer(df, lambda b: pd.DataFrame({"id": b.id, "score": b.id * 2.0}), "id long, score double")
    assert rows(got) == [(i, i * 2.0) for i in range(6)]


def test_versions_and_appends(spark, tmp_path):
    root = str(tmp_path / "v")
    a = spark.createDataFrame([(1,)], "id long")
    assert sinks.publish({"heads": a, "children": a}, root) == 1
    assert sinks.publish({"heads": a.union(a), "children": a}, root) == 2
    assert sinks.read(spark, root, "heads").count() == 2
    with pytest.raises(ValueError):
        sinks.publish({"heads": a, "children": a.limit(0)}, root)
    assert sinks.version(spark, root) == 2 and sinks.read(spark, root, "heads").count() == 2
    log = str(tmp_path / "log")
    for k in (1, 2):
        sinks.append(spark.createDataFrame([(k, "x")], "run int, v string"), log, "run")
    assert rows(spark.read.parquet(log), "run", "v") == [(1, "x"), (2, "x")]
    facts = str(tmp_path / "facts")
    sinks.checked_append(a, a.limit(0), ["id"], facts)
    for bad in (a, a.union(a).withColumn("id", F.lit(9).cast("long"))):
        with pytest.raises(ValueError):
            sinks.checked_append(bad, spark.read.parquet(facts), ["id"], facts)
    assert spark.read.parquet(facts).count() == 1


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), 1), ("b", 0.5, 2)], "k string, x double, n int")
    sinks.export_all({"one": df, "two": df.limit(1)}, str(tmp_path / "out"))
    one, out = tmp_path / "out" / "one.csv", tmp_path / "out"
    assert sorted(one.read_text().split()) == ["a,,1", "b,0.5,2", "k,x,n"]
    broken = df.withColumn("n", F.when(F.col("k") == "b", F.raise_error(F.lit("broken row"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken row"):
        sinks.report_csv(broken, str(one))
    assert sorted(one.read_text().split()) == ["a,,1", "b,0.5,2", "k,x,n"]  # the old file stays whole
    sinks.report_csv(df.limit(0), str(one))
    assert one.read_text().split() == ["k,x,n"]
    assert sorted(f.name for f in out.iterdir() if not f.name.endswith(".crc")) == ["one.csv", "two.csv"]
    assert sinks.artifact_name("r1", "ft_adjudication", "queue", "html") == "r1_ft_adjudication_queue.html"
    for bad in (("r1", "audit", "queue", "html"), ("r1", "ft_adjudication", "out", "html")):
        with pytest.raises(ValueError):
            sinks.artifact_name(*bad)
    frames = B.report_frames(spark.createDataFrame([("m",), ("m",)], "model string"), df)
    assert rows(frames["summary"]) == [("m", 2)] and frames["evidence"] is df


def test_reparse_only_headers_without_spans(spark):
    heads = spark.createDataFrame([(1, 10, "x", '{"fields": [{"field_name": "a", "value": "1"}]}'), (2, 11, "x", "broken"), (3, 12, "y", '[{"field_name": "b", "value": null}]')], "id long, paper_id long, arm string, response string")
    found, covered = B.reparse(heads, spark.createDataFrame([(3,)], "extraction_id long"))
    assert rows(found, "paper_id", "field_name", "value") == [(10, "a", "1")] and rows(covered) == [("x", 1, 1)]


def test_small_selections(spark):
    states = L.workflow(spark, spark.createDataFrame([(L.STAGES[0], 1, "complete"), (L.STAGES[1], 1, "pending"), (L.STAGES[1], 2, "bypassed")], "stage string, seq long, state string"))
    assert L.can_advance(states, L.STAGES[2]).first()[0] and not L.can_advance(states, L.STAGES[3]).first()[0]
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "a")], "paper_id long, schema_hash string")
    assert Q.stale_count(e, "a").first().n == 2
    assert B.has_columns(e, ["paper_id", "model"]) == ["model"]
    big = spark.range(1000).selectExpr("id % 3 AS k", "id")
    assert rows(S.smallest(big, ["k"], "id", 2)) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    r = {x.k: x for x in B.approximate(big, ["k"], "id").collect()}
    assert all(abs(r[k].n_distinct - 333) < 40 and abs(r[k].median - 500) < 20 for k in range(3))
    papers = spark.createDataFrame([(7, '["Smith, John", "Doe"]', 2020, "INGESTED"), (3, "no JSON", None, None), (5, '["X"]', 2001, "SCREENED_OUT"), (9, '["O\'Neil-Ruiz A"]', 0, "PARSED")], "id long, authors string, year int, status string")
    assert rows(B.manifest(papers), "id", "seq", "file") == [(3, 1, "EE-001_Unknown_XXXX.pdf"), (7, 2, "EE-002_Smith_2020.pdf"), (9, 3, "EE-003_ONeil-Ruiz_XXXX.pdf")]


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def events(spark, tmp_path):
    data = [(i, datetime(2026, 1, 1) + timedelta(minutes=13 * i), i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(data, EVENTS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df


def ended(query):
    query.processAllAvailable()
    query.stop()


def test_streams_agree_with_batches(spark, tmp_path, events):
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    for name, f, keys in (("tumble", streams.tumbling, ("start", "event_type", "n", "total")), ("slide", streams.sliding, ("start", "event_type", "n"))):
        ended(f(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start())
        assert rows(spark.table(name), *keys) == rows(f(events), *keys)
    ended(streams.first_of_key(stream, ["user_id", "event_type"], "3 days").writeStream.outputMode("append").format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "f")).start())
    assert rows(spark.table("firsts"), "user_id", "event_type") == rows(events.select("user_id", "event_type").distinct())

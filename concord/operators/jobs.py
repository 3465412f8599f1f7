"""Smaller jobs: queues from consensus, resets, retries, priorities, paged sources, report rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from concord import lifecycle as L
from concord.functions.nulls import is_absence_claim
from concord.functions.text import has_ellipsis
from concord.operators.latest import cascade, childless, labelled, latest
from concord.operators.reports import VERDICTS, crosstab
from concord.operators.sampling import hash_rank
from concord.sources.responses import spans


def paged_source(name: str, schema: str, pages: Callable[[dict], list], fetch: Callable[[object], Iterator[tuple]]) -> type[DataSource]:
    """SRC-04 / SRC-06: a Python data source, one partition a page; `pages` lists page keys or cursors, `fetch` reads one."""

    class Page(InputPartition):
        def __init__(self, key: object):
            self.key = key

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return [Page(k) for k in pages(self.options)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(partition.key)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return Reader(dict(self.options))

    return Source


def rules_from(config: dict) -> list[dict]:
    """SRC-12: category rules in order from a parsed configuration; each needs a name and a pattern or keywords."""
    rules = config.get("categories", [])
    for r in rules:
        if not r.get("name") or not (r.get("regex") or r.get("keywords")):
            raise ValueError(f"incomplete category {r}")
    return rules


def workbook_rows(rows: DataFrame, header: int = 2) -> DataFrame:
    """SRC-15: a sheet exported as CSV without a header; row `header` (column _row counts from 1) names the columns."""
    names = rows.where(F.col("_row") == header).first()
    columns = [c for c in rows.columns if c != "_row" and names[c]]
    return rows.where(F.col("_row") > header).select(*[F.col(c).alias(names[c].strip()) for c in columns])


def report_frames(extractions: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """SNK-12: the frames behind the styled reports."""
    return {"summary": extractions.groupBy("model").agg(F.count("*").alias("n")), "evidence": current}


def marked_titles(decisions: DataFrame, papers: DataFrame, marker: str) -> DataFrame:
    """F-11."""
    return decisions.where(F.col("rationale").contains(marker)).join(papers, decisions.paper_id == papers.id).select("id", "title").distinct()


def paper_spans(sp: DataFrame, extractions: DataFrame, papers: DataFrame) -> DataFrame:
    """J-02."""
    heads = extractions.select(F.col("id").alias("extraction_id"), "paper_id")
    return sp.join(heads, "extraction_id").join(papers.select(F.col("id").alias("paper_id"), "title", "status"), "paper_id")


def children_of(sp: DataFrame, extractions: DataFrame, papers: DataFrame) -> DataFrame:
    """J-09: the spans that a reset of these papers would remove."""
    doomed = extractions.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return sp.join(doomed.select(F.col("id").alias("extraction_id")), "extraction_id", "left_semi")


def human_against_model(human: DataFrame, model: DataFrame) -> DataFrame:
    """J-20: cells where a reader and the model differ, in any case."""
    both = human.select("paper_id", "field_name", F.col("value").alias("human")).join(model.select("paper_id", "field_name", F.col("value").alias("model")), ["paper_id", "field_name"])
    return both.where(F.lower(F.trim("human")) != F.lower(F.trim("model")))


def workload(rows: DataFrame, seconds: float) -> DataFrame:
    """A-26: hours that the rows take at a rate."""
    return rows.agg(F.count("*").alias("n"), F.round(F.count("*") * seconds / 3600, 2).alias("hours"))


def absence_table(verdicts: DataFrame) -> DataFrame:
    """A-28."""
    return crosstab(verdicts.withColumn("absent", is_absence_claim(F.col("value"))), ["arm", "absent"], "verdict", VERDICTS)


def path_table(verdicts: DataFrame) -> DataFrame:
    """A-29 / A-30: verdicts and short circuits by arm and path."""
    return verdicts.groupBy("arm", "windowed").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], F.round(F.avg(F.col("short_circuit").cast("double")), 6).alias("short_circuit_rate"))


def approximate(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A-46: distinct values and median by sketches."""
    return df.groupBy(*keys).agg(F.approx_count_distinct(column).alias("n_distinct"), F.percentile_approx(column, 0.5).alias("median"))


def priorities(rows: DataFrame, sample: int = 30, seed: int = 42) -> DataFrame:
    """T-09 / T-12: 1 for what was screened in, 2 for a seeded sample of the rest, 3 for all others."""
    wanted = F.col("status") == "ABSTRACT_SCREENED_IN"
    drawn = rows.where(~wanted).select("id").orderBy(hash_rank(seed, F.col("id")), "id").limit(sample).withColumn("_drawn", F.lit(True))
    # at most `sample` rows are broadcast
    return rows.join(F.broadcast(drawn), "id", "left").withColumn("priority", F.when(wanted, 1).when(F.col("_drawn"), 2).otherwise(3)).drop("_drawn")


def distinct_fields(sp: DataFrame) -> DataFrame:
    """U-04."""
    return sp.select("field_name").distinct()


def rounded(v: Column, digits: int = 4) -> Column:
    """N-04 / N-05: rounding that never fails on text."""
    return F.round(v.try_cast("double"), digits)


def spec_hash(spec: dict) -> str:
    """JS-03: SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def votes_json(votes: DataFrame) -> DataFrame:
    """JS-05 / C-13: undecided cells with their votes as a JSON map in key order."""
    real = votes.where("norm IS NOT NULL").groupBy("paper_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("norm", "n"))).alias("v"), F.sum("n").alias("total"), F.max("n").alias("top"))
    return real.where("total >= 2 AND size(v) > 1 AND 2 * top <= total").select("paper_id", "field_name", F.to_json(F.map_from_entries("v")).alias("votes"))


def reject(papers: DataFrame, rejected: DataFrame) -> DataFrame:
    """M-02: papers of the given ids rejected with a reason, where the edge is allowed; others stay."""
    r = rejected.select("id", F.col("reason").alias("_r"))
    ok = F.col("_r").isNotNull() & L.allowed(F.col("status"), F.lit("REJECTED"))
    out = papers.join(r, "id", "left").withColumn("rejected_reason", F.when(ok, F.col("_r")).otherwise(F.col("rejected_reason")))
    return out.withColumn("status", F.when(ok, "REJECTED").otherwise(F.col("status"))).select(*papers.columns)


def adjudicate(papers: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """M-08 / H-13: (papers moved by decisions found by any key, decisions without a paper)."""
    found = cascade(decisions, papers.select("id", *keys), keys, "id")
    moved = latest(found.where("id IS NOT NULL"), ["id"], ["ord"]).select("id", F.col("to_status").alias("_to"))
    ok = F.col("_to").isNotNull() & L.allowed(F.col("status"), F.col("_to"))
    out = papers.join(moved, "id", "left").withColumn("status", F.when(ok, F.col("_to")).otherwise(F.col("status")))
    return out.select(*papers.columns), found.where("id IS NULL")


def legacy_decisions(rows: DataFrame) -> DataFrame:
    """M-13: paper-level accept, reject and correct; here a rejection does reject the paper."""
    d = F.lower(F.trim("decision"))
    return rows.withColumn("to_status", F.when(d == "reject", "REJECTED").when(d.isin("accept", "correct"), "HUMAN_AUDIT_COMPLETE"))


def reparse(heads: DataFrame, sp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC-04 / SC-12: (spans of the payloads whose extractions have none, papers covered by arm); nothing is written."""
    found = spans(childless(heads, sp)).where("field_name IS NOT NULL")
    return found, found.groupBy("arm").agg(F.count_distinct("paper_id").alias("n_papers"), F.count("*").alias("n_spans"))


def without_authors(papers: DataFrame, statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """SC-05: papers without authors that a PMID, or only a DOI, can fill."""
    bare = papers.where(F.col("status").isin(statuses) & (F.coalesce(F.size("authors"), F.lit(0)) <= 0))
    return bare.where("pmid IS NOT NULL"), bare.where("pmid IS NULL AND doi IS NOT NULL")


def rescreened(status: Column, decisions: Column) -> Column:
    """SC-09: the new decisions against the original status; a disagreement flags."""
    said = F.when(F.forall(decisions, lambda d: d == "include"), "ABSTRACT_SCREENED_IN").when(F.forall(decisions, lambda d: d == "exclude"), "ABSTRACT_SCREENED_OUT").otherwise("ABSTRACT_SCREEN_FLAGGED")
    return F.when(status == said, status).otherwise("ABSTRACT_SCREEN_FLAGGED")


def run_pairs(ratings: DataFrame, pair_ratings: DataFrame, run: str) -> DataFrame:
    """H-04."""
    return ratings.where(F.col("run_id") == run).join(pair_ratings, "rating_id")


def snap_paragraph(text: Column, at: Column) -> Column:
    """H-09: where the paragraph around a 0-based place begins: after the first break of the last blank line before it, else after the last line break, else 0."""

    def last(mark: str) -> Column:
        """0-based place of the last mark that ends at `at` or before; -1 if none."""
        back = F.call_function("locate", F.lit(mark), F.reverse(F.call_function("left", text, at)))
        return F.when(back > 0, F.least(at, F.length(text)) - back - len(mark) + 1).otherwise(-1)

    return F.when(at <= 0, 0).otherwise(F.when(last("\n\n") >= 0, last("\n\n")).otherwise(last("\n")) + 1)


def snap_paragraph_end(text: Column, at: Column) -> Column:
    """H-09: where the paragraph around a 0-based place ends: at the next blank line, else at the next line break, else at the end of the text."""
    next_ = lambda mark: F.nullif(F.call_function("locate", F.lit(mark), text, F.greatest(at, F.lit(0)) + 1), F.lit(0)) - 1
    return F.when(at >= F.length(text), F.length(text)).otherwise(F.coalesce(next_("\n\n"), next_("\n"), F.length(text)))


def with_not_null(sp: DataFrame) -> DataFrame:
    """H-17."""
    return sp.fillna({"confidence": 0.0, "tier": 1})


def decorated(rationale: Column, confidence: Column) -> Column:
    """H-19: the rationale followed by the confidence; without one, or with 0, the rationale alone."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) == 0, rationale).otherwise(F.concat(F.coalesce(rationale, F.lit("")), F.lit(" [confidence: "), confidence.cast("string"), F.lit("]")))


def has_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """H-24: the wanted columns that are missing."""
    return [c for c in wanted if c not in df.columns]


def report_order(report: DataFrame) -> DataFrame:
    """H-30: collapsed first, then little variance, then the rest; by name."""
    rank = F.when(F.col("status") == "COLLAPSED", 0).when(F.col("status") == "LOW_VARIANCE", 1).otherwise(2)
    return report.orderBy(rank, "field_name")


def repaired(sp: DataFrame, model: Callable[[DataFrame], DataFrame], tries: int = 2) -> DataFrame:
    """H-32: snippets with an ellipsis go to the model again, at most `tries` times, then are empty."""
    out = sp
    for _ in range(tries):
        bad = out.where(has_ellipsis(F.col("source_snippet")))
        out = out.where(~has_ellipsis(F.col("source_snippet")) | F.col("source_snippet").isNull()).unionByName(model(bad))
    return out.withColumn("source_snippet", F.when(has_ellipsis(F.col("source_snippet")), "").otherwise(F.col("source_snippet")))


def isolated(df: DataFrame, score: Callable, schema: str) -> DataFrame:
    """H-34 / H-35: a scorer row by row whose failures become an `error` column instead of failing the batch."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                try:
                    rows.append({**r, **score(r), "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({**r, "error": str(e)})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return df.mapInPandas(run, schema)


def manifest(papers: DataFrame, statuses_out: list[str] = ("SCREENED_OUT",)) -> DataFrame:
    """SC-10: id, seq, ee_id, file of all papers whose status does not leave them out, numbered by id: label, surname and year of each.

    The surname is the first word of the first author of a JSON array, without a comma and signs; `Unknown` where there is none.
    """
    kept = labelled(papers.where(F.col("status").isNull() | ~F.col("status").isin(list(statuses_out)))).withColumnsRenamed({"ee_seq": "seq", "ee_label": "_l"})
    first = F.get(F.split(F.trim(F.get(F.from_json(F.col("authors"), "array<string>"), F.lit(0))), r"\s+"), F.lit(0))
    name = F.regexp_replace(F.rtrim(first, F.lit(",")), r"(?U)[^\w-]", "")
    name = F.when(F.coalesce(first, F.lit("")) == "", "Unknown").otherwise(name)
    label = F.concat(F.lit("EE-"), F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string")))
    year = F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("XXXX"))
    return kept.select("id", "seq", label.alias("ee_id"), F.concat(label, F.lit("_"), name, F.lit("_"), year, F.lit(".pdf")).alias("file"))


def updated(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """H-16: a table with single-row changes applied, the last of each key."""
    c = latest(changes, [key], ["ord"]).select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    out = table.join(c, key, "left")
    return out.select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in columns else F.col(x) for x in table.columns])


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)

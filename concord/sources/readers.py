"""Sources (SRC-01..SRC-28): Parquet catalogue, CSV, JSON lines with rejects, citations, texts, specs, scorer seams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.text import is_pdf, let
from concord.operators.latest import latest


def catalogue(spark: SparkSession, root: str, tables: list[str]) -> dict[str, DataFrame]:
    """SRC-01 / SRC-02: Parquet tables of a review as frames and temporary views."""
    out = {t: spark.read.parquet(f"{root}/{t}.parquet") for t in tables}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def by_status(papers: DataFrame, *statuses: str) -> DataFrame:
    """SRC-03 / F-08 / U-01."""
    return papers.where(F.col("status").isin(*statuses))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-13: a header, quoted line ends, an explicit schema."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-14: (rows, malformed lines)."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value")


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-16: one JSON document a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_log(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """SRC-21: groups of a pattern from log lines."""
    hit = lines.where(F.col("value").rlike(pattern))
    return hit.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def medline(records: DataFrame) -> DataFrame:
    """SRC-05: pmid, doi, title, abstract, journal, year, authors of a record struct column `r`."""
    doi = F.get(F.filter("r.aid", lambda x: x.endswith("[doi]")), F.lit(0))
    return records.select(F.col("r.pmid").alias("pmid"), F.trim(F.regexp_replace(doi, r"\[doi\]$", "")).alias("doi"), F.col("r.ti").alias("title"), F.col("r.ab").alias("abstract"), F.col("r.jt").alias("journal"), F.substring("r.dp", 1, 4).try_cast("int").alias("year"), F.col("r.au").alias("authors"))


def inverted_index(words: Column) -> Column:
    """SRC-08 the other way: a map word -> places of an array of words, from one sort of the row's words."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        end = lambda b, j: F.coalesce(F.get(b, j + 1), F.size(s))
        entry = lambda b, i, j: F.struct(F.get(s, i)["w"].alias("w"), F.transform(F.slice(s, i + 1, end(b, j) - i), lambda x: x["p"]).alias("places"))
        return let(begins, lambda b: F.map_from_entries(F.transform(b, lambda i, j: entry(b, i, j))))

    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    return F.when(F.size(words) > 0, let(placed, runs))


def inverted_abstract(index: Column) -> Column:
    """SRC-08: a map word -> places as text."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x.w), " ")


def works(records: DataFrame) -> DataFrame:
    """SRC-07: citations of work structs `r`."""
    doi = F.lower(F.regexp_replace("r.doi", r"^https?://(dx\.)?doi\.org/", ""))
    return records.select(F.regexp_extract("r.ids.pmid", r"(\d+)$", 1).alias("pmid"), doi.alias("doi"), F.col("r.title").alias("title"), inverted_abstract(F.col("r.abstract_inverted_index")).alias("abstract"), F.col("r.publication_year").cast("int").alias("year"), F.transform("r.authorships", lambda a: a.author.display_name).alias("authors"))


def boolean_query(groups: list[list[str]], years: tuple[int, int] | None = None) -> str:
    """SRC-09."""
    text = " AND ".join("(" + " OR ".join(f'"{t}"' if " " in t else t for t in g) + ")" for g in groups if g)
    return text + (f" AND {years[0]}:{years[1]}[dp]" if years else "")


def newest_text(texts: DataFrame) -> DataFrame:
    """SRC-17: the text of the largest version number."""
    return latest(texts, ["paper_id"], ["version"])


def pdf_files(spark: SparkSession, path: str, least: int = 10 * 1024) -> DataFrame:
    """SRC-18 / SRC-19 / SRC-25: path, hash and validity of the PDF files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), (is_pdf(F.col("content")) & (F.col("length") >= least)).alias("valid"))


def file_papers(files: DataFrame, papers: DataFrame) -> DataFrame:
    """J-25: files joined to papers by the number in an `EE-` name."""
    return files.withColumn("id", F.regexp_extract("path", r"EE-0*(\d+)", 1).try_cast("long")).join(papers, "id", "left")


def rename_headers(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """SRC-27: the first header that contains one of the candidates becomes the wanted name."""
    picked = {}
    for name, options in wanted.items():
        hit = next((c for o in options for c in df.columns if o.lower() in c.lower()), None)
        if hit:
            picked[name] = hit
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in picked.items()])


def unchecked(papers: DataFrame, known: DataFrame, lookup: DataFrame) -> DataFrame:
    """SRC-22 / SRC-26: papers without a known answer, joined to a lookup frame."""
    return papers.join(known.select("id"), "id", "left_anti").join(lookup, "doi", "left")


def first_success(attempts: DataFrame) -> DataFrame:
    """SRC-24: the first strategy that succeeded for each id; attempts: id, strategy, ordinal, ok, result."""
    return attempts.where("ok").groupBy("id").agg(F.min_by(F.struct("strategy", "result"), "ordinal").alias("r")).select("id", "r.*")


def scorer(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """SRC-20 / SRC-23 / H-33: a user's model over Arrow batches; its errors are the user's columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def enum_dimension(spark: SparkSession, spec: dict[str, list]) -> DataFrame:
    """SRC-10 / SRC-11 / H-25: field_name, ordinal, enum_value from a parsed spec; values are strings or {value: ...}."""
    rows = [(f, i, v["value"] if isinstance(v, dict) else v) for f, values in spec.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "field_name string, ordinal int, enum_value string")


def check_spec(fields: list[dict], years: tuple[int, int]) -> None:
    """H-20: a tier-1 field, and years in order."""
    if not any(f.get("tier") == 1 for f in fields):
        raise ValueError("no tier-1 field")
    if years[0] > years[1]:
        raise ValueError("the start year is after the end year")

"""Ragged responses (JS-01, JS-02, A-38, SC-04, SC-12): JSON of several shapes to span rows, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import strip_fence

# Keys under which responses list their spans
LIST_KEYS = ["fields", "spans", "evidence_spans", "extractions", "extracted_data", "data", "results", "items", "evidence"]


def spans(rows: DataFrame, response: str = "response") -> DataFrame:
    """JS-01: rows with field_name, value, source_snippet, confidence, tier and ordinal; `_ok` false where nothing could be read."""
    v = F.try_parse_json(strip_fence(F.col(response)))
    out = rows.withColumn("_v", v)
    text = strip_fence(F.col(response))
    item = "struct<field_name:string,field:string,name:string,value:string,source_snippet:string,snippet:string,confidence:string,tier:string>"
    as_list = lambda path: F.from_json(F.get_json_object(text, path), f"array<{item}>")
    listed = F.coalesce(*[as_list(f"$.{k}") for k in LIST_KEYS], F.when(text.startswith("["), F.from_json(text, f"array<{item}>")))
    single = F.when(F.get_json_object(text, "$.field_name").isNotNull(), F.array(F.from_json(text, item)))
    flat = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.from_json(F.to_json(F.struct(e.key.alias("field_name"), F.coalesce(e.value, F.lit("NR")).alias("value"))), item))
    out = out.withColumn("_ok", F.col("_v").isNotNull()).drop("_v").withColumn("_s", F.coalesce(listed, single, flat))
    out = out.select("*", F.posexplode_outer("_s").alias("ordinal", "_x"))
    name = F.coalesce("_x.field_name", "_x.field", "_x.name")
    return out.select(
        *rows.columns, "_ok", "ordinal", name.alias("field_name"), F.when(name.isNotNull(), F.coalesce("_x.value", F.lit("NR"))).alias("value"),
        F.coalesce("_x.source_snippet", "_x.snippet").alias("source_snippet"), F.col("_x.confidence").try_cast("double").alias("confidence"), F.col("_x.tier").try_cast("int").alias("tier"),
    )


def populated(found: DataFrame, key: str, absent: Column) -> DataFrame:
    """A-38: fields with a value, per key."""
    return found.groupBy(key).agg(F.count_if(F.col("field_name").isNotNull() & ~absent).alias("n_populated"))


def tiers(found: DataFrame) -> DataFrame:
    """JS-02: the first tier seen for each field."""
    return found.where("tier IS NOT NULL").groupBy("field_name").agg(F.min_by("tier", "ordinal").alias("tier"))

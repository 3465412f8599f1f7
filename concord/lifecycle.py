"""Lifecycle and workflow dimensions (§1.6, M-01..M-13, C-21, H-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statuses, allowed edges, gate levels, ordered stages
STATUSES = ["INGESTED", "ABSTRACT_SCREENED_IN", "ABSTRACT_SCREENED_OUT", "ABSTRACT_SCREEN_FLAGGED", "PDF_ACQUIRED", "PDF_EXCLUDED", "PARSED", "FT_ELIGIBLE", "FT_SCREENED_OUT", "FT_FLAGGED", "EXTRACT_FAILED", "EXTRACTED", "AI_AUDIT_COMPLETE", "HUMAN_AUDIT_COMPLETE", "REJECTED"]
TRANSITIONS = {
    "INGESTED": ["ABSTRACT_SCREENED_IN", "ABSTRACT_SCREENED_OUT", "ABSTRACT_SCREEN_FLAGGED"],
    "ABSTRACT_SCREENED_IN": ["PDF_ACQUIRED", "ABSTRACT_SCREEN_FLAGGED"],
    "ABSTRACT_SCREEN_FLAGGED": ["ABSTRACT_SCREENED_IN", "ABSTRACT_SCREENED_OUT"],
    "PDF_ACQUIRED": ["PARSED", "PDF_EXCLUDED"],
    "PARSED": ["FT_ELIGIBLE", "FT_SCREENED_OUT", "FT_FLAGGED", "EXTRACTED", "EXTRACT_FAILED"],
    "FT_ELIGIBLE": ["EXTRACTED", "EXTRACT_FAILED", "FT_FLAGGED"],
    "FT_FLAGGED": ["FT_ELIGIBLE", "FT_SCREENED_OUT"],
    "EXTRACT_FAILED": ["PARSED", "FT_ELIGIBLE", "EXTRACTED"],
    "EXTRACTED": ["AI_AUDIT_COMPLETE"],
    "AI_AUDIT_COMPLETE": ["HUMAN_AUDIT_COMPLETE", "REJECTED"],
    "HUMAN_AUDIT_COMPLETE": ["REJECTED"],
}
GATE_LEVELS = {"PARSED": 0, "ABSTRACT_SCREENED_OUT": 1, "EXTRACTED": 2, "AI_AUDIT_COMPLETE": 3, "HUMAN_AUDIT_COMPLETE": 4}
BEFORE_SCREENING = ["INGESTED", "ABSTRACT_SCREENED_OUT", "ABSTRACT_SCREEN_FLAGGED"]
BEFORE_FULL_TEXT = [*BEFORE_SCREENING, "ABSTRACT_SCREENED_IN", "PDF_ACQUIRED", "PDF_EXCLUDED"]
INCLUDED = ["AI_AUDIT_COMPLETE", "HUMAN_AUDIT_COMPLETE"]
EXCLUDED = ["ABSTRACT_SCREENED_OUT", "PDF_EXCLUDED", "FT_SCREENED_OUT", "REJECTED"]
STAGES = ["ABSTRACT_SCREENING_COMPLETE", "ABSTRACT_DIAGNOSTIC_COMPLETE", "ABSTRACT_CATEGORIES_CONFIGURED", "ABSTRACT_QUEUE_EXPORTED", "ABSTRACT_ADJUDICATION_COMPLETE", "PDF_ACQUISITION", "FULL_TEXT_SCREENING_COMPLETE", "FULL_TEXT_ADJUDICATION_COMPLETE", "EXTRACTION_COMPLETE", "AI_AUDIT_COMPLETE_STAGE", "AUDIT_QUEUE_EXPORTED", "AUDIT_REVIEW_COMPLETE"]
DECISION_NAMES = {"ABSTRACT_SCREENED_IN": "INCLUDE", "ABSTRACT_SCREENED_OUT": "EXCLUDE", "INCLUDE": "INCLUDE", "EXCLUDE": "EXCLUDE", "ACCEPT": "ACCEPT", "REJECT": "REJECT_VALUE", "CORRECT": "CORRECT"}

EDGES = [f"{a}>{b}" for a, to in TRANSITIONS.items() for b in to]


def passes_gate(status: Column, least: str) -> Column:
    """F-07: at or above the gate level of `least`; statuses without a level never pass."""
    level = F.create_map(*[F.lit(x) for kv in GATE_LEVELS.items() for x in kv])
    return F.coalesce(level[status] >= GATE_LEVELS[least], F.lit(False))


def allowed(frm: Column, to: Column) -> Column:
    return F.concat_ws(">", frm, to).isin(EDGES)


RANGE = 4096
FOLD = "struct<status:string,applied:bigint,rejected:bigint>"


def fold_status(events: DataFrame, start: str = "INGESTED") -> DataFrame:
    """M-01 / M-05: paper_id, status, applied and rejected of events (paper_id, seq, to_status, override).

    Illegal events are skipped before later ones are judged; an override
    always applies. Events are folded within ranges of `seq` of RANGE numbers
    into a map from each status before the range to the status after it, with
    the events applied and rejected on the way. Maps of ranges are chained in
    the same way, so no array holds more than RANGE events or maps, however
    long the history of one paper is. A paper whose events lie in one range
    needs no map.
    """
    begin = lambda s: F.struct(s.alias("status"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("rejected")).cast(FOLD)
    step = lambda acc, e: F.when(e.override | allowed(acc.status, e.to_status), F.struct(e.to_status.alias("status"), (acc.applied + 1).alias("applied"), acc.rejected.alias("rejected"))).otherwise(F.struct(acc.status.alias("status"), acc.applied.alias("applied"), (acc.rejected + 1).alias("rejected"))).cast(FOLD)
    statuses = F.array(*map(F.lit, STATUSES))
    sizes = events.groupBy("paper_id").agg(F.count("*").alias("_n"))
    few, many = sizes.where(F.col("_n") <= RANGE).select("paper_id"), sizes.where(F.col("_n") > RANGE).select("paper_id")
    rows = events.join(few, "paper_id", "left_semi").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("seq", "to_status", "override"))).alias("events"))
    short = rows.select("paper_id", F.aggregate("events", begin(F.lit(start)), step).alias("f"))

    parts = events.join(many, "paper_id", "left_semi").groupBy("paper_id", F.expr(f"seq div {RANGE}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "to_status", "override"))).alias("events"))
    maps = parts.select("paper_id", "part", F.transform(statuses, lambda s: F.aggregate("events", begin(s), step)).alias("map"))
    follow = lambda acc, m: F.struct(at(m, acc).status.alias("status"), (acc.applied + at(m, acc).applied).alias("applied"), (acc.rejected + at(m, acc).rejected).alias("rejected")).cast(FOLD)
    at = lambda m, acc: F.get(m["map"], (F.array_position(statuses, acc.status) - 1).cast("int"))
    for _ in range(2):
        wider = maps.groupBy("paper_id", F.expr(f"part div {RANGE}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"))
        maps = wider.select("paper_id", "part", F.transform(statuses, lambda s: F.aggregate("maps", begin(s), follow)).alias("map"))
    chained = maps.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("part", "map"))).alias("maps"))
    long = chained.select("paper_id", F.aggregate("maps", begin(F.lit(start)), follow).alias("f"))
    return short.unionByName(long).select("paper_id", "f.*")


def reset(papers: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """M-03 / M-04 / SC-08: papers with the status of the given ids put back."""
    mark = ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct()
    return papers.join(mark, "id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).select(*papers.columns)


def map_decisions(rows: DataFrame, column: str = "decision") -> tuple[DataFrame, DataFrame]:
    """M-12: (rows with the mapped decision, rows whose decision has no mapping)."""
    names = F.create_map(*[F.lit(x) for kv in DECISION_NAMES.items() for x in kv])
    mapped = rows.withColumn("_to", names[F.upper(F.trim(F.col(column)))])
    return mapped.where("_to IS NOT NULL").withColumn(column, F.col("_to")).drop("_to"), mapped.where("_to IS NULL").drop("_to")


def workflow(spark: SparkSession, events: DataFrame) -> DataFrame:
    """H-15 / M-11: every stage in order with its latest state (stage, ordinal, state, done); events: stage, seq, state."""
    dim = spark.createDataFrame(list(enumerate(STAGES)), "ordinal int, stage string")
    last = events.groupBy("stage").agg(F.max_by("state", "seq").alias("state"))
    out = dim.join(F.broadcast(last), "stage", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    return out.withColumn("done", F.col("state").isin("complete", "bypassed"))


def blocker(states: DataFrame) -> DataFrame:
    """C-21: the first stage that is not done, and how many are."""
    return states.agg(F.min_by("stage", F.when(~F.col("done"), F.col("ordinal"))).alias("blocker"), F.count_if("done").alias("n_done"), F.count("*").alias("n_stages"))


def can_advance(states: DataFrame, stage: str) -> DataFrame:
    """C-21: whether all earlier stages are done."""
    return states.agg(F.coalesce(F.bool_and(F.when(F.col("ordinal") < STAGES.index(stage), F.col("done"))), F.lit(True)).alias("can_advance"))

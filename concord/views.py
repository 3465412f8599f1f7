"""Domain views over plain tables: the relational model that the operators work on.

Each view is one SELECT that Spark and DuckDB read alike; ``frames`` gives
them as DataFrames, ``sql_prefix`` as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.lifecycle import STATUSES


def _case(value: str, options: list[str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options)) + " END"


# Expressions over current spans (flag, line_status, quantity, field_name): the values of the model arms, all text, and of typed fields
ARMS = {
    "local": "CASE flag WHEN 'A' THEN 'Randomized trial' WHEN 'N' THEN 'NR' ELSE 'Cohort study (prospective)' END",
    "openai": "CASE WHEN line_status = 'O' THEN 'randomized  Trial' ELSE 'Cohort study' END",
    "anthropic": "CASE WHEN quantity % 3 = 0 THEN 'n/a' WHEN quantity % 3 = 1 THEN 'Prospective cohort' ELSE 'Randomized trial' END",
}
TYPED_ARMS = {
    "local": "CASE field_name WHEN 'f2' THEN CASE flag WHEN 'A' THEN 'Original Research' WHEN 'N' THEN 'Review' ELSE 'NR' END WHEN 'f3' THEN concat(cast(cast(quantity AS int) AS string), ' pigs, 1,000') WHEN 'f4' THEN CASE flag WHEN 'A' THEN 'Abdominal; thoracic' WHEN 'N' THEN 'Cardiac' ELSE 'none; NR' END WHEN 'f5' THEN concat(cast(cast(quantity AS int) AS string), '  mm') ELSE CASE flag WHEN 'A' THEN 'Small  Sample' ELSE 'Short follow-up' END END",
    "openai": "CASE field_name WHEN 'f2' THEN CASE line_status WHEN 'O' THEN 'original research' ELSE 'Editorial' END WHEN 'f3' THEN concat('n = ', cast(cast(quantity AS int) AS string), '1000') WHEN 'f4' THEN CASE line_status WHEN 'O' THEN 'Thoracic;Abdominal' ELSE 'Cardiac (open); Abdominal' END WHEN 'f5' THEN concat(cast(cast(quantity AS int) AS string), ' mm') ELSE CASE line_status WHEN 'O' THEN 'Limited sample size and short follow-up' ELSE 'not reported' END END",
    "anthropic": "CASE field_name WHEN 'f2' THEN CASE WHEN quantity % 2 = 0 THEN 'Editorial (invited)' ELSE ' Review ' END WHEN 'f3' THEN CASE WHEN quantity % 3 = 0 THEN 'unclear' ELSE concat('0', cast(cast(quantity AS int) AS string), '1000 pigs') END WHEN 'f4' THEN CASE WHEN quantity % 2 = 0 THEN 'Abdominal' ELSE 'N/R' END WHEN 'f5' THEN '7 MM' ELSE CASE WHEN quantity % 2 = 0 THEN 'SMALL SAMPLE' ELSE 'Brief follow-up period' END END",
}
KINDS = {"f2": "categorical", "f3": "numeric", "f4": "multi", "f5": "raw"}
OPTIONS = {"f2": ["Original Research", "Review", "Editorial (invited)"], "f4": ["Abdominal", "Thoracic", "Cardiac (open)"]}

# name: (tables it reads, SELECT)
VIEWS: dict[str, tuple[list[str], str]] = {
    "papers": (["documents"], f"""
        SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, source, 2010 + doc_id % 16 AS year,
               CASE WHEN doc_id % 3 <> 0 THEN '10.1000/' || lpad(cast(doc_id % 400 AS string), 4, '0') END AS doi,
               CASE WHEN doc_id % 4 = 1 THEN cast(100000 + doc_id AS string) END AS pmid,
               {_case("doc_id % 15", STATUSES)} AS status,
               {_case("doc_id % 4", ["INACCESSIBLE", "NON_ENGLISH", "ABSTRACT_ONLY"])} AS pdf_exclusion_reason,
               {_case("doc_id % 5", ["low_yield: 2 fields", "off_topic", "duplicate"])} AS rejected_reason
        FROM {{documents}}"""),
    "extractions": (["orders"], """
        SELECT o_orderkey AS id, o_custkey AS paper_id, o_orderpriority AS schema_hash, o_orderstatus AS model, o_orderdate AS extracted_at
        FROM {orders}"""),
    "spans": (["lineitem"], """
        SELECT l_orderkey AS extraction_id, 'f' || cast(l_linenumber AS string) AS field_name, l_returnflag AS flag, l_linestatus AS line_status,
               l_quantity AS quantity, l_partkey AS partkey, l_discount * 10 AS confidence,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'verified' WHEN l_returnflag = 'N' THEN 'contested'
                    WHEN l_returnflag = 'A' THEN 'flagged' ELSE 'verified' END AS audit_status,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS span_no
        FROM {lineitem}"""),
    "human": (["events"], """
        SELECT event_id AS id, user_id AS paper_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS extractor,
               'f' || cast(event_id % 7 AS string) AS field_name, CASE WHEN event_id % 11 = 0 THEN 'NR' ELSE event_type END AS value, ts, value AS number, props AS snippet
        FROM {events}"""),
    "cloud": (["lineitem"], """
        SELECT l_orderkey AS paper_id, CASE WHEN l_suppkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS arm, 'f' || cast(l_linenumber AS string) AS field_name,
               CASE l_partkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'Not discussed' WHEN 2 THEN '  ' WHEN 3 THEN NULL WHEN 4 THEN 'n/a' ELSE l_linestatus || cast(l_partkey % 5 AS string) END AS value, 'p' || cast(l_partkey AS string) AS snippet
        FROM {lineitem}"""),
    "runs": (["orders"], """
        SELECT o_orderkey AS item, o_orderdate AS started_at, o_custkey % 13 AS run_id, o_totalprice / 1000 AS seconds, o_orderkey % 17 = 0 AS failed, o_orderpriority AS model, o_orderstatus AS verdict
        FROM {orders}"""),
    "decisions": (["labels"], """
        SELECT doc_id AS paper_id, CASE quality WHEN 1 THEN 'include' ELSE 'exclude' END AS pass1, CASE toxic WHEN 0 THEN 'include' ELSE 'exclude' END AS pass2,
               CASE WHEN doc_id % 6 = 0 THEN 'exclude' WHEN doc_id % 6 < 4 THEN 'include' END AS verifier
        FROM {labels}"""),
    "ratings": (["lineitem", "part"], """
        SELECT l_orderkey AS paper_id, 'f' || cast(l_linenumber AS string) AS field_name,
               CASE l_linenumber % 3 WHEN 0 THEN 'categorical' WHEN 1 THEN 'numeric' ELSE 'free_text' END AS field_type,
               CASE l_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'local' ELSE 'anthropic' END AS arm_a,
               CASE l_suppkey % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'openai' END AS arm_b,
               CASE l_partkey % 3 WHEN 0 THEN 'EQUIVALENT' WHEN 1 THEN 'PARTIAL' ELSE 'DIVERGENT' END AS level1,
               CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'GRANULARITY' WHEN p_size % 5 = 1 THEN 'SELECTION' WHEN p_size % 5 = 2 THEN 'OMISSION' WHEN p_size % 5 = 3 THEN 'CONTRADICTION' ELSE 'FABRICATION' END AS level2,
               CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'medium' ELSE 'high' END AS risk, l_tax > 0.05 AS tripped
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""),
    "verdicts": (["lineitem"], """
        SELECT l_orderkey AS paper_id, 'f' || cast(l_linenumber AS string) AS field_name,
               CASE l_linenumber % 3 WHEN 0 THEN 'categorical' WHEN 1 THEN 'numeric' ELSE 'free_text' END AS field_type,
               CASE l_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'openai' ELSE 'anthropic' END AS arm,
               CASE WHEN l_returnflag = 'N' THEN 'SUPPORTED' WHEN l_returnflag = 'A' THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict,
               l_discount < 0.02 AS short_circuit, l_linestatus = 'F' AS windowed, CASE l_partkey % 9 WHEN 0 THEN 'NR' WHEN 1 THEN 'na' WHEN 2 THEN ' Not Found ' WHEN 3 THEN '  ' WHEN 4 THEN NULL WHEN 5 THEN 'N/R' ELSE 'value' END AS value,
               l_partkey AS partkey, l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS no
        FROM {lineitem}"""),
}


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views (or plain tables) as DataFrames."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return [spark.sql(VIEWS[n][1], **{t: table(t) for t in VIEWS[n][0]}) if n in VIEWS else table(n) for n in names]


def sql_prefix(*names: str) -> str:
    """WITH clause of the named views for the SQL side."""
    made = [f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]}).replace('AS string)', 'AS VARCHAR)')})" for n in names]
    return "WITH " + ",\n".join(made)

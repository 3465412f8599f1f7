"""Validate all, then apply (V-02, V-03, H-12, M-08): a plan whose rows all depend on the errors found.

``only_if_clean`` puts the number of errors, one row, beside every row of a
result. With an error the action fails, or the result is empty, as wished; in
neither case is a part of it applied. The error rows stay a table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.nulls import human_value


def only_if_clean(result: DataFrame, errors: DataFrame, refuse: str = "raise", shown: int = 5) -> DataFrame:
    """The result if there are no errors; else an exception with the first of them ("raise") or no rows ("empty")."""
    if refuse not in ("raise", "empty"):
        raise ValueError(refuse)
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in errors.columns])
    first = errors.select(line.alias("_line")).groupBy().agg(F.count("*").alias("_errors"), F.min_by("_line", "_line").alias("_first"))
    if refuse == "raise":
        message = F.concat(F.lit("import refused, errors: "), F.col("_errors").cast("string"), F.lit(", first: "), F.col("_first"))
        clean = F.when(F.col("_errors") == 0, True).otherwise(F.raise_error(message).cast("boolean"))
    else:
        clean = F.col("_errors") == 0
    # one row is broadcast
    return result.crossJoin(F.broadcast(first)).where(clean).select(*result.columns)


def pair_decisions(rows: DataFrame, done: DataFrame, keys: list[str], refuse: str = "raise") -> tuple[DataFrame, DataFrame]:
    """H-12: (decisions to add, errors). Undecided rows (null) are skipped; any other word than AGREE or DISAGREE, and a key that
    is twice in the rows or known already, is an error, and with an error no decision is added."""
    decided = rows.where(F.col("decision").isNotNull())
    bad = decided.where(~F.col("decision").isin("AGREE", "DISAGREE")).select(*keys, F.lit("invalid decision").alias("error"))
    twice = decided.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit("duplicate").alias("error"))
    known = decided.join(done.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit("duplicate").alias("error")).distinct()
    errors = bad.unionByName(twice.unionByName(known).distinct())
    return only_if_clean(decided, errors, refuse), errors


def workbook_problems(rows: DataFrame, options: dict[str, list[str]], quoted: dict[str, str], known: DataFrame | None = None, key: str = "paper_id") -> DataFrame:
    """V-03: key, error, part of every broken rule.

    Labels are EE- and three digits and, where `known` is given, of a known paper. Each part of a `;` list must be one of the
    field's values in any case; blanks and NR are no values. A field in `quoted` with a value needs text in its quote column.
    A workbook without rows is an error.
    """
    rows = rows.withColumn(key, F.trim(key))
    for c in {*options, *quoted, *quoted.values()}:
        rows = rows.withColumn(c, human_value(F.col(c)))

    def error(text: str, part: Column | None = None) -> Column:
        return F.struct(F.lit(text).alias("error"), (F.lit(None).cast("string") if part is None else part).alias("part"))

    def stray(c: str, allowed: list[str]) -> Column:
        parts = F.transform(F.split(F.col(c), ";"), lambda p: F.trim(p))
        bad = F.filter(parts, lambda p: ~F.lower(p).isin([x.lower() for x in allowed]))
        return F.transform(F.coalesce(bad, F.array().cast("array<string>")), lambda p: error(f"value of {c}", p))

    found = [F.array(F.when(~F.col(key).rlike(r"^EE-\d{3}$"), error("label")))]
    found += [stray(c, allowed) for c, allowed in options.items()]
    found += [F.array(F.when(F.col(c).isNotNull() & F.col(q).isNull(), error(f"quote of {c}"))) for c, q in quoted.items()]
    out = rows.select(key, F.explode(F.filter(F.concat(*found), lambda x: x.isNotNull())).alias("e")).select(key, "e.error", "e.part")
    if known is not None:
        strange = rows.join(known.select(F.col(key)).distinct(), key, "left_anti")
        out = out.unionByName(strange.select(key, F.lit("unknown paper").alias("error"), F.lit(None).cast("string").alias("part")))
    none = rows.groupBy().agg(F.count("*").alias("_n")).where("_n = 0")
    return out.unionByName(none.select(F.lit(None).cast("string").alias(key), F.lit("no rows").alias("error"), F.lit(None).cast("string").alias("part")))

"""Arms, concordance, consensus and distribution monitoring (J-11..J-14, J-18..J-21, A-05..A-20, C-09..C-13, H-01..H-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.nulls import is_null_synonym
from concord.functions.values import kappa_columns, normalised, pair_score
from concord.operators.latest import latest
from concord.operators.scan import running


def stacked(rows: DataFrame, keys: list[str], arms: dict[str, Column]) -> DataFrame:
    """One row an arm, in the order of the arms: keys, arm_ord, arm and value; one scan."""
    cells = F.array(*[F.struct(F.lit(i).alias("arm_ord"), F.lit(n).alias("arm"), v.alias("value")) for i, (n, v) in enumerate(arms.items())])
    return rows.select(*keys, F.inline(cells))


def arm_store(local: DataFrame, cloud: DataFrame, human: DataFrame) -> DataFrame:
    """H-01 / H-02: arm, paper_id, field_name, value and snippet of all three stores: `local`, cloud arms by their name, readers as `human_<extractor>`.

    A filter on the arm is pushed into the branches, so a query for one arm reads one store.
    """
    columns = ["paper_id", "field_name", "value", "snippet"]
    named = [local.select(F.lit("local").alias("arm"), *columns), cloud.select("arm", *columns), human.select(F.concat(F.lit("human_"), F.col("extractor")).alias("arm"), *columns)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def wide(arms: DataFrame, names: list[str]) -> DataFrame:
    """paper_id, field_name, a struct of the value for each arm (null without a row), and has_<arm>: whether the arm has the paper.

    Rows are dealt once, by paper; cells and papers are both put together within that.
    """
    cell = lambda n: F.max(F.when(F.col("arm") == n, F.struct("value"))).alias(n)
    cells = arms.repartition("paper_id").groupBy("paper_id", "field_name").agg(*[cell(n) for n in names])
    paper = Window.partitionBy("paper_id")
    return cells.select("*", *[F.max(F.col(n).isNotNull()).over(paper).alias(f"has_{n}") for n in names])


def align(arms: DataFrame, names: list[str], kind: Column | None = None, options: Column | None = None) -> DataFrame:
    """J-11 / J-13: every pair of arms in order, on the papers that both have, over the union of their fields, normalised once.

    kind and options are expressions over field_name.
    """
    cells = wide(arms, names).select("paper_id", "field_name", *[F.struct(F.col(f"has_{n}").alias("has"), F.col(n).isNotNull().alias("seen"), normalised(F.col(n)["value"], kind, options).alias("v")).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = lambda a, b: F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"), F.col(a)["v"].alias("a"), F.col(b)["v"].alias("b"), (F.col(a)["has"] & F.col(b)["has"] & (F.col(a)["seen"] | F.col(b)["seen"])).alias("both"))
    return cells.select("paper_id", "field_name", F.inline(F.array(*[row(a, b) for a, b in pairs]))).where("both").drop("both")


def scores(arms: DataFrame, names: list[str], kind: Column | None = None, options: Column | None = None) -> DataFrame:
    """X-10 over J-11."""
    return align(arms, names, kind, options).withColumn("score", pair_score(F.col("a"), F.col("b"), F.lit("text") if kind is None else kind))


def concordance(arms: DataFrame, names: list[str], kind: Column | None = None, options: Column | None = None) -> DataFrame:
    """C-09: kappa with interval per pair of arms and field."""
    return scores(arms, names, kind, options).groupBy("arm_a", "arm_b", "field_name").agg(*kappa_columns(F.col("score")))


def mean_kappa(report: DataFrame) -> DataFrame:
    """A-14: the mean over fields that have a kappa."""
    return report.groupBy("arm_a", "arm_b").agg(F.round(F.avg("kappa"), 6).alias("mean_kappa"), F.count("kappa").alias("n_fields"))


def only_in(left: DataFrame, right: DataFrame, key: str = "paper_id") -> DataFrame:
    """J-12 / U-02."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def schema_parity(extractions: DataFrame) -> DataFrame:
    """A-07: models with more than one schema hash."""
    return extractions.groupBy("model").agg(F.count_distinct("schema_hash").alias("n_hashes"), F.array_join(F.array_sort(F.collect_set("schema_hash")), ",").alias("hashes")).where("n_hashes > 1")


def disagreements(arms: DataFrame, names: list[str], kind: Column | None = None, options: Column | None = None) -> DataFrame:
    """J-14 / C-10: cells of papers that all arms have, where some pair does not match; wide by arm."""
    cells = wide(arms, names).where(" AND ".join(f"has_{n}" for n in names))
    values = [normalised(F.col(n)["value"], kind, options).alias(f"v_{n}") for n in names]
    score = lambda a, b: pair_score(F.col(f"v_{a}"), F.col(f"v_{b}"), F.lit("text") if kind is None else kind)
    pairs = [score(a, b).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    scored = cells.select("paper_id", "field_name", *[F.col(n)["value"].alias(n) for n in names], *values).select("paper_id", "field_name", *names, F.array(*pairs).alias("s"))
    out = scored.select("paper_id", "field_name", F.size(F.filter("s", lambda x: x != "MATCH")).cast("long").alias("n_pairs"), F.array_contains("s", "MISMATCH").alias("mismatch"), *names)
    return out.where("n_pairs > 0")


def ambiguous_queue(arms: DataFrame, names: list[str], kind: Column | None = None, options: Column | None = None) -> DataFrame:
    """C-11."""
    return scores(arms, names, kind, options).where("score = 'AMBIGUOUS'").select("paper_id", "field_name", "arm_a", "arm_b", F.array_join("a", ";").alias("value_a"), F.array_join("b", ";").alias("value_b"))


def shared_papers(human: DataFrame, least: int = 2) -> DataFrame:
    """A-05."""
    return human.groupBy("paper_id").agg(F.count_distinct("extractor").alias("n_extractors")).where(F.col("n_extractors") >= least)


def votes(human: DataFrame) -> DataFrame:
    """A-18 counts: normalised value, number of votes and the first voter of every (paper, field); newest value of an extractor."""
    now = latest(human, ["paper_id", "field_name", "extractor"], ["ts", "id"])
    now = now.withColumn("norm", F.when(~is_null_synonym(F.col("value")), F.lower(F.trim("value"))))
    return now.groupBy("paper_id", "field_name", "norm").agg(F.count("*").alias("n"), F.min("extractor").alias("first"))


def consensus(human: DataFrame) -> DataFrame:
    """C-12 / A-18 / A-19: status, winner and votes of every (paper, field); strict majority of non-null votes, ties by first voter."""
    counted = votes(human)
    real = F.col("norm").isNotNull()
    out = counted.groupBy("paper_id", "field_name").agg(
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("n_votes"), F.count("norm").alias("n_values"), F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("top"),
        F.min_by("norm", F.when(real, F.struct((-F.col("n")).alias("n"), F.col("first").alias("first")))).alias("winner"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("norm", "n")))), lambda x: F.concat_ws("=", x.norm, x.n.cast("string"))), ",").alias("votes"),
    )
    status = F.when(F.col("n_votes") < 2, "INSUFFICIENT").when(F.col("n_values") == 1, "UNANIMOUS").when(2 * F.col("top") > F.col("n_votes"), "MAJORITY").otherwise("NO_CONSENSUS")
    return out.withColumn("status", status).withColumn("winner", F.when(F.col("status").isin("UNANIMOUS", "MAJORITY"), F.col("winner"))).select("paper_id", "field_name", "status", "winner", "n_votes", "votes")


# Fixed values
CONSENSUS = ["UNANIMOUS", "MAJORITY", "NO_CONSENSUS", "INSUFFICIENT"]


def consensus_pivot(found: DataFrame) -> DataFrame:
    """A-20."""
    return found.groupBy("field_name").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in CONSENSUS], F.count("*").alias("total"))


def distribution(values: DataFrame, keys: list[str], value: str = "value", collapse_at: int = 10, low_at: int = 20, share: float = 0.85) -> DataFrame:
    """A-16 / A-17: entropy, top share, distinct values and status of each group; null synonyms do not count."""
    counts = values.where(~is_null_synonym(F.col(value))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"), F.max("n").alias("top_n"),
        F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("mode"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_s"),
    )
    top = F.col("top_n") / F.col("n_values")
    entropy = F.greatest(F.log2(F.col("n_values").cast("double")) - F.col("_s") / F.col("n_values"), F.lit(0.0))
    status = F.when((F.col("n_values") >= collapse_at) & (F.col("n_distinct") == 1), "COLLAPSED").when((F.col("n_values") >= low_at) & (top >= share), "LOW_VARIANCE").otherwise("OK")
    return total.select(*keys, "n_values", "n_distinct", "mode", F.round(top, 6).alias("top_share"), F.round(entropy, 6).alias("entropy"), status.alias("status"))


def assert_no_collapse(report: DataFrame, strict: bool = False) -> DataFrame:
    """V-07: raises if a group has collapsed (strict: or varies little); the report otherwise."""
    bad = report.where(F.col("status").isin("COLLAPSED", *(["LOW_VARIANCE"] if strict else []))).limit(5).collect()
    if bad:
        raise ValueError(f"collapsed distributions: {bad}")
    return report


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """J-18 / J-19 / C-23 / U-03: same, changed, gone or new for every key of two runs."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("change", change)


def filled_domain(counts: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """H-06: counts over a fixed domain, zero where there is none."""
    return domain.join(counts, key, "left").fillna(0)


def progress(df: DataFrame, order: str, seconds: Column, failed: Column, total: int) -> DataFrame:
    """W-06: after each item: done, failed, mean seconds, percent and seconds to go."""
    out = running(df, order, {"failures": failed.cast("long"), "spent": seconds})
    mean = F.col("spent") / F.col("seen")
    return out.withColumn("mean", mean).withColumn("percent", 100.0 * F.col("seen") / total).withColumn("to_go", mean * (total - F.col("seen")))


def checkpoints(df: DataFrame, order: str, seconds: Column, failed: Column, total: int, every: int = 100, most_failed: float = 0.05, most_hours: float = 30.0) -> DataFrame:
    """W-07: every `every` items the failure rate, the projected hours, and whether to stop and why."""
    out = progress(df, order, seconds, failed, total).where(F.col("seen") % every == 0)
    rate, hours = F.col("failures") / F.col("seen"), (F.col("spent") + F.col("to_go")) / 3600
    reason = F.when(rate > most_failed, "failure rate").when(hours > most_hours, "projected hours")
    return out.withColumn("failure_rate", rate).withColumn("hours", hours).withColumn("abort", reason)

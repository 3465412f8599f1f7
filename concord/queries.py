"""The registered queries of the library over the domain views, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import lifecycle as L
from concord.functions import nulls as N
from concord.functions import text as X
from concord.functions import values as V
from concord.operators import agreement as A
from concord.operators import entities as E
from concord.operators import imports as I
from concord.operators import latest as J
from concord.operators import reports as R
from concord.operators import sampling as S
from concord.operators import verify as C
from concord.sources import responses
from concord.streaming import streams
from concord.registry import ORACLE_SQL, QUERIES, query
from concord.views import ARMS as MODEL_ARMS
from concord.views import frames

FLAGSHIP = "concordance_kappa"


# ---- pieces of SQL that several oracles share
HEADS = "heads AS (SELECT paper_id, max(id) AS extraction_id FROM extractions GROUP BY paper_id)"
CURRENT = f"""{HEADS}, current AS (SELECT * FROM (SELECT h.paper_id, s.*, row_number() OVER (PARTITION BY h.paper_id, s.field_name ORDER BY s.span_no DESC) AS rn
    FROM heads h JOIN spans s ON s.extraction_id = h.extraction_id) WHERE rn = 1)"""
ARMS = f"""{CURRENT}, raw_arms AS (
    {" UNION ALL ".join(f"SELECT paper_id, field_name, {i} AS arm_ord, '{n}' AS arm, {v} AS value FROM current" for i, (n, v) in enumerate(MODEL_ARMS.items()))}),
    arms AS (SELECT paper_id, field_name, arm_ord, arm, value, CASE WHEN lower(trim(value)) IN ('', 'nr', 'n/r', 'not reported', 'not_found', 'none', 'n/a') THEN NULL
        ELSE lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) END AS v FROM raw_arms)"""
SCORES = f"""{ARMS}, scored AS (SELECT paper_id, field_name, arm_a, arm_b, a, b, CASE WHEN a IS NULL AND b IS NULL THEN 'MATCH' WHEN a IS NULL OR b IS NULL THEN 'MISMATCH'
    WHEN contains(a, b) OR contains(b, a) THEN 'MATCH' WHEN len(list_intersect(string_split(a, ' '), string_split(b, ' '))) = 0 THEN 'MISMATCH' ELSE 'AMBIGUOUS' END AS score
    FROM (SELECT x.paper_id, x.field_name, x.arm AS arm_a, y.arm AS arm_b, x.v AS a, y.v AS b FROM arms x JOIN arms y ON x.paper_id = y.paper_id AND x.field_name = y.field_name AND x.arm_ord < y.arm_ord))"""
VOTES = """now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, field_name, extractor ORDER BY ts DESC, id DESC) AS rn FROM human) WHERE rn = 1),
    votes AS (SELECT paper_id, field_name, CASE WHEN lower(trim(value)) NOT IN ('', 'nr', 'n/r', 'not reported', 'not_found', 'none', 'n/a') THEN lower(trim(value)) END AS norm, count(*) AS n, min(extractor) AS first FROM now GROUP BY ALL),
    agg AS (SELECT paper_id, field_name, coalesce(sum(n) FILTER (norm IS NOT NULL), 0)::BIGINT AS n_votes, count(norm) AS n_values, coalesce(max(n) FILTER (norm IS NOT NULL), 0) AS top,
        first(norm ORDER BY n DESC, first) FILTER (norm IS NOT NULL) AS w, coalesce(string_agg(norm || '=' || n, ',' ORDER BY norm) FILTER (norm IS NOT NULL), '') AS votes FROM votes GROUP BY ALL),
    consensus AS (SELECT paper_id, field_name, CASE WHEN n_votes < 2 THEN 'INSUFFICIENT' WHEN n_values = 1 THEN 'UNANIMOUS' WHEN 2 * top > n_votes THEN 'MAJORITY' ELSE 'NO_CONSENSUS' END AS status, w, n_votes, votes FROM agg)"""
KAPPA = """count(*) FILTER (score <> 'AMBIGUOUS') AS n, count(*) FILTER (score = 'MATCH') AS n_match, count(*) FILTER (score = 'MISMATCH') AS n_mismatch, count(*) FILTER (score = 'AMBIGUOUS') AS n_ambiguous"""


NAMES = list(MODEL_ARMS)


def model_arms(extractions: DataFrame, spans: DataFrame) -> DataFrame:
    """The three model arms over the current spans."""
    return A.stacked(J.current_spans(extractions, spans), ["paper_id", "field_name"], {n: F.expr(v) for n, v in MODEL_ARMS.items()})


@query("extractions", "spans", sql=f"""WITH {SCORES}, c AS (SELECT arm_a, arm_b, field_name, {KAPPA} FROM scored GROUP BY ALL),
    p AS (SELECT *, CASE WHEN n > 0 THEN n_match::DOUBLE / n END AS p FROM c), e AS (SELECT *, p * p + (1 - p) * (1 - p) AS e FROM p),
    k AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN n_match = n THEN 1.0 WHEN n_match = 0 THEN 0.0 ELSE (p - e) / (1 - e) END AS k,
          CASE WHEN n <= 1 OR n_match = n OR n_match = 0 THEN 0.0 ELSE sqrt(p * (1 - p) / (n * (1 - e) * (1 - e))) END AS s FROM e)
    SELECT arm_a, arm_b, field_name, n, n_match, n_mismatch, n_ambiguous, round(p, 6) AS percent_agreement, round(k, 6) AS kappa, round(k - 1.96 * s, 6) AS ci_lower, round(k + 1.96 * s, 6) AS ci_upper FROM k""")
def concordance_kappa(extractions, spans):
    return A.concordance(model_arms(extractions, spans), NAMES)


@query("extractions", "spans", sql=f"WITH {SCORES} SELECT paper_id, field_name, arm_a, arm_b, a AS value_a, b AS value_b FROM scored WHERE score = 'AMBIGUOUS'")
def ambiguous_queue(extractions, spans):
    return A.ambiguous_queue(model_arms(extractions, spans), NAMES)


@query("extractions", "spans", sql=f"""WITH {SCORES}, bad AS (SELECT paper_id, field_name, count(*) FILTER (score <> 'MATCH') AS n_pairs, bool_or(score = 'MISMATCH') AS mismatch FROM scored GROUP BY ALL HAVING count(*) FILTER (score <> 'MATCH') > 0),
    w AS (SELECT paper_id, field_name, max(value) FILTER (arm = 'local') AS local, max(value) FILTER (arm = 'openai') AS openai, max(value) FILTER (arm = 'anthropic') AS anthropic FROM arms GROUP BY ALL)
    SELECT paper_id, field_name, n_pairs, mismatch, local, openai, anthropic FROM bad JOIN w USING (paper_id, field_name)""")
def three_arm_disagreements(extractions, spans):
    return A.disagreements(model_arms(extractions, spans), NAMES)


@query("extractions", sql="SELECT id, paper_id, schema_hash, model FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) AS rn FROM extractions) WHERE rn = 1")
def latest_extraction(extractions):
    return J.latest(extractions, ["paper_id"], ["id"]).select("id", "paper_id", "schema_hash", "model")


@query("extractions", sql="SELECT id, paper_id, schema_hash FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) AS rn FROM extractions) WHERE rn = 1 AND schema_hash <> '1-URGENT'")
def stale_extractions(extractions):
    return J.stale(extractions, "1-URGENT").select("id", "paper_id", "schema_hash")


@query("papers", "extractions", sql="SELECT id, status FROM papers WHERE id NOT IN (SELECT paper_id FROM extractions)")
def pending_papers(papers, extractions):
    return J.pending(papers, extractions).select("id", "status")


@query("spans", "extractions", sql=f"WITH {HEADS} SELECT field_name, count(*) AS n FROM spans WHERE extraction_id NOT IN (SELECT extraction_id FROM heads) GROUP BY ALL")
def orphan_spans(spans, extractions):
    return R.counts(J.orphans(spans, extractions), "field_name")


@query("extractions", "spans", sql="SELECT id, paper_id FROM extractions WHERE id NOT IN (SELECT extraction_id FROM spans)")
def childless_extractions(extractions, spans):
    return J.childless(extractions, spans).select("id", "paper_id")


@query("spans", "extractions", sql=f"WITH {HEADS} SELECT field_name, count(*) AS n_spans, count(DISTINCT extraction_id) AS n_extractions FROM spans WHERE extraction_id NOT IN (SELECT extraction_id FROM heads) GROUP BY ALL")
def cleanup_plan(spans, extractions):
    return I.cleanup_plan(spans, extractions)


@query("extractions", sql="SELECT model, count(DISTINCT schema_hash) AS n_hashes, string_agg(DISTINCT schema_hash, ',' ORDER BY schema_hash) AS hashes FROM extractions GROUP BY model HAVING count(DISTINCT schema_hash) > 1")
def schema_parity(extractions):
    return A.schema_parity(extractions)


@query("extractions", sql="SELECT model, count(DISTINCT paper_id) AS n_papers, count(*) AS n_extractions FROM extractions GROUP BY model")
def model_counts(extractions):
    return R.model_counts(extractions)


@query("extractions", sql="""WITH m AS (SELECT model, count(DISTINCT paper_id) AS n FROM extractions GROUP BY model), l AS (SELECT list(model || ' (n=' || n || ')' ORDER BY n DESC, model) AS p FROM m)
    SELECT array_to_string(p[:len(p) - 1], ', ') || ' and ' || p[len(p)] AS text FROM l""")
def model_list_text(extractions):
    return R.list_text(R.model_counts(extractions), "model", "n_papers")


@query("papers", sql=f"SELECT count(*) AS total, count(*) FILTER (status = 'ABSTRACT_SCREENED_IN') AS screened_in, count(*) FILTER (status = 'ABSTRACT_SCREENED_OUT') AS screened_out, count(*) FILTER (status = 'ABSTRACT_SCREEN_FLAGGED') AS flagged, count(*) FILTER (status = 'PARSED') AS parsed, count(*) FILTER (status = 'EXTRACTED') AS extracted, count(*) FILTER (status IN {tuple(L.INCLUDED)}) AS audited FROM papers")
def pipeline_stats(papers):
    return R.pipeline_stats(papers)


FLOW = f"""flow AS (SELECT count(*) AS identified, count(*) FILTER (status NOT IN {tuple(L.BEFORE_SCREENING)} OR status IN ('ABSTRACT_SCREENED_OUT', 'ABSTRACT_SCREEN_FLAGGED')) AS screened,
    count(*) FILTER (status = 'ABSTRACT_SCREENED_OUT') AS excluded, count(*) FILTER (status = 'ABSTRACT_SCREEN_FLAGGED') AS screen_flagged, count(*) FILTER (status = 'PDF_EXCLUDED') AS pdf_excluded,
    count(*) FILTER (status = 'PDF_EXCLUDED' AND pdf_exclusion_reason = 'INACCESSIBLE') AS not_retrieved, count(*) FILTER (status NOT IN {tuple(L.BEFORE_FULL_TEXT)}) AS full_text_retrieved,
    count(*) FILTER (status = 'FT_SCREENED_OUT') AS ft_screened_out, count(*) FILTER (status = 'FT_FLAGGED') AS ft_flagged, count(*) FILTER (status = 'EXTRACT_FAILED') AS extract_failed,
    count(*) FILTER (status IN {tuple(L.INCLUDED)}) AS included, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status = 'REJECTED' AND contains(lower(rejected_reason), 'low_yield')) AS low_yield_rejected,
    count(*) FILTER (status NOT IN {tuple(L.INCLUDED + L.EXCLUDED)}) AS in_progress FROM papers)"""


@query("papers", sql=f"WITH {FLOW} SELECT * FROM flow")
def prisma_flow(papers):
    return R.prisma_flow(papers)


BOXES = "excluded + pdf_excluded + ft_screened_out + rejected + included + in_progress"


@query("papers", sql=f"""WITH {FLOW}, kept AS (SELECT * FROM papers WHERE id % 41 <> 0), src AS (SELECT sum(n)::BIGINT AS counted, sum(i)::BIGINT AS counted_included FROM (SELECT source, count(*) AS n, count(*) FILTER (status IN {tuple(L.INCLUDED)}) AS i FROM kept GROUP BY source)),
    c AS (SELECT *, {BOXES} AS accounted, [counted = {BOXES}, counted_included = included, not_retrieved <= pdf_excluded, screened <= identified, low_yield_rejected <= rejected] AS checks FROM flow, src)
    SELECT counted, accounted, counted - accounted AS discrepancy, len(list_filter(checks, lambda x: NOT x))::INTEGER AS n_broken, len(list_filter(checks, lambda x: NOT x)) = 0 AS valid FROM c""")
def prisma_reconcile(papers):
    """The flow against a count by source that misses some records: the checks must find it."""
    return R.prisma_reconcile(R.prisma_flow(papers), R.prisma_by_source(papers.where("id % 41 <> 0")))


@query("papers", sql="SELECT coalesce(pdf_exclusion_reason, 'No reason given') AS reason, count(*) AS n FROM papers WHERE status = 'PDF_EXCLUDED' GROUP BY ALL")
def exclusion_reasons(papers):
    return R.reasons(papers, "PDF_EXCLUDED", "pdf_exclusion_reason")


@query("papers", sql="SELECT id, status FROM papers WHERE status IN ('EXTRACTED', 'AI_AUDIT_COMPLETE', 'HUMAN_AUDIT_COMPLETE', 'PARSED', 'ABSTRACT_SCREENED_OUT')")
def status_gate(papers):
    return papers.where(L.passes_gate(F.col("status"), "PARSED")).select("id", "status")


DECIDED = """d AS (SELECT paper_id, CASE WHEN pass1 = 'include' AND pass2 = 'include' THEN 'ABSTRACT_SCREENED_IN' WHEN pass1 = 'exclude' AND pass2 = 'exclude' THEN 'ABSTRACT_SCREENED_OUT' ELSE 'ABSTRACT_SCREEN_FLAGGED' END AS screened, verifier, pass1 FROM decisions)"""


@query("decisions", sql=f"WITH {DECIDED} SELECT paper_id, screened, CASE WHEN screened = 'ABSTRACT_SCREENED_IN' AND verifier = 'exclude' THEN 'ABSTRACT_SCREEN_FLAGGED' ELSE screened END AS status FROM d")
def screening_resolution(decisions):
    out = decisions.withColumn("screened", I.dual_pass(F.col("pass1"), F.col("pass2")))
    return out.select("paper_id", "screened", I.verifier_override(F.col("screened"), F.col("verifier")).alias("status"))


@query("decisions", sql="SELECT paper_id, CASE WHEN pass1 = 'include' AND (verifier IS NULL OR verifier = 'include') THEN 'ABSTRACT_SCREENED_IN' WHEN pass1 = 'include' THEN 'ABSTRACT_SCREEN_FLAGGED' ELSE 'ABSTRACT_SCREENED_OUT' END AS status FROM decisions")
def expanded_status(decisions):
    return decisions.select("paper_id", I.expanded_status(F.col("pass1"), F.col("verifier")).alias("status"))


def status_events(events: DataFrame) -> DataFrame:
    """Events as decisions: the type and the id choose the next status."""
    nxt = F.element_at(F.array(*map(F.lit, L.STATUSES)), ((F.col("event_id") % 15) + 1).cast("int"))
    return events.select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("seq"), nxt.alias("to_status"), (F.col("event_id") % 97 == 0).alias("override"))


@query("events", sql=f"""WITH RECURSIVE e AS (SELECT user_id AS paper_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {str(L.STATUSES)}[event_id % 15 + 1] AS t, event_id % 97 = 0 AS o FROM events),
    f AS (SELECT paper_id, 0 AS k, 'INGESTED' AS status, 0 AS applied, 0 AS rejected FROM (SELECT DISTINCT paper_id FROM e)
      UNION ALL SELECT f.paper_id, e.k, CASE WHEN o OR f.status || '>' || t IN {tuple(L.EDGES)} THEN t ELSE f.status END, f.applied + CASE WHEN o OR f.status || '>' || t IN {tuple(L.EDGES)} THEN 1 ELSE 0 END,
        f.rejected + CASE WHEN o OR f.status || '>' || t IN {tuple(L.EDGES)} THEN 0 ELSE 1 END FROM f JOIN e ON e.paper_id = f.paper_id AND e.k = f.k + 1)
    SELECT paper_id, status, applied::BIGINT AS applied, rejected::BIGINT AS rejected FROM f QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY k DESC) = 1""")
def status_fold(events):
    return L.fold_status(status_events(events))


@query("human", sql="""WITH c AS (SELECT extractor, field_name, value, count(*) AS n FROM human WHERE lower(trim(value)) NOT IN ('', 'nr', 'n/r', 'not reported', 'not_found', 'none', 'n/a') GROUP BY ALL),
    t AS (SELECT extractor, field_name, sum(n)::BIGINT AS n_values, count(*) AS n_distinct, first(value ORDER BY n DESC, value) AS mode, max(n) AS top, sum(n * log2(n)) AS s FROM c GROUP BY ALL)
    SELECT extractor, field_name, n_values, n_distinct, mode, round(top / n_values, 6) AS top_share, round(greatest(log2(n_values) - s / n_values, 0.0), 6) AS entropy,
           CASE WHEN n_values >= 10 AND n_distinct = 1 THEN 'COLLAPSED' WHEN n_values >= 20 AND top / n_values >= 0.85 THEN 'LOW_VARIANCE' ELSE 'OK' END AS status FROM t""")
def distribution_monitor(human):
    return A.distribution(human, ["extractor", "field_name"])


@query("human", sql=f"WITH {VOTES} SELECT paper_id, field_name, status, CASE WHEN status IN ('UNANIMOUS', 'MAJORITY') THEN w END AS winner, n_votes, votes FROM consensus")
def consensus(human):
    return A.consensus(human)


@query("human", sql=f"WITH {VOTES} SELECT field_name, count(*) FILTER (status = 'UNANIMOUS') AS unanimous, count(*) FILTER (status = 'MAJORITY') AS majority, count(*) FILTER (status = 'NO_CONSENSUS') AS no_consensus, count(*) FILTER (status = 'INSUFFICIENT') AS insufficient, count(*) AS total FROM consensus GROUP BY ALL")
def consensus_pivot(human):
    return A.consensus_pivot(A.consensus(human))


@query("human", sql="SELECT paper_id, count(DISTINCT extractor) AS n_extractors FROM human GROUP BY ALL HAVING count(DISTINCT extractor) >= 4")
def shared_papers(human):
    return A.shared_papers(human, 4)


def _level(values):
    return ", ".join(f"count(*) FILTER (x = '{v}') AS \"{v}\"" for v in values) + ", count(x) AS total"


@query("ratings", sql=f"WITH t AS (SELECT field_name, {_level(R.LEVEL1)} FROM (SELECT *, level1 AS x FROM ratings) GROUP BY ALL) SELECT *, round(100.0::DOUBLE * EQUIVALENT / total, 1) AS pct_eq, CASE WHEN round(100.0::DOUBLE * EQUIVALENT / total, 1) >= 90 THEN 'HIGH_EQ' WHEN round(100.0::DOUBLE * EQUIVALENT / total, 1) <= 10 THEN 'LOW_EQ' ELSE '' END AS flag FROM t")
def xtab_level1(ratings):
    return R.level1_table(ratings)


@query("ratings", sql=f"SELECT field_name, {_level(R.LEVEL2)} FROM (SELECT *, level2 AS x FROM ratings WHERE level1 <> 'EQUIVALENT') GROUP BY ALL")
def xtab_level2(ratings):
    return R.crosstab(ratings.where("level1 <> 'EQUIVALENT'"), ["field_name"], "level2", R.LEVEL2)


@query("ratings", sql=f"SELECT field_type, {_level(R.LEVEL2)} FROM (SELECT *, level2 AS x FROM ratings) GROUP BY ALL")
def xtab_fieldtype(ratings):
    return R.crosstab(ratings, ["field_type"], "level2", R.LEVEL2)


@query("ratings", sql=f"SELECT arm_a || ' × ' || arm_b AS arm_pair, {_level(R.LEVEL2)} FROM (SELECT *, level2 AS x FROM ratings) GROUP BY ALL")
def xtab_armpair(ratings):
    return R.crosstab(ratings.withColumn("arm_pair", F.concat_ws(" × ", "arm_a", "arm_b")), ["arm_pair"], "level2", R.LEVEL2)


@query("ratings", sql="""WITH c AS (SELECT paper_id, field_name, max(CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS r, bool_or(tripped) AS f FROM ratings GROUP BY ALL)
    SELECT ['low', 'medium', 'high'][r + 1] AS risk, count(*) AS n, count(*) FILTER (f) AS tripped, count(*) FILTER (r = 2 OR (r = 1 AND f)) AS kept, round(100.0::DOUBLE * count(*) FILTER (f) / count(*), 1) AS trip_rate FROM c GROUP BY ALL""")
def bfilter_trip_rates(ratings):
    return R.bfilter(ratings)


@query("verdicts", sql="SELECT arm, field_type, field_name, count(*) AS n, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v.lower()}" for v in R.VERDICTS) + ", grouping_id(arm, field_type, field_name)::INTEGER AS grouping FROM verdicts GROUP BY GROUPING SETS ((arm), (field_type), (field_name, arm), ())")
def verdict_grouping_sets(verdicts):
    return R.verdict_sets(verdicts)


@query("verdicts", sql="SELECT arm, value IS NULL OR upper(trim(value)) IN ('', 'NR', 'N/A', 'NA', 'NOT_FOUND', 'NOT FOUND', 'NOT REPORTED') AS absent, count(*) FILTER (verdict = 'SUPPORTED') AS \"SUPPORTED\", count(*) FILTER (verdict = 'PARTIALLY_SUPPORTED') AS \"PARTIALLY_SUPPORTED\", count(*) FILTER (verdict = 'UNSUPPORTED') AS \"UNSUPPORTED\", count(*) AS total FROM verdicts GROUP BY ALL")
def absence_verdicts(verdicts):
    return R.crosstab(verdicts.withColumn("absent", N.is_absence_claim(F.col("value"))), ["arm", "absent"], "verdict", R.VERDICTS)


@query("verdicts", sql="SELECT arm, windowed, count(*) AS n, count(*) FILTER (short_circuit) AS short_circuits, round(avg(short_circuit::INT), 6) AS rate FROM verdicts GROUP BY ALL")
def short_circuit_rate(verdicts):
    return verdicts.groupBy("arm", "windowed").agg(F.count("*").alias("n"), F.count_if("short_circuit").alias("short_circuits"), F.round(F.avg(F.col("short_circuit").cast("int")), 6).alias("rate"))


@query("verdicts", sql="""WITH r AS (SELECT arm, price, row_number() OVER (PARTITION BY arm ORDER BY price) AS rn, count(*) OVER (PARTITION BY arm) AS n FROM verdicts)
    SELECT arm, max(n) AS n, min(price) FILTER (rn > round_even(0.5 * (n - 1), 0)) AS p50, min(price) FILTER (rn > round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY arm""")
def percentile_nearest(verdicts):
    return R.nearest_rank(verdicts, ["arm"], "price", [50, 95])


@query("verdicts", sql="SELECT paper_id, count(*) AS n FROM verdicts WHERE verdict = 'UNSUPPORTED' GROUP BY ALL ORDER BY n DESC, paper_id LIMIT 10")
def top_unsupported(verdicts):
    return R.top(verdicts.where("verdict = 'UNSUPPORTED'"), "paper_id", 10, [F.col("paper_id")])


@query("spans", sql="SELECT field_name, count(*) AS n, count(*) FILTER (audit_status = 'verified') AS verified, round(count(*) FILTER (audit_status = 'verified') / count(*), 6) AS rate FROM spans GROUP BY ALL")
def field_verification_rate(spans):
    return R.verification_rate(spans, ["field_name"])


@query("extractions", "spans", sql=f"WITH {CURRENT} SELECT paper_id, count(*) AS n_fields FROM current GROUP BY ALL HAVING count(*) < 4")
def field_coverage(extractions, spans):
    return R.field_coverage(J.current_spans(extractions, spans), 4)


@query("cloud", sql="SELECT paper_id, count(*) FILTER (value IS NOT NULL AND trim(value) NOT IN ('', 'NOT_FOUND', 'Not discussed', 'NR', 'No comparison reported', 'Not assessable')) AS n_populated FROM cloud GROUP BY paper_id HAVING n_populated < 4")
def low_yield(cloud):
    return R.low_yield(cloud)


@query("spans", sql="""WITH c AS (SELECT extraction_id, audit_status, CASE audit_status WHEN 'flagged' THEN 2 WHEN 'contested' THEN 3 ELSE 5 END AS r, count(*) AS n FROM spans GROUP BY ALL)
    SELECT extraction_id, first(audit_status ORDER BY r) AS worst, string_agg(n || ' ' || upper(audit_status), ', ' ORDER BY r) AS summary, sum(n)::BIGINT AS n_spans FROM c GROUP BY extraction_id""")
def worst_state_queue(spans):
    return R.worst_state(spans)


FIELDS = [f"f{i}" for i in range(1, 8)]


@query("extractions", "spans", sql=f"WITH {CURRENT} SELECT paper_id, " + ", ".join(f"max(flag) FILTER (field_name = '{f}') AS {f}_value, max(confidence) FILTER (field_name = '{f}') AS {f}_confidence, max(audit_status) FILTER (field_name = '{f}') AS {f}_state" for f in FIELDS) + " FROM current GROUP BY ALL")
def evidence_wide(extractions, spans):
    return R.evidence_wide(J.current_spans(extractions, spans), FIELDS)


@query("conversations", sql="SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, round(coalesce(stddev_samp(length(text)), 0.0), 6) AS stdev, min(length(text))::INTEGER AS least, max(length(text))::INTEGER AS most FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def trace_quality(conversations):
    return R.length_stats(conversations.where("text IS NOT NULL"), ["role"], "text")


@query("conversations", sql="""WITH b AS (SELECT CASE WHEN length(text) < 100 THEN 0 WHEN length(text) < 200 THEN 1 WHEN length(text) < 400 THEN 2 WHEN length(text) < 800 THEN 3 WHEN length(text) < 1600 THEN 4 ELSE 5 END AS ordinal FROM conversations WHERE text IS NOT NULL)
    SELECT d.ordinal::INTEGER AS ordinal, ['0-100', '100-200', '200-400', '400-800', '800-1600', '1600+'][d.ordinal + 1] AS bucket, count(b.ordinal) AS n FROM range(6) d(ordinal) LEFT JOIN b ON b.ordinal = d.ordinal GROUP BY d.ordinal""")
def trace_histogram(conversations):
    return R.histogram(conversations.where("text IS NOT NULL"), F.length("text"), [0, 100, 200, 400, 800, 1600])


@query("conversations", sql="SELECT conv_id, turn, length(text)::INTEGER AS n_chars FROM conversations WHERE role = 'assistant' AND NOT regexp_matches(rtrim(text), '[.?!>]$')")
def truncated_traces(conversations):
    return conversations.where((F.col("role") == "assistant") & X.is_truncated(F.col("text"))).select("conv_id", "turn", F.length("text").alias("n_chars"))


@query("verdicts", sql="""WITH a AS (SELECT paper_id, field_name, max(verdict) AS b FROM verdicts WHERE no % 3 <> 0 GROUP BY ALL), c AS (SELECT paper_id, field_name, min(verdict) AS a FROM verdicts WHERE no % 3 <> 1 GROUP BY ALL)
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'gone' WHEN a = b THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN c USING (paper_id, field_name)) GROUP BY ALL""")
def run_delta(verdicts):
    keys = ["paper_id", "field_name"]
    a = verdicts.where("no % 3 <> 0").groupBy(*keys).agg(F.max("verdict").alias("verdict"))
    b = verdicts.where("no % 3 <> 1").groupBy(*keys).agg(F.min("verdict").alias("verdict"))
    return R.counts(A.compare_runs(a, b, keys, "verdict"), "change")


@query("documents", sql="SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_key FROM documents")
def title_norm(documents):
    return documents.select("doc_id", X.title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"))


# Host and path patterns of publishers
PUBLISHERS = [("archive", r"arxiv|archive"), ("shop", r"shop|store"), ("news", r"news|press"), ("wiki", r"wiki"), ("forum", r"forum|board"), ("blog", r"blog|post")]


@query("pages", sql="SELECT publisher, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{n}'" for n, p in PUBLISHERS) + " ELSE 'other' END AS publisher FROM pages) GROUP BY ALL")
def publisher_class(pages):
    return R.counts(pages.select(X.first_rule(F.col("url"), PUBLISHERS, "other").alias("publisher")), "publisher")


RULES = [{"name": "license", "regex": "licen[sc]e"}, {"name": "token", "keywords": ["token", "secret"], "exclusions": ["example"]}, {"name": "contact", "keywords": ["@"]}]


@query("documents", sql="SELECT category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'license' WHEN (contains(lower(text), 'token') OR contains(lower(text), 'secret')) AND NOT contains(lower(text), 'example') THEN 'token' WHEN contains(text, '@') THEN 'contact' ELSE 'ambiguous' END AS category FROM documents) GROUP BY ALL")
def rule_category(documents):
    return R.counts(documents.select(X.keyword_category(F.col("text"), RULES).alias("category")), "category")


@query("verdicts", sql="SELECT verdict, arm, paper_id, no FROM (SELECT *, row_number() OVER (PARTITION BY verdict, arm ORDER BY sha256('42|' || verdict || '|' || arm || '|' || paper_id || ':' || no)) AS rn FROM verdicts) WHERE rn <= 4")
def stratified_hash_sample(verdicts):
    keyed = verdicts.withColumn("key", F.concat_ws(":", F.col("paper_id").cast("string"), F.col("no").cast("string")))
    return S.stratified(keyed, ["verdict", "arm"], "key", 4).select("verdict", "arm", "paper_id", F.col("no").cast("long").alias("no"))


@query("orders", sql="SELECT o_orderstatus, o_orderkey, rn FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) ORDER BY rn, o_orderstatus LIMIT 10")
def round_robin_topk(orders):
    return S.round_robin(orders, "o_orderstatus", "o_orderkey", 10).select("o_orderstatus", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("extractions", sql="SELECT id, ('0x' || substr(sha256(paper_id || chr(31) || model), 1, 8))::BIGINT AS seed, ('0x' || substr(sha256(paper_id || chr(31) || model), 1, 8))::BIGINT % 2147483648 AS cell_seed FROM extractions")
def stable_seed(extractions):
    parts = [F.col("paper_id").cast("string"), F.col("model")]
    return extractions.select("id", V.stable_seed(*parts).alias("seed"), V.stable_seed(*parts, below=1 << 31).alias("cell_seed"))


@query("extractions", "spans", "verdicts", sql="""SELECT 'confidence' AS rule, count(*) FILTER (NOT (confidence BETWEEN 0 AND 1)) AS n FROM spans UNION ALL SELECT 'state', count(*) FILTER (audit_status NOT IN ('verified', 'contested', 'flagged')) FROM spans
    UNION ALL SELECT 'unique', count(*) FROM (SELECT 1 FROM spans GROUP BY extraction_id, field_name HAVING count(*) > 1)""")
def integrity_checks(extractions, spans, verdicts):
    return R.violations(spans, {"confidence": F.col("confidence").between(0, 1), "state": F.col("audit_status").isin("verified", "contested", "flagged")}, ["extraction_id", "field_name"])


@query("verdicts", sql="SELECT 'has_rows' AS gate, count(*) > 0 AS passed FROM verdicts UNION ALL SELECT 'all_arms', count(DISTINCT arm) = 3 FROM verdicts UNION ALL SELECT 'few_short_circuits', avg(short_circuit::INT) <= 0.5 FROM verdicts")
def smoke_gates(verdicts):
    return R.gates(verdicts, {"has_rows": F.count("*") > 0, "all_arms": F.count_distinct("arm") == 3, "few_short_circuits": F.avg(F.col("short_circuit").cast("int")) <= 0.5})


STAGE_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(L.STAGES))


def workflow_blocker(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = frames(spark, sf_dir, "events")
    stage = F.element_at(F.array(*map(F.lit, L.STAGES)), ((F.col("event_id") % 9) + 1).cast("int"))
    state = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_id") % 5 < 4, "complete").otherwise("pending")
    return L.blocker(L.workflow(spark, events.select(stage.alias("stage"), F.col("event_id").alias("seq"), state.alias("state"))))


QUERIES["workflow_blocker"] = workflow_blocker
ORACLE_SQL["workflow_blocker"] = f"""WITH dim(ordinal, stage) AS (VALUES {STAGE_ROWS}), e AS (SELECT event_id % 9 AS ordinal, first(CASE WHEN event_type = 'purchase' OR event_id % 5 < 4 THEN 'complete' ELSE 'pending' END ORDER BY event_id DESC) AS state FROM events GROUP BY ALL),
    s AS (SELECT dim.ordinal, stage, coalesce(state, 'pending') IN ('complete', 'bypassed') AS done FROM dim LEFT JOIN e ON e.ordinal = dim.ordinal)
    SELECT first(stage ORDER BY ordinal) FILTER (NOT done) AS blocker, count(*) FILTER (done) AS n_done, count(*) AS n_stages FROM s"""


@query("events", sql="SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(events):
    return streams.tumbling(events).withColumn("total", F.round("total", 4))


@query("events", sql="""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minute OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(events):
    return streams.sessions(events)


@query("benchmark", "documents", sql="""WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark), d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
    SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t)""")
def snippet_exact(benchmark, documents):
    """All pairs of snippets and texts."""
    return C.contained_anywhere(benchmark.select("item_id", F.col("text").alias("snippet")), documents.select("doc_id", "text"), "snippet", "text").select("doc_id", "item_id")


def citations(papers: DataFrame, side: int) -> DataFrame:
    return papers.where(F.col("id") % 2 == side).select(F.col("id").alias("ord"), "pmid", "doi", "title", "abstract", "year")


CITED = """k AS (SELECT id, id % 2 AS side, lower(doi) AS doi, pmid, nullif(trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')), '') AS t FROM papers)"""


@query("papers", sql=f"""WITH {CITED}, m AS (SELECT b.id AS ord, (SELECT min(a.id) FROM k a WHERE a.side = 0 AND a.doi = b.doi) AS d, (SELECT min(a.id) FROM k a WHERE a.side = 0 AND a.pmid = b.pmid) AS p, (SELECT min(a.id) FROM k a WHERE a.side = 0 AND a.t = b.t) AS t FROM k b WHERE b.side = 1)
    SELECT ord, coalesce(d, p, t) AS a_ord, CASE WHEN d IS NOT NULL THEN 'doi_key' WHEN p IS NOT NULL THEN 'pmid' WHEN t IS NOT NULL THEN 'title_key' END AS hit FROM m""")
def dedup_exact(papers):
    return E.exact_matches(citations(papers, 0), citations(papers, 1)).select("ord", "a_ord", "hit")


@query("papers")
def dedup_fuzzy(papers):
    return E.fuzzy_matches(citations(papers, 0), citations(papers, 1))


@query("papers", sql="SELECT count(*) FILTER (doi IS NOT NULL AND pmid IS NULL) AS doi_only, count(*) FILTER (doi IS NULL AND pmid IS NOT NULL) AS pmid_only, count(*) FILTER (doi IS NOT NULL AND pmid IS NOT NULL) AS both, count(*) FILTER (doi IS NULL AND pmid IS NULL) AS neither FROM papers")
def key_coverage(papers):
    return E.key_coverage(papers)


@query("papers", sql="SELECT id, 'EE-' || lpad(id::VARCHAR, greatest(3, length(id::VARCHAR))::INTEGER, '0') AS ee_label, row_number() OVER (ORDER BY id) AS ee_seq FROM papers")
def paper_labels(papers):
    return J.labelled(papers).select("id", "ee_label", "ee_seq")


ENUMS = "SELECT field_name, enum_value FROM (VALUES ('f1', 'click'), ('f1', 'view'), ('f2', 'purchase'), ('f3', 'login'), ('f4', 'logout'), ('f5', 'click'), ('f6', 'view'), ('f0', 'purchase'), ('f0', 'signup')) AS t(field_name, enum_value)"


@query("human", sql=f"""WITH enums AS ({ENUMS}), stray AS (SELECT h.* FROM human h WHERE value <> 'NR' AND NOT EXISTS (SELECT 1 FROM enums e WHERE e.field_name = h.field_name AND e.enum_value = h.value))
    SELECT s.field_name, e.field_name AS other_field, count(*) AS n FROM stray s JOIN enums e ON e.enum_value = s.value AND e.field_name <> s.field_name GROUP BY ALL""")
def field_bleed(human):
    return R.counts(C.field_bleed(human.select("id", "field_name", "value"), human.sparkSession.sql(ENUMS)), "field_name", "other_field")


@query("human")
def field_issues(human):
    fields = human.sparkSession.sql(ENUMS).groupBy("field_name").agg(F.collect_set("enum_value").alias("options"))
    return R.counts(C.field_issues(human.select("id", "field_name", "value"), fields), "field_name", "part", "closest")


def triples(documents: DataFrame) -> DataFrame:
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    kind = F.when(F.col("doc_id") % 3 == 0, "categorical").when(F.col("doc_id") % 3 == 1, "numeric").otherwise("free_text")
    return documents.select("doc_id", F.substring(line, 1, 12).alias("value"), F.when(F.col("doc_id") % 4 == 0, F.upper(line)).when(F.col("doc_id") % 4 == 1, F.concat(line, F.lit(" zzzz qqqq"))).otherwise(line).alias("span"), F.col("text").alias("source_text"), kind.alias("field_type"), F.lit(0.0).alias("tolerance"))


@query("documents")
def precheck_flags(documents):
    return C.short_circuit(C.precheck(triples(documents))).drop("source_text", "value", "span", "tolerance")


@query("documents")
def audit_states(documents):
    rows = triples(documents).select("doc_id", "value", F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, F.concat("span", F.lit("..."))).otherwise(F.col("span")).alias("source_snippet"), (F.col("doc_id") % 5).cast("int").alias("tier"), F.col("source_text").alias("paper_text"), (F.col("doc_id") % 6 != 0).alias("semantic"))
    return C.audit(rows).select("doc_id", "audit_state")


@query("events", sql="""SELECT event_id, event_id % 5 <> 4 AS _ok, CASE WHEN event_id % 5 <> 4 THEN 0 END::INTEGER AS ordinal, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 'k' ELSE event_type END AS field_name,
    CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN json_extract_string(props, '$.k') ELSE value::VARCHAR END AS value, NULL::VARCHAR AS source_snippet, NULL::DOUBLE AS confidence, NULL::INTEGER AS tier FROM events""")
def response_to_spans(events):
    one = F.to_json(F.struct(F.col("event_type").alias("field_name"), F.col("value").cast("string").alias("value")))
    shape = F.col("event_id") % 5
    text = F.when(shape == 0, F.concat(F.lit('{"fields": ['), one, F.lit("]}"))).when(shape == 1, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(shape == 2, one).when(shape == 3, F.col("props")).otherwise("not json")
    return responses.spans(events.select("event_id", text.alias("response"))).drop("response")



"""Queries of the review workflow: functions of text and values, typed agreement, imports, queues, samples and progress, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord import lifecycle as L
from concord.functions import nulls as N
from concord.functions import text as X
from concord.functions import values as V
from concord.operators import agreement as A
from concord.operators import entities as E
from concord.operators import gates as G
from concord.operators import imports as I
from concord.operators import jobs as B
from concord.operators import latest as J
from concord.operators import queues as Q
from concord.operators import reports as R
from concord.operators import sampling as S
from concord.operators import sketches as K
from concord.operators import verify as C
from concord.operators import windows as W
from concord.queries import CURRENT, HEADS, KAPPA, NAMES, VOTES, status_events
from concord.registry import query
from concord.sources import readers, responses, sinks
from concord.views import KINDS, OPTIONS, TYPED_ARMS

NULLS = "('', 'nr', 'n/r', 'not reported', 'not_found', 'none', 'n/a')"
LINE = "split_part(text, chr(10), 1)"


def line() -> F.Column:
    return F.split_part("text", F.lit("\n"), F.lit(1))


# ---- agreement of typed fields


def chosen(column: str, options: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in options.items()) + f" ELSE {other} END"


def canonical_sql(x: str) -> str:
    """One value against the list `opts`."""
    head = f"list_filter(opts, lambda o: starts_with(o, {x} || ' ') OR o = {x})"
    same = f"list_filter(opts, lambda o: lower(o) = lower({x}))"
    return f"CASE WHEN list_contains(opts, {x}) THEN {x} WHEN len({same}) > 0 THEN {same}[-1] WHEN len({head}) = 1 AND trim(regexp_extract({head}[1], '^(.+?)\\s*\\(', 1)) = {x} THEN {head}[1] ELSE {x} END"


TYPED = f"""{CURRENT}, raw AS ({" UNION ALL ".join(f"SELECT paper_id, field_name, {i} AS arm_ord, '{n}' AS arm, {v} AS value FROM current" for i, (n, v) in enumerate(TYPED_ARMS.items()))}),
    kinds AS (SELECT *, {chosen("field_name", {k: f"'{v}'" for k, v in KINDS.items()}, "'text'")} AS kind, {chosen("field_name", {k: str(v) for k, v in OPTIONS.items()}, "[]::VARCHAR[]")} AS opts FROM raw),
    parts AS (SELECT paper_id, field_name, arm, trim(x) AS x, opts FROM (SELECT *, unnest(string_split(value, ';')) AS x FROM kinds WHERE kind = 'multi' AND contains(value, ';')) WHERE lower(trim(x)) NOT IN {NULLS}),
    multi AS (SELECT paper_id, field_name, arm, list_sort(list_distinct(list(c))) AS l FROM (SELECT *, {canonical_sql("x")} AS c FROM parts) GROUP BY ALL),
    one AS (SELECT *, trim(value) AS t, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM kinds),
    typed AS (SELECT o.paper_id, o.field_name, o.arm_ord, o.arm, o.kind, CASE WHEN o.value IS NULL OR lower(o.t) IN {NULLS} THEN NULL WHEN o.kind = 'multi' AND contains(o.value, ';') THEN m.l
        WHEN o.kind = 'numeric' THEN [CASE WHEN d = '' THEN t ELSE d::HUGEINT::VARCHAR END] WHEN o.kind = 'raw' THEN [trim(regexp_replace(o.value, '\\s+', ' ', 'g'))]
        WHEN o.kind IN ('categorical', 'multi') THEN [{canonical_sql("t")}] ELSE [lower(trim(regexp_replace(o.value, '\\s+', ' ', 'g')))] END AS v FROM one o LEFT JOIN multi m USING (paper_id, field_name, arm)),
    scored AS (SELECT paper_id, field_name, arm_a, arm_b, a, b, CASE WHEN a IS NULL AND b IS NULL THEN 'MATCH' WHEN a IS NULL OR b IS NULL THEN 'MISMATCH'
        WHEN len(a) > 1 OR len(b) > 1 THEN CASE WHEN a = b THEN 'MATCH' WHEN NOT list_has_any(a, b) THEN 'MISMATCH' ELSE 'AMBIGUOUS' END
        WHEN a[1] = b[1] THEN 'MATCH' WHEN kind IN ('categorical', 'multi') THEN 'MISMATCH' WHEN contains(a[1], b[1]) OR contains(b[1], a[1]) THEN 'MATCH'
        WHEN NOT list_has_any(string_split(lower(a[1]), ' '), string_split(lower(b[1]), ' ')) THEN 'MISMATCH' ELSE 'AMBIGUOUS' END AS score
        FROM (SELECT x.paper_id, x.field_name, x.kind, x.arm AS arm_a, y.arm AS arm_b, x.v AS a, y.v AS b FROM typed x JOIN typed y ON x.paper_id = y.paper_id AND x.field_name = y.field_name AND x.arm_ord < y.arm_ord)),
    c AS (SELECT arm_a, arm_b, field_name, {KAPPA} FROM scored GROUP BY ALL), p AS (SELECT *, CASE WHEN n > 0 THEN n_match::DOUBLE / n END AS p FROM c), e AS (SELECT *, p * p + (1 - p) * (1 - p) AS e FROM p),
    k AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN n_match = n THEN 1.0 WHEN n_match = 0 THEN 0.0 ELSE (p - e) / (1 - e) END AS k, CASE WHEN n <= 1 OR n_match = n OR n_match = 0 THEN 0.0 ELSE sqrt(p * (1 - p) / (n * (1 - e) * (1 - e))) END AS s FROM e),
    report AS (SELECT arm_a, arm_b, field_name, n, n_match, n_mismatch, n_ambiguous, round(p, 6) AS percent_agreement, round(k, 6) AS kappa, round(k - 1.96 * s, 6) AS ci_lower, round(k + 1.96 * s, 6) AS ci_upper FROM k)"""


def kind_of(field: F.Column) -> F.Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[field], F.lit("text"))


def options_of(field: F.Column) -> F.Column:
    out = F.array().cast("array<string>")
    for name, options in OPTIONS.items():
        out = F.when(field == name, F.array(*map(F.lit, options))).otherwise(out)
    return out


def typed_arms(extractions: DataFrame, spans: DataFrame) -> DataFrame:
    return A.stacked(J.current_spans(extractions, spans), ["paper_id", "field_name"], {n: F.expr(v) for n, v in TYPED_ARMS.items()})


def typed(extractions: DataFrame, spans: DataFrame) -> tuple:
    return typed_arms(extractions, spans), NAMES, kind_of(F.col("field_name")), options_of(F.col("field_name"))


@query("extractions", "spans", sql=f"WITH {TYPED} SELECT * FROM report")
def typed_concordance(extractions, spans):
    return A.concordance(*typed(extractions, spans))


@query("extractions", "spans", sql=f"WITH {TYPED} SELECT paper_id, field_name, arm_a, arm_b, array_to_string(a, ';') AS value_a, array_to_string(b, ';') AS value_b FROM scored WHERE score = 'AMBIGUOUS'")
def typed_ambiguous_queue(extractions, spans):
    return A.ambiguous_queue(*typed(extractions, spans))


@query("extractions", "spans", sql=f"WITH {TYPED}, m AS (SELECT arm_a, arm_b, avg(kappa) AS k, count(kappa) AS n_fields FROM report GROUP BY ALL) SELECT arm_a, arm_b, round(k, 6) AS mean_kappa, n_fields, CASE WHEN k >= 0.8 THEN 'high' WHEN k >= 0.6 THEN 'medium' WHEN k IS NOT NULL THEN 'low' ELSE 'none' END AS band, CASE WHEN k IS NULL THEN 'N/A' ELSE printf('%.3f', round(k, 6)) END AS shown FROM m")
def mean_kappa_bands(extractions, spans):
    out = A.mean_kappa(A.concordance(*typed(extractions, spans)))
    return out.withColumn("band", V.kappa_band(F.col("mean_kappa"))).withColumn("shown", V.shown(F.col("mean_kappa")))


STORE = "store AS (SELECT 'local' AS arm, e.paper_id, s.field_name, s.flag AS value, s.line_status AS snippet FROM spans s JOIN extractions e ON e.id = s.extraction_id UNION ALL SELECT arm, paper_id, field_name, value, snippet FROM cloud UNION ALL SELECT 'human_' || extractor, paper_id, field_name, value, snippet FROM human)"


def store(extractions: DataFrame, spans: DataFrame, cloud: DataFrame, human: DataFrame) -> DataFrame:
    local = spans.join(extractions.select(F.col("id").alias("extraction_id"), "paper_id"), "extraction_id").select("paper_id", "field_name", F.col("flag").alias("value"), F.col("line_status").alias("snippet"))
    return A.arm_store(local, cloud, human)


@query("extractions", "spans", "cloud", "human", sql=f"WITH {STORE} SELECT arm, field_name, count(*) FILTER (value IS NOT NULL AND lower(trim(value)) NOT IN {NULLS}) AS n_values, count(DISTINCT value) FILTER (value IS NOT NULL AND lower(trim(value)) NOT IN {NULLS}) AS n_distinct, min(snippet) AS first_snippet FROM store GROUP BY ALL")
def arm_store_values(extractions, spans, cloud, human):
    real = ~N.is_null_synonym(F.col("value"))
    return store(extractions, spans, cloud, human).groupBy("arm", "field_name").agg(F.count_if(real).alias("n_values"), F.count_distinct(F.when(real, F.col("value"))).alias("n_distinct"), F.min("snippet").alias("first_snippet"))


@query("extractions", "spans", "cloud", "human", sql=f"WITH {STORE}, s AS (SELECT * FROM store WHERE arm IN ('local', 'openai', 'human_A')) SELECT paper_id, field_name, max(snippet) FILTER (arm = 'local') AS local, max(snippet) FILTER (arm = 'openai') AS openai, max(snippet) FILTER (arm = 'human_A') AS \"human_A\" FROM s GROUP BY ALL")
def snippets_of_cells(extractions, spans, cloud, human):
    order = ["local", "openai", "human_A"]
    return Q.snippets_by_arm(store(extractions, spans, cloud, human).where(F.col("arm").isin(order)), order)


@query("human", "cloud", sql="SELECT 'human' AS side, count(DISTINCT paper_id) AS n FROM human WHERE paper_id NOT IN (SELECT paper_id FROM cloud) UNION ALL SELECT 'cloud', count(DISTINCT paper_id) FROM cloud WHERE paper_id NOT IN (SELECT paper_id FROM human)")
def papers_of_one_side(human, cloud):
    return A.only_in(human, cloud).agg(F.lit("human").alias("side"), F.count("*").alias("n")).union(A.only_in(cloud, human).agg(F.lit("cloud").alias("side"), F.count("*").alias("n")))


@query("human", "cloud", sql="SELECT h.paper_id, h.field_name, h.value AS human, c.value AS model FROM human h JOIN cloud c ON h.paper_id = c.paper_id AND h.field_name = c.field_name WHERE lower(trim(h.value)) <> lower(trim(c.value))")
def human_model_differences(human, cloud):
    return B.human_against_model(human, cloud)


@query("human", sql=f"WITH {VOTES}, r AS (SELECT paper_id, field_name, norm, n FROM votes WHERE norm IS NOT NULL) SELECT paper_id, field_name, '{{' || string_agg('\"' || norm || '\":' || n, ',' ORDER BY norm) || '}}' AS votes FROM r GROUP BY ALL HAVING sum(n) >= 2 AND count(*) > 1 AND 2 * max(n) <= sum(n)")
def undecided_cells(human):
    return B.votes_json(A.votes(human))


# ---- values


@query("cloud", "human", sql=f"""WITH v AS (SELECT value FROM cloud UNION ALL SELECT value FROM human)
    SELECT value, count(*) AS n, bool_or(value IS NULL OR lower(trim(value)) IN {NULLS}) AS synonym, bool_or(value IS NULL OR upper(trim(value)) IN ('', 'NR', 'N/A', 'NA', 'NOT_FOUND', 'NOT FOUND', 'NOT REPORTED')) AS claim,
        bool_or(coalesce(value IN ('NOT_FOUND', 'Not discussed', 'NR', 'No comparison reported'), false)) AS audit_absence, bool_or(value IS NOT NULL AND trim(value) NOT IN ('', 'NOT_FOUND', 'Not discussed', 'NR', 'No comparison reported', 'Not assessable')) AS populated,
        min(CASE WHEN trim(value) <> '' AND upper(trim(value)) <> 'NR' THEN trim(value) END) AS human_value, min(CASE WHEN lower(trim(value)) NOT IN ('', 'none', 'null') THEN trim(value) END) AS csv_value FROM v GROUP BY value""")
def absence_predicates(cloud, human):
    v = F.col("value")
    rows = cloud.select("value").unionByName(human.select("value")).groupBy("value").agg(F.count("*").alias("n"))
    return rows.select("value", "n", N.is_null_synonym(v).alias("synonym"), N.is_absence_claim(v).alias("claim"), N.is_audit_absence(v).alias("audit_absence"), N.is_populated(v).alias("populated"), N.human_value(v).alias("human_value"), N.csv_value(v).alias("csv_value"))


NUMBERS = "CASE l_linenumber % 4 WHEN 0 THEN concat('00', cast(l_quantity AS string), ' pigs, ', cast(l_suppkey AS string)) WHEN 1 THEN concat('-', cast(l_partkey AS string), ',', cast(l_extendedprice AS string), ' mm') WHEN 2 THEN concat(l_returnflag, ' ', l_linestatus) ELSE concat(' ', cast(l_extendedprice AS string)) END"


@query("lineitem", sql=f"""WITH v AS (SELECT l_orderkey, l_linenumber, {NUMBERS} AS v, l_extendedprice AS price FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN regexp_replace(v, '[^0-9]', '', 'g') = '' THEN trim(v) ELSE regexp_replace(v, '[^0-9]', '', 'g')::HUGEINT::VARCHAR END AS digits, TRY_CAST(nullif(regexp_extract(replace(trim(v), ',', ''), '^-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS leading,
        greatest(0.0, least(1.0, price / 50000)) AS clamped, round(TRY_CAST(trim(v) AS DOUBLE), 4) AS rounded FROM v""")
def numbers_in_values(lineitem):
    """N-01 / N-02 / N-04 / F-18: numbers in texts of a row's own values."""
    rows = lineitem.select("l_orderkey", "l_linenumber", F.expr(NUMBERS).alias("v"), "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", V.digits_only(F.col("v")).alias("digits"), V.leading_number(F.col("v")).alias("leading"), X.clamp(F.col("l_extendedprice") / 50000).alias("clamped"), B.rounded(F.col("v")).alias("rounded"))


@query("human", sql="""WITH v AS (SELECT DISTINCT value, substr(value, 1, 3) AS short FROM human), o AS (SELECT ['click', 'view', 'purchase', 'login', 'logout'] AS opts)
    SELECT value, CASE WHEN len(list_filter(opts, lambda x: starts_with(lower(x), lower(short)))) = 1 THEN list_filter(opts, lambda x: starts_with(lower(x), lower(short)))[1] ELSE short END AS completed FROM v, o""")
def completed_prefixes(human):
    options = F.array(*map(F.lit, ["click", "view", "purchase", "login", "logout"]))
    return human.select("value").distinct().select("value", V.prefix_of(F.substring("value", 1, 3), options).alias("completed"))


@query("human", sql="""WITH e AS (SELECT * FROM (VALUES ('f1', 'click'), ('f1', 'view'), ('f2', 'purchase'), ('f3', 'login'), ('f3', 'logout')) AS t(field_name, enum_value)), o AS (SELECT field_name, list(enum_value) AS opts FROM e GROUP BY ALL),
    v AS (SELECT h.id, h.field_name, substr(h.value, 1, 4) AS value, opts FROM human h LEFT JOIN o ON o.field_name = h.field_name),
    n AS (SELECT *, CASE WHEN opts IS NOT NULL AND len(list_filter(opts, lambda x: starts_with(lower(x), lower(value)))) = 1 THEN list_filter(opts, lambda x: starts_with(lower(x), lower(value)))[1] ELSE value END AS new_value FROM v)
    SELECT field_name, value, new_value, count(*) AS n FROM n WHERE value <> new_value GROUP BY ALL""")
def category_changes(human):
    enums = human.sparkSession.createDataFrame([("f1", "click"), ("f1", "view"), ("f2", "purchase"), ("f3", "login"), ("f3", "logout")], "field_name string, enum_value string")
    _, changes = C.normalise_categories(human.select("id", "field_name", F.substring("value", 1, 4).alias("value")), enums)
    return R.counts(changes, "field_name", "value", "new_value")


# ---- text


@query("documents", sql=f"""WITH d AS (SELECT doc_id, text AS line FROM documents), e AS (SELECT doc_id, line, CASE WHEN doc_id % 3 = 0 THEN '<think> ' || line || chr(10) || '</think> x' WHEN doc_id % 3 = 1 THEN '```json' || chr(10) || line || chr(10) || '```' ELSE line END AS v FROM d)
    SELECT doc_id, trim(regexp_extract(v, '(?s)<think>(.*?)</think>', 1)) AS thinking, CASE WHEN doc_id % 3 = 1 THEN trim(line) ELSE trim(v) END AS bare, CASE WHEN length(v) > 40 THEN substr(v, 1, 40) || '...' ELSE v END AS short, ceil(length(v) / 4.0)::BIGINT AS n_tokens,
        coalesce(regexp_matches(v, '\\.\\.\\.|…'), false) AS bridged, regexp_replace(v || chr(7), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') = v AS controls_gone FROM e""")
def text_forms(documents):
    d = documents.select("doc_id", F.col("text").alias("line"))
    kind = F.col("doc_id") % 3
    v = F.when(kind == 0, F.concat(F.lit("<think> "), F.col("line"), F.lit("\n</think> x"))).when(kind == 1, F.concat(F.lit("```json\n"), F.col("line"), F.lit("\n```"))).otherwise(F.col("line"))
    e = d.withColumn("v", v)
    return e.select("doc_id", X.thinking(F.col("v")).alias("thinking"), X.strip_fence(F.col("v")).alias("bare"), X.shorten(F.col("v"), 40).alias("short"), X.token_estimate(F.col("v")).cast("long").alias("n_tokens"), X.has_ellipsis(F.col("v")).alias("bridged"), (X.strip_controls(F.concat("v", F.lit("\x07"))) == F.col("v")).alias("controls_gone"))


STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query("documents", sql=f"""WITH d AS (SELECT doc_id, substr(text, 1, (length(text) // 2)::BIGINT) AS a, substr(text, (length(text) // 2 + 1)::BIGINT) AS b FROM documents),
    t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z]+'), lambda x: length(x) >= 2 AND NOT list_contains({STOPS}, x))) AS x, list_distinct(list_filter(regexp_extract_all(lower(b), '[a-z]+'), lambda x: length(x) >= 2 AND NOT list_contains({STOPS}, x))) AS y FROM d),
    s AS (SELECT doc_id, len(x) AS n_a, len(y) AS n_b, len(list_intersect(x, y)) AS shared FROM t) SELECT doc_id, n_a::INTEGER AS n_a, n_b::INTEGER AS n_b, round(CASE WHEN n_a + n_b = shared THEN 1.0 ELSE shared::DOUBLE / (n_a + n_b - shared) END, 9) AS jaccard, n_a > 0 AND n_b > 0 AND shared::DOUBLE / nullif(n_a + n_b - shared, 0) >= 0.3 AS matched FROM s""")
def content_similarity(documents):
    half = F.floor(F.length("text") / 2).cast("int")
    d = documents.select("doc_id", F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("b"))
    x, y = X.content_tokens(F.col("a")), X.content_tokens(F.col("b"))
    return d.select("doc_id", F.size(x).alias("n_a"), F.size(y).alias("n_b"), F.round(X.jaccard(x, y), 9).alias("jaccard"), V.free_text_match(F.col("a"), F.col("b")).alias("matched"))


def spans_to_find(documents: DataFrame) -> DataFrame:
    kind = F.col("doc_id") % 5
    piece = lambda a, n: F.substring("text", a, n)
    span = F.when(kind == 0, piece(31, 250)).when(kind == 1, F.concat(piece(11, 85), F.lit(" zzzz"))).when(kind == 2, F.concat(piece(5, 20), F.lit(" ... "), piece(101, 70))).when(kind == 3, F.concat(F.lit("zzzzzzzzzz qqqqqqqqqq"), piece(202, 140))).otherwise("")
    return documents.select("doc_id", "text", span.alias("span"))


SPAN_PARTS = "list_filter(list_transform(regexp_split_to_array(span, '\\s*\\.\\.\\.\\s*'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 60)"


@query("documents", sql=f"""WITH d AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN substr(text, 31, 250) WHEN 1 THEN substr(text, 11, 85) || ' zzzz' WHEN 2 THEN substr(text, 5, 20) || ' ... ' || substr(text, 101, 70) WHEN 3 THEN 'zzzzzzzzzz qqqqqqqqqq' || substr(text, 202, 140) ELSE '' END AS span FROM documents),
    p AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY length(x) DESC, i) AS r FROM (SELECT doc_id, unnest({SPAN_PARTS}) AS x, generate_subscripts({SPAN_PARTS}, 1) AS i FROM d)),
    b AS (SELECT p.doc_id, first(instr(text, substr(x, 1, 60)) ORDER BY r) AS at FROM p JOIN d USING (doc_id) WHERE instr(text, substr(x, 1, 60)) > 0 GROUP BY p.doc_id),
    w AS (SELECT doc_id, first(instr(text, substr(span, s + 1, 60)) ORDER BY s) AS at FROM (SELECT doc_id, text, span, unnest(range(0, length(span) - 60, 20)) AS s FROM d WHERE length(span) > 60) WHERE instr(text, substr(span, s + 1, 60)) > 0 GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN span = '' THEN -1 ELSE coalesce(nullif(instr(text, substr(span, 1, 200)), 0), CASE WHEN length(span) >= 80 THEN nullif(instr(text, substr(span, 1, 80)), 0) END, b.at, w.at, 0) - 1 END::INTEGER AS at FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN w ON w.doc_id = d.doc_id""")
def span_places(documents):
    return spans_to_find(documents).select("doc_id", X.locate_span(F.col("text"), F.col("span")).alias("at"))


@query("documents", sql=f"""WITH d AS (SELECT doc_id, {LINE} AS title, 'About ' || doc_id AS abstract, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 900) || chr(10) || '## References' || chr(10) || text ELSE text END AS t FROM documents),
    h AS (SELECT *, CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) || chr(10) ELSE '' END || 'Abstract: ' || abstract || chr(10) || chr(10) AS header FROM d), r AS (SELECT *, 2000 - length(header) AS room, strpos(t, regexp_extract(t, '(?im)^(?:#{{1,4}}\\s+)?(?:references|bibliography|acknowledgements?)\\b')) - 1 AS refs, regexp_matches(t, '(?im)^(?:#{{1,4}}\\s+)?(?:references|bibliography|acknowledgements?)\\b') AS has FROM h),
    c AS (SELECT *, CASE WHEN has AND refs <= room THEN regexp_replace(substr(t, 1, refs), '\\s+$', '') WHEN room > 0 THEN substr(t, 1, room) ELSE '' END AS b FROM r), l AS (SELECT *, CASE WHEN contains(b, '. ') THEN length(b) - strpos(reverse(b), ' .') - 1 ELSE -1 END AS last FROM c)
    SELECT doc_id, CASE WHEN room <= 0 THEN substr(header, 1, 2000) WHEN length(t) <= room THEN header || t ELSE header || CASE WHEN last > length(b) * 0.8 THEN substr(b, 1, last + 1) ELSE b END END AS fitted FROM l""")
def fitted_texts(documents):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 900), F.lit("\n## References\n"), F.col("text"))).otherwise(F.col("text"))
    return documents.select("doc_id", X.fitted_text(t, line(), F.concat(F.lit("About "), F.col("doc_id").cast("string")), 2000).alias("fitted"))


@query("documents", sql=f"""WITH w AS (SELECT doc_id, list_filter(string_split({LINE}, ' '), lambda x: x <> '') AS w FROM documents),
    n AS (SELECT doc_id, w, trim(regexp_replace(regexp_replace(strip_accents(array_to_string(w[1:2], ' ')), '[^A-Za-z0-9\\- ]', '', 'g'), ' +', ' ', 'g')) AS plain, trim(split_part(split_part(array_to_string(w[1:2], ', ') || '; ' || array_to_string(w[3:4], ', '), ';', 1), ',', 1)) AS listed FROM w),
    s AS (SELECT *, string_split(plain, ' ') AS p FROM n), m AS (SELECT *, CASE WHEN plain = '' THEN 'Unknown' WHEN len(p) > 1 AND length(p[-1]) <= 2 THEN p[1] ELSE p[-1] END AS name FROM s)
    SELECT doc_id, name, 'EE-' || doc_id || '_' || name || '_' || CASE WHEN doc_id % 20 = 0 THEN 'XXXX' ELSE (2000 + doc_id % 20)::VARCHAR END || '.pdf' AS file, CASE WHEN listed = '' THEN '—' ELSE substr(listed, 1, 30) END AS listed_name FROM m""")
def author_names(documents):
    """X-11 / X-12: words of the title as names."""
    w = F.filter(F.split(line(), " "), lambda x: x != "")
    names = lambda i, by: F.array_join(F.slice(w, i, 2), by)
    d = documents.where("text IS NOT NULL").select("doc_id", F.to_json(F.array(names(1, " "), names(3, " "))).alias("authors"), F.concat_ws("; ", names(1, ", "), names(3, ", ")).alias("listed"), F.when(F.col("doc_id") % 20 > 0, F.lit(2000) + F.col("doc_id") % 20).otherwise(0).alias("year"))
    return d.select("doc_id", X.first_author(F.col("authors")).alias("name"), X.canonical_filename(F.concat(F.lit("EE-"), F.col("doc_id").cast("string")), F.col("authors"), F.col("year")).alias("file"), X.first_author_list(F.col("listed")).alias("listed_name"))


@query("documents", sql=f"""WITH d AS (SELECT doc_id, text, list_filter(string_split({LINE}, ' '), lambda x: x <> '') AS w, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat FROM documents WHERE text IS NOT NULL),
    e AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN substr(text, 41, 60) WHEN 1 THEN lower(substr(text, 41, 60)) WHEN 2 THEN array_to_string(list_reverse(w), ' ') ELSE array_to_string(w, ' ') || ' qqqqzz xxxxzz' END AS snippet FROM d),
    t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(snippet), '\\s+'), lambda x: x <> '')) AS own, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS held FROM e)
    SELECT doc_id, CASE WHEN contains(text, snippet) THEN 'exact' WHEN contains(flat, lower(trim(regexp_replace(snippet, '\\s+', ' ', 'g')))) THEN 'normalized' WHEN len(list_intersect(own, held))::DOUBLE / greatest(len(own), 1) >= 0.8 THEN 'token_overlap' ELSE 'none' END AS found,
        CASE WHEN strpos(text, snippet) > 0 THEN substr(text, greatest(strpos(text, snippet) - 201, 0) + 1, length(snippet) + 400) END AS around FROM t""")
def snippet_kinds(documents):
    """X-16 / X-17 / X-22: pieces of a text, its title backwards and with words of no text, and what stands around them."""
    s, w = F.substring("text", 41, 60), F.filter(F.split(line(), " "), lambda x: x != "")
    snippet = F.when(F.col("doc_id") % 4 == 0, s).when(F.col("doc_id") % 4 == 1, F.lower(s)).when(F.col("doc_id") % 4 == 2, F.array_join(F.reverse(w), " ")).otherwise(F.concat(F.array_join(w, " "), F.lit(" qqqqzz xxxxzz")))
    d = documents.where("text IS NOT NULL").select("doc_id", "text", snippet.alias("snippet"))
    return d.select("doc_id", X.snippet_match(F.col("text"), F.col("snippet")).alias("found"), X.context(F.col("text"), F.expr("instr(text, snippet) - 1"), F.length("snippet")).alias("around"))


@query("papers", sql="""SELECT id, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi END AS doi_link, CASE WHEN pmid IS NOT NULL THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid END AS pmid_link, 1 + (doi IS NOT NULL)::INT + (pmid IS NOT NULL)::INT AS n_links,
    concat_ws('; ', CASE WHEN id % 2 = 0 THEN 'Non-English: German' END, CASE WHEN id % 3 = 0 THEN 'Content type: Meeting Abstract' END) AS flag, id % 2 = 0 OR id % 3 = 0 AS flagged FROM papers""")
def links_and_flags(papers):
    language, kind = F.when(F.col("id") % 2 == 0, "German").otherwise("English"), F.when(F.col("id") % 3 == 0, "meeting_abstract").otherwise("full_manuscript")
    made = X.links(F.col("doi"), F.col("pmid"), F.col("title"))
    url = lambda k: F.get(F.filter("links", lambda x: x["kind"] == k), F.lit(0))["url"]
    rows = papers.select("id", made.alias("links"), language.alias("language"), kind.alias("content_type"))
    marked = Q.quality_flagged(rows).select("id", F.lit(True).alias("flagged"))
    return rows.join(marked, "id", "left").select("id", url("doi").alias("doi_link"), url("pubmed").alias("pmid_link"), F.size("links").alias("n_links"), X.flag_reason(F.col("language"), F.col("content_type")).alias("flag"), F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("documents", sql=f"SELECT doc_id, 'Paper ' || doc_id || ' in ' || coalesce(nullif(lang, 'xx'), '(not available)') || ': ' || coalesce(text, '(not available)') || '.' AS prompt, CASE WHEN lang = 'en' THEN 300 WHEN lang = 'de' THEN 900 ELSE 600 END::INTEGER AS time_limit, upper(left(lang, 1)) AS extractor FROM documents WHERE length(lang) > 0")
def prompts(documents):
    """X-23, H-26, H-31."""
    documents = documents.where("length(lang) > 0")
    path = F.concat(F.lit("imports/review_of_"), F.col("lang"), F.lit("_"), F.substring("lang", 1, 1), F.lit(".xlsx"))
    return documents.select("doc_id", X.prompt("Paper {id} in {lang}: {text}.", id=F.col("doc_id"), lang=F.col("lang"), text=F.col("text")).alias("prompt"), Q.limit_for(F.col("lang"), [("^en$", 300), ("^de$", 900)]).alias("time_limit"), Q.extractor_of(path).alias("extractor"))


@query("documents", sql="""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), e AS (SELECT doc_id, text, n, unnest([n // 5, n // 4, n // 2, n - 1]) AS a FROM d),
    i AS (SELECT doc_id, text, greatest(a - 60, 0) AS s, least(a + 60, n) AS e FROM e), m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i))
    SELECT doc_id, string_agg(substr(text, s::BIGINT + 1, (e - s)::BIGINT), chr(10) || '[...]' || chr(10) ORDER BY s) AS windows FROM (SELECT doc_id, text, g, min(s) AS s, max(e) AS e FROM m GROUP BY ALL) GROUP BY doc_id""")
def merged_windows(documents):
    """X-14 by characters: windows around four places of every text."""
    n = F.length("text")
    at = F.array(*[F.floor(x).cast("int") for x in (n / 5, n / 4, n / 2)], n - 1)
    return documents.where(n > 0).select("doc_id", X.windows_around(F.col("text"), at, 60).alias("windows"))


# ---- sources and ragged payloads


@query("documents", sql="SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') AS abstract FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0")
def inverted_abstracts(documents):
    """SRC-08: the words of a text to an inverted index and back."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    rows = documents.where(F.size(words) > 0).select("doc_id", readers.inverted_index(words).alias("index"))
    return rows.select("doc_id", readers.inverted_abstract(F.col("index")).alias("abstract"))


@query("papers", sql="SELECT CASE WHEN pmid IS NULL THEN '' ELSE pmid END AS pmid, lower(doi) AS doi, title, CASE WHEN year % 4 = 0 THEN NULL ELSE year END::INTEGER AS year, 'A ' || id AS first_author FROM papers")
def work_records(papers):
    """SRC-07."""
    r = F.struct(
        F.struct(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.coalesce("pmid", F.lit("none"))).alias("pmid")).alias("ids"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), "title",
        F.create_map(F.lit("a"), F.array(F.lit(0))).alias("abstract_inverted_index"), F.when(F.col("year") % 4 != 0, F.col("year").cast("string")).alias("publication_year"),
        F.array(F.struct(F.struct(F.concat(F.lit("A "), F.col("id").cast("string")).alias("display_name")).alias("author"))).alias("authorships"))
    return readers.works(papers.select(r.alias("r"))).select("pmid", "doi", "title", "year", F.col("authors")[0].alias("first_author"))


@query("papers", sql="SELECT pmid, doi, title, year::INTEGER AS year, 'J ' || id AS journal FROM papers")
def medline_records(papers):
    """SRC-05."""
    aid = F.filter(F.array(F.lit("S0001 [pii]"), F.concat("doi", F.lit(" [doi]"))), lambda x: x.isNotNull())
    r = F.struct("pmid", aid.alias("aid"), F.col("title").alias("ti"), F.lit("ab").alias("ab"), F.concat(F.lit("J "), F.col("id").cast("string")).alias("jt"), F.concat(F.col("year").cast("string"), F.lit(" Jan")).alias("dp"), F.array(F.lit("A B")).alias("au"))
    return readers.medline(papers.select(r.alias("r"))).select("pmid", "doi", "title", "year", "journal")


@query("pages", sql="SELECT regexp_extract(url, '^http[s]?://([^/]+)/', 1) AS host, regexp_extract(url, '^http[s]?://[^/]+/([a-z]+)/', 1) AS lang, count(*) AS n FROM pages WHERE regexp_matches(url, '^http[s]?://([^/]+)/([a-z]+)/') GROUP BY ALL")
def log_groups(pages):
    """SRC-21: named groups of a pattern."""
    return R.counts(readers.read_log(pages.select(F.col("url").alias("value")), "^http[s]?://([^/]+)/([a-z]+)/", ["host", "lang"]), "host", "lang")


@query("orders", sql="SELECT o_custkey AS paper_id, max_by(o_orderstatus, o_orderkey) AS text FROM orders GROUP BY ALL")
def newest_texts(orders):
    """SRC-17."""
    return readers.newest_text(orders.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("text"))).select("paper_id", "text")


@query("lineitem", sql="SELECT l_orderkey AS id, first('s' || l_suppkey % 5 ORDER BY l_linenumber, l_partkey) AS strategy, first(l_partkey ORDER BY l_linenumber, l_partkey) AS result FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL")
def first_successes(lineitem):
    """SRC-24."""
    ordinal = F.struct("l_linenumber", "l_partkey")
    return readers.first_success(lineitem.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("strategy"), ordinal.alias("ordinal"), (F.col("l_returnflag") == "N").alias("ok"), F.col("l_partkey").alias("result")))


@query("papers", sql="SELECT p.id, p.doi, l.answer FROM papers p LEFT JOIN (SELECT doi, min(source) AS answer FROM papers WHERE doi IS NOT NULL AND id % 2 = 0 GROUP BY doi) l ON l.doi = p.doi WHERE p.id % 5 <> 0")
def lookups(papers):
    """SRC-22 / SRC-26: only rows without a known answer are looked up."""
    found = papers.where("doi IS NOT NULL AND id % 2 = 0").groupBy("doi").agg(F.min("source").alias("answer"))
    return readers.unchecked(papers.select("id", "doi"), papers.where("id % 5 = 0"), found).select("id", "doi", "answer")


@query("events", sql="""WITH w AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS f1, CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN props END AS f2 FROM events)
    SELECT event_id, 'f1' AS field_name, f1 AS correction FROM w WHERE trim(coalesce(f1, '')) <> '' UNION ALL SELECT event_id, 'f2', f2 FROM w WHERE trim(coalesce(f2, '')) <> ''""")
def long_corrections(events):
    """SRC-28 / SNK-08, by headers found like SRC-27."""
    wide = events.select(F.col("event_id").alias("The Event ID"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("f1_correction"), F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, F.col("props")).alias("f2_correction"))
    named = readers.rename_headers(wide, {"event_id": ["identifier", "event id"], "f1_correction": ["f1"], "f2_correction": ["f2_corr"]})
    return I.wide_to_long(named, "event_id")


@query("papers", sql="SELECT status, count(*) AS n FROM papers WHERE status IN ('PARSED', 'EXTRACTED', 'REJECTED') GROUP BY ALL")
def papers_by_status(papers):
    return R.counts(readers.by_status(papers, "PARSED", "EXTRACTED", "REJECTED"), "status")


@query("papers", sql="SELECT p.id, 'EE-' || lpad((p.id % 1200)::VARCHAR, greatest(3, length((p.id % 1200)::VARCHAR))::INTEGER, '0') || '_Smith_2020.pdf' AS file, q.title FROM papers p LEFT JOIN papers q ON q.id = p.id % 1200")
def files_of_papers(papers):
    """J-25."""
    files = papers.select(F.col("id").alias("no"), F.format_string("EE-%03d_Smith_2020.pdf", F.col("id") % 1200).alias("path"))
    return readers.file_papers(files, papers.select("id", "title")).select(F.col("no").alias("id"), F.col("path").alias("file"), "title")


@query("events", sql="""SELECT event_id, event_type AS field_name, CASE WHEN event_id % 4 = 0 THEN 'NR' ELSE value::VARCHAR END AS value, event_id % 4 <> 0 AS populated FROM events WHERE event_id % 5 <> 4""")
def response_fields(events):
    """JS-01 / A-38: spans of ragged payloads by shape, and which are populated."""
    value = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("value").cast("string"))
    one = F.to_json(F.struct(F.col("event_type").alias("field_name"), value.alias("value")))
    shape = F.col("event_id") % 5
    text = F.when(shape == 0, F.concat(F.lit('{"results": ['), one, F.lit("]}"))).when(shape == 1, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(shape == 2, F.concat(F.lit('{"evidence_spans":['), one, F.lit("]}"))).when(shape == 3, one).otherwise("broken {")
    found = responses.spans(events.select("event_id", text.alias("response"))).where("field_name IS NOT NULL")
    return found.select("event_id", "field_name", "value", N.is_populated(F.col("value")).alias("populated"))


@query("events", sql="SELECT event_type AS field_name, min_by(event_id % 4 + 1, event_id)::INTEGER AS tier FROM events WHERE event_id % 3 <> 0 GROUP BY ALL")
def first_tiers(events):
    """JS-02."""
    rows = events.select(F.col("event_type").alias("field_name"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 4 + 1).cast("int")).alias("tier"), F.col("event_id").alias("ordinal"))
    return responses.tiers(rows)


@query("papers", sql="SELECT a.id, coalesce(a.doi, b.doi) AS doi, coalesce(a.pmid, b.pmid) AS pmid, a.title FROM papers a LEFT JOIN (SELECT id // 2 * 2 AS a_ord, min_by(doi, id) AS doi, min_by(pmid, id) AS pmid FROM (SELECT id, coalesce(doi, '') AS doi, coalesce(pmid, '') AS pmid FROM papers WHERE id % 2 = 1) GROUP BY ALL) b ON b.a_ord = a.id WHERE a.id % 2 = 0")
def merged_records(papers):
    """JS-06: only nulls are filled."""
    a = papers.where("id % 2 = 0").select(F.col("id").alias("ord"), "doi", "pmid", "title")
    b = papers.where("id % 2 = 1").select(F.col("id").alias("ord"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("pmid", F.lit("")).alias("pmid"), "title", F.expr("id div 2 * 2").alias("a_ord"))
    return E.merge(a, b, ["doi", "pmid", "title"]).withColumnRenamed("ord", "id")


@query("papers", sql="SELECT coalesce(nullif(doi, ''), nullif(pmid, ''), title) AS stable, count(*) AS n FROM papers GROUP BY ALL")
def stable_keys(papers):
    """SC-02."""
    return R.counts(papers.select(E.stable_key(F.col("doi"), F.col("pmid"), F.col("title")).alias("stable")), "stable")


@query("papers", sql="WITH k AS (SELECT * FROM papers WHERE id % 3 = 0), i AS (SELECT * FROM papers WHERE id % 3 <> 0) SELECT id FROM i WHERE doi IS NULL UNION ALL SELECT min(id) FROM i WHERE doi IS NOT NULL AND doi NOT IN (SELECT doi FROM k WHERE doi IS NOT NULL) GROUP BY doi")
def new_citations(papers):
    """SNK-01: rows with a known key are skipped, of a new key the first comes in."""
    return E.add_new(papers.where("id % 3 = 0").select("id", "doi"), papers.where("id % 3 <> 0").select("id", "doi"), "doi", "id").select("id")


@query("papers", sql="SELECT id, CASE WHEN id % 4 = 1 THEN 'r' || (id % 7) ELSE 'not attempted' END AS reason FROM papers WHERE id % 3 <> 0")
def missing_files(papers):
    """SC-07."""
    log = papers.where("id % 4 = 1").select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("old").alias("reason")), F.struct(F.lit(2).alias("seq"), F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("reason")))).alias("l")).select("id", "l.*")
    return E.missing(papers.select("id"), papers.where("id % 3 = 0").select("id"), log)


@query("papers", sql="SELECT id, CASE WHEN pmid IS NOT NULL THEN 'pmid' ELSE 'doi' END AS fill FROM papers WHERE status IN ('EXTRACTED', 'INGESTED') AND id % 4 < 2 AND (pmid IS NOT NULL OR doi IS NOT NULL)")
def papers_without_authors(papers):
    """SC-05."""
    rows = papers.withColumn("authors", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).when(F.col("id") % 4 > 1, F.array(F.lit("A"))))
    pmid, doi = B.without_authors(rows, ["EXTRACTED", "INGESTED"])
    return pmid.select("id", F.lit("pmid").alias("fill")).union(doi.select("id", F.lit("doi").alias("fill")))


# ---- joins and queues


@query("papers", "human", sql="SELECT p.id, p.status, d.value AS decision, v.value AS verifier FROM papers p LEFT JOIN (SELECT paper_id, max_by(value, id) AS value FROM human WHERE extractor = 'A' GROUP BY ALL) d ON d.paper_id = p.id LEFT JOIN (SELECT paper_id, max_by(value, id) AS value FROM human WHERE extractor = 'B' GROUP BY ALL) v ON v.paper_id = p.id WHERE p.status = 'ABSTRACT_SCREEN_FLAGGED'")
def flagged_with_decisions(papers, human):
    """J-22."""
    said = lambda e: human.where(F.col("extractor") == e).select("id", "paper_id", F.lit(1).alias("pass"), F.col("value").alias("decision"), F.col("snippet").alias("rationale"))
    return Q.flagged_papers(papers, said("A"), said("B"), "ABSTRACT_SCREEN_FLAGGED").select("id", "status", "decision", "verifier")


@query("papers", "orders", sql="SELECT p.id, coalesce(a.path, 'own/' || p.id) AS effective_path FROM papers p LEFT JOIN (SELECT o_custkey AS paper_id, max_by('asset/' || o_orderkey, o_orderkey) AS path FROM orders GROUP BY ALL) a ON a.paper_id = p.id")
def effective_paths(papers, orders):
    """F-14 / J-10."""
    assets = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id"), F.concat(F.lit("asset/"), F.col("o_orderkey").cast("string")).alias("path"))
    return Q.effective_path(papers.select("id", F.concat(F.lit("own/"), F.col("id").cast("string")).alias("pdf_path")), assets).select("id", "effective_path")


@query("pages", sql="SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'abstract_only' ELSE 'other' END AS content_type, CASE WHEN regexp_extract(url, '/([a-z]{2})/', 1) IN ('en', 'fr') THEN regexp_extract(url, '/([a-z]{2})/', 1) ELSE 'other' END AS language, greatest(0.0, least(1.0, CASE WHEN page_id % 4 = 0 THEN 0.0 ELSE (page_id % 5 - 1) / 2.0 END)) AS confidence FROM pages")
def page_classes(pages):
    """F-17 / F-18."""
    rows = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "abstract_only").otherwise("strange").alias("content_type"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("language"), F.when(F.col("page_id") % 4 != 0, (F.col("page_id") % 5 - 1) / 2.0).alias("confidence"))
    return Q.page_class(rows, ["abstract_only", "full_manuscript"], ["en", "fr"])


@query("human", "papers", sql="SELECT DISTINCT p.id, p.title FROM human h JOIN papers p ON p.id = h.paper_id WHERE contains(h.snippet, '\"k\": 1')")
def marked_titles(human, papers):
    """F-11."""
    return B.marked_titles(human.select("paper_id", F.col("snippet").alias("rationale")), papers, '"k": 1')


@query("spans", "extractions", "papers", sql="SELECT p.status, count(*) AS n_spans, count(DISTINCT e.paper_id) AS n_papers FROM spans s JOIN extractions e ON e.id = s.extraction_id JOIN papers p ON p.id = e.paper_id GROUP BY ALL")
def spans_by_paper_status(spans, extractions, papers):
    """J-02."""
    return B.paper_spans(spans, extractions, papers).groupBy("status").agg(F.count("*").alias("n_spans"), F.count_distinct("paper_id").alias("n_papers"))


@query("spans", "extractions", "papers", sql="SELECT field_name, count(*) AS n FROM spans WHERE extraction_id IN (SELECT id FROM extractions WHERE paper_id IN (SELECT id FROM papers WHERE status = 'EXTRACT_FAILED')) GROUP BY ALL")
def spans_to_remove(spans, extractions, papers):
    """J-09."""
    return R.counts(B.children_of(spans, extractions, papers.where("status = 'EXTRACT_FAILED'")), "field_name")


@query("verdicts", "ratings", sql="WITH t AS (SELECT paper_id, field_name, min(field_type) AS kind FROM ratings GROUP BY ALL) SELECT kind, v.verdict, count(*) AS n FROM verdicts v JOIN t ON t.paper_id = v.paper_id AND t.field_name = v.field_name GROUP BY ALL")
def verdicts_by_rated_type(verdicts, ratings):
    """J-17 / H-05."""
    return R.counts(Q.with_verdict_type(verdicts.drop("field_type"), ratings).withColumnRenamed("field_type", "kind"), "kind", "verdict")


@query("ratings", "spans", sql="WITH f AS (SELECT extraction_id AS paper_id, field_name, bool_or(audit_status = 'flagged') AS flag FROM spans WHERE flag <> 'R' GROUP BY ALL) SELECT r.risk, count(*) AS n, count(*) FILTER (coalesce(f.flag, false)) AS flagged FROM ratings r LEFT JOIN f ON f.paper_id = r.paper_id AND f.field_name = r.field_name GROUP BY ALL")
def flagged_ratings(ratings, spans):
    """J-21."""
    flags = spans.where("flag <> 'R'").groupBy(F.col("extraction_id").alias("paper_id"), "field_name").agg(F.bool_or(F.col("audit_status") == "flagged").alias("flag"))
    return Q.with_flags(ratings, flags).groupBy("risk").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))


SPAN_ROWS = "sp AS (SELECT e.paper_id, s.field_name, s.audit_status, s.flag AS value FROM spans s JOIN extractions e ON e.id = s.extraction_id)"


def span_rows(spans: DataFrame, extractions: DataFrame) -> DataFrame:
    return spans.join(extractions.select(F.col("id").alias("extraction_id"), "paper_id"), "extraction_id").select("paper_id", "field_name", "audit_status", F.col("flag").alias("value"))


@query("spans", "extractions", "human", sql=f"WITH {SPAN_ROWS} SELECT count(DISTINCT paper_id) AS n FROM sp WHERE audit_status <> 'verified' AND NOT EXISTS (SELECT 1 FROM human h WHERE h.paper_id = sp.paper_id AND h.field_name = sp.field_name)")
def unresolved_papers(spans, extractions, human):
    """A-42 / H-14."""
    return Q.unresolved(span_rows(spans, extractions), human.select("paper_id", "field_name").distinct())


@query("spans", "extractions", sql=f"WITH {SPAN_ROWS}, r AS (SELECT *, CASE audit_status WHEN 'flagged' THEN 2 WHEN 'contested' THEN 3 WHEN 'verified' THEN 5 ELSE 99 END AS r FROM sp) SELECT paper_id, count(*) AS n, first(audit_status ORDER BY r, field_name, value) AS worst, first(field_name ORDER BY r, field_name, value) AS worst_field FROM r GROUP BY ALL")
def paper_span_documents(spans, extractions):
    """A-40."""
    docs = Q.paper_documents(span_rows(spans, extractions))
    return docs.select("paper_id", F.size("spans").cast("long").alias("n"), F.col("spans")[0]["audit_status"].alias("worst"), F.col("spans")[0]["field_name"].alias("worst_field"))


@query("spans", "extractions", sql=f"WITH {SPAN_ROWS} SELECT paper_id, field_name, audit_status, CASE field_name WHEN 'f1' THEN 1 WHEN 'f2' THEN 1 WHEN 'f3' THEN 2 ELSE 99 END::INTEGER AS tier FROM sp WHERE audit_status <> 'verified' ORDER BY CASE audit_status WHEN 'flagged' THEN 2 ELSE 3 END, tier, field_name, paper_id LIMIT 200")
def review_queue_head(spans, extractions):
    """C-17 / T-04 / T-05: the first 200 of the queue."""
    tiers = spans.sparkSession.createDataFrame([("f1", 1), ("f2", 1), ("f3", 2)], "field_name string, tier int")
    return Q.review_queue(span_rows(spans, extractions), tiers).limit(200).select("paper_id", "field_name", "audit_status", "tier")


@query("papers", sql="SELECT coalesce(nullif(pdf_exclusion_reason, ''), 'unknown') AS reason, count(*) AS n FROM papers GROUP BY ALL")
def reason_counts(papers):
    """A-43 / A-47 / A-48."""
    return Q.queue_counts(papers.select(F.col("pdf_exclusion_reason").alias("reason")), "reason")


@query("spans", sql="""WITH c AS (SELECT extraction_id, CASE WHEN bool_or(audit_status = 'flagged') THEN 'flagged' WHEN bool_or(audit_status = 'contested') THEN 'contested' ELSE 'verified' END AS worst FROM spans GROUP BY ALL)
    SELECT extraction_id % 4 AS section, count(*) AS n, count(*) FILTER (worst = 'invalid_snippet') AS invalid_snippet, count(*) FILTER (worst = 'flagged') AS flagged, count(*) FILTER (worst = 'contested') AS contested, count(*) FILTER (worst = 'pending') AS pending, count(*) FILTER (worst = 'verified') AS verified FROM c GROUP BY ALL""")
def queue_sections(spans):
    """A-49 / A-50 / A-51."""
    return Q.queue_summary(R.worst_state(spans).withColumn("section", F.col("extraction_id") % 4), "section")


@query("runs", sql="SELECT run_id, count(*) AS attempted, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, true AND count(*) FILTER (NOT failed) + count(*) FILTER (failed) = count(*) AS valid, sum(seconds)::DOUBLE / nullif(count(*) FILTER (NOT failed), 0) > 0 AS timed FROM runs GROUP BY ALL")
def run_counters(runs):
    """A-45 / SNK-06."""
    out = Q.run_summary(runs.select("run_id", (~F.col("failed")).alias("ok"), "seconds"))
    return out.join(runs.groupBy("run_id").agg((F.sum("seconds") > 0).alias("timed")), "run_id")


@query("runs", sql="SELECT run_id, max(item) - min(item) AS seconds, round(CASE WHEN count(*) FILTER (NOT failed) = 0 THEN 0 ELSE (max(item) - min(item)) / (count(*) FILTER (NOT failed)) END, 9) AS per_success FROM runs GROUP BY ALL")
def run_durations(runs):
    """A-55."""
    r = runs.groupBy("run_id").agg(F.timestamp_seconds(F.min("item")).alias("started_at"), F.timestamp_seconds(F.max("item")).alias("ended_at"), F.count_if(~F.col("failed")).alias("succeeded"))
    return R.duration(r).select("run_id", "seconds", F.round("per_success", 9).alias("per_success"))


@query("runs", sql="SELECT item, failed, row_number() OVER (ORDER BY item) AS seen, sum(failed::BIGINT) OVER w::BIGINT AS failures, round(sum(seconds) OVER w / row_number() OVER (ORDER BY item), 4) AS mean, round(100.0 * row_number() OVER (ORDER BY item) / 20000, 6) AS percent, round(sum(seconds) OVER w / row_number() OVER (ORDER BY item) * (20000 - row_number() OVER (ORDER BY item)) / 1000, 2) AS to_go FROM runs WINDOW w AS (ORDER BY item ROWS UNBOUNDED PRECEDING)")
def running_progress(runs):
    """W-06."""
    out = A.progress(runs.select("item", "failed", "seconds"), "item", F.col("seconds"), F.col("failed"), 20000)
    return out.select("item", "failed", "seen", "failures", F.round("mean", 4).alias("mean"), F.round("percent", 6).alias("percent"), F.round(F.col("to_go") / 1000, 2).alias("to_go"))


@query("runs", sql="""WITH r AS (SELECT item, row_number() OVER w AS seen, sum(failed::BIGINT) OVER w AS failures, sum(seconds) OVER w AS spent FROM runs WINDOW w AS (ORDER BY item ROWS UNBOUNDED PRECEDING)), c AS (SELECT item, seen, failures / seen AS rate, (spent + spent / seen * (20000 - seen)) / 3600 AS hours FROM r WHERE seen % 100 = 0)
    SELECT item, seen, round(rate, 9) AS failure_rate, round(hours, 3) AS hours, CASE WHEN rate > 0.059 THEN 'failure rate' WHEN hours > 800 THEN 'projected hours' END AS abort FROM c""")
def abort_projection(runs):
    """W-07."""
    out = A.checkpoints(runs.select("item", "failed", "seconds"), "item", F.col("seconds"), F.col("failed"), 20000, 100, 0.059, 800.0)
    return out.select("item", "seen", F.round("failure_rate", 9).alias("failure_rate"), F.round("hours", 3).alias("hours"), "abort")


@query("papers", "runs", sql="SELECT (SELECT count(*) FROM papers) AS n, count(DISTINCT item % 900) AS done, sum(item)::BIGINT AS input_tokens, sum(run_id)::BIGINT AS output_tokens, (SELECT count(*) FROM papers) - count(DISTINCT item % 900) AS remaining, round(sum(item) / 1e6 * 2.5 + sum(run_id) / 1e6 * 10, 6) AS cost FROM runs")
def token_costs(papers, runs):
    """A-09 / A-10."""
    return Q.progress(papers, runs.select((F.col("item") % 900).alias("paper_id"), F.col("item").alias("input_tokens"), F.col("run_id").alias("output_tokens")), 2.5, 10.0)


@query("runs", sql="SELECT count(*) AS n, round(count(*) * 45.75 / 3600, 2) AS hours FROM runs WHERE NOT failed")
def work_hours(runs):
    """A-26."""
    return B.workload(runs.where("NOT failed"), 45.75)


@query("runs", sql="WITH w AS (SELECT run_id, max(verdict) FILTER (model = '1-URGENT') AS a, max(verdict) FILTER (model = '2-HIGH') AS b, max(verdict) FILTER (model = '5-LOW') AS c FROM runs GROUP BY ALL) SELECT '1-URGENT' AS model_a, '2-HIGH' AS model_b, round(avg((a = b)::INT), 6) AS agreement FROM w UNION ALL SELECT '1-URGENT', '5-LOW', round(avg((a = c)::INT), 6) FROM w UNION ALL SELECT '2-HIGH', '5-LOW', round(avg((b = c)::INT), 6) FROM w")
def model_agreements(runs):
    """A-37."""
    return Q.model_agreement(runs, "run_id", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("verdicts", sql="WITH t AS (SELECT * FROM (VALUES ('SUPPORTED', 'local', 10), ('UNSUPPORTED', 'openai', 1000000), ('NONE', 'local', 3)) AS t(verdict, arm, want)), h AS (SELECT verdict, arm, count(*) AS have FROM verdicts GROUP BY ALL) SELECT t.verdict, t.arm, want, coalesce(have, 0) AS have, greatest(want - coalesce(have, 0), 0) AS short FROM t LEFT JOIN h ON h.verdict = t.verdict AND h.arm = t.arm")
def sampling_targets(verdicts):
    """A-31."""
    targets = verdicts.sparkSession.createDataFrame([("SUPPORTED", "local", 10), ("UNSUPPORTED", "openai", 1000000), ("NONE", "local", 3)], "verdict string, arm string, want int")
    return Q.feasibility(verdicts, targets)


@query("verdicts", sql="SELECT arm, windowed, count(*) AS n, count(*) FILTER (verdict = 'SUPPORTED') AS \"SUPPORTED\", count(*) FILTER (verdict = 'PARTIALLY_SUPPORTED') AS \"PARTIALLY_SUPPORTED\", count(*) FILTER (verdict = 'UNSUPPORTED') AS \"UNSUPPORTED\", round(avg(short_circuit::INT), 6) AS short_circuit_rate FROM verdicts GROUP BY ALL")
def verdicts_by_path(verdicts):
    """A-29 / A-30."""
    return B.path_table(verdicts)


@query("part", "orders", sql="SELECT count(*) AS n, round(sum(p_retailprice), 4) AS gb, sum(p_retailprice) <= 500.0 AS fits FROM part WHERE p_brand IN (SELECT DISTINCT 'Brand#' || (o_custkey % 20) FROM orders) OR split_part(p_brand || ':' || p_size, ':', 1) = 'Brand#13'")
def model_budget(part, orders):
    """A-56: wanted by name, or by the name before a tag."""
    available = part.select(F.when(F.col("p_brand") == "Brand#13", F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand")).alias("name"), F.col("p_retailprice").alias("gb"))
    wanted = orders.select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 20).cast("string")).alias("name")).union(orders.sparkSession.createDataFrame([("Brand#13",)], "name string"))
    return Q.budget_check(available=available, wanted=wanted, limit=500.0).withColumn("gb", F.round("gb", 4))


@query("events", sql=f"WITH w AS (SELECT event_type AS f1, CASE WHEN event_id % 3 = 0 THEN 'NR' ELSE props END AS f2, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ' n/a ' END AS f3 FROM events) SELECT 'f1' AS field_name, count(*) AS filled, round(1.0::DOUBLE, 9) AS share FROM w UNION ALL SELECT 'f2', count(*) FILTER (f2 <> 'NR'), round(count(*) FILTER (f2 <> 'NR') / count(*), 9) FROM w UNION ALL SELECT 'f3', 0, 0.0 FROM w LIMIT 3")
def import_coverage(events):
    """A-53."""
    rows = events.select(F.col("event_type").alias("f1"), F.when(F.col("event_id") % 3 == 0, "NR").otherwise(F.col("props")).alias("f2"), F.when(F.col("event_id") % 7 != 0, " n/a ").alias("f3"))
    return Q.coverage(rows, ["f1", "f2", "f3"]).withColumn("share", F.round("share", 9))


@query("ratings", "verdicts", sql="WITH w AS (SELECT paper_id, field_name, CASE WHEN min(risk) = 'low' THEN 'a' END AS local, CASE WHEN max(risk) = 'medium' THEN 'b' END AS openai, max(level2) AS anthropic FROM ratings GROUP BY ALL), l AS (SELECT paper_id, field_name, unnest(['local', 'openai', 'anthropic']) AS arm, unnest([local, openai, anthropic]) AS value FROM w) SELECT l.paper_id, l.field_name, arm, value, n_arms FROM l JOIN (SELECT paper_id, field_name, count(value) AS n_arms FROM l GROUP BY ALL HAVING count(value) >= 2) USING (paper_id, field_name) WHERE value IS NOT NULL")
def judge_arms(ratings, verdicts):
    """C-18 / H-21."""
    w = ratings.groupBy("paper_id", "field_name").agg(F.when(F.min("risk") == "low", "a").alias("local"), F.when(F.max("risk") == "medium", "b").alias("openai"), F.max("level2").alias("anthropic"))
    return Q.judge_inputs(w, ["local", "openai", "anthropic"])


@query("documents", sql="WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 500 END AS place FROM documents) SELECT doc_id, CASE WHEN length(text) <= 800 THEN 'whole' WHEN place >= 0 THEN 'window' ELSE 'head' END AS strategy, CASE WHEN length(text) <= 800 THEN text WHEN place >= 0 THEN substr(text, greatest(place - 400, 0) + 1, 800) ELSE substr(text, 1, 600) END AS \"window\" FROM d")
def source_windows(documents):
    """C-19 / H-08."""
    rows = documents.select("doc_id", F.col("text").alias("source_text"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise((F.col("doc_id") % 500).cast("int")).alias("at"))
    return Q.source_windows(rows, 800, 600).select("doc_id", "strategy", "window")


@query("papers", "events", sql="WITH e AS (SELECT max_by(event_type, event_id) AS event_type, user_id AS id FROM events GROUP BY user_id) SELECT id, CASE WHEN event_type = 'click' THEN 'ABSTRACT_SCREENED_IN' ELSE 'ABSTRACT_SCREENED_OUT' END AS status FROM e WHERE id NOT IN (SELECT id FROM papers WHERE id % 2 = 0)")
def backfilled_papers(papers, events):
    """C-20 / H-18: of rows with one key the last wins."""
    rows = events.select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), "event_type")
    return Q.backfill(papers.where("id % 2 = 0").select("id"), rows, "id", F.when(F.col("event_type") == "click", "ABSTRACT_SCREENED_IN").otherwise("ABSTRACT_SCREENED_OUT")).select("id", "status")


@query("human", sql="WITH h AS (SELECT CASE WHEN id % 5 = 0 THEN 'field_' || (id % 3) WHEN id % 5 = 1 THEN ' ' ELSE field_name END AS field_name FROM human) SELECT field_name, CASE WHEN regexp_matches(field_name, '^field_\\d+$') THEN 'unnamed column' WHEN trim(field_name) = '' THEN 'empty name' ELSE 'unknown field' END AS cause, count(*) AS n FROM h WHERE field_name NOT IN ('f1', 'f2', 'f3', 'f4') GROUP BY ALL")
def stray_fields(human):
    """C-22."""
    rows = human.select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("field_"), (F.col("id") % 3).cast("string"))).when(F.col("id") % 5 == 1, " ").otherwise(F.col("field_name")).alias("field_name"))
    return R.counts(Q.stray_field(rows, ["f1", "f2", "f3", "f4"]), "field_name", "cause")


@query("human", sql="SELECT extractor, count(*) AS n FROM human WHERE contains(lower(extractor || chr(31) || value || chr(31) || snippet), 'purchase') OR contains(lower(extractor || chr(31) || value || chr(31) || snippet), '\"k\": 7') GROUP BY ALL")
def blinding_leaks(human):
    """C-24."""
    return R.counts(S.leaks(human, ["extractor", "value", "snippet"], ["PURCHASE", '"k": 7']), "extractor")


@query("verdicts", sql="SELECT arm, verdict, count(*) AS n, round(avg((paper_id % 3 > 0)::INT), 6) AS precision FROM verdicts GROUP BY ALL")
def unblinded_precision(verdicts):
    """C-25."""
    rows = verdicts.withColumn("blind_id", F.concat_ws("/", "paper_id", "no"))
    return S.precision(rows.select("blind_id", (F.col("paper_id") % 3 > 0).alias("correct")), rows.select("blind_id", "arm", "verdict"), "blind_id", ["arm", "verdict"])


@query("papers", sql="""WITH n AS (SELECT id, year, string_split(trim(regexp_replace(title, '[^\\p{L} ]', '', 'g')), ' ') AS words FROM papers)
    SELECT id, CASE WHEN id % 4 = 3 OR words[-1] = '' THEN id::VARCHAR ELSE words[-1] || ' ' || year END AS label FROM n""")
def paper_short_labels(papers):
    """H-10: authors as a JSON array, a `;` list, an empty array or nothing; the names are the words of the titles."""
    name = F.trim(F.regexp_replace("title", r"[^\p{L} ]", ""))
    authors = F.when(F.col("id") % 4 == 0, F.to_json(F.array(name, F.lit("Other C")))).when(F.col("id") % 4 == 1, F.concat(name, F.lit("; Other C"))).when(F.col("id") % 4 == 2, name).when(F.col("id") % 8 == 3, "[]")
    return papers.select("id", Q.paper_label(authors, F.col("year"), F.col("id")).alias("label"))


@query("human", sql="WITH f AS (SELECT * FROM (VALUES ('f1', 'categorical', 1), ('f2', 'numeric', 2)) AS t(field_name, field_type, tier)) SELECT h.field_name, coalesce(f.field_type, 'free_text') AS field_type, coalesce(f.tier, 99) AS tier, count(*) AS n FROM human h LEFT JOIN f ON f.field_name = h.field_name GROUP BY ALL")
def field_defaults(human):
    """H-11."""
    fields = human.sparkSession.createDataFrame([("f1", "categorical", 1), ("f2", "numeric", 2)], "field_name string, field_type string, tier int")
    return R.counts(Q.with_defaults(human.select("field_name"), fields), "field_name", "field_type", "tier")


# ---- imports, lifecycle and corrections


@query("human", "papers", sql="""WITH r AS (SELECT paper_id * 7 % 1300 AS id, CASE WHEN id % 9 = 0 THEN 'MAYBE' WHEN id % 9 = 1 THEN NULL WHEN id % 2 = 0 THEN 'REJECT' ELSE 'ACCEPT' END AS decision, CASE WHEN id % 3 = 0 THEN ' ' ELSE snippet END AS note FROM human WHERE extractor = 'A'),
    e AS (SELECT id, 'unknown id' AS error FROM r WHERE id NOT IN (SELECT id FROM papers) UNION ALL SELECT id, 'bad decision' FROM r WHERE decision IS NULL OR decision NOT IN ('ACCEPT', 'REJECT') UNION ALL SELECT id, 'repeated' FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'note missing' FROM r WHERE decision = 'REJECT' AND trim(coalesce(note, '')) = '')
    SELECT error, count(*) AS n, count(DISTINCT id) AS n_ids FROM e GROUP BY ALL""")
def import_errors(human, papers):
    """V-02 / V-04."""
    rows = human.where("extractor = 'A'").select((F.col("paper_id") * 7 % 1300).alias("id"), F.when(F.col("id") % 9 == 0, "MAYBE").when(F.col("id") % 9 == 1, None).when(F.col("id") % 2 == 0, "REJECT").otherwise("ACCEPT").alias("decision"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("snippet")).alias("note"))
    return I.errors(rows, papers, "id", "decision", ["ACCEPT", "REJECT"], ["REJECT"]).groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_ids"))


DECISIONS = "dec AS (SELECT DISTINCT paper_id, field_name, CASE WHEN paper_id % 4 = 0 THEN 'REJECT_VALUE' WHEN paper_id % 4 = 1 THEN 'CORRECT' ELSE 'ACCEPT' END AS decision, CASE WHEN paper_id % 4 = 1 THEN 'fixed' END AS correction FROM sp WHERE audit_status = 'flagged' OR paper_id % 2 = 0)"


def span_decisions(rows: DataFrame) -> DataFrame:
    kind = F.col("paper_id") % 4
    return rows.where("audit_status = 'flagged' OR paper_id % 2 = 0").select("paper_id", "field_name", F.when(kind == 0, "REJECT_VALUE").when(kind == 1, "CORRECT").otherwise("ACCEPT").alias("decision"), F.when(kind == 1, "fixed").alias("correction")).distinct()


@query("spans", "extractions", sql=f"WITH {SPAN_ROWS}, {DECISIONS}, o AS (SELECT sp.paper_id, sp.field_name, CASE WHEN decision IN ('ACCEPT', 'CORRECT') THEN 'verified' WHEN decision = 'REJECT_VALUE' THEN 'rejected_value' ELSE audit_status END AS state, CASE WHEN decision = 'CORRECT' THEN correction ELSE value END AS value FROM sp LEFT JOIN dec ON dec.paper_id = sp.paper_id AND dec.field_name = sp.field_name) SELECT field_name, state AS audit_status, value, count(*) AS n FROM o GROUP BY ALL")
def applied_decisions(spans, extractions):
    """M-07 / M-09."""
    rows = span_rows(spans, extractions)
    return R.counts(I.apply_decisions(rows, span_decisions(rows), ["paper_id", "field_name"])[0], "field_name", "audit_status", "value")


@query("spans", "extractions", sql=f"WITH {SPAN_ROWS}, {DECISIONS} SELECT sp.paper_id FROM sp LEFT JOIN dec ON dec.paper_id = sp.paper_id AND dec.field_name = sp.field_name GROUP BY sp.paper_id HAVING bool_and(decision IS NOT NULL OR audit_status = 'verified')")
def completed_papers(spans, extractions):
    """M-07: papers without an unresolved span."""
    rows = span_rows(spans, extractions)
    return I.apply_decisions(rows, span_decisions(rows), ["paper_id", "field_name"])[1]


@query("human", "papers", sql="""WITH r AS (SELECT id, CASE WHEN paper_id % 5 = 0 THEN 'X' || paper_id ELSE printf('EE-%03d', paper_id) END AS paper_id, nullif(value, 'NR') AS f1, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN lower(extractor) || '; D' ELSE extractor END AS f2, CASE WHEN length(trim(snippet)) > 8 AND upper(trim(snippet)) <> 'NR' THEN snippet END AS q FROM human),
    known AS (SELECT printf('EE-%03d', id) AS paper_id FROM papers),
    e AS (SELECT 'label' AS error, NULL AS part FROM r WHERE NOT regexp_full_match(paper_id, 'EE-[0-9]{3}') UNION ALL SELECT 'unknown paper', NULL FROM r WHERE paper_id NOT IN (SELECT paper_id FROM known)
    UNION ALL SELECT 'value of f1', f1 FROM r WHERE lower(f1) NOT IN ('click', 'view') UNION ALL SELECT 'value of f2', part FROM (SELECT unnest(string_split(f2, '; ')) AS part FROM r) WHERE upper(part) NOT IN ('A', 'C') UNION ALL SELECT 'quote of f1', NULL FROM r WHERE f1 IS NOT NULL AND q IS NULL)
    SELECT error, part, count(*) AS n FROM e GROUP BY ALL""")
def workbook_errors(human, papers):
    """V-03."""
    label = F.format_string("EE-%03d", F.col("paper_id"))
    f2 = F.when(F.col("id") % 6 == 0, " NR ").when(F.col("id") % 6 == 1, F.concat(F.lower("extractor"), F.lit("; D"))).otherwise(F.col("extractor"))
    rows = human.select(F.when(F.col("paper_id") % 5 == 0, F.concat(F.lit("X"), F.col("paper_id").cast("string"))).otherwise(label).alias("paper_id"), F.col("value").alias("f1"), f2.alias("f2"), F.when(F.length(F.trim("snippet")) > 8, F.col("snippet")).alias("q1"))
    known = papers.select(F.format_string("EE-%03d", F.col("id")).alias("paper_id"))
    return R.counts(G.workbook_problems(rows, {"f1": ["Click", "View"], "f2": ["A", "C"]}, {"f1": "q1"}, known), "error", "part")


@query("papers", sql="SELECT id, CASE WHEN id % 5 = 0 AND status NOT IN ('REJECTED', 'FT_SCREENED_OUT') THEN 'PDF_EXCLUDED' ELSE status END AS status, CASE WHEN id % 5 = 0 AND status NOT IN ('REJECTED', 'FT_SCREENED_OUT') THEN 'NON_ENGLISH' ELSE pdf_exclusion_reason END AS reason FROM papers")
def pdf_dispositions(papers):
    """M-10."""
    decided = papers.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, "EXCLUDE").otherwise("PROCEED").alias("disposition"), F.lit("NON_ENGLISH").alias("exclude_reason"))
    return I.dispositions(papers, decided, ["REJECTED", "FT_SCREENED_OUT"]).select("id", "status", F.col("pdf_exclusion_reason").alias("reason"))


@query("papers", sql="SELECT id, CASE WHEN id % 4 = 0 AND status IN ('AI_AUDIT_COMPLETE', 'HUMAN_AUDIT_COMPLETE') THEN 'REJECTED' ELSE status END AS status, CASE WHEN id % 4 = 0 AND status IN ('AI_AUDIT_COMPLETE', 'HUMAN_AUDIT_COMPLETE') THEN 'late' ELSE rejected_reason END AS rejected_reason FROM papers")
def rejected_papers(papers):
    """M-02: only over an allowed edge."""
    return B.reject(papers, papers.where("id % 4 = 0").select("id", F.lit("late").alias("reason"))).select("id", "status", "rejected_reason")


@query("papers", sql="SELECT id, CASE WHEN id % 6 = 0 THEN 'PARSED' ELSE status END AS status FROM papers")
def reset_papers(papers):
    """M-03 / M-04 / SC-08."""
    return L.reset(papers, papers.where("id % 6 = 0").select("id"), "PARSED").select("id", "status")


@query("papers", sql="""WITH d AS (SELECT id AS ord, CASE WHEN id % 2 = 0 THEN upper(doi) END AS doi, CASE WHEN id % 2 = 1 THEN pmid END AS pmid, CASE WHEN id % 3 = 0 THEN 'ABSTRACT_SCREENED_IN' ELSE 'PARSED' END AS to_status FROM papers WHERE id % 2 = 0 OR pmid IS NOT NULL),
    f AS (SELECT d.*, coalesce((SELECT min(id) FROM papers p WHERE p.doi = d.doi), (SELECT min(id) FROM papers p WHERE p.pmid = d.pmid)) AS id FROM d), m AS (SELECT id, max_by(to_status, ord) AS t FROM f WHERE id IS NOT NULL GROUP BY ALL)
    SELECT p.id, CASE WHEN t IS NOT NULL AND (p.status || '>' || t) IN ('INGESTED>ABSTRACT_SCREENED_IN', 'ABSTRACT_SCREEN_FLAGGED>ABSTRACT_SCREENED_IN', 'PDF_ACQUIRED>PARSED', 'EXTRACT_FAILED>PARSED') THEN t ELSE p.status END AS status FROM papers p LEFT JOIN m ON m.id = p.id""")
def adjudicated_papers(papers):
    """M-08 / H-13: decisions find their paper by DOI, then PMID."""
    rows = papers.where("id % 2 = 0 OR pmid IS NOT NULL").select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, F.upper("doi")).alias("doi"), F.when(F.col("id") % 2 == 1, F.col("pmid")).alias("pmid"), F.when(F.col("id") % 3 == 0, "ABSTRACT_SCREENED_IN").otherwise("PARSED").alias("to_status"))
    return B.adjudicate(papers, rows, ["doi", "pmid"])[0].select("id", "status")


@query("human", sql="WITH d AS (SELECT CASE id % 5 WHEN 0 THEN ' accept' WHEN 1 THEN 'Reject' WHEN 2 THEN 'abstract_screened_in' WHEN 3 THEN 'correct' ELSE 'unsure' END AS decision FROM human) SELECT decision, CASE upper(trim(decision)) WHEN 'ACCEPT' THEN 'ACCEPT' WHEN 'REJECT' THEN 'REJECT_VALUE' WHEN 'ABSTRACT_SCREENED_IN' THEN 'INCLUDE' WHEN 'CORRECT' THEN 'CORRECT' END AS mapped, CASE lower(trim(decision)) WHEN 'reject' THEN 'REJECTED' WHEN 'accept' THEN 'HUMAN_AUDIT_COMPLETE' WHEN 'correct' THEN 'HUMAN_AUDIT_COMPLETE' END AS legacy, count(*) AS n FROM d GROUP BY ALL")
def decision_names(human):
    """M-12 / M-13."""
    d = F.when(F.col("id") % 5 == 0, " accept").when(F.col("id") % 5 == 1, "Reject").when(F.col("id") % 5 == 2, "abstract_screened_in").when(F.col("id") % 5 == 3, "correct").otherwise("unsure")
    rows = B.legacy_decisions(human.select(d.alias("decision"))).withColumn("mapped", F.col("decision"))
    known, unknown = L.map_decisions(rows, "mapped")
    return R.counts(known.unionByName(unknown.withColumn("mapped", F.lit(None).cast("string"))).withColumnRenamed("to_status", "legacy"), "decision", "mapped", "legacy")


@query("decisions", sql="SELECT paper_id, CASE WHEN paper_id % 10 = 0 THEN NULL WHEN pass1 = 'exclude' THEN 'FT_SCREENED_OUT' WHEN verifier = 'exclude' THEN 'FT_FLAGGED' ELSE 'FT_ELIGIBLE' END AS full_text, CASE WHEN pass1 = 'include' AND pass2 = 'include' THEN CASE WHEN paper_id % 2 = 0 THEN 'ABSTRACT_SCREENED_IN' ELSE 'ABSTRACT_SCREEN_FLAGGED' END WHEN pass1 = 'exclude' AND pass2 = 'exclude' THEN CASE WHEN paper_id % 2 = 1 THEN 'ABSTRACT_SCREENED_OUT' ELSE 'ABSTRACT_SCREEN_FLAGGED' END ELSE 'ABSTRACT_SCREEN_FLAGGED' END AS again FROM decisions")
def second_screening(decisions):
    """C-04 / SC-09."""
    primary = F.when(F.col("pass1") == "exclude", "FT_EXCLUDE").otherwise("FT_ELIGIBLE")
    before = F.when(F.col("paper_id") % 2 == 0, "ABSTRACT_SCREENED_IN").otherwise("ABSTRACT_SCREENED_OUT")
    return decisions.select("paper_id", I.full_text(primary, F.when(F.col("verifier") == "exclude", "FT_FLAGGED"), F.col("paper_id") % 10 == 0).alias("full_text"), B.rescreened(before, F.array("pass1", "pass2")).alias("again"))


@query("extractions", sql="WITH e AS (SELECT paper_id, min_by(schema_hash, id) AS expected FROM extractions WHERE model <> 'P' GROUP BY ALL), a AS (SELECT paper_id, max_by(schema_hash, id) AS actual FROM extractions GROUP BY ALL) SELECT coalesce(e.paper_id, a.paper_id) AS paper_id, expected, actual FROM e FULL JOIN a ON e.paper_id = a.paper_id WHERE expected IS DISTINCT FROM actual")
def hash_drift(extractions):
    """V-09 / SC-13."""
    e = extractions.where("model <> 'P'").groupBy("paper_id").agg(F.min_by("schema_hash", "id").alias("h"))
    return I.drift(e, extractions.groupBy("paper_id").agg(F.max_by("schema_hash", "id").alias("h")), "paper_id", "h")


@query("spans", sql="WITH s AS (SELECT extraction_id, list_sort(list(span_no + (extraction_id % 3 = 0)::INT * (span_no // 2))) AS slots FROM spans GROUP BY ALL) SELECT extraction_id, len(list_filter([1, 2, 3, 4], lambda x: NOT list_contains(slots, x)))::INTEGER AS n_missing, len(slots) <> len(list_distinct(slots)) AS repeated, len(list_distinct(list_filter(slots, lambda x: x > 4 OR x < 1)))::INTEGER AS n_beyond FROM s")
def slot_checks(spans):
    """U-05."""
    slot = (F.col("span_no") + F.when(F.col("extraction_id") % 3 == 0, F.expr("span_no div 2")).otherwise(0)).cast("int")
    c = spans.groupBy("extraction_id").agg(F.array_sort(F.collect_list(slot)).alias("slots")).select("extraction_id", I.slot_coverage(F.col("slots"), 4).alias("c"))
    return c.select("extraction_id", F.size("c.missing").alias("n_missing"), "c.repeated", F.size("c.out_of_range").alias("n_beyond"))


@query("human", "papers", sql="""WITH r AS (SELECT id, CASE value WHEN 'click' THEN 'AGREE' WHEN 'view' THEN 'DISAGREE' WHEN 'purchase' THEN NULL ELSE value END AS decision FROM human), d AS (SELECT * FROM r WHERE decision IS NOT NULL)
    SELECT 'all' AS batch, 'invalid decision' AS kind, count(*) AS n FROM d WHERE decision NOT IN ('AGREE', 'DISAGREE') UNION ALL SELECT 'all', 'duplicate', count(*) FROM d WHERE id IN (SELECT id FROM papers) UNION ALL SELECT 'all', 'added', 0
    UNION ALL SELECT 'clean', 'added', count(*) FROM d WHERE decision IN ('AGREE', 'DISAGREE') AND id NOT IN (SELECT id FROM papers)""")
def pair_adjudication(human, papers):
    """H-12: all rows as one import, which is refused as a whole, and the good rows as another."""
    v = F.col("value")
    rows = human.select("id", F.when(v == "click", "AGREE").when(v == "view", "DISAGREE").when(v == "purchase", None).otherwise(v).alias("decision"))
    good = rows.where("decision IS NULL OR decision IN ('AGREE', 'DISAGREE')").join(papers.select("id"), "id", "left_anti")
    count = lambda df, batch: df.agg(F.lit(batch).alias("batch"), F.lit("added").alias("kind"), F.count("*").alias("n"))
    added, errors = G.pair_decisions(rows, papers, ["id"], "empty")
    why = errors.groupBy(F.lit("all").alias("batch"), F.col("error").alias("kind")).agg(F.count("*").alias("n"))
    return count(added, "all").unionByName(why).unionByName(count(G.pair_decisions(good, papers, ["id"])[0], "clean"))


@query("runs", "verdicts", sql="SELECT count(*) AS n FROM runs WHERE item NOT IN (SELECT paper_id FROM verdicts WHERE no > 3)")
def items_to_retry(runs, verdicts):
    """SC-03 / ST-04."""
    return I.retry(runs.select(F.col("item").alias("paper_id")), verdicts.where("no > 3"), ["paper_id"]).agg(F.count("*").alias("n"))


@query("spans", sql="SELECT extraction_id, span_no, CASE WHEN flag = 'R' THEN quantity + 1 ELSE coalesce(CASE WHEN partkey % 2 <> 0 THEN confidence END, 0.0) END AS confidence FROM spans")
def updated_confidence(spans):
    """H-16 / H-17: nulls are filled, then the last of the two changes of a key is applied."""
    keyed = spans.withColumn("key", F.concat_ws("/", "extraction_id", "span_no"))
    s = B.with_not_null(keyed.select("key", "extraction_id", "span_no", F.when(F.col("partkey") % 2 != 0, F.col("confidence")).alias("confidence"), F.lit(None).cast("int").alias("tier"))).drop("tier")
    changes = keyed.where("flag = 'R'").select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), "quantity").select("key", "ord", (F.col("quantity") + F.col("ord") - 1).alias("confidence"))
    return B.updated(s, changes, "key", ["confidence"]).drop("key")


@query("ratings", "human", sql="SELECT r.risk, count(*) AS n FROM ratings r JOIN human h ON h.id = r.paper_id AND h.extractor = 'A' WHERE r.level1 = 'PARTIAL' GROUP BY ALL")
def pairs_of_run(ratings, human):
    """H-04."""
    a = ratings.select(F.col("paper_id").alias("rating_id"), "risk", F.col("level1").alias("run_id"))
    return R.counts(B.run_pairs(a, human.where("extractor = 'A'").select(F.col("id").alias("rating_id")), "PARTIAL"), "risk")


@query("verdicts", sql="WITH d AS (SELECT unnest(['SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'ERROR']) AS verdict) SELECT d.verdict, count(v.verdict) AS n FROM d LEFT JOIN verdicts v ON v.verdict = d.verdict GROUP BY ALL")
def zero_filled(verdicts):
    """H-06."""
    domain = verdicts.sparkSession.createDataFrame([("SUPPORTED",), ("PARTIALLY_SUPPORTED",), ("UNSUPPORTED",), ("ERROR",)], "verdict string")
    return A.filled_domain(R.counts(verdicts, "verdict"), domain, "verdict")


@query("orders", sql="WITH a AS (SELECT o_orderkey AS rating_id, list_sort(list_distinct([o_orderstatus, o_orderpriority, 'x'])) AS arms FROM orders) SELECT x AS arm_a, y AS arm_b, count(*) AS n FROM (SELECT rating_id, unnest(arms) AS x, arms FROM a) t, LATERAL (SELECT unnest(t.arms) AS y) WHERE y > x GROUP BY ALL")
def arm_pairs(orders):
    """SNK-04 / V-08 / H-22."""
    return R.counts(sinks.pair_rows(orders.select(F.col("o_orderkey").alias("rating_id"), F.array_distinct(F.array("o_orderstatus", "o_orderpriority", F.lit("x"))).alias("arms"))), "arm_a", "arm_b")


@query("orders", sql="SELECT o_orderkey AS result, s AS slot, CASE WHEN s = 1 THEN o_orderstatus END AS reasoning, CASE WHEN s = 2 THEN o_orderpriority END AS hypothesis FROM orders, (SELECT unnest([1, 2]) AS s)")
def verdict_rows(orders):
    """SNK-05 / H-23."""
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.lit(1).alias("slot"), F.col("o_orderstatus").alias("reasoning"), none.alias("hypothesis")), F.struct(F.lit(2).alias("slot"), none.alias("reasoning"), F.col("o_orderpriority").alias("hypothesis")))
    return sinks.verdict_rows(orders.select(F.col("o_orderkey").alias("result"), both.alias("verdicts")))


@query("conversations", sql="SELECT conv_id, string_agg(role || ': ' || length(text), chr(10) || chr(10) ORDER BY turn, role || ': ' || length(text)) AS markdown FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def markdown_per_conversation(conversations):
    """SNK-13."""
    rows = conversations.where("text IS NOT NULL").select("conv_id", "turn", F.concat("role", F.lit(": "), F.length("text").cast("string")).alias("text"))
    return sinks.text_per_paper(rows, "conv_id", "turn", "text")


@query("papers", sql="SELECT 'We identified ' || count(*) || ' records, screened ' || count(*) FILTER (status NOT IN ('INGESTED')) || ', excluded ' || count(*) FILTER (status = 'ABSTRACT_SCREENED_OUT') || ', assessed ' || count(*) FILTER (status NOT IN ('INGESTED', 'ABSTRACT_SCREENED_OUT', 'ABSTRACT_SCREEN_FLAGGED', 'ABSTRACT_SCREENED_IN', 'PDF_ACQUIRED', 'PDF_EXCLUDED')) || ' full texts and included ' || count(*) FILTER (status IN ('AI_AUDIT_COMPLETE', 'HUMAN_AUDIT_COMPLETE')) || ' studies.' AS text FROM papers")
def methods_paragraph(papers):
    """SNK-14."""
    return sinks.methods_text(R.prisma_flow(papers))


@query("papers", sql="SELECT '{\"source\":\"' || source || '\",\"n\":' || count(*) || '}' AS value FROM papers GROUP BY source")
def json_report(papers):
    """SNK-10."""
    return sinks.report_json(R.counts(papers, "source"))


# ---- samples and orders


@query("papers", sql="SELECT id, CASE WHEN status = 'ABSTRACT_SCREENED_IN' THEN 1 WHEN row_number() OVER (PARTITION BY status = 'ABSTRACT_SCREENED_IN' ORDER BY sha256('42|' || id), id) <= 30 THEN 2 ELSE 3 END::INTEGER AS priority FROM papers")
def priorities(papers):
    """T-09 / T-12."""
    return B.priorities(papers).select("id", "priority")


@query("verdicts", sql="WITH v AS (SELECT paper_id || ':' || no AS key FROM verdicts), r AS (SELECT key, row_number() OVER (ORDER BY sha256('42|' || key)) AS rn, count(*) OVER () AS n FROM v) SELECT key FROM r WHERE rn <= greatest(1, (n * 0.013)::DECIMAL(18, 6)::DOUBLE // 1)")
def spot_check(verdicts):
    """T-08."""
    return S.fraction(verdicts.select(F.concat_ws(":", F.col("paper_id").cast("string"), F.col("no").cast("string")).alias("key")), "key", 0.013)


@query("verdicts", sql="SELECT verdict, arm, count(*) AS n FROM verdicts WHERE short_circuit GROUP BY ALL HAVING count(*) < 1200")
def scarce_cells(verdicts):
    """T-07."""
    return S.under_supplied(verdicts.where("short_circuit"), ["verdict", "arm"], 1200)


@query("verdicts", sql="SELECT verdict, arm, first(paper_id ORDER BY paper_id, no) AS paper_id, first(no ORDER BY paper_id, no) AS no FROM verdicts GROUP BY ALL")
def first_examples(verdicts):
    """T-13."""
    rows = verdicts.select("verdict", "arm", "paper_id", "no", F.struct("paper_id", "no").alias("place"))
    return S.examples(rows, ["verdict", "arm"], "place").select("verdict", "arm", "paper_id", F.col("no").cast("long").alias("no"))


@query("orders", sql="WITH a AS (SELECT o_orderkey, unnest(['local', 'openai', 'anthropic']) AS arm FROM orders) SELECT o_orderkey, string_agg(arm, ',' ORDER BY sha256(o_orderkey || '|' || arm), arm) AS slots FROM a GROUP BY ALL")
def arm_permutations(orders):
    """T-11."""
    return orders.select("o_orderkey", F.array_join(S.permutation(F.array(*map(F.lit, ["local", "openai", "anthropic"])), F.col("o_orderkey")), ",").alias("slots"))


@query("papers", sql="WITH s AS (SELECT id, row_number() OVER (ORDER BY sha256('42|' || id)) AS row_id FROM papers) SELECT (SELECT count(*) FROM s) AS n, (SELECT first(id ORDER BY row_id) FROM s) AS first_id, (SELECT coalesce(bool_and(up), true) FROM (SELECT id > lag(id) OVER (ORDER BY row_id) AS up FROM s)) AS monotonic")
def shuffled_sample(papers):
    """W-03 / W-05."""
    s = S.shuffled(papers.select("id"), "id")
    return s.agg(F.count("*").alias("n"), F.min_by("id", "row_id").alias("first_id")).join(S.is_monotonic(s, "row_id", "id"))


@query("papers", sql="WITH g AS (SELECT source, count(*) AS group_n FROM papers GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (ORDER BY group_n DESC, source) AS group_rank FROM g) SELECT p.id, p.source, group_n, group_rank::INTEGER AS group_rank, (row_number() OVER (PARTITION BY p.source ORDER BY id))::INTEGER AS item_rank FROM papers p JOIN r ON r.source = p.source")
def ranked_groups(papers):
    """W-04."""
    return R.group_rank(papers.select("id", "source"), "source", "id").select("id", "source", "group_n", "group_rank", "item_rank")


@query("papers", sql="WITH a AS (SELECT id, 'odd' AS stratum FROM papers WHERE id % 2 = 1 ORDER BY id LIMIT 5), b AS (SELECT id, 'third' AS stratum FROM papers WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM a) ORDER BY id LIMIT 6), c AS (SELECT id, 'any' AS stratum FROM papers WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY id LIMIT 4) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def chosen_strata(papers):
    """W-09."""
    return S.first_strata(papers.select("id"), "id", [("odd", F.col("id") % 2 == 1, 5), ("third", F.col("id") % 3 == 0, 6), ("any", F.lit(True), 4)], "id")


@query("papers", sql="WITH k AS (SELECT CASE WHEN id % 10 = 0 THEN 'x' || id ELSE (id * 7 % 1000)::VARCHAR END AS key FROM papers) SELECT key FROM k ORDER BY TRY_CAST(key AS BIGINT) NULLS LAST, key")
def numbers_first(papers):
    """T-03."""
    keys = papers.select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise((F.col("id") * 7 % 1000).cast("string")).alias("key"))
    return keys.orderBy(*R.id_order("key"))


@query("human", "papers", sql="SELECT field_name FROM human GROUP BY ALL UNION ALL SELECT status FROM papers GROUP BY ALL")
def distinct_names(human, papers):
    """U-04 / U-06."""
    return Q.merge_sources(B.distinct_fields(human), papers.select(F.col("status").alias("field_name")).distinct())


@query("human", sql="WITH c AS (SELECT field_name, count(*) AS n, count(DISTINCT value) AS d FROM human GROUP BY ALL) SELECT field_name, status, place FROM (SELECT field_name, CASE WHEN n % 3 = 0 THEN 'COLLAPSED' WHEN n % 3 = 1 THEN 'LOW_VARIANCE' ELSE 'OK' END AS status, row_number() OVER (ORDER BY n % 3, field_name) AS place FROM c)")
def report_in_order(human):
    """H-30."""
    c = human.groupBy("field_name").agg(F.count("*").alias("n"))
    rows = c.select("field_name", F.when(F.col("n") % 3 == 0, "COLLAPSED").when(F.col("n") % 3 == 1, "LOW_VARIANCE").otherwise("OK").alias("status"))
    ordered = B.report_order(rows).agg(F.collect_list(F.struct("field_name", "status")).alias("r"))  # a row for each field
    return ordered.select(F.posexplode("r").alias("place", "x")).select("x.field_name", "x.status", (F.col("place") + 1).cast("long").alias("place"))


@query("spans", sql="SELECT extraction_id, span_no, CASE WHEN partkey % 3 = 0 OR round(confidence, 2) = 0 THEN 'r' || partkey ELSE 'r' || partkey || ' [confidence: ' || round(confidence, 2) || ']' END AS shown FROM spans")
def decorated_rationales(spans):
    """H-19."""
    confidence = F.when(F.col("partkey") % 3 != 0, F.round("confidence", 2))
    return spans.select("extraction_id", "span_no", B.decorated(F.concat(F.lit("r"), F.col("partkey").cast("string")), confidence).alias("shown"))


@query("documents", sql="""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS t, doc_id * 37 % 700 AS place FROM documents), h AS (SELECT *, substr(t, 1, place) AS head, substr(t, place + 1) AS tail FROM d)
    SELECT doc_id, CASE WHEN contains(head, chr(10) || chr(10)) THEN length(head) - length(string_split(head, chr(10) || chr(10))[-1]) - 1 WHEN contains(head, chr(10)) THEN length(head) - length(string_split(head, chr(10))[-1]) ELSE 0 END::INTEGER AS "start",
    (CASE WHEN place >= length(t) THEN length(t) WHEN contains(tail, chr(10) || chr(10)) THEN place + length(string_split(tail, chr(10) || chr(10))[1]) WHEN contains(tail, chr(10)) THEN place + length(string_split(tail, chr(10))[1]) ELSE length(t) END)::INTEGER AS "end" FROM h""")
def paragraph_starts(documents):
    """H-09: the paragraph around a place of every text; half of the texts have blank lines."""
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    at = (F.col("doc_id") * 37 % 700).cast("int")
    return documents.select("doc_id", B.snap_paragraph(t, at).cast("int").alias("start"), B.snap_paragraph_end(t, at).cast("int").alias("end"))


@query("papers", sql="""WITH k AS (SELECT id, year, row_number() OVER (ORDER BY id) AS seq, string_split(trim(regexp_replace(title, '[^\\p{L} ]', '', 'g')), ' ')[1] AS name FROM papers WHERE status <> 'ABSTRACT_SCREENED_OUT')
    SELECT id, seq, 'EE-' || lpad(seq::VARCHAR, greatest(3, length(seq::VARCHAR))::INTEGER, '0') || '_' || CASE WHEN id % 3 = 2 OR name = '' THEN 'Unknown' ELSE name END || '_' || year || '.pdf' AS file FROM k""")
def manifest(papers):
    """SC-10: the names of the files of all papers that stay, in sequence; the authors are the words of the titles."""
    name = F.trim(F.regexp_replace("title", r"[^\p{L} ]", ""))
    authors = F.when(F.col("id") % 3 == 0, F.to_json(F.array(name, F.lit("Other C")))).when(F.col("id") % 3 == 1, F.to_json(F.array(F.regexp_replace(name, "^([^ ]+)", "$1,")))).otherwise("no JSON")
    return B.manifest(papers.withColumn("authors", authors), ["ABSTRACT_SCREENED_OUT"]).select("id", "seq", "file")


@query("human", sql="""WITH p AS (SELECT field_name, value, unnest(string_split(value || '; vi', '; ')) AS part FROM human)
    SELECT field_name, 'unknown field name' AS issue, field_name AS part, count(*) AS n FROM human WHERE field_name IN ('f5', 'f6') GROUP BY ALL
    UNION ALL SELECT field_name, 'invalid categorical value', part, count(*) FROM p WHERE field_name IN ('f0', 'f1', 'f2') AND part NOT IN ('click', 'view', 'vi') GROUP BY ALL
    UNION ALL SELECT field_name, 'non-numeric size', value || '; vi', count(*) FROM human WHERE field_name = 'f4' GROUP BY ALL""")
def field_issue_counts(human):
    """C-14: values with a word that begins an option, against a specification without two of the fields; f4 is a size."""
    values = human.select("field_name", F.concat("value", F.lit("; vi")).alias("value"))
    fields = human.sparkSession.createDataFrame([*((f"f{i}", ["click", "view", "vi (shorthand)"]) for i in range(3)), ("f3", None), ("f4", None)], "field_name string, options array<string>")
    return R.counts(C.field_issues(values, fields, "f4"), "field_name", "issue", "part")


@query("papers", sql="SELECT source, count(*) AS n, count(*) FILTER (status = 'PDF_EXCLUDED') AS pdf_excluded, count(*) FILTER (status IN ('AI_AUDIT_COMPLETE', 'HUMAN_AUDIT_COMPLETE')) AS included FROM papers GROUP BY ALL")
def prisma_by_source(papers):
    """A-03: the flow by source of the records."""
    return R.prisma_by_source(papers)


@query("documents")
def token_windows(documents):
    """C-19 / X-14: what of every text is shown for three spans of it, with a budget of 400 tokens and cells of 1,200 characters."""
    import public_tokenizers

    n, at = F.length("text"), lambda part: F.floor(F.length("text") * part).cast("int")
    spans = F.array(F.substring("text", at(0.2) + 1, F.lit(90)), F.when(F.col("doc_id") % 3 == 0, F.substring("text", at(0.7) + 1, F.lit(250))), F.lit("not in any text"))
    own = F.when(F.col("doc_id") % 2 == 0, F.substring("text", at(0.5) + 1, F.lit(70)))
    rows = documents.where(n > 0).select("doc_id", F.col("text").alias("source_text"), F.when(F.col("doc_id") % 5 == 0, "NR").otherwise("a value").alias("value"), own.alias("span"), spans.alias("spans"))
    return W.with_audit_windows(rows, public_tokenizers.path("byte_bpe_50k.json"), 400, (40, 20), 1200).select("doc_id", "strategy", "window")


@query("papers", "human", sql="WITH a AS (SELECT DISTINCT paper_id FROM human WHERE value = 'purchase') SELECT count(*) FILTER (status = 'FT_SCREENED_OUT') AS ft_screened_out, count(*) FILTER (status = 'FT_SCREENED_OUT' AND id IN (SELECT paper_id FROM a)) AS adjudicated, count(*) FILTER (status = 'FT_SCREENED_OUT' AND id NOT IN (SELECT paper_id FROM a)) AS primary_only FROM papers")
def ft_exclusions_split(papers, human):
    """A-03: full-text exclusions by who decided."""
    return R.ft_split(papers, human.where("value = 'purchase'").select("paper_id"))


@query("lineitem", sql="""SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, true AS close_parts, true AS close_median, true AS close_shared FROM lineitem GROUP BY l_returnflag""")
def merged_sketches(lineitem):
    """A-46: sketches by flag and month merged by flag, and their errors against the exact figures: 3 % of the parts, 2 % of the ranks, 6 % of the parts shared by early and late months."""
    rows = lineitem.select(F.col("l_returnflag").alias("flag"), F.trunc("l_shipdate", "month").alias("month"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), (F.year("l_shipdate") < 1995).alias("early"))
    stored = K.sketched(rows, ["flag", "month", "early"], "part", "price")
    got = K.estimates(K.merged(stored, ["flag"])).drop("n")
    sides = K.merged(stored, ["flag", "early"])
    both = K.shared(sides.where("early"), sides.where("NOT early"), ["flag"])
    parts = rows.groupBy("flag", "part").agg(F.count("*").alias("n"), F.count_distinct("early").alias("sides"))
    exact = parts.groupBy("flag").agg(F.sum("n").alias("n"), F.count("*").alias("n_parts"), F.count_if(F.col("sides") == 2).alias("in_both"))
    below = rows.join(got.select("flag", "q50"), "flag").groupBy("flag").agg(F.avg((F.col("price") <= F.col("q50")).cast("double")).alias("rank"))
    out = exact.join(got, "flag").join(below, "flag").join(both, "flag", "left")
    near = lambda a, b, share: F.abs(a - b) <= share * b
    return out.select("flag", "n", "n_parts", near(F.col("n_distinct"), F.col("n_parts"), 0.03).alias("close_parts"), (F.abs(F.col("rank") - 0.5) <= 0.02).alias("close_median"), near(F.coalesce("n_shared", F.lit(0)), F.col("in_both"), 0.06).alias("close_shared"))

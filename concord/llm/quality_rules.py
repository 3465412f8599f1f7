"""Operator 7: quality rules and cross-document line frequency, with DataFrame functions only.

Base rules: a document fails with fewer than 50 words, or if over half of
its words lie in three-word windows that the text holds twice or more.

Line rule: lines are normalised (letters and digits only, lower case) and
hashed; for each host the documents that hold a line are counted. A line is
boilerplate of its host if it is in more than ``MIN_DOCS`` documents and in
more than the square root of the host's number of documents, a limit that
hardly grows with the host. ``clean`` removes these lines. A document is
depleted, and rejected, if fewer than ``MIN_WORDS`` words and less than half
of its words remain.

Lines are normalised once, and counts are partial sums before they are
shuffled, so a hot host or line is a row for each task; only boilerplate lines
meet their documents again, by broadcast where they have ``BROADCAST_BYTES`` at
most.

Edge cases: null text has no words and fails the base rules; a null host is
a host of its own; rows are judged one by one, whatever their ids, and each
row counts as a document of its host; documents without lines keep the base
verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import durable, named, table

MIN_WORDS, MIN_DOCS = 50, 20
BROADCAST_BYTES = 16 << 20
GAP = r"[ \t-\r]+"
WORD = r"[^ \t-\r]"


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """The base figures of every row, with its doc and row (see common.named)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = ("doc", "row", *more)
    out = named(docs, *more[2:]).withColumn("words", F.filter(F.split(text, GAP), lambda x: x != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = out.select(
        "doc_id", "text", *more, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
    )
    three = F.when(F.size("hashes") > 2, F.transform(F.sequence(F.lit(0), F.size("hashes") - 3), lambda i: F.xxhash64(F.col("hashes")[i], F.col("hashes")[i + 1], F.col("hashes")[i + 2]))).otherwise(F.array().cast("array<long>"))
    out = out.select("doc_id", "text", *more, "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), three.alias("windows"))
    # windows are put in order only where some window comes twice
    order = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("sorted", order).drop("windows")
    alike = F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), F.lit(0))), lambda a, b: F.when(a.h == b.h, F.array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(alike, lambda x: x.isNotNull()))))
    out = out.withColumn("n_repeat_words", F.when(F.col("sorted").isNull(), 0).otherwise(covered).cast("long")).drop("sorted")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """array<struct<line (hash), n (words)>> of a text's lines that have a letter or digit, in their order."""
    norm = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.transform(F.filter(norm, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x, F.length(x)).alias("line"), F.size(F.split(x, " ")).cast("long").alias("n")))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, row, host, line, n (its words), first (1 at the line's first place in the text, else 0) and total (words in lines) of every line."""
    rows = named(docs, F.coalesce("source", F.lit("\x00")).alias("host")).select("doc", "row", "host", F.sort_array(normal_lines(F.coalesce("text", F.lit("")))).alias("lines"))
    before = F.concat(F.array(F.lit(None).cast("long")), F.col("lines.line"))
    rows = rows.select("doc", "row", "host", F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("total"), F.inline(F.zip_with("lines", F.slice(before, F.lit(1), F.size("lines")), lambda x, b: F.struct(x["line"].alias("line"), x["n"].alias("n"), F.when(x["line"].eqNullSafe(b), 0).otherwise(1).alias("first")))))
    return rows


def removed_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row, removed_share (of the words in lines) and bad_lines (hashes) of every row that has boilerplate lines."""
    lines = durable(lines_of(docs))
    counts = lines.groupBy("host", "line").agg(F.sum("first").alias("docs")).where(F.col("docs") > min_docs)
    hosts = docs.groupBy(F.coalesce("source", F.lit("\x00")).alias("host")).agg(F.count("*").alias("host_docs"))
    bad = counts.join(hosts, "host").where("docs * docs > host_docs").select("host", "line")
    gone = lines.join(bad, ["host", "line"]).groupBy("doc", "row").agg(F.sum("n").alias("words"), F.sum("first").alias("firsts"), F.max("total").alias("total"), F.collect_set("line").alias("bad_lines"))  # at most the text's own
    # rows equal in id and text share one key: the sums are as many times a text's own as there are such rows
    return gone.select("doc", "row", (F.col("words") * F.size("bad_lines") / (F.col("firsts") * F.col("total"))).alias("removed_share"), "bad_lines")


def judged(docs: DataFrame, *more: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """The base figures, removed_share, bad_lines and kept of every row."""
    base = measured(docs, *more)
    removed = durable(removed_lines(docs, min_docs))
    size = removed.agg(F.coalesce(F.sum(40 + 8 * F.size("bad_lines")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:  # else the texts are shuffled to meet their lines
        removed = F.broadcast(removed)
    out = base.join(removed, ["doc", "row"], "left").withColumn("removed_share", F.coalesce("removed_share", F.lit(0.0)))
    depleted = (F.col("removed_share") > 0.5) & (F.col("n_words") * (1 - F.col("removed_share")) < MIN_WORDS)
    # one CASE over both sides of the join: a filter on it stays above the projections, which then run once
    return out.withColumn("kept", F.when(depleted, False).otherwise(~F.col("base_failed")))


def without_lines(text: Column, bad_lines: Column) -> Column:
    """The text without the lines whose hash is in bad_lines (null: none); line ends go with their lines."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    stays = lambda x: (norm(x) == "") | ~F.array_contains(bad_lines, F.xxhash64(norm(x), F.length(norm(x))))
    return F.when(F.size(bad_lines) > 0, F.array_join(F.filter(F.split(text, "\n"), stays), "\n")).otherwise(text)


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; all other columns stay, n_chars follows the text."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    kept = judged(rows, "_row", min_docs=min_docs).where("kept").select("_row", "bad_lines")
    kept = kept.select("_row", "bad_lines", without_lines(F.col("_row.text"), F.col("bad_lines")).alias("_text"))
    renewed = {"text": F.col("_text")} | ({"n_chars": F.when(F.col("bad_lines").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast("long"))} if "n_chars" in docs.columns else {})
    return kept.select(*[renewed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_share"]


def quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select(*RESULT)


def op7(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS host FROM documents),
w AS (SELECT doc_id, text, host, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw_lines WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY doc_id),
norm AS (SELECT d.doc_id, d.host, s.line, s.n FROM d,
         LATERAL (SELECT line, count(*) AS n FROM (SELECT trim(regexp_replace(lower(unnest(string_split(d.text, chr(10)))), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS line) WHERE line <> '' GROUP BY line) s),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
bad AS (SELECT host, line FROM norm JOIN hosts USING (host) GROUP BY host, line, host_docs HAVING count(*) > 20 AND count(*) * count(*) > host_docs),
gone AS (SELECT n.doc_id,
                sum(CASE WHEN b.line IS NOT NULL THEN n.n * len(string_split(n.line, ' ')) ELSE 0 END) * 1.0 / sum(n.n * len(string_split(n.line, ' '))) AS removed_share
         FROM norm n LEFT JOIN bad b ON n.host = b.host AND n.line = b.line GROUP BY n.doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(g.removed_share, 0.0) AS removed_share
      FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id
             LEFT JOIN gone g ON w.doc_id = g.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (removed_share > 0.5 AND n_words * (1 - removed_share) < 50) AS kept, removed_share::DOUBLE AS removed_share
FROM b
"""

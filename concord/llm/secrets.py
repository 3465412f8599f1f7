"""Operator 2: secret scans with a random forest, in DataFrame functions only.

Candidates are all runs of 16 or more characters of ``[A-Za-z0-9+/_-]``, with
up to two ``=`` after them, at their own places. Their features are length,
character transitions, dictionary coverage, signs of a path (in the candidate
and in the document's source), and the neighbouring words, hashed into
``BUCKETS``. The dictionary are the words that come at least once in
``DICTIONARY_DOCS`` documents on average, counted over the whole corpus, as a
table of fixed size. A random forest trained from
labelled findings removes false positives; its trees are written out as
expressions over one candidate, so that a text is scored and masked in one
projection, without a shuffle.

The tables hold no labelled findings, so by default ``labelled_findings``
makes them by rule (a bounded, seeded set of ``rows``); a frame of real
findings with the same columns can be given instead.

Edge cases: null or empty text has no candidates; a repeated candidate is a
finding each time, at its own place; a null source is a path without signs;
rows are scored one by one, whatever their ids; an empty corpus gives an
empty dictionary.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import table

THRESHOLD = 0.5
MASK = "[SECRET]"
RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
BUCKETS, DICTIONARY_DOCS, DICTIONARY_SLOTS = 16, 50, 1 << 15
NEAR = 64  # characters before and after a candidate in which its neighbours are

# Words of made findings
PIECES = "the and ing ion ent for that with ment tion able ness house world quick brown lazy user name test data file path page index image photo version release edition report project program python java script build main master config example sample your here placeholder change default none null value number order item article section chapter street server client local host http https www com org net html json".split()
# Words near a secret, and words near other long strings
NEAR_SECRET = "key|token|secret|passw|pwd|credential|auth|bearer|private|apikey"
NEAR_OTHER = "commit|sha|md5|hash|checksum|digest|uuid|guid|revision|etag|example|sample|dummy|fake|placeholder|id|trace|request|order|card|phone|version|build"
PATH_SIGNS = "test|example|sample|mock|fixture|doc"


def prefix_sums(lengths: Column, chunk: int = 512) -> Column:
    """The sum of all elements before each, of an array that is not empty; in chunks, so that work does not grow with the square of its size."""
    add = lambda s, x: F.struct(F.array_append(s["out"], s["at"]).alias("out"), (s["at"] + x).alias("at"))
    start = lambda at: F.struct(F.array().cast("array<long>").alias("out"), at.alias("at"))
    chunks = F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / chunk).cast("int")), lambda i: F.slice(lengths, i * chunk + 1, F.lit(chunk)))
    zero = F.lit(0).cast("long")
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, x: s + x))
    before = F.aggregate(sums, start(zero), add)["out"]
    return F.flatten(F.zip_with(chunks, before, lambda c, b: F.aggregate(c, start(b), add)["out"]))


def bound(value: Column, of) -> Column:
    """of(value), with value evaluated once: it is the variable of a lambda."""
    return F.transform(F.array(value), of)[0]


def candidates(text: Column) -> Column:
    """array<struct<start, secret, before, after>> of a text's candidates."""
    text = F.coalesce(text, F.lit(""))
    tail = lambda x: F.call_function("right", x, F.lit(NEAR))
    none = F.array().cast("array<struct<start: long, secret: string, before: string, after: string>>")

    def made(x: Column) -> Column:
        lengths = F.zip_with(x["runs"], F.slice(x["gaps"], F.lit(1), F.size(x["runs"])), lambda r, g: (F.length(r) + F.length(g)).cast("long"))
        before = prefix_sums(lengths)
        found = F.transform(x["runs"], lambda r, i: F.struct(
            (F.get(before, i) + F.length(F.get(x["gaps"], i))).alias("start"), r.alias("secret"), tail(F.get(x["gaps"], i)).alias("before"), F.left(F.get(x["gaps"], i + 1), F.lit(NEAR)).alias("after")))
        return F.when(F.size(x["runs"]) > 0, found).otherwise(none)

    return bound(F.struct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs"), F.split(text, RUN).alias("gaps")), made)


def dictionary(docs: DataFrame) -> bytes:
    """A table of DICTIONARY_SLOTS marks: 1 where a word hashes that comes at least once in DICTIONARY_DOCS documents on average, and twice in all."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    often = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, docs.count() / DICTIONARY_DOCS))
    slot = F.pmod(F.xxhash64("w"), F.lit(DICTIONARY_SLOTS)).cast("int")
    # 64 slots a row: a table's worth of rows at most
    rows = often.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("part")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)))).alias("bits")).collect()
    return bytes(marks_of({r.part: r.bits & (1 << 64) - 1 for r in rows}))


def marks_of(parts: dict[int, int]) -> list[int]:
    return [parts.get(k >> 6, 0) >> (k & 63) & 1 for k in range(DICTIONARY_SLOTS)]


def features(secret: Column, before: Column, after: Column, path: Column, marks: bytes) -> dict[str, Column]:
    """The numbers that the forest sees of a candidate; marks: see dictionary()."""
    n = F.length(secret)
    share = lambda pattern: F.length(F.regexp_replace(secret, pattern, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(secret, "[0-9]", "d"), "[A-Z]", "u"), "[a-ce-tv-z]", "l"), "[^dul]", "o")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    vowels = F.regexp_replace(F.regexp_replace(F.lower(secret), "[aeiouy]", "1"), "[b-df-hj-np-tv-xz]", "2")
    before, after, path = F.lower(before), F.lower(after), F.lower(F.coalesce(path, F.lit("")))
    pieces = F.split(F.lower(F.regexp_replace(secret, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    slot = lambda x: (F.pmod(F.xxhash64(x), F.lit(DICTIONARY_SLOTS)) + 1).cast("int")
    known = F.filter(pieces, lambda x: (F.length(x) >= 3) & (F.substring(F.lit(marks), slot(x), F.lit(1)) == F.lit(b"\x01")))
    neighbours = F.concat(F.slice(F.reverse(F.regexp_extract_all(before, F.lit("[a-z0-9]+"), F.lit(0))), 1, 3), F.slice(F.regexp_extract_all(after, F.lit("[a-z0-9]+"), F.lit(0)), 1, 1))
    near = F.transform(neighbours, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)))
    return {
        "length": n.cast("double"),
        "transitions": F.length(runs) / n,
        "letter_transitions": F.length(F.regexp_replace(vowels, r"([12])\1+", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(secret, ""))) / n,
        "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "marks": share("[A-Za-z0-9]"),
        "hex": secret.rlike("^[0-9a-fA-F]+$").cast("double"),
        "uuid": secret.rlike("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-").cast("double"),
        "repeats": secret.rlike(r"(.)\1{3}").cast("double"),
        "dictionary": F.aggregate(known, F.lit(0), lambda s, x: s + F.length(x)) / n,
        "slashes": F.length(F.regexp_replace(secret, "[^/]", "")).cast("double"),
        "path_signs": path.rlike(PATH_SIGNS).cast("double"),
        "near_secret": F.call_function("right", before, F.lit(32)).rlike(NEAR_SECRET).cast("double"),
        "near_other": (F.call_function("right", before, F.lit(32)).rlike(rf"\b({NEAR_OTHER})\b") | F.left(after, F.lit(16)).rlike(rf"\b({NEAR_OTHER})\b")).cast("double"),
        "assigned": before.rlike("[=:] ?[\"']?$").cast("double"),
        **{f"near_{k}": F.array_contains(near, F.lit(k).cast("long")).cast("double") for k in range(BUCKETS)},
    }


def labelled_findings(spark: SparkSession, rows: int = 3200) -> DataFrame:
    """secret, before, after, path and label (0 or 1), made by rule from row numbers."""
    kind, sha = F.col("id") % 16, F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 512)
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (F.conv(F.substring(sha, 100 + n, 4), 16, 10).cast("int") % len(of)) + 1)
    b64 = F.base64(F.unhex(sha))
    name = pick(["token =", "api_key:", "password =", "secret =", "auth token:", "the private key ="], 0)
    prose = pick(["of the", "and with", "les et", "der und", "see also", "on a"], 1)
    other = pick(["commit", "sha256", "checksum:", "request id", "etag:", "revision =", "md5 ="], 2)
    hexed = F.expr("substr(sha, 1, CASE id % 3 WHEN 0 THEN 32 WHEN 1 THEN 40 ELSE 64 END)")
    words = F.concat_ws("-", pick(PIECES[13:30], 3), pick(PIECES[22:44], 4), pick(PIECES[30:60], 5), F.conv(F.substring(sha, 1, 3), 16, 10))
    digits = F.lpad(F.conv(F.substring(sha, 1, 12), 16, 10), 16, "4")
    uuid = F.regexp_replace(F.substring(sha, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    blank = F.concat(pick(["your_api_key_", "example_token_", "xxxxxxxxxxxxxxxx", "placeholder_secret_", "changeme_changeme_"], 6), F.conv(F.substring(sha, 1, 2), 16, 10))
    path = F.concat_ws("/", F.lit(""), pick(["usr", "home", "var"], 7), pick(PIECES[18:40], 8), F.concat(pick(PIECES[18:40], 9), F.conv(F.substring(sha, 1, 3), 16, 10)))
    strong = F.element_at(F.array(hexed, F.regexp_replace(F.substring(b64, 1, 40), "[^A-Za-z0-9+/]", "x"), F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 3, 16))), F.concat(F.lit("ghp_"), F.regexp_replace(F.substring(b64, 1, 36), "[^A-Za-z0-9]", "q"))), (F.col("id") / 16 % 4).cast("int") + 1)
    letters = F.substring(F.regexp_replace(F.concat(b64, F.base64(F.unhex(F.sha2("sha", 256)))), "[^A-Za-z]", ""), 1, 28)
    long_word = F.concat(pick(PIECES[:20], 10), pick(PIECES[:30], 11), pick(PIECES[:20], 12), pick(PIECES[:30], 13), pick(PIECES[:20], 14), pick(PIECES[:9], 15))
    cased = F.when(F.col("id") % 3 == 0, F.upper(long_word)).when(F.col("id") % 3 == 1, F.initcap(long_word)).otherwise(long_word)
    again = F.substring(F.repeat(F.concat(pick(PIECES, 16), pick(PIECES, 17)), 40), 1, 400)
    made = spark.range(rows).withColumn("sha", sha)
    secret = F.when(kind.isin(12, 13), F.rpad(cased, 16, "a")).when(kind == 14, letters).when(kind == 15, again).otherwise(F.when(kind < 6, strong).when(kind == 6, hexed).when(kind == 7, uuid).when(kind == 8, blank).when(kind == 9, path).when(kind == 10, words).otherwise(digits))
    before = F.when((kind < 4) | (kind == 14), name).when(kind < 6, prose).when(kind.isin(6, 7), other).when(kind == 8, name).otherwise(F.when(F.col("id") % 24 < 12, prose).otherwise(other))
    source = F.when(F.col("id") % 5 == 0, F.when(((kind < 6) | (kind == 14)) & (F.col("id") % 2 == 0), "src/app").otherwise("tests/fixtures")).otherwise("src0")
    return made.select(secret.alias("secret"), before.alias("before"), prose.alias("after"), source.alias("path"), ((kind < 6) | (kind == 14)).cast("double").alias("label"))


def forest(findings: DataFrame, marks: bytes, trees: int = 25, depth: int = 6, seed: int = 11):
    """Train on the findings; gives a function from a struct of features to the share of trees that vote for a secret."""
    made = features(F.col("secret"), F.col("before"), F.col("after"), F.col("path"), marks)
    names = list(made)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(findings.select("label", *[v.alias(k) for k, v in made.items()]).coalesce(1)).select("label", "features").cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3, featureSubsetStrategy="onethird").fit(rows)
    rows.unpersist()

    def vote(lines: list[str], f: Column) -> Column:
        if m := re.match(r"\s*Predict: ([0-9.]+)", lines[0]):
            return F.lit(float(m[1]))
        m = re.match(r"(\s*)If \(feature (\d+) <= ([-0-9.E]+)\)", lines[0])
        other = next(i for i, x in enumerate(lines) if x.startswith(f"{m[1]}Else "))
        return F.when(f[names[int(m[2])]] <= float(m[3]), vote(lines[1:other], f)).otherwise(vote(lines[other + 1 :], f))

    written = [tree.toDebugString.splitlines()[1:] for tree in model.trees]
    return lambda f: reduce(lambda a, b: a + b, [vote(x, f) for x in written]) / len(written)


def findings(docs: DataFrame, labelled: DataFrame | None = None):
    """A function from (text, path) to array<struct<start, secret, score>> of all candidates; docs: the corpus that fills the dictionary."""
    marks = dictionary(docs)
    score = forest(labelled_findings(docs.sparkSession) if labelled is None else labelled, marks)

    def of(text: Column, path: Column) -> Column:
        seen = lambda c: F.struct(*[v.alias(k) for k, v in features(c["secret"], c["before"], c["after"], path, marks).items()])
        return F.transform(candidates(text), lambda c: F.struct(c["start"].alias("start"), c["secret"].alias("secret"), bound(seen(c), score).alias("score")))

    return of


def scored(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, secret and score of every candidate."""
    of = findings(docs, labelled)
    rows = docs.select("doc_id", F.explode(of(F.col("text"), F.col("source"))).alias("c"))
    return rows.select("doc_id", "c.start", "c.secret", "c.score")


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents with every secret in their texts replaced by MASK; all other columns stay, n_chars follows the text."""
    of = findings(docs, labelled)
    text = F.col("_row.text")

    def masked(found: Column) -> Column:
        starts, ends = F.transform(found, lambda x: x["start"]), F.transform(found, lambda x: x["start"] + F.length(x["secret"]))
        stretches = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(starts, F.array(F.length(text).cast("long"))), lambda a, b: F.call_function("substring", text, (a + 1).cast("int"), (b - a).cast("int")))
        return F.struct(F.when(F.size(found) > 0, F.array_join(stretches, MASK)).otherwise(text).alias("_text"), (F.size(found) > 0).alias("_found"))

    secrets = F.filter(of(text, F.col("_row.source")), lambda x: x["score"] >= THRESHOLD)
    # the result leaves a generator, so that no projection evaluates it twice
    rows = docs.select(F.struct("*").alias("_row")).select("_row", F.inline(F.array(bound(secrets, masked))))
    renewed = {"text": F.col("_text")} | ({"n_chars": F.when(F.col("_found"), F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {})
    return rows.select(*[renewed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op2(spark, sf_dir):
    """The findings that the forest takes for secrets."""
    found = scored(table(spark, sf_dir, "documents"))
    return found.where(F.col("score") >= THRESHOLD).select("doc_id", "start", F.length("secret").cast("long").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), "score")

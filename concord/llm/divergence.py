"""Operator 11: how far the sources of each language diverge, by systolic rotation.

Terms are counted in Arrow tasks and summed by (lang, source, term); a term is
kept where its language has it in `least` documents. The kept terms of a
language are cut into slices of about `SLICE` terms, so a cell, the counts of
one (lang, source) in one slice, is bounded whatever the vocabulary is. Cells are
compressed (delta ids and counts, zlib) and seated: a seat holds some sources of
a language and stays in its partition. The seats of a slice play a round-robin
tournament: in each round every seat meets one other, and one of the two sends
copies of its cells to the other's partition, which reads them in the order of
the rounds, one at a time. A meeting gives the difference of two sources once,
for both directions. A seat also meets the language's own counts, and keeps
the terms that lie furthest above them in a heap of `top` for each source.
What the slices give is summed, or merged, by keys.

Edge cases: null text, lang and source are ''; every (lang, source) that occurs
takes part, without terms too; a language without kept terms has differences
of 0; a source alone in its language has no pairs. Ties follow the UTF-8 order
of the item; repeated rows count each time; an empty table gives no rows; other
columns are dropped. Counts may reach 9 * 10^15 in fast arithmetic and are exact beyond.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import durable

#: Runs of letters: in UTF-8, bytes of A-Z, a-z and of all characters beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
PRIOR = 5  # added to each count
SLICE = 8192  # terms
SEATS = 8  # of a language, as long as a seat has room
ROOM = (4, 256)  # least and most sources in a seat; the matrix of a seat has at most ROOM[1] * SLICE numbers
HELD = 400_000  # counts that a task holds before it sends them on
BLOCK = 1 << 20  # bytes


def _terms(text: str) -> Iterator[list[bytes]]:
    data, start = text.encode().lower(), 0  # bytes.lower changes A-Z alone
    while start < len(data):
        cut = data.find(b" ", start + BLOCK)
        end = len(data) if cut < 0 else cut
        yield TERM.findall(data[start:end])
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                if n:
                    size = len(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(lang, size), pa.repeat(source, size), pa.array([t.decode() for t in n], pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(d.__getitem__, n), pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen: set[bytes] = set()
                for found in _terms(text):
                    n.update(found)
                    seen.update(found)
                d.update(seen)
                size += len(n)
                if size > HELD:
                    yield from send()
                    size = 0
        yield from send()

    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*empty).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exactly."""
    x = counts.astype(np.int64) + PRIOR
    if total >= 9 * 10**15:
        return np.array([1 + SCALE * int(c) // total for c in x], np.int64)
    whole, rest = np.divmod(x, total)
    for _ in range(3):  # three digits at a time
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def squeeze(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending ids as differences, with their counts."""
    gaps = np.diff(ids, prepend=0).astype("<u2")
    return zlib.compress(len(ids).to_bytes(4, "little") + gaps.tobytes() + counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if data is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ids = np.cumsum(np.frombuffer(raw, "<u2", n, 4), dtype=np.int64)
    return ids, np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 4 + 2 * n).reshape(8, n).T).view("<i8").ravel()


def squeezed(rows: DataFrame, *keys: str) -> DataFrame:
    """One compressed vector for each key, from rows with id (from 1) and n; a vector has at most a slice's terms."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, entries = batch.column(batch.num_columns - 1).offsets.to_numpy(), batch.column(batch.num_columns - 1).values
            ids, n = entries.field(0).to_numpy(), entries.field(1).to_numpy()
            out = [squeeze(ids[a:b], n[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*keys, "vector"])

    return grouped.mapInArrow(run, ", ".join(f"{k} {grouped.schema[k].dataType.simpleString()}" for k in keys) + ", vector binary")


def round_of(a: Column, b: Column, seats: Column) -> Column:
    """In which round of a tournament of so many seats two of them meet; each meets one other in a round, or none."""
    even = seats + seats % 2
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == even - 1, 2 * low % (even - 1)).otherwise((low + high) % (even - 1))


def host_of(a: Column, b: Column) -> Column:
    """Which of two seats stays at home when they meet; each does half of the times."""
    return F.when((a + b) % 2 == 1, F.least(a, b)).otherwise(F.greatest(a, b))


class Seat:
    """Sources of one slice and seat, in memory while its visitors pass."""

    def __init__(self, lang: str, slice_: int, totals: np.ndarray, n_total: int, kept: int, top: int):
        self.lang, self.slice, self.kept, self.top = lang, slice_, kept, top
        self.size, self.rows = len(totals), []
        self.own = shares(totals, n_total + PRIOR * kept) if len(totals) else totals
        self.sources: list[str] = []
        self.matrix = np.zeros((0, self.size), np.int64)

    def p(self, n_source: int, vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(every term's share in a source, ids that occur)."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, n = unsqueeze(vector)
        out = np.full(self.size, shares(np.zeros(1, np.int64), n_source + PRIOR * self.kept)[0])
        out[ids - 1] = shares(n, n_source + PRIOR * self.kept)
        return out, ids

    def admit(self, source: str, n_source: int, vector: bytes | None) -> None:
        """A resident: it meets those that sit already, and its heap is filled."""
        p, ids = self.p(n_source, vector)
        self.meet(source, p)
        self.sources.append(source)
        self.matrix = np.vstack([self.matrix, p])
        above = p[ids - 1] - self.own[ids - 1] if self.size else p
        best = np.lexsort((ids, -above))[: self.top]  # ids follow the order of the terms
        self.rows += [(self.lang, source, "term", "", self.slice, int(ids[i]), int(above[i])) for i in best if above[i] > 0]

    def meet(self, source: str, p: np.ndarray) -> None:
        for other, value in zip(self.sources, np.abs(self.matrix - p).sum(axis=1).tolist(), strict=True):
            self.rows.append((self.lang, source, "pair", other, 0, 0, value))
            self.rows.append((self.lang, other, "pair", source, 0, 0, value))


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("slice", pa.int64()), ("id", pa.int64()), ("value", pa.int64())])


def _tournament(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat, key = None, None
        for batch in batches:
            for lang, slice_, at, turn, _, source, n, kept, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turn == -2:
                    if seat and seat.rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, r, strict=True)) for r in seat.rows], FOUND)
                    seat, key = Seat(lang, slice_, unsqueeze(vector)[1], n, kept, top), (lang, slice_, at)
                elif key != (lang, slice_, at):
                    raise ValueError("a seat without its language's counts")
                elif turn == -1:
                    seat.admit(source, n, vector)
                else:
                    seat.meet(source, seat.p(n, vector)[0])
                if len(seat.rows) > 50_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, r, strict=True)) for r in seat.rows], FOUND)
                    seat.rows = []
        if seat and seat.rows:
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, r, strict=True)) for r in seat.rows], FOUND)

    return run


def audit(docs: DataFrame, least: int = 30, top: int = 50, slice_terms: int = SLICE, room: tuple[int, int] = ROOM) -> DataFrame:
    """lang, source, part, item, value, rank: see the module. Part `pair` has every other source of the language, `term` the `top` terms above the language."""
    by_term = Window.partitionBy("lang", "term")
    kept = durable(term_counts(docs).withColumn("df", F.sum("docs").over(by_term)).where(F.col("df") >= least).select("lang", "source", "term", "n"))

    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    ordinal = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = F.count("*").over(Window.partitionBy("lang"))
    per_seat = F.greatest(F.lit(room[0]), F.least(F.lit(room[1]), F.ceil(sources / SEATS)))
    groups = groups.select("lang", "source", ordinal.alias("ordinal"), F.floor(ordinal / per_seat).cast("int").alias("seat"), F.ceil(sources / per_seat).cast("int").alias("seats"))

    totals = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = totals.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("n_lang")).withColumn("slices", F.ceil(F.col("kept") / slice_terms).cast("int"))
    in_slice = Window.partitionBy("lang", "slice").orderBy("term")
    sliced = totals.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int")).repartition("lang", "slice")  # the join has dealt by language
    terms = durable(sliced.select("lang", "term", "slice", F.row_number().over(in_slice).alias("id"), "n"))

    cells = squeezed(kept.join(terms.drop("n"), ["lang", "term"]), "lang", "slice", "source")
    own = squeezed(terms, "lang", "slice")
    n_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    # every source sits in every slice of its language, and where nothing is kept in one slice of no terms
    seated = groups.join(langs, "lang", "left").join(n_source, ["lang", "source"], "left").na.fill(0, ["kept", "n_lang", "n_source"])
    seated = seated.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0)))))
    residents = durable(seated.join(cells, ["lang", "slice", "source"], "left"))

    row = lambda seat, turn, n: ("lang", "slice", seat.alias("seat"), turn.alias("turn"), "ordinal", "source", n.alias("n"), "kept", "vector")
    seat, other = F.col("seat"), F.col("other")
    visits = residents.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("seats") - 1))).where((other != seat) & (host_of(seat, other) == other))
    heads = residents.select("lang", "slice", "seat", "kept", "n_lang").distinct().join(own, ["lang", "slice"], "left").withColumn("ordinal", F.lit(0)).withColumn("source", F.lit(""))
    moves = (
        heads.select(*row(seat, F.lit(-2), F.col("n_lang")))
        .unionByName(residents.select(*row(seat, F.lit(-1), F.col("n_source"))))
        .unionByName(visits.select(*row(other, round_of(seat, other, F.col("seats")), F.col("n_source"))))
    )
    order = ["lang", "slice", "seat", "turn", "ordinal"]
    met = moves.repartition("lang", "slice", "seat").sortWithinPartitions(*order).mapInArrow(_tournament(top), "lang string, source string, part string, item string, slice long, id long, value long")
    met = durable(met)

    pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    above = met.where("part = 'term'").drop("item").join(terms.select("lang", "slice", "id", F.col("term").alias("item")), ["lang", "slice", "id"])
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(above.select("lang", "source", "part", "item", "value")).withColumn("rank", F.row_number().over(ranked))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11(spark, sf_dir):
    from concord.llm.common import table

    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT k) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept v USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
own AS (
  SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM cells GROUP BY lang, term
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN own USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""

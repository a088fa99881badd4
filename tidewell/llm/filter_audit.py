"""Filter interaction audit: what each of five filters removes in every order, and its Shapley share.

A document is a mask of the filters that it fails, so a part of the corpus is a table of at most 32 counts. From it
the removals of all 32 coalitions follow. What a filter removes at a step is the difference of two coalitions. Its
Shapley share solves the least squares problem of the coalition values with the Shapley kernel as weights, under the
constraint that the shares sum to the removals of all five. The normal equations depend on the number of filters
alone: they are solved once, in rationals, for each unit vector of values, so that the shares of any part are exact
sums of its coalition values.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

FILTERS = "ABCDE"
#: ASCII white space, which parts words.
SPACE = " \t\n\x0b\x0c\r"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions x of matrix · x = right, by exact elimination; ``right`` has a column for each system."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of ``n`` players the weight of every coalition's value (indexed by its bits) in the player's share.

    Least squares over the coalitions that are neither empty nor whole, with weights (n-1) / (C(n,s) s (n-s)), under
    sum of shares = value of all less value of none. One Lagrange multiplier joins the normal equations.
    """
    whole = (1 << n) - 1
    inner = [(m, Fraction(n - 1, comb(n, m.bit_count()) * m.bit_count() * (n - m.bit_count()))) for m in range(1, whole)]
    matrix = [[sum((w for m, w in inner if m >> i & m >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    # Values count from the empty coalition, so that its column is what is taken off all others.
    right = [[Fraction(0)] * (whole + 1) for _ in range(n + 1)]
    for m, w in inner:
        for i in range(n):
            if m >> i & 1:
                right[i][m] += w
                right[i][0] -= w
    right[n][whole], right[n][0] = Fraction(1), Fraction(-1)
    return solved(matrix, right)[:n] if n > 1 else [[Fraction(-1), Fraction(1)]]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fails`` (bits of filters A to D that the row's whole text fails) and ``same`` (its SHA-256).

    A null text counts as empty: too short (A), without repeated words (B), capitals (C) or signs (D).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    n, distinct = F.size("words__"), F.size(F.array_distinct("words__"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike("[#$%&*|]")]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return docs.withColumn("words__", words).withColumns({"fails": bits, "same": F.sha2(text, 256)}).drop("words__")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, fails (bits of all five filters), n, good, toxic: documents by part and mask.

    E fails where a smaller id has the same text anywhere in the table; rows of one id do not repeat each other, and a
    row without an id repeats nothing and is repeated by nothing. Several labels of a document count once (1 wins);
    a missing label is 0. A null part is the empty string. Counts are grouped before they meet their labels and before
    the copies of a text meet, so that a text, id or part that many rows share does not gather in one task.
    """
    rows = failures(docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")), "key", "text")
    what = ["same", "part", "fails"]
    known = labels.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    one = rows.groupBy("key", *what).agg(F.count(F.lit(1)).alias("n")).join(known, "key", "left").na.fill(0, ["good", "toxic"])
    kinds = one.groupBy(*what, "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("free"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("first"))
    least = kinds.groupBy("same").agg(F.min("first.key").alias("least"), F.collect_list(F.struct("part", "fails", "good", "toxic", "n", "free", "first")).alias("kinds"))
    each = least.select("least", F.inline("kinds"))
    kept = F.col("free") + F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.inline(F.array(F.struct(F.col("fails").alias("mask"), kept.alias("docs")), F.struct(F.col("fails").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - kept).alias("docs"))))
    counted = each.select("part", "good", "toxic", split)
    some = lambda c: F.sum(F.when(F.col(c) == 1, F.col("docs")).otherwise(0)).alias(c)
    return counted.groupBy("part", F.col("mask").alias("fails")).agg(F.sum("docs").alias("n"), some("good"), some("toxic"))


def coalitions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part and ``removed``, ``good``, ``toxic``: for each of the 2^n coalitions (by its bits) what it removes; ``only``: documents
    of exactly that mask. Coalition of all filters is the last entry; ``total`` counts all documents."""
    every = range(1 << len(filters))
    summed = lambda c, m: F.sum(F.when(F.col("fails").bitwiseAND(m) != 0, F.col(c)).otherwise(0))
    table_of = lambda c: F.array(*(summed(c, m) for m in every)).alias("removed" if c == "n" else c)
    only = F.array(*(F.sum(F.when(F.col("fails") == m, F.col("n")).otherwise(0)) for m in every)).alias("only")
    return counts.groupBy("part").agg(F.sum("n").alias("total"), table_of("n"), table_of("good"), table_of("toxic"), only)


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step: the counts of the step and 120 (n!) times the filter's Shapley share."""
    n = len(filters)
    shares = shapley_weights(n)
    scaled = [[w * factorial(n) for w in row] for row in shares]
    if any(w.denominator != 1 for row in scaled for w in row):
        raise ValueError("shares times n! are integers for every game of counts")
    share = lambda i: sum((F.col("removed")[m] * int(w) for m, w in enumerate(scaled[i]) if w), F.lit(0).cast("long"))
    plan: list[tuple] = []
    for order in permutations(range(n)):
        before, name = 0, "".join(filters[i] for i in order)
        for step, i in enumerate(order, 1):
            plan.append((len(plan), name, step, i, before, before | 1 << i))
            before |= 1 << i
    steps = found.sparkSession.createDataFrame(plan, "at int, filter_order string, step int, filter int, before int, after int")
    each = found.withColumn("shares", F.array(*(share(i) for i in range(n)))).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(plan) - 1)))).join(F.broadcast(steps), "at")
    gain = lambda c: F.col(c)[F.col("after")] - F.col(c)[F.col("before")]
    own = F.array(*(F.lit(1 << i) for i in range(n)))[F.col("filter")]
    return each.select(
        "part", "filter_order", "step", (F.col("total") - F.col("removed")[F.col("after")]).alias("kept"), gain("removed").alias("removed"), (F.col("removed")[own] - gain("removed")).alias("redundant"),
        F.col("only")[own].alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.col("shares")[F.col("filter")].alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(coalitions(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > least THEN 'E' END) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS BIGINT), 1) AS own, left(filter_order, CAST(step AS BIGINT) - 1) AS before FROM orders, range(1, 6) r(step)),
masks AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
hits AS (SELECT *, contains(fails, own) AS fail, before <> '' AND regexp_matches(fails, '[' || before || 'z]') AS gone FROM masks, steps),
counted AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fail AND NOT gone AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fail AND NOT gone AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""

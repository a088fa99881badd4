"""The given tables under the names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: id, title, description, location_text, workplace, published_at, updated_at."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    point = F.col("o_custkey")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.coalesce("c_name", F.lit("")).alias("company"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_mktsegment").alias("description"),
        F.col("n_name").alias("location_text"),
        workplace_of(F.col("o_orderpriority")).alias("workplace_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        (F.lit(-33.0) + (point * 37 % 280) / 10.0).alias("latitude"),
        (F.lit(-73.0) + (point * 91 % 380) / 10.0).alias("longitude"),
    )


def workplace_of(priority):
    """Spellings of workplaces in place of priorities."""
    return F.when(priority == "1-URGENT", "Remoto").when(priority == "2-HIGH", "híbrido").when(priority == "3-MEDIUM", "Presencial").when(priority == "4-NOT SPECIFIED", "remote")


WORKPLACE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Remoto' WHEN '2-HIGH' THEN 'híbrido' WHEN '3-MEDIUM' THEN 'Presencial' WHEN '4-NOT SPECIFIED' THEN 'remote' END"
OPPORTUNITIES_SQL = f"""
opportunities AS (
  SELECT o_orderkey AS id, coalesce(c_name, '') AS company, concat_ws(' ', o_orderpriority, c_mktsegment) AS title,
    c_mktsegment AS description, n_name AS location_text, {WORKPLACE_SQL} AS workplace_type, strftime(o_orderdate, '%Y-%m-%d') AS published_at,
    strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
    CAST(-33.0 AS DOUBLE) + CAST(o_custkey * 37 % 280 AS DOUBLE) / 10 AS latitude,
    CAST(-73.0 AS DOUBLE) + CAST(o_custkey * 91 % 380 AS DOUBLE) / 10 AS longitude
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: source, source_job_id (four-part key), opportunity_id, is_active, last_seen_at."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_returnflag").alias("source"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("source_job_id"),
        F.col("l_orderkey").alias("opportunity_id"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("last_seen_at"),
        F.col("l_partkey").cast("long").alias("check_key"),
    )


POSTINGS_SQL = """
postings AS (
  SELECT l_returnflag AS source, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS source_job_id,
    l_orderkey AS opportunity_id, l_linestatus = 'O' AS is_active, strftime(l_shipdate, '%Y-%m-%d') AS last_seen_at,
    CAST(l_partkey AS BIGINT) AS check_key
  FROM lineitem
)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability overlay: the verdict of every labelled document; part keys of postings are its ids."""
    x = table(spark, sf_dir, "labels")
    return x.select(F.col("doc_id").cast("long").alias("check_key"), verdict_of(F.col("quality"), F.col("toxic")).alias("verdict"))


def verdict_of(quality, toxic):
    return F.when(toxic == 1, "unverified").when(quality == 1, "open").otherwise("closed")


CHECKS_SQL = """
checks AS (
  SELECT CAST(doc_id AS BIGINT) AS check_key, CASE WHEN toxic = 1 THEN 'unverified' WHEN quality = 1 THEN 'open' ELSE 'closed' END AS verdict
  FROM labels
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each opportunity for each course: the best over its postings."""
    x = table(spark, sf_dir, "lineitem")
    return (
        x.select(F.col("l_orderkey").alias("opportunity_id"), F.concat(F.lit("course_"), F.pmod("l_partkey", F.lit(15)).cast("string")).alias("course_id"), F.round(F.col("l_discount") * 1000).cast("int").alias("score"))
        .groupBy("opportunity_id", "course_id")
        .agg(F.max("score").alias("score"))
    )


SCORES_SQL = """
scores AS (
  SELECT l_orderkey AS opportunity_id, 'course_' || CAST(l_partkey % 15 AS VARCHAR) AS course_id, max(CAST(round(l_discount * 1000) AS INTEGER)) AS score
  FROM lineitem GROUP BY 1, 2
)"""


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: source, source_job_id, title (first line), description, country."""
    d = table(spark, sf_dir, "documents")
    return d.select("source", F.col("doc_id").cast("string").alias("source_job_id"), "doc_id", F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("description"), F.upper("lang").alias("country"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of postings over time: user as posting, error as a bad check."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("posting_id"), "event_id", F.col("ts").alias("checked_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") == "error").alias("bad"), "event_type", "value", "props")


OBSERVATIONS_SQL = """
observations AS (
  SELECT user_id AS posting_id, event_id, ts AS checked_at, strftime(ts, '%Y-%m-%d') AS day, event_type = 'error' AS bad, event_type, value, props FROM events
)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings: the user is the address, the type of event the source, k of props gives the attributes."""
    e = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    user, k = F.col("user_id").cast("string"), F.col("k")
    return e.select(
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("source"),
        F.col("event_id").cast("string").alias("source_job_id"),
        F.concat(F.lit("https://Example.org/jobs/"), user, F.lit("?utm_source="), F.col("event_type")).alias("url"),
        F.when(F.col("user_id") % 9 == 0, "99jobs").otherwise(F.concat(F.lit("Maker "), (F.col("user_id") % 7).cast("string"))).alias("company"),
        F.concat(F.lit("Rôle "), (k % 2).cast("string")).alias("title"),
        F.when(k % 5 > 0, F.concat(F.lit("2026-01-0"), (k % 2 + 1).cast("string"))).alias("published_at"),
        F.when(k % 3 > 0, F.concat(F.lit("Town "), (k % 3).cast("string"))).otherwise("").alias("location"),
        F.lit(None).cast("string").alias("workplace_type"),
        F.lit(None).cast("string").alias("employment_type"),
        F.when(k % 4 > 1, F.concat(F.lit("text of "), user)).alias("description"),
        F.when(k >= 50, "north").alias("unit"),
        "k",
        "user_id",
        "ts",
    )


VISITS_SQL = """
visits AS (
  SELECT event_id AS pos, event_type AS source, CAST(event_id AS VARCHAR) AS source_job_id,
    'https://Example.org/jobs/' || user_id || '?utm_source=' || event_type AS url,
    CASE WHEN user_id % 9 = 0 THEN '99jobs' ELSE 'Maker ' || (user_id % 7) END AS company, 'Rôle ' || (k % 2) AS title,
    CASE WHEN k % 5 > 0 THEN '2026-01-0' || (k % 2 + 1) END AS published_at, CASE WHEN k % 3 > 0 THEN 'Town ' || (k % 3) ELSE '' END AS location,
    CASE WHEN k % 4 > 1 THEN 'text of ' || user_id END AS description, CASE WHEN k >= 50 THEN 'north' END AS unit, k, user_id, ts
  FROM (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)
)"""

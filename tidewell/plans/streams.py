"""Queries over payloads, page links and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.datasets import table
from tidewell.plans.base import query
from tidewell.sources import payloads
from tidewell.streaming import observations as st


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    last = lambda df: df.where(F.col("batch") == df.agg(F.max("batch")).first()[0]).drop("batch")
    counts = st.drained(spark, st.window_counts(st.stream(spark, sf_dir, "events.parquet")), "complete", "window-counts", last)
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_sightings(spark, sf_dir):
    return st.drained(spark, st.first_sightings(st.stream(spark, sf_dir, "events.parquet")), "append", "first-sightings")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type = 'error', (ts, event_id)) AS bad FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS run, max(day) OVER (PARTITION BY user_id) AS last FROM d)
SELECT user_id, strftime(max(last), '%Y-%m-%d') AS last_day, count(*) FILTER (bad AND run = top) AS bad_checks FROM (SELECT *, max(run) OVER (PARTITION BY user_id) AS top FROM r) GROUP BY 1""")
def stream_bad_streaks(spark, sf_dir):
    latest = lambda df: df.groupBy("user_id").agg(F.max_by(F.struct("last_day", "bad_checks"), "batch").alias("s")).select("user_id", "s.*")
    return st.drained(spark, st.bad_streaks(st.stream(spark, sf_dir, "events.parquet")), "update", "bad-streaks", latest)


@query("SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<template\\b[^>]*>.*?</template>', ' ', 'g'), '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"''][^\"'']*[\"''][^>]*>.*?</a>')) AS n FROM pages")
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    counts = payloads.links(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'gupy' AS source, CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority AS title, o_orderstatus || ', ' || CAST(o_custkey AS VARCHAR) AS location FROM orders")
def decode_payloads(spark, sf_dir):
    """Orders as payloads of up to a few items each, decoded again."""
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("city"), F.col("o_custkey").alias("state"))
    raw = table(spark, sf_dir, "orders").groupBy(F.lit("c").alias("company"), F.expr("o_orderkey div 8").alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("raw"))
    return payloads.decode(raw, "gupy").select("source", "source_job_id", "title", "location")

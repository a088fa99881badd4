"""Availability: coverage, audit queues, sticky verdicts, failure streaks, retirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIKES, PURGE_CHECKS, PURGE_DAYS = 3, 5, 14


def coverage(postings: DataFrame, checks: DataFrame) -> DataFrame:
    """Counts of verdicts over the active postings of each source."""
    rows = postings.where("is_active").join(checks, "check_key", "left")
    n = lambda cond: F.count_if(cond).alias
    return rows.groupBy("source").agg(
        F.count("*").alias("active"),
        n(F.col("verdict") == "open")("open"),
        n(F.col("verdict") == "closed")("closed"),
        n(F.col("verdict") == "unverified")("unverified"),
        n(F.col("verdict").isNull())("unchecked"),
    )


def fair_queue(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows taken in turn from all groups, each group in its own order.

    No group can give more than ``limit`` rows, so ranks beyond it are cut before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)


def stalest(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose last check is longest ago, those never checked first."""
    return rows.orderBy(F.coalesce("checked_at", F.lit("")), "last_seen_at", "source_job_id").limit(limit)


def sticky_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts after new checks: closed stays closed, else the new one counts."""
    a, b = old.withColumnsRenamed({"verdict": "old_verdict", "checked_at": "old_at"}), new.withColumnsRenamed({"verdict": "new_verdict", "checked_at": "new_at"})
    keep = (F.col("old_verdict") == "closed") | F.col("new_verdict").isNull()
    return a.join(b, keys, "full").select(*keys, F.when(keep, F.col("old_verdict")).otherwise(F.col("new_verdict")).alias("verdict"), F.when(keep, F.col("old_at")).otherwise(F.col("new_at")).alias("checked_at"))


def daily_checks(observations: DataFrame) -> DataFrame:
    """One check of each posting and UTC day: the first; so a key's rows are reduced before any window."""
    first = F.min_by(F.struct("bad"), F.struct("checked_at", "event_id"))
    return observations.groupBy("posting_id", "day").agg(first.alias("f")).select("posting_id", "day", F.col("f.bad").alias("bad"))


def bad_streaks(daily: DataFrame) -> DataFrame:
    """The running streak of bad days of each posting as of its last day: first_bad_day, last_day, bad_checks."""
    order = Window.partitionBy("posting_id").orderBy("day")
    runs = daily.withColumn("run", F.sum((~F.col("bad")).cast("int")).over(order))
    last = runs.groupBy("posting_id").agg(F.max("run").alias("run"), F.max("day").alias("last_day"))
    return (
        runs.where("bad").join(last, ["posting_id", "run"])
        .groupBy("posting_id", "last_day")
        .agg(F.min("day").alias("first_bad_day"), F.count("*").alias("bad_checks"))
    )


def retirement_stage(streaks: DataFrame) -> DataFrame:
    """watch, deactivate (after three strikes) or purge (five, over two weeks)."""
    days = F.datediff("last_day", "first_bad_day")
    stage = F.when((F.col("bad_checks") >= PURGE_CHECKS) & (days >= PURGE_DAYS), "purge").when(F.col("bad_checks") >= STRIKES, "deactivate").otherwise("watch")
    return streaks.withColumn("stage", stage)


def page_verdict(status: Column, html: Column, closed_notices: list[str], today: Column) -> Column:
    """Verdict of a recorded response: gone, notice of closure, past deadline, else open or unverified."""
    text = F.lower(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|template)[^>]*>.*?</\1>|<[^>]*\bhidden\b[^>]*>[^<]*", " "), "<[^>]+>", " "))
    expiry = F.try_to_date(F.regexp_extract(html, r'"validThrough"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1), "yyyy-MM-dd")
    notice = F.lit(False)
    for n in closed_notices:
        notice = notice | F.contains(text, F.lit(n.lower()))
    return F.when(status.isin(404, 410), "closed").when(status != 200, "unverified").when(notice | (expiry < today), "closed").when(expiry.isNotNull(), "open").otherwise("unverified")


def followups(postings: DataFrame, strikes: DataFrame, closed: DataFrame, purged: DataFrame, keys: list[str], today: str, limit: int) -> DataFrame:
    """Postings to look at again today: with strikes before those that only a check calls closed, then by the day of the
    last look. Purged ones and those looked at today are left out."""
    rows = postings.join(strikes.select(*keys, "bad_checks", "last_checked_day"), keys, "left").join(closed.select(*keys).distinct().withColumn("shut", F.lit(True)), keys, "left").join(purged.select(*keys), keys, "left_anti")
    struck = F.coalesce(F.col("bad_checks") > 0, F.lit(False))
    due = rows.where((struck | F.col("shut").isNotNull()) & (F.col("last_checked_day").isNull() | (F.col("last_checked_day") < today)))
    return due.orderBy(F.when(struck, 0).otherwise(1), F.coalesce("last_checked_day", F.lit("")), *keys).limit(limit)

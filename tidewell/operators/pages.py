"""Ordered pages: early stops, repeats, look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_page_stop(pages: DataFrame, scan: str, page: str, is_known: str, needed: int) -> DataFrame:
    """The page at which each scan may stop: the ``needed``-th known page in a row (a new one resets the count)."""
    order = Window.partitionBy(scan).orderBy(page)
    runs = pages.withColumn("__run", F.sum((~F.col(is_known)).cast("int")).over(order))
    in_run = Window.partitionBy(scan, "__run").orderBy(page)
    streaks = runs.where(is_known).withColumn("__streak", F.row_number().over(in_run))
    return streaks.where(F.col("__streak") == needed).groupBy(scan).agg(F.min(page).alias("stop_page"))


def longest_run(pages: DataFrame, scan: str, page: str, flag: str) -> DataFrame:
    order = Window.partitionBy(scan).orderBy(page)
    runs = pages.withColumn("__run", F.sum((~F.col(flag)).cast("int")).over(order)).where(flag)
    return runs.groupBy(scan, "__run").agg(F.count("*").alias("n")).groupBy(scan).agg(F.max("n").alias("longest_run"))


def repeated_pages(items: DataFrame, scan: str, page: str, item: str) -> DataFrame:
    """Pages whose set of ids an earlier page of the scan had: scan, page, first_page."""
    signature = items.groupBy(scan, page).agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.col(item).cast("string")))), 256).alias("signature"))
    first = signature.groupBy(scan, "signature").agg(F.min(page).alias("first_page"))
    return signature.join(first, [scan, "signature"]).where(F.col(page) > F.col("first_page")).select(scan, page, "first_page")


def pages_without_news(items: DataFrame, scan: str, page: str, item: str) -> DataFrame:
    """Pages all of whose ids earlier pages of the scan had: an id is news on its first page alone."""
    first = items.groupBy(scan, item).agg(F.min(page).alias("__first"))
    news = items.select(scan, page, item).distinct().join(first, [scan, item]).groupBy(scan, page).agg(F.count_if(F.col(page) == F.col("__first")).alias("n_new"))
    return news.where("n_new = 0").select(scan, page)


def blocks(lines: DataFrame, doc: str, line_no: str, is_head: str) -> DataFrame:
    """Number of the block of each line: a head line opens one; lines before the first have none (0)."""
    order = Window.partitionBy(doc).orderBy(line_no)
    return lines.withColumn("block", F.sum(F.col(is_head).cast("int")).over(order))


def labelled_values(lines: DataFrame, doc: str, line_no: str, text: str, labels: list[str]) -> DataFrame:
    """The line after each label line, unless that is a label as well."""
    order = Window.partitionBy(doc).orderBy(line_no)
    rows = lines.withColumn("value", F.lead(text).over(order))
    return rows.where(F.col(text).isin(*labels) & F.col("value").isNotNull() & ~F.col("value").isin(*labels)).select(doc, F.col(text).alias("label"), "value")


def probe_decisions(items: DataFrame, scan: str, page: str, item: str, needed: int) -> DataFrame:
    """The first decision of each scan: its page, whether a light scan is safe, and why.

    ``items`` has one row for each item of a page, or one with a null item for an empty page, and the flags ``known``,
    ``relevant`` and ``telling``. Decisions, in order: an empty page (safe if an earlier one had items), a page with
    the same items as an earlier one (not safe), an unknown item that matters or doesn't tell what it is (not safe),
    and ``needed`` pages without such (safe). A scan without a decision has null.
    """
    news = ~F.col("known") & (F.col("relevant") | ~F.col("telling"))
    each = items.groupBy(scan, page).agg(F.count(item).alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_set(item))), 256).alias("signature"), F.coalesce(F.bool_or(F.when(F.col(item).isNotNull(), news)), F.lit(False)).alias("news"))
    first = each.groupBy(scan, "signature").agg(F.min(page).alias("first_page"))
    turn = F.row_number().over(Window.partitionBy(scan).orderBy(page))
    rows = each.withColumn("turn", turn).join(first, [scan, "signature"])
    reason = F.when(F.col("n") == 0, "empty page").when(F.col("first_page") < F.col(page), "repeated page").when(F.col("news"), "news").when(F.col("turn") >= needed, "no news")
    safe = F.when(F.col("n") == 0, F.col("turn") > 1).otherwise(reason == "no news")
    decided = F.min_by(F.struct(F.col(page).alias("page"), safe.alias("safe"), reason.alias("reason")), F.when(reason.isNotNull(), F.col("turn")))
    return rows.groupBy(scan).agg(decided.alias("d")).select(scan, "d.page", "d.safe", "d.reason")


def looked_back(lines: DataFrame, doc: str, line_no: str, is_head: Column, is_mark: Column, reach: int) -> DataFrame:
    """``lines`` with ``mark``: for a head the number of the nearest earlier line that is a mark, at most ``reach`` rows back; else null.

    A null flag is false. Lines of one document that share a number are in no defined order.
    """
    before = Window.partitionBy(doc).orderBy(line_no).rowsBetween(-reach, -1)
    nearest = F.last(F.when(is_mark, F.col(line_no)), ignorenulls=True).over(before)
    return lines.withColumn("mark", F.when(is_head, nearest))


def next_actions(rows: DataFrame, doc: str, place: str, is_head: Column, is_action: Column, within: int) -> DataFrame:
    """``rows`` with ``action``: for a head the place of the first action after it, at most ``within`` rows on and before the next head; else null."""
    ahead = Window.partitionBy(doc).orderBy(place).rowsBetween(1, within)
    first_of = lambda flag: F.min(F.when(flag, F.col(place))).over(ahead)
    both = rows.withColumns({"__head": first_of(is_head), "__action": first_of(is_action)})
    found = F.col("__head").isNull() | (F.col("__action") < F.col("__head"))
    return both.withColumn("action", F.when(is_head & found, F.col("__action"))).drop("__head", "__action")

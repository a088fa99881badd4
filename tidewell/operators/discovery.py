"""Discovery on boards: links from listing to listing, what is reached over them, feeds and languages of a page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import urls as U
from tidewell.session import scratch, written
from tidewell.sources import html as H

#: Parts of the paths of listings, of searches among them, and of postings.
LISTING_PARTS = ("/go/", "/search/", "/viewalljobs/")
SEARCH_PART, POSTING_PART = "/search/", "/job/"
#: Languages that boards have by default, in the order in which they are asked.
LOCALES = ("en_GB", "en_US", "pt_BR", "de_DE", "es_ES")
#: Parts of the hosts that serve feeds, and the query of a feed.
FEED_HOSTS = ("successfactors.", "sapcloud.")
FEED_QUERY = "&career_ns=job_listing_summary&resultType=XML"


def _path(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A[^:/?#]+://[^/?#]*([^?#]*)", 1))


def _has_part(url: Column, parts: Iterable[str]) -> Column:
    path, found = _path(url), F.lit(False)
    for part in parts:
        found = found | F.contains(path, F.lit(part))
    return found


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, page_url, at, address: the absolute addresses of the links of pages, without fragments.

    Pages without an address or text have none. Rows of one key and address are one page.
    """
    page = F.struct(F.col(key).alias("key"), F.regexp_replace(F.trim(F.col(url)), "(?s)#.*", "").alias("url"))
    found = H.tokens(pages.select(page.alias("page"), F.col(html).alias("html")), "page", "html").where("kind = 1 and name = 'a'")
    each = H.settled(found.select("key.key", F.col("key.url").alias("page_url"), "at", "href"), ["key", "page_url", "at"], address=U.resolved(F.col("page_url"), F.col("href")))
    return each.where("address is not null")


def listing_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, from_url, to_url: links of pages to listings, each once."""
    found = anchors(pages, key, url, html).where(_has_part(F.col("address"), LISTING_PARTS))
    return found.select("key", F.col("page_url").alias("from_url"), F.col("address").alias("to_url")).distinct()


def starts(explicit: DataFrame, discovered: DataFrame, home: DataFrame) -> DataFrame:
    """tenant, url, method of the addresses at which boards are entered, from tables of tenant and url.

    Explicit addresses count before discovered ones; the home page of a board counts only where it has no others.
    """
    by_path = F.when(_has_part(F.col("url"), [SEARCH_PART]), "search").otherwise("go")
    known = explicit.select("tenant", "url", F.lit("explicit").alias("method")).unionByName(discovered.select("tenant", "url", by_path.alias("method"))).where(_enters(F.col("url")))
    only = home.select("tenant", "url", F.lit("home_listing").alias("method")).join(known.select("tenant"), "tenant", "left_anti")
    return known.unionByName(only)


def _enters(url: Column) -> Column:
    return F.coalesce(url != "", F.lit(False)) & ~_has_part(url, [POSTING_PART])


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """tenant, url, depth, method, discovered_from: all listings that a board's seeds lead to.

    ``seeds`` are tenant, url, method (depth 0, discovered from nothing); ``links`` tenant, from_url, to_url. A listing
    is found on the shortest way; of several pages that link to it at that depth the least address counts. Postings and
    blank addresses are not followed, boards do not mix, and null tenants have no listings. An empty table gives an empty one.

    Each round joins only the listings that the round before found with the links, cuts them to one row each before
    the shuffle, and drops those already known. Rounds run while the result is built, as many as the longest
    shortest way (or ``max_depth``); each is a table of the shared folder, so that a lost executor costs one round, and
    these tables are deleted at the end.
    """
    spark, keys = seeds.sparkSession, ["tenant", "url"]
    with scratch(spark) as put:
        edges = put(links.select("tenant", "from_url", "to_url").where(_enters(F.col("to_url")) & (F.col("from_url") != F.col("to_url"))).distinct(), "links")
        first = F.min_by("method", F.struct(F.col("method") != "explicit", "method")).alias("method")
        entered = seeds.where(_enters(F.col("url")) & F.col("tenant").isNotNull()).groupBy(*keys).agg(first)
        last = put(entered.select(*keys, F.lit(0).alias("depth"), "method", F.lit(None).cast("string").alias("discovered_from")), "frontier")
        found, depth = last, 0
        while (max_depth is None or depth < max_depth) and not last.isEmpty():
            depth += 1
            reached = edges.join(last.select("tenant", F.col("url").alias("from_url")), ["tenant", "from_url"]).groupBy("tenant", F.col("to_url").alias("url")).agg(F.min("from_url").alias("discovered_from"))
            new = reached.join(found.select(*keys), keys, "left_anti")
            method = F.when(_has_part(F.col("url"), [SEARCH_PART]), "search").otherwise("go")
            last = put(new.select(*keys, F.lit(depth).alias("depth"), method.alias("method"), "discovered_from"), "frontier")
            found = found.unionByName(last)
        return written(found, "listings")


def feeds(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", company: str | None = None, known: Iterable[str] = ()) -> DataFrame:
    """key, nth, url: addresses of XML feeds of each page, known ones first.

    A feed is built for each host that serves feeds, of the page or its links, and each company that the page's address, its
    links to such hosts or its text name; both are in order. ``known`` addresses count for every page.
    """
    serves = lambda c: F.coalesce(F.lower(F.regexp_extract(c, r"(?s)\A[^:/?#]+://([^/?#]*)", 1)).rlike("|".join(h.replace(".", r"\.") for h in FEED_HOSTS)), F.lit(False))
    root = lambda c: F.regexp_extract(c, r"(?s)\A[^:/?#]+://[^/?#]*", 0)
    asked = lambda c: F.regexp_extract(c, r"[?&]company=([^&#]+)", 1)
    to_feeds = anchors(pages, key, url, html).where(serves(F.col("address"))).groupBy("key").agg(F.collect_set(root(F.col("address"))).alias("hosts"), F.collect_set(asked(F.col("address"))).alias("companies"))
    text, page, none = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.array().cast("array<string>")
    named = F.concat(F.regexp_extract_all(text, F.lit(r"(?i)(?:[?&]|&amp;)company=([A-Za-z0-9_.-]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"""(?i)["']company(?:Id)?["']\s*[:=]\s*["']([A-Za-z0-9_.-]+)["']"""), F.lit(1)))
    own = pages.dropDuplicates([key]).select(F.col(key).alias("key"), F.when(serves(page), F.array(root(page))).otherwise(none).alias("own"), F.concat(named, F.array(asked(page), F.lit(company or ""))).alias("named"))
    both = own.join(to_feeds, "key", "left")
    tidy = lambda a, b: F.array_sort(F.filter(F.array_union(a, F.coalesce(b, none)), lambda x: x != ""))
    both = both.select("key", tidy(F.col("own"), F.col("hosts")).alias("hosts"), tidy(F.col("named"), F.col("companies")).alias("companies"))
    built = F.flatten(F.transform("hosts", lambda h: F.transform("companies", lambda c: F.concat(h, F.lit("/career?company="), F.url_encode(F.try_url_decode(c)), F.lit(FEED_QUERY)))))
    given = F.array(*map(F.lit, known)) if known else none
    return both.select("key", F.posexplode(F.array_distinct(F.concat(given, built))).alias("nth", "url"))


def locales(html: Column, configured: Iterable[str] = ()) -> Column:
    """The languages in which a board is asked: configured ones in their order, default ones in theirs, then those that the
    page names, by name. What isn't of the form xx_XX does not count; null counts as an empty page."""
    text = F.coalesce(html, F.lit(""))
    named = F.concat(F.regexp_extract_all(text, F.lit(r"(?:[?&]|&amp;)locale=([a-z]{2}_[A-Z]{2})\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"""/(?:\d+)-([a-z]{2}_[A-Z]{2})/?(?:[?'"#<]|$)"""), F.lit(1)))
    ahead = F.filter(F.array(*map(F.lit, [*configured, *LOCALES])), lambda x: x.rlike(r"\A[a-z]{2}_[A-Z]{2}\z"))
    return F.array_distinct(F.concat(ahead, F.array_sort(named)))

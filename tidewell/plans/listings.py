"""Queries on HTML: elements and links of pages, listing cards, look-back and pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.datasets import table
from tidewell.operators import pages as P
from tidewell.plans.base import query
from tidewell.sources import cards as C
from tidewell.sources import html as H

_BARE = r"regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"


@query(
    rf"""
WITH navs AS (SELECT page_id, regexp_extract({_BARE}, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
found AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs, regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM navs)
SELECT page_id, unnest(range(len(hrefs))) AS nth, unnest(hrefs) AS href, trim(unnest(texts)) AS text, 'nav' AS block FROM found
"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages with their texts and the block that they lie in."""
    return H.links(table(spark, sf_dir, "pages")).select(F.col("key").alias("page_id"), F.col("nth").cast("long").alias("nth"), "href", "text", "block")


@query(
    rf"""
WITH articles AS (SELECT page_id, regexp_extract({_BARE}, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
plain AS (
  SELECT page_id, body, replace(replace(replace(replace(regexp_replace(regexp_replace(body, '<[^>]*>', chr(1), 'g'), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM articles
)
SELECT page_id, CAST(len(regexp_extract_all(body, '<p>')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(body, '<b>')) AS BIGINT) AS n_bold,
  list_aggregate(list_filter(list_transform(string_split(text, chr(1)), lambda t: trim(t)), lambda t: t <> ''), 'string_agg', ' ') AS text
FROM plain
"""
)
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page as its elements give it: paragraphs (most never closed), bold parts, and all its text."""
    found = H.elements(table(spark, sf_dir, "pages"))
    article = H.first(F.filter("elements", lambda e: e["name"] == "article"))
    count = lambda name: F.size(H.inside(F.col("elements"), F.col("article"), name)).cast("long")
    return found.withColumn("article", article).select(F.col("key").alias("page_id"), count("p").alias("n_paragraphs"), count("b").alias("n_bold"), H.inner_text(F.col("texts"), F.col("article")).alias("text"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages: one for each customer, its orders as cards in the layout of one of four sites."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    key, id_, nation = F.col("c_custkey"), F.col("o_orderkey").cast("string"), F.translate("n_name", "_0123456789", " ABCDEFGHIJ")
    title = F.concat(F.lit("Vaga &amp; "), F.initcap(F.col("c_mktsegment")))
    put = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    cards = [
        put('<article><a href="/empresa/jobs/', id_, '-x?utm_source=t"><h3>', title, "</h3><span>Estágio</span><span>Presencial</span><span>", nation, ", BR</span><span>Casa ", key.cast("string"), "</span><span>4.3</span><span>Eu quero!</span></a></article>"),
        put('<li><h2><a class=t href="/vagas/v', id_, '/vaga">', title, "</a></h2><span>em</span><div>Casa ", key.cast("string"), "<br></div><p>", nation, " / BR</li>"),
        put("<div><h3>", title, "</h3><p>na cidade ... ", F.initcap(nation), "/BR Híbrido<p>R$ 1.200,00<p>publicada 12/03/2026<a href='/BR/vaga/estagio/", id_, "/nome-da-vaga'>Quero esta vaga</a></div>"),
        put("<ul><li><h4>", title, '</h4><span>R$ 900</span> <span>jovem aprendiz</span><A HREF="/vagas/', id_, '000#topo">ver</A></ul>'),
    ]
    layout = (key % 4).cast("int")
    card = F.element_at(F.array(*cards), layout + 1)
    pages = rows.groupBy(key.alias("page_id"), layout.alias("layout")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("card")))), lambda s: s["card"]), "\n").alias("body"))
    return pages.select("page_id", "layout", put("<html><nav><a href='/vagas/'><b>Vagas</b></a></nav><script>var t='<a href=\"/jobs/1\">';</script><main>", F.col("body"), "</main>").alias("html"))


@query(
    """
WITH rows AS (
  SELECT c_custkey AS page_id, c_custkey % 4 AS layout, CAST(o_orderkey AS VARCHAR) AS id, 'Vaga & ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title, translate(n_name, '_0123456789', ' ABCDEFGHIJ') AS nation,
    array_to_string(list_transform(string_split(translate(n_name, '_0123456789', ' ABCDEFGHIJ'), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS town
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)
SELECT page_id, CASE layout WHEN 0 THEN '99jobs' WHEN 1 THEN 'vagas_com' WHEN 2 THEN 'iel' ELSE 'walljobs' END AS source,
  CASE layout WHEN 2 THEN 'iel:BR:' || id WHEN 3 THEN 'walljobs:' || id || '000' ELSE id END AS source_job_id, title,
  CASE layout WHEN 0 THEN 'https://www.99jobs.com/empresa/jobs/' || id || '-x' WHEN 1 THEN 'https://www.vagas.com.br/vagas/v' || id || '/vaga' WHEN 2 THEN 'https://carreiras.iel.org.br/BR/vaga/estagio/' || id || '/nome-da-vaga' ELSE 'https://app.walljobs.com.br/vagas/' || id || '000' END AS url,
  CASE layout WHEN 2 THEN 'IEL / empresa anunciante' WHEN 3 THEN 'WallJobs / empresa anunciante' ELSE 'Casa ' || page_id END AS company,
  CASE layout WHEN 0 THEN nation || ', BR' WHEN 1 THEN nation || ' / BR' WHEN 2 THEN town || ', BR' ELSE '' END AS location,
  CASE layout WHEN 0 THEN 'Estágio' WHEN 2 THEN 'internship' WHEN 3 THEN 'apprentice' END AS employment_type, CASE layout WHEN 0 THEN 'Presencial' WHEN 2 THEN 'hybrid' END AS workplace_type,
  CASE layout WHEN 2 THEN 'R$ 1.200,00' WHEN 3 THEN 'R$ 900' END AS salary, CASE layout WHEN 2 THEN '2026-03-12' END AS published_at
FROM rows
"""
)
def decode_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of listing pages in four layouts."""
    pages = listing(spark, sf_dir)
    rows = None
    for i, (source, shape) in enumerate(C.CARDS.items()):
        found = H.decode_cards(pages.where(F.col("layout") == i), shape, source).drop("description")
        rows = found if rows is None else rows.unionByName(found)
    return rows


@query(
    r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS at FROM documents),
heads AS (SELECT * FROM lines WHERE length(line) < 60), marks AS (SELECT * FROM lines WHERE regexp_matches(line, '[0-9]'))
SELECT h.doc_id, h.at, max(m.at) AS mark FROM heads h LEFT JOIN marks m ON m.doc_id = h.doc_id AND m.at BETWEEN h.at - 3 AND h.at - 1 GROUP BY h.doc_id, h.at
"""
)
def look_back_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each short line of a document the nearest of the three lines before it that has a number."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    head = F.length("line") < 60
    return P.looked_back(lines, "doc_id", "at", head, F.col("line").rlike("[0-9]"), 3).where(head).select("doc_id", F.col("at").cast("long").alias("at"), F.col("mark").cast("long").alias("mark"))


@query(
    rf"""
WITH tags AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<(h1|p|b|footer)\b', 1)) AS name, unnest(range(len(regexp_extract_all({_BARE}, '<(h1|p|b|footer)\b', 1)))) AS spot FROM pages),
heads AS (SELECT *, lead(spot) OVER (PARTITION BY page_id ORDER BY spot) AS stop FROM tags WHERE name IN ('h1', 'b'))
SELECT h.page_id, h.spot AS at, min(t.spot) AS action FROM heads h LEFT JOIN tags t ON t.page_id = h.page_id AND t.name = 'footer' AND t.spot > h.spot AND t.spot <= h.spot + 20 AND (h.stop IS NULL OR t.spot < h.stop) GROUP BY h.page_id, h.spot
"""
)
def heading_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and bold parts of pages with the footer that follows within 20 tags and before the next of them."""
    found = H.elements(table(spark, sf_dir, "pages"))
    tags = found.select(F.col("key").alias("page_id"), F.posexplode(F.filter("elements", lambda e: e["name"].isin("h1", "p", "b", "footer"))).alias("at", "e"))
    head = F.col("e.name").isin("h1", "b")
    rows = P.next_actions(tags, "page_id", "at", head, F.col("e.name") == "footer", 20).where(head)
    return rows.select("page_id", F.col("at").cast("long").alias("at"), F.col("action").cast("long").alias("action"))

"""HTML pages as elements, and listing cards as posting rows.

A page becomes two arrays: its elements in order of their start tags, each with the end of its extent, and its pieces
of text. A helper reads each page once, in tasks, from Arrow batches (:mod:`tidewell.sources.tree`): an element's end is
the closing tag at its own depth among tags of its name, and an element that is never closed ends where the closed
element around it does. Elements carry how many texts and elements precede their start and end, so that what lies inside
one is a slice of the arrays; what encloses it is found by containment of intervals. All rules on elements and cards are
columns. Pages are shuffled once by key.

A closing tag whose start lies outside the enclosing element is matched by name all the same. Scripts, styles,
comments and declarations hold no text. A null page has no elements. Keys name pages: rows that share one count once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.sources.tree import ELEMENTS, VOID, read_pages

HEADINGS = ("h1", "h2", "h3", "h4")

_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\z)|</?[a-z][^\s/>]*+[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>|<[!?][^>]*+>|[^<]++|<"""


def settled(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns computed once: filters on them stay above, where else they would compute them again below."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _dealt(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and html, one row for each key."""
    # A page's tokens take many times its bytes and its cards much more time: a count that is named is not merged by bytes.
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").dropDuplicates(["key"])


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, kind (1 start, -1 end, 0 text), name, href, classes, text, empty (an element that has no content)."""
    found = _dealt(pages, key, html)
    each = found.select("key", F.posexplode(F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    name = F.when(F.col("token").startswith("<"), F.lower(F.regexp_extract("token", r"\A</?([A-Za-z][^\s/>]*)", 1)))
    each = settled(each, each.columns, name=F.nullif(name, F.lit(""))).where("name is null or name not in ('script', 'style')").where("name is not null or not (token like '<!%' or token like '<?%')")
    kind = F.when(F.col("name").isNull(), 0).when(F.col("token").startswith("</"), -1).otherwise(1)
    plain = F.when(F.col("name").isNull(), F.trim(F.regexp_replace(T.unescape(F.col("token")), r"(?U)\s+", " ")))
    each = settled(each, ["key", "at", "name"], kind=kind, text=plain, token=F.when(kind == 1, F.col("token"))).where("name is not null or text <> ''")
    empty = F.col("token").endswith("/>") | F.col("name").isin(*sorted(VOID))
    return each.select("key", "at", "kind", "name", "text", F.coalesce(empty, F.lit(False)).alias("empty"), attribute(F.col("token"), "href").alias("href"), F.lower(attribute(F.col("token"), "class")).alias("classes"))


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, ``elements`` (at, stop, name, href, classes and the counts that slices need) and ``texts`` of each page.

    A link has the places of the elements around it as ``up``, unless they are many.
    """
    found = _dealt(pages, key, html)
    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(read_pages, f"key {kind}, {ELEMENTS}")


def attribute(of: Column, name: str) -> Column:
    """The value of an attribute of a start tag, unescaped; null where it has none."""
    value = F.regexp_extract(of, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = F.when(value.startswith('"') | value.startswith("'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.when(F.lower(of).contains(name) & (value != ""), T.unescape(bare))


def inner_text(texts: Column, e: Column) -> Column:
    """All text inside an element, pieces joined by a space."""
    return F.array_join(F.slice(texts, e["texts"] + 1, F.greatest(e["texts_end"] - e["texts"], F.lit(0))), " ")


def inner_texts(texts: Column, e: Column) -> Column:
    return F.slice(texts, e["texts"] + 1, F.greatest(e["texts_end"] - e["texts"], F.lit(0)))


def inside(all_elements: Column, e: Column, *names: str) -> Column:
    """Elements of some names within an element, in order: those that start between its start and its end."""
    within = F.slice(all_elements, e["starts"] + 1, e["inner_end"] - e["starts"])
    return F.filter(within, lambda x: x["name"].isin(*names)) if names else within


def ancestors(all_elements: Column, e: Column) -> Column:
    """Elements around an element, nearest first."""
    sought = F.reverse(F.filter(F.slice(all_elements, 1, e["starts"] - 1), lambda x: x["stop"] > e["at"]))
    return F.when(e["up"].isNotNull(), F.transform(e["up"], lambda i: F.get(all_elements, i))).otherwise(sought)


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def links(pages: DataFrame, key: str = "page_id", html: str = "html", blocks: tuple[str, ...] = ("nav", "article", "footer", "div", "main", "header")) -> DataFrame:
    """Links of pages: key, nth, href, text, and ``block``, the name of the nearest enclosing element of ``blocks``."""
    found = elements(pages, key, html)
    each = found.select("key", "elements", "texts", F.posexplode(F.filter("elements", lambda e: (e["name"] == "a") & e["href"].isNotNull())).alias("nth", "e"))
    around = F.filter(ancestors(F.col("elements"), F.col("e")), lambda x: x["name"].isin(*blocks))
    return each.select("key", "nth", "e.href", inner_text(F.col("texts"), F.col("e")).alias("text"), first(around)["name"].alias("block"))


Rule = Callable[[Column, Column, Column], Column]
Row = dict[str, Column]


def nearest(*tags: str, levels: int | None = None, when: Rule | None = None) -> Rule:
    """Card rule: the nearest ancestor with one of the tags (any, if none is given) at most ``levels`` up for which ``when`` holds."""

    def rule(e: Column, all_elements: Column, texts: Column) -> Column:
        up = F.slice(F.col("up"), 1, levels) if levels else F.col("up")
        named = F.filter(up, lambda x: x["name"].isin(*tags)) if tags else up
        return first(F.filter(named, lambda x: when(x, all_elements, texts)) if when else named)

    return rule


def text_of_length(least: int, most: int) -> Rule:
    return lambda x, _, texts: F.length(inner_text(texts, x)).between(least, most)


def holds(*names: str, at_most: int | None = None) -> Rule:
    if at_most is not None:
        return lambda x, all_elements, _: F.size(inside(all_elements, x, *names)) <= at_most
    return lambda x, all_elements, _: F.size(inside(all_elements, x, *names)) > 0


def has_class(classes: Column, *words: str) -> Column:
    """Whether one class of a class attribute has all the words in it."""
    ahead = "".join(rf"(?=\S*{w})" for w in words)
    return F.coalesce(classes.rlike(rf"(?:^|\s){ahead}"), F.lit(False))


@dataclass(frozen=True)
class CardShape:
    """How one source lists postings: which links count, what card a link lies in, and what the card's text says.

    ``marks`` are flags of elements: rules find them as columns, arrays that have one for each element. Functions of ``title`` sources,
    ``keep`` and ``fields`` get a row: address, url, title, description, pieces, looks and the fields before them.
    """

    base: str
    #: Pattern over the absolute address (without fragment); its first group is the id, unless ``identity`` gives it.
    link: str
    #: Rules for the card in order; the link's parent is the last resort, or the link itself.
    card: tuple[Rule, ...]
    fall_back_to_link: bool = False
    marks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: Where to look for the title, in order: headings of the "link", of the "card", the link's "text", the address's "slug".
    title: tuple[str, ...] = ("card",)
    headings: tuple[str, ...] = HEADINGS
    #: Headings that can be titles, over their text.
    heading: Callable[[Column], Column] = lambda text: F.lit(True)
    slug: Callable[[Column], Column] | None = None
    clean_url: Callable[[Column], Column] | None = None
    identity: Callable[[Column], Column] | None = None
    #: Whether a link looks like a posting; rows that ``keep`` does not hold for are left out.
    looks: Rule | None = None
    keep: Callable[[Row], Column] | None = None
    fields: dict[str, Callable[[Row], Column]] = field(default_factory=dict)


FIELDS = ("company", "location", "employment_type", "workplace_type", "salary", "published_at")


def decode_cards(pages: DataFrame, shape: CardShape, source: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Posting rows of listing pages: key, source, source_job_id, title, url, description (the card's text) and the shape's fields.

    Of the links of a page with one id the first counts. Links without title or id are left out; a null page has none.
    """
    found = elements(pages, key, html).withColumns({n: F.transform("elements", of) for n, of in shape.marks.items()})
    is_link = lambda e: (e["name"] == "a") & e["href"].isNotNull()
    addressed = F.transform(F.filter("elements", is_link), lambda e: F.struct(e.alias("e"), U.joined(shape.base, e["href"]).alias("address")))
    each = found.select(*found.columns, F.posexplode(F.filter(addressed, lambda x: x["address"].rlike(shape.link))).alias("nth", "link")).select(*found.columns, "nth", "link.*")
    e, all_elements, texts = F.col("e"), F.col("elements"), F.col("texts")
    each = settled(each, each.columns, up=ancestors(all_elements, e))
    last = e if shape.fall_back_to_link else first(F.col("up"))
    each = settled(each, each.columns, card=F.coalesce(*(rule(e, all_elements, texts) for rule in shape.card), last, e))
    heading = lambda x: F.nullif(first(F.filter(F.transform(inside(all_elements, x, *shape.headings), lambda h: inner_text(texts, h)), shape.heading)), F.lit(""))
    titles = {"link": heading(e), "card": heading(F.col("card")), "text": F.nullif(inner_text(texts, e), F.lit("")), "slug": shape.slug(F.col("address")) if shape.slug else F.lit(None)}
    looks = shape.looks(e, all_elements, texts) if shape.looks else F.lit(True)
    title = F.coalesce(*(titles[t] for t in shape.title), F.lit(""))
    rows = settled(each, ["key", "nth", "address"], looks=looks, title=title, description=inner_text(texts, F.col("card")), pieces=inner_texts(texts, F.col("card")))
    row: Row = {n: F.col(n) for n in ("address", "url", "title", "description", "pieces", "looks")}
    rows = settled(rows, rows.columns, url=shape.clean_url(F.col("address")) if shape.clean_url else F.col("address"))
    rows = settled(rows, rows.columns, source_job_id=F.nullif(shape.identity(F.col("url")) if shape.identity else F.regexp_extract("address", shape.link, 1), F.lit("")))
    kept = (F.col("title") != "") & F.col("source_job_id").isNotNull()
    rows = rows.where(kept & shape.keep(row) if shape.keep else kept)
    # Fields take longest: they are computed in as many tasks as pages are read in.
    rows = rows.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key", "source_job_id").orderBy("nth"))).where("turn = 1")
    for name, f in shape.fields.items():
        rows = rows.withColumn(name, f(row).cast("string"))
        row[name] = F.col(name)
    missing = {n: F.lit(None).cast("string") for n in FIELDS if n not in row}
    return rows.withColumns(missing).select(F.col("key").alias(key), F.lit(source).alias("source"), "source_job_id", "title", "url", "description", *FIELDS)

"""Payloads of recruiting systems to posting rows.

A payload shape is data: where its items lie and which paths hold each field. All shapes share one
plan over variants: parse once, explode the items, take the first path that has a value. HTTP is
not part of the engine; payloads come as rows (company, raw).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.dates import epoch_to_iso
from tidewell.functions.text import workplace

FIELDS = ("source_job_id", "title", "location", "url", "description", "published_at", "employment_type", "workplace_type")


@dataclass(frozen=True)
class Shape:
    """Paths are variant paths below an item; the first that isn't empty counts. ``joined`` ones are put together."""

    items: tuple[str, ...]
    fields: dict[str, tuple[str, ...]]
    joined: dict[str, tuple[str, ...]] = field(default_factory=dict)
    epoch: tuple[str, ...] = ()
    #: items whose path has one of these values (lower case) are left out
    drop: tuple[str, tuple[str, ...]] | None = None
    #: whether an id that is missing may be the item's position
    position_id: bool = False


#: Item lists and field paths of the payloads.
SHAPES: dict[str, Shape] = {
    "lever": Shape(("$",), {"source_job_id": ("$.id",), "title": ("$.text",), "location": ("$.categories.location",), "url": ("$.hostedUrl",), "description": ("$.descriptionPlain",), "published_at": ("$.createdAt",), "employment_type": ("$.categories.commitment",), "workplace_type": ("$.workplaceType",)}, epoch=("published_at",)),
    "ashby": Shape(("$.jobs",), {"source_job_id": ("$.jobUrl", "$.applyUrl"), "title": ("$.title",), "location": ("$.location",), "url": ("$.jobUrl", "$.applyUrl"), "description": ("$.descriptionPlain",), "published_at": ("$.publishedAt",), "employment_type": ("$.employmentType",), "workplace_type": ("$.workplaceType",)}, drop=("$.isListed", ("false",)), position_id=True),
    "greenhouse": Shape(("$.jobs",), {"source_job_id": ("$.id",), "title": ("$.title",), "location": ("$.location.name",), "url": ("$.absolute_url",), "description": ("$.content",), "published_at": ("$.updated_at",)}),
    "gupy": Shape(("$.data", "$.jobs", "$.results"), {"source_job_id": ("$.id",), "title": ("$.name",), "url": ("$.jobUrl",), "description": ("$.description",), "published_at": ("$.publishedDate",), "employment_type": ("$.type",), "workplace_type": ("$.workplaceType",)}, joined={"location": ("$.city", "$.state", "$.country")}),
    "workday": Shape(("$.jobPostings",), {"source_job_id": ("$.bulletFields[0]", "$.externalPath"), "title": ("$.title",), "location": ("$.locationsText",), "url": ("$.externalPath",), "published_at": ("$.postedOn",)}),
    "smartrecruiters": Shape(("$.content",), {"source_job_id": ("$.id", "$.uuid"), "title": ("$.name",), "url": ("$.ref",), "published_at": ("$.releasedDate",), "employment_type": ("$.typeOfEmployment.label",)}, joined={"location": ("$.location.city", "$.location.region", "$.location.country")}),
    "inhire": Shape(("$.jobsPage", "$.data.jobsPage"), {"source_job_id": ("$.jobId",), "title": ("$.displayName",), "location": ("$.location",), "workplace_type": ("$.workplaceType",)}, drop=("$.status", ("closed", "canceled", "archived"))),
    "izirh": Shape(("$.result.data",), {"source_job_id": ("$.id",), "title": ("$.name",), "location": ("$.city",), "published_at": ("$.createdAt",), "employment_type": ("$.typeContraction.name",), "workplace_type": ("$.workModel.name",)}, epoch=("published_at",)),
    "eightfold": Shape(("$.data.positions",), {"source_job_id": ("$.id",), "title": ("$.name",), "location": ("$.locations[0]",), "url": ("$.positionUrl",), "published_at": ("$.postedTs",), "workplace_type": ("$.workLocationOption",)}, epoch=("published_at",)),
    "successfactors": Shape(("$.jobSearchResult",), {"source_job_id": ("$.response.id",), "title": ("$.response.unifiedStandardTitle",), "location": ("$.response.jobLocationShort[0]",), "url": ("$.response.unifiedUrlTitle",), "published_at": ("$.response.unifiedStandardStart",)}),
}


def _text(item: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(item, path, "string")), F.lit(""))


def decode(payloads: DataFrame, source: str, shape: Shape | None = None) -> DataFrame:
    """Posting rows of payloads (company, raw) of one source.

    Broken JSON and items without title and id are left out; a payload without any known item list is
    an error, so that a changed format does not pass for an empty one.
    """
    s = shape or SHAPES[source]
    v = F.try_parse_json("raw")
    lists = [F.try_variant_get(v, p, "array<variant>") for p in s.items]
    found = F.coalesce(*lists)
    drift = F.when(v.isNotNull() & found.isNull(), F.raise_error(F.lit(f"{source}: no known item list"))).otherwise(found)
    items = payloads.select("company", F.posexplode(drift).alias("position", "item"))
    if s.drop:
        path, values = s.drop
        items = items.where(~F.coalesce(F.lower(_text(F.col("item"), path)).isin(*values), F.lit(False)))
    columns = {}
    for name in FIELDS:
        paths = s.joined.get(name)
        if paths:
            value = F.nullif(F.concat_ws(", ", *(_text(F.col("item"), p) for p in paths)), F.lit(""))
        elif s.fields.get(name):
            value = F.coalesce(*(_text(F.col("item"), p) for p in s.fields[name]))
        else:
            value = F.lit(None).cast("string")
        columns[name] = F.coalesce(epoch_to_iso(value), value) if name in s.epoch else value
    if s.position_id:
        columns["source_job_id"] = F.coalesce(columns["source_job_id"], F.col("position").cast("string"))
    rows = items.select(F.lit(source).alias("source"), "company", *(c.alias(n) for n, c in columns.items()))
    kind = F.lower("workplace_type")
    kind = F.when(kind.isNull(), None).when(workplace(kind) != "unknown", workplace(kind)).otherwise(kind)
    return rows.where("title is not null and source_job_id is not null").withColumn("workplace_type", kind)


#: Names that feeds use for each field.
XML_ALIASES = {"source_job_id": ("jobid", "id", "reqid", "guid"), "title": ("title", "jobtitle"), "location": ("location", "city"), "url": ("url", "link"), "description": ("description",), "published_at": ("pubdate", "date", "posteddate")}


def read_xml_feed(spark, path: str, row_tag: str, company: str, source: str) -> DataFrame:
    """Posting rows of an XML feed, whatever of the known names its elements have."""
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    have = {c.lower().replace("-", "").replace("_", ""): c for c in rows.columns}
    pick = lambda names: F.coalesce(*(F.col(f"`{have[n]}`").cast("string") for n in names if n in have), F.lit(None).cast("string"))
    return rows.select(F.lit(source).alias("source"), F.lit(company).alias("company"), *(pick(names).alias(field) for field, names in XML_ALIASES.items())).where("title is not null")


def json_ld_postings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Fields of the first JobPosting in a page's JSON-LD scripts, inside lists and @graph as well."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    blobs = pages.select(key, F.posexplode(scripts).alias("no", "raw")).withColumn("v", F.try_parse_json("raw"))
    nodes = F.coalesce(F.try_variant_get("v", "$.@graph", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    each = blobs.where("v is not null").select(key, "no", F.posexplode(nodes).alias("at", "n")).where(_text(F.col("n"), "$.@type") == "JobPosting")
    fields = (("title", "title"), ("datePosted", "published_at"), ("validThrough", "valid_through"), ("employmentType", "employment_type"), ("hiringOrganization.name", "company"), ("description", "description"))
    first = each.groupBy(key).agg(F.min(F.struct("no", "at", *(_text(F.col("n"), f"$.{p}").alias(a) for p, a in fields))).alias("p"))
    return first.select(key, "p.title", "p.published_at", "p.valid_through", "p.employment_type", "p.company", "p.description")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, href, text) of a page's anchors; scripts, styles and comments hold none."""
    visible = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1>", " ")
    pattern = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""")
    pairs = F.arrays_zip(F.regexp_extract_all(visible, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(visible, pattern, F.lit(2)).alias("text"))
    rows = pages.select(key, F.posexplode(pairs).alias("position", "a"))
    return rows.select(key, "position", "a.href", F.trim(F.regexp_replace(F.regexp_replace("a.text", "<[^>]+>", " "), r"\s+", " ")).alias("text"))

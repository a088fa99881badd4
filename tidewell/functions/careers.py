"""Rules on the titles, statuses, payload fields and addresses of postings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import has_phrase, normalize

#: Words that mark a title as one for the start of a career.
EARLY_CAREER = (
    "estagio", "estagiario", "intern", "internship", "summer", "ferias", "verao", "trainee", "aprendiz", "apprentice", "junior", "entry level",
    "graduate", "co-op", "coop", "new grad", "working student", "student", "research", "thesis", "temporary", "seasonal",
)
#: Statuses that end a posting, and the sources whose status counts.
TERMINAL = ("closed", "canceled", "cancelled", "encerrada", "cancelada")
STATUS_SOURCES = ("gupy_global", "gupy_public", "gupy_api")
#: Evidence that a page is gone.
GONE = ("http_404", "http_410")
#: Titles that say nothing.
EMPTY_TITLES = ("job", "vaga", "position", "opportunity")
#: Weights of what a reference has.
TITLE_WEIGHT, LOCATION_WEIGHT, TITLE_STEP, LONGEST_TITLE = 3, 2, 50, 100


def _given(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def is_early_career(title: Column, terms: Iterable[str] = EARLY_CAREER) -> Column:
    """Whether a title holds one of the terms between blanks."""
    return has_phrase(normalize(title), [t.lower() for t in terms])


def is_seasonal(title: Column, employment: Column, description: Column, terms: Iterable[str], job_type: Column | None = None) -> Column:
    """Whether the system says so, or a term stands between blanks in title, employment or description."""
    told = normalize(job_type) == "vacancy_type_summer" if job_type is not None else F.lit(False)
    return told | has_phrase(normalize(F.concat_ws(" ", title, employment, description)), [t.lower() for t in terms])


def is_terminal(source: Column, status: Column, closed_at: Column) -> Column:
    """Whether the source itself calls a posting closed."""
    told = F.coalesce(F.lower(F.trim(status)).isin(*TERMINAL), F.lit(False)) | _given(closed_at)
    return F.coalesce(source.isin(*STATUS_SOURCES), F.lit(False)) & told


def is_missing_page(source: Column, url: Column, evidence: Column, safe: Column) -> Column:
    """Whether a response says that a posting is gone: a safe address that isn't found, but for addresses of the old
    form, which vanish though the posting stays open."""
    old_form = source.isin(*STATUS_SOURCES) & F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).startswith("/jobs/")
    return F.coalesce(evidence.isin(*GONE) & safe & ~old_form, F.lit(False))


def is_telling_title(title: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (t != "") & ~t.isin(*EMPTY_TITLES) & t.rlike(r"\p{L}")


def reference_quality(title: Column, location: Column, url: Column, published_at: Column) -> Column:
    """How much a listing says about a posting."""
    has = lambda c: _given(c).cast("int")
    length = F.least(F.length(F.coalesce(title, F.lit(""))), F.lit(LONGEST_TITLE))
    return TITLE_WEIGHT * has(title) + LOCATION_WEIGHT * has(location) + has(url) + has(published_at) + F.floor(length / TITLE_STEP).cast("int")


def title_from_slug(slug: Column) -> Column:
    """Words of an address's last segment, the first letter as a capital."""
    plus = F.replace(F.coalesce(slug, F.lit("")), F.lit("+"), F.lit("%2B"))
    words = F.regexp_replace(F.coalesce(F.try_url_decode(plus), slug, F.lit("")), "[-_]", " ")
    return F.trim(F.regexp_replace(F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))), r"(?U)\s+", " "))


def board_parts(url: Column, site: Column | None = None) -> Column:
    """Struct (tenant, locale, site, api) of a Workday board's address, null for others."""
    pattern = r"(?i)^([a-z]*)://([a-z0-9_-]+)\.(wd[0-9]+)\.myworkdayjobs\.com(?:/([^?#]*))?(?:[?#].*)?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    segments = F.filter(F.split(part(4), "/"), lambda s: s != "")
    first = F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit(""))
    localised = first.rlike(r"^[a-z]{2}[-_][A-Z]{2}$")
    named = F.coalesce(F.nullif(F.trim(site), F.lit("")) if site is not None else F.lit(None), F.try_element_at(segments, F.when(localised, 2).otherwise(1)))
    origin = F.regexp_extract(url, r"^[^/]*//[^/?#]+", 0)
    api = F.concat(origin, F.lit("/wday/cxs/"), part(2), F.lit("/"), named, F.lit("/jobs"))
    return F.when(url.rlike(pattern) & named.isNotNull(), F.struct(part(2).alias("tenant"), F.when(localised, first).otherwise("").alias("locale"), named.alias("site"), api.alias("api")))


def portal_job_id(url: Column) -> Column:
    """Number of a posting from /jobs/<number> or the Base64 JSON of /job/<token> on a host of gupy.io, else null."""
    path = F.regexp_extract(F.trim(url), r"(?i)^https://[^/?#@:]+\.gupy\.io(?::443)?(/[^?#]*)", 1)
    old = F.regexp_extract(path, r"^/jobs/([0-9]{1,16})/?$", 1)
    token = F.translate(F.regexp_extract(path, r"^/job/([A-Za-z0-9_-]{16,512})={0,2}/?$", 1), "-_", "+/")
    # whole groups of four are needed
    padded = F.rpad(token, (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(padded, F.lit("base64"))
    data = F.when(F.length(raw) <= 500, F.try_validate_utf8(raw.cast("string")))
    number = F.get_json_object(data, "$.jobId")
    whole = (F.get_json_object(data, "$.source") == "gupy_portal") & number.rlike("^[1-9][0-9]{0,15}$") & data.rlike(r'"jobId"\s*:\s*[0-9]')
    return F.when(old != "", old).when(whole, number)


def course_score_map(payload: Column) -> Column:
    """Courses and scores of a JSON payload; a score that is no number of 0 to 100 is an error."""
    raw = F.from_json(F.get_json_object(payload, "$.course_scores"), "map<string,string>")
    number = lambda v: v.try_cast("double")
    valid = lambda k, v: F.when(F.floor(number(v)).between(0, 100), F.floor(number(v)).cast("int")).otherwise(F.raise_error(F.concat(F.lit("score outside 0..100 for course "), k)).cast("int"))
    named = F.map_filter(F.transform_keys(F.coalesce(raw, F.create_map().cast("map<string,string>")), lambda k, v: F.trim(k)), lambda k, v: k != "")
    return F.transform_values(named, valid)


def intent_list(payload: Column) -> Column:
    """Intents of a JSON payload, trimmed, distinct and sorted."""
    raw = F.from_json(F.get_json_object(payload, "$.detected_intents"), "array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")))


def lines(text: Column) -> Column:
    """Lines with single blanks; empty ones are left out."""
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda l: F.trim(F.regexp_replace(l, r"(?U)\s+", " ")))
    return F.array_join(F.filter(tidy, lambda l: l != ""), "\n")

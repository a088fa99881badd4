"""Canonical addresses, stable ids and shard numbers as Column builders."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import once

#: Query parameters that only track a visit.
TRACKING = r"(?s)^(fbclid|gclid|mc_cid|mc_eid|utm_.*)$"
#: Query parameters and path segments that name one posting.
ID_PARAMETERS = ("jobid", "job_id", "requisitionid", "gh_jid", "reqid")
ID_PARENTS = ("job", "jobs", "vagas")
_WEB = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def _decoded(text: Column) -> Column:
    """Percent signs and plus signs decoded; text that isn't well encoded stays."""
    return F.coalesce(F.try_url_decode(text), text)


def _key(pair: Column) -> Column:
    return F.lower(_decoded(F.substring_index(pair, "=", 1)))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, the query without tracking; path, fragment and other parameters stay as they are.

    Null, other schemes than http and https, no host, and credentials give an empty string.
    """
    # an array of one element holds the trimmed address, which each of its uses would compute anew
    raw = F.array(F.translate(F.trim(F.coalesce(url, F.lit(""))), "\t\r\n", ""))
    return F.get(F.transform(raw, _canonical), F.lit(0))


def _canonical(raw: Column) -> Column:
    """Cut at the first number sign, then at the first question mark and the third slash: no expression is matched for parts."""
    led = lambda sign, text: F.when(text != "", F.concat(F.lit(sign), text)).otherwise("")
    base = F.substring_index(raw, "#", 1)
    head = F.substring_index(base, "?", 1)
    origin = F.substring_index(head, "/", 3)
    rest = lambda whole, part: F.substr(whole, F.length(part) + 2)
    kept = F.array_join(F.filter(F.split(rest(base, head), "&"), lambda p: ~_key(p).rlike(TRACKING)), "&")
    query = F.when(base.contains("?"), led("?", kept)).otherwise("")
    whole = F.concat(F.lower(origin), F.substr(head, F.length(origin) + 1), query, F.when(raw.contains("#"), led("#", rest(raw, base))).otherwise(""))
    # with a host and without a name or password before it
    return F.when(raw.rlike("(?is)^https?://(:?@)?[^/?#@:][^/?#@]*(?![^/?#])"), whole).otherwise("")


_ID = r"(v?\p{Nd}+([-_][^/]+)?|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"


def names_posting(canonical: Column) -> Column:
    """Whether a canonical address names one posting: its last path segment, or one right below a segment for jobs, is a
    number (a "v" before or a text after it may stand) or a UUID, or a parameter for ids has a value."""
    return F.get(F.transform(F.array(canonical), _names), F.lit(0))


def _names(canonical: Column) -> Column:
    base = F.substring_index(canonical, "#", 1)
    head = F.substring_index(base, "?", 1)
    path = F.substr(head, F.length(F.substring_index(head, "/", 3)) + 1)
    query = F.split(F.substr(base, F.length(head) + 2), "&")
    in_path = path.rlike(rf"(?s)(^|/){_ID}/*$|/({'|'.join(ID_PARENTS)})/{_ID}(/|$)")
    return in_path | F.exists(query, lambda p: _key(p).isin(*ID_PARAMETERS) & p.rlike("(?s)^[^=]*=."))


def detail_url(url: Column) -> Column:
    """The canonical address where it :func:`names_posting`, else null."""
    canonical = canonical_url(url)
    return F.when(names_posting(canonical), canonical)


def catalogue_address(url: Column) -> Column:
    """Host without "www." and decoded lower-case path without closing slashes, for lookups of pasted addresses.

    Paths that hold case-sensitive tokens (below /job/ on hosts of gupy.io) keep their case.
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"(?is)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[^/?#]*)?([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(raw, pattern, 1)), r"^www\.", "")
    # a plus sign in a path is a plus sign
    path = F.regexp_replace(_decoded(F.replace(F.regexp_extract(raw, pattern, 2), F.lit("+"), F.lit("%2B"))), "/+$", "")
    return F.concat(host, F.when(host.endswith(".gupy.io") & path.startswith("/job/"), path).otherwise(F.lower(path)))


def native_id(url: Column) -> Column:
    """The last run of at least four digits, else the last path segment, else a hash of the address."""
    runs = F.regexp_extract_all(url, F.lit(r"(\d{4,})"), F.lit(1))
    tail = F.element_at(F.filter(F.split(F.coalesce(_part(url, "PATH"), F.lit("")), "/"), lambda s: s != ""), -1)
    return F.coalesce(F.try_element_at(runs, F.lit(-1)), F.when(F.size(F.filter(F.split(F.coalesce(_part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")) > 0, tail), F.substring(F.sha1(url), 1, 16))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(_part(url, "HOST")), r"^www\.", "")


def is_safe_url(url: Column, hosts: Iterable[str] | None = None) -> Column:
    """http or https with a public host name, and one of ``hosts`` or below it where they are given."""
    host = url_host(url)
    scheme = F.lower(_part(url, "PROTOCOL")).isin("http", "https")
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|\[)") | host.rlike(r"\.(local|internal|localhost)$")
    named = F.lit(True)
    if hosts is not None:
        named = F.lit(False)
        for h in hosts:
            named = named | (host == h) | host.endswith("." + h)
    return F.coalesce(scheme & host.isNotNull() & ~private & named, F.lit(False))


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a name (by default in the URL namespace)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def stable_id(source: Column, source_id: Column) -> Column:
    """UUID of the compact JSON list [source, id]."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return uuid5(F.concat(F.lit("["), quoted(source), F.lit(","), quoted(source_id), F.lit("]")))


def shard_number(key: Column, shards: int) -> Column:
    """The first eight bytes of a SHA-256, modulo ``shards``: the same on any machine."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(shards)).cast("int")


def joined(base: str, href: Column) -> Column:
    """The absolute address of a link on a page at ``base``, without fragment; null stays null."""
    parts = urlsplit(base)
    return _absolute(*map(F.lit, (parts.scheme, parts.netloc, parts.path, parts.query)), href)


def resolved(base: Column, href: Column) -> Column:
    """:func:`joined` where each row has its own base; null where that is no http or https address."""
    part = lambda i: F.regexp_extract(base, _WEB, i)
    return F.when(part(2) != "", _absolute(F.lower(part(1)), part(2), part(3), part(4), href))


def _absolute(scheme: Column, host: Column, path: Column, query: Column, href: Column) -> Column:
    root, folder = F.concat(scheme, F.lit("://"), host), F.concat(F.regexp_replace(path, r"/?[^/]*\z", ""), F.lit("/"))

    def whole(link: Column) -> Column:
        return (
            F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link == "", F.concat(root, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
            .when(link.startswith("?"), F.concat(root, path, link))
            .otherwise(F.concat(root, folder, link))
        )

    made = once(F.regexp_replace(F.trim(href), "(?s)#.*", ""), whole)
    return once(made, lambda url: F.when(url.rlike(r"/\.\.?(?:[/?]|\z)"), _without_dots(url)).otherwise(url))


def _without_dots(url: Column) -> Column:
    """An address whose path has no ``.`` and ``..`` segments."""
    head, path, query = (F.regexp_extract(url, r"(?s)\A([^:]*://[^/?]*)([^?]*)(.*)\z", i) for i in (1, 2, 3))
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    tidy = F.aggregate(F.slice(F.split(path, "/"), 2, F.length(path) + 1), F.array().cast("array<string>"), step)
    closing = F.when(path.rlike(r"/\.\.?\z") & (F.size(tidy) > 0), "/").otherwise("")
    return F.concat(head, F.lit("/"), F.array_join(tidy, "/"), closing, query)

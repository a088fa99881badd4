"""Listing layouts of recruiting sites, as data for :func:`tidewell.sources.html.decode_cards`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.operators.pages import looked_back, next_actions
from tidewell.sources.html import HEADINGS, CardShape, Row, ancestors, elements, has_class, holds, inner_text, inner_texts, inside, nearest, text_of_length

#: Words of listing cards and what they stand for, in the order in which they count.
PORTAL_LEVELS = (("Estágio", ("estágio", "estagio")), ("Trainee", ("trainee",)), ("Aprendiz", ("aprendiz",)), ("Júnior", ("júnior", "junior")))
PORTAL_PLACES = (("Híbrido", ("híbrid", "hibrid")), ("Remoto", ("remota", "remoto")), ("Presencial", ("presencial",)))
LEVELS = (("apprentice", ("aprendiz",)), ("trainee", ("trainee",)), ("internship", ("estagio", "estagiario")))
PLACES = (("hybrid", ("hibrid",)), ("remote", ("home office", "remot")), ("on-site", ("presencial",)))
PLACE_MARKS = r"(?i)^.*(?:presencial|h[ií]brid[oa]|remot[oa])"
COMPANIES_OF_HOSTS = {"gruposmartfit": "Grupo Smart Fit", "vagasgrupodpsp": "Grupo DPSP", "carreiras": "99jobs"}
NO_COMPANIES = ("em", "de", "da", "do", "das", "dos", "para", "por", "estagio", "estagio em", "vaga", "vagas", "publicidade", "mais relevantes", "mais recentes", "candidatar se", "candidatar-se", "descricao", "descricao da vaga", "requisitos", "beneficios", "remoto", "remota", "hibrido", "hibrida", "presencial")
GENERIC_HOSTS = ("carreiras", "career", "careers", "jobs", "vagas", "talentos")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def _last(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _label(text: Column, rules: tuple) -> Column:
    return T.once(text, lambda held: T.first_match(held, rules, None))


def without_first(text: Column, part: Column) -> Column:
    """A text with the first occurrence of a part taken out, white space collapsed."""

    def cut(at: Column) -> Column:
        rest = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(part), F.length(text)))
        return F.when((at > 0) & (part != ""), rest).otherwise(text)

    return F.trim(F.regexp_replace(T.once(F.instr(text, part), cut), r"\s+", " "))


def _titled(slug: Column) -> Column:
    return F.nullif(F.initcap(F.trim(F.translate(slug, "-_", "  "))), F.lit(""))


# One portal whose postings lie on its own hosts or elsewhere --------------------------------------------------

_PORTAL_BASE = "https://www.99jobs.com/opportunities/search"
_PORTAL_HOST = r"(?i)^https?://(?:[^/?#]*\.)?99jobs\.com(?::\d+)?(?:[/?#]|$)"
_PORTAL_ID = r"(?i)^[^?]*/(?:jobs|vagas)/(\d+)(?:[-/?]|$)"


def _portal_id(url: Column) -> Column:
    hosted = F.when(url.rlike(_PORTAL_HOST), F.nullif(F.regexp_extract(url, _PORTAL_ID, 1), F.lit("")))
    return F.coalesce(hosted, F.concat(F.lit("external-"), F.substring(F.sha2(url, 256), 1, 20)))


def _portal_url(url: Column) -> Column:
    return F.when(url.rlike(_PORTAL_HOST), F.regexp_replace(url, r"\?.*$", "")).otherwise(U.canonical_url(url))


def _card_class(e: Column) -> Column:
    return has_class(e["classes"], "opportunity", "card")


def _posting(e: Column) -> Column:
    # an address names a posting only where the link does
    address = F.when((e["name"] == "a") & e["href"].rlike("(?i)(?:jobs|vagas)/"), U.joined(_PORTAL_BASE, e["href"]))
    return (e["name"] == "a") & (_card_class(e) | F.coalesce(address.rlike(_PORTAL_ID), F.lit(False)))


def _lone_posting(x: Column, *_) -> Column:
    inner = F.slice(F.col("postings"), x["starts"] + 1, x["inner_end"] - x["starts"])
    return _card_class(x) | (x["name"].isin("li", "article") & (F.size(F.filter(inner, lambda p: p)) == 1))


def _portal_looks(e: Column, all_elements: Column, texts: Column) -> Column:
    telling = F.lower(inner_text(texts, e)).rlike("eu quero|ver oportunidade|presencial|remot[oa]|h[ií]brid[oa]")
    own = F.coalesce(e["classes"].rlike(r"(?:^|\s)opportunity-card(?:\s|$)"), F.lit(False))
    return own | (telling & (F.size(inside(all_elements, e, *HEADINGS)) > 0))


def portal_company(row: Row) -> Column:
    """The company that stands between place and rating; else that of the address; else the last words in capitals."""
    rest, url = row["rest"], row["url"]
    rated = _found(rest, r"(?i)(?:Não informado|[A-Za-zÀ-ÿ .'-]{2,60}(?:,|\s+-)\s*[A-Z]{2})\s+(.{2,100}?)\s+\d(?:[.,]\d+)?\s+(?:Eu quero!?|Ver Oportunidade)(?![\wÀ-ÿ])")
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]*)", 1))
    own = host.isin("99jobs.com", "www.99jobs.com")
    before = F.lower(F.regexp_extract(url, r"(?i)^https?://[^/]*/(?:[^/?#]+/)*?([^/?#]+)/jobs(?:[/?#]|$)", 1))
    of_path = F.when(own & ~before.isin("opportunities", "jobs", "vagas"), _titled(before))
    sub = F.substring_index(host, ".", 1)
    known = F.create_map(*(F.lit(x) for pair in COMPANIES_OF_HOSTS.items() for x in pair))
    of_sub = F.when(host.endswith(".99jobs.com") & ~own, F.coalesce(known[sub], _titled(sub)))
    labels = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    part = F.when((F.size(labels) >= 3) & host.endswith(".com.br"), F.try_element_at(labels, F.lit(-3))).when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(labels[0])
    of_host = F.when((host != "") & ~host.rlike(r"(?:^|\.)99jobs\.com$"), _titled(F.when(part.isin(*GENERIC_HOSTS), labels[0]).otherwise(part)))
    capitals = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(r"(?<![\wÀ-ÿ])[A-ZÁÉÍÓÚÂÊÔÃÕÇ][A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9 &.\-]{3,80}(?![\wÀ-ÿ])"), F.lit(0)), F.trim), lambda c: ~F.upper(c).isin("ESTÁGIO", "TRAINEE", "PRESENCIAL", "REMOTO", "REMOTA", "HÍBRIDO", "HÍBRIDA"))
    return F.coalesce(rated, of_path, of_sub, of_host, F.try_element_at(capitals, F.lit(-1)), F.lit("99jobs"))


def portal_location(row: Row) -> Column:
    """City and state after the last word for a workplace."""
    parts = lambda rest: (F.regexp_extract(rest, r"([A-Za-zÀ-ÿ .'-]{2,60}?)\s*(?:,|-)\s*([A-Z]{2})(?![\wÀ-ÿ])", i) for i in (1, 2))
    told = lambda rest: T.once(F.struct(*(p.alias(n) for n, p in zip(("city", "state"), parts(rest)))), lambda t: F.when(t["state"] != "", F.concat(F.trim(t["city"]), F.lit(", "), t["state"])).otherwise(""))
    return T.once(F.regexp_replace(row["description"], PLACE_MARKS, ""), told)


PORTAL = CardShape(
    base=_PORTAL_BASE,
    link=r"(?i)^https?://",
    marks={"postings": _posting},
    card=(lambda e, *_: F.when(_card_class(e), e), nearest(levels=4, when=_lone_posting)),
    fall_back_to_link=True,
    title=("link", "card", "text"),
    clean_url=_portal_url,
    identity=_portal_id,
    looks=_portal_looks,
    keep=lambda row: (F.length(row["title"]) >= 3) & ((row["url"].rlike(_PORTAL_HOST) & row["url"].rlike(_PORTAL_ID)) | row["looks"]),
    fields={
        "rest": lambda row: without_first(row["description"], row["title"]),
        "company": portal_company,
        "location": portal_location,
        "employment_type": lambda row: _label(F.lower(row["description"]), PORTAL_LEVELS),
        "workplace_type": lambda row: _label(F.lower(row["description"]), PORTAL_PLACES),
    },
)


# A board with lines for company and place after the title --------------------------------------------------------


def _is_place(text: Column) -> Column:
    return text.rlike(r"(?<![\wÀ-ÿ]).+\s*/\s*[A-Z]{2}(?![\wÀ-ÿ])|(?<![\wÀ-ÿ]).+\s+-\s+[A-Z]{2}(?![\wÀ-ÿ])")


def _after_title(pieces: Column, title: Column) -> Column:
    at = F.greatest(F.array_position(pieces, title), F.lit(1)).cast("int")
    return F.slice(pieces, at + 1, 19)


def board_location(row: Row) -> Column:
    near = F.get(F.filter(_after_title(row["pieces"], row["title"]), _is_place), F.lit(0))
    city, state = (F.regexp_extract(row["description"], r"([A-Za-zÀ-ÿ .'-]{2,60})\s*/\s*([A-Z]{2})", i) for i in (1, 2))
    return F.coalesce(near, F.when(state != "", F.concat(F.trim(city), F.lit(" / "), state)), F.lit(""))


def board_company(row: Row) -> Column:
    """The first line after the title that can be a company: no place, amount, age, number or word of the page itself."""

    def fits(line: Column) -> Column:
        low, text = line["key"], line["text"]
        plain = (F.length(low) >= 3) & (F.length(text) <= 120) & ~low.isin(*NO_COMPANIES) & (low != row["title_key"]) & ((row["location"] == "") | (low != row["place_key"]))
        return plain & ~_is_place(text) & ~text.rlike(r"(?i)(?<![\wÀ-ÿ])R\$\s*\d") & ~low.rlike(r"\bha\s+\d+\s+(?:dias?|horas?)\b|^\d+[+]?$")

    keyed = F.transform(_after_title(row["pieces"], row["title"]), lambda t: F.struct(t.alias("text"), T.normalize(t).alias("key")))
    return F.coalesce(F.get(F.filter(keyed, fits), F.lit(0))["text"], F.lit("Empresa não identificada"))


BOARD = CardShape(
    base="https://www.vagas.com.br",
    link=r"/vagas/v(\d+)/",
    card=(nearest("li"), nearest("article"), nearest(levels=6, when=lambda x, a, t: text_of_length(31, 3499)(x, a, t) & holds("h2", "h3", at_most=10)(x, a, t))),
    title=("text",),
    fields={
        "location": board_location,
        "title_key": lambda row: T.normalize(row["title"]),
        "place_key": lambda row: T.normalize(row["location"]),
        "company": board_company,
        "employment_type": lambda row: F.when(T.normalize(F.concat_ws(" ", row["title"], F.substring(row["description"], 1, 500))).rlike(r"estagio|internship|\bintern\b"), "Estágio"),
    },
)


# Boards whose cards are found by what they hold ---------------------------------------------------------------------

_HOLDING_CARD = (nearest("article", "li", "div", when=lambda x, a, t: (x["name"] != "div") | (text_of_length(20, 3500)(x, a, t) & holds("h1", "h2", "h3", "h4", "strong")(x, a, t))),)


def text_location(text: Column) -> Column:
    """City and state of the last such pair of a text."""
    out: Column = F.lit(None).cast("string")
    for pattern in (r"([A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ][A-Za-zÀ-ÿ .'-]{1,80})\s*[,/|\-]\s*([A-Z]{2})(?![\wÀ-ÿ])", r"([A-ZÁÀÂÃÉÊÍÓÔÕÚÜÇ][A-Za-zÀ-ÿ .'-]{1,80}),\s*([A-Z]{2}),\s*Brasil(?![\wÀ-ÿ])"):
        city = F.regexp_replace(_last(text, pattern, 1), r"^[ \-|,]+|[ \-|,]+$", "")
        city = F.trim(F.regexp_replace(city, r"(?i)^.*(?<![\wÀ-ÿ])(?:Estágio|Trainee|Aprendiz|Presencial|Híbrido|Remoto|place)(?![\wÀ-ÿ])", ""))
        state = _last(text, pattern, 2)
        out = F.coalesce(out, F.concat(F.nullif(city, F.lit("")), F.lit(", "), state))
    return F.coalesce(out, F.lit(""))


def regional_location(text: Column) -> Column:
    """City and state before a word for the workplace; a company in capitals before the city is left out."""
    pattern = r"(?i)([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ .'-]{1,80})\s*/\s*([A-Z]{2})\s+(?:Presencial|H[ií]brido|Remoto)(?![\wÀ-ÿ])"
    city = F.trim(F.regexp_replace(_last(text, pattern, 1), r"^.*\.\.\.", ""))
    bare = lambda c: F.when(c.rlike(r"\p{Ll}"), F.regexp_replace(c, r"^(?:[^\p{Ll}\s]*\p{Lu}[^\p{Ll}\s]*\s+)+(?=.)", "")).otherwise(c)
    told = T.once(_last(text, pattern, 2), lambda state: F.when(state != "", F.concat(T.once(city, bare), F.lit(", "), F.upper(state))))
    return F.coalesce(told, text_location(text))


REGIONAL = CardShape(
    base="https://carreiras.iel.org.br/",
    link=r"(?i)^https?://[^/?]+/[A-Z]{2}/vaga/(?:[^/?]+/)?(\d+)(?:/[^/?]+)?/?(?:\?.*)?$",
    card=_HOLDING_CARD,
    title=("card", "slug"),
    headings=("h2", "h3", "h4", "strong"),
    heading=lambda text: (text != "") & (F.length(text) <= 140) & ~T.normalize(text).contains("quero esta vaga"),
    identity=lambda url: F.concat_ws(":", F.lit("iel"), F.upper(F.regexp_extract(url, r"(?i)^https?://[^/]+/([A-Z]{2})/vaga/", 1)), F.regexp_extract(url, r"(?i)/vaga/(?:[^/?]+/)?(\d+)", 1)),
    slug=lambda url: F.coalesce(_titled(F.regexp_extract(url, r"(?i)/vaga/(?:[^/?]+/)?\d+/([^/?]+)", 1)), F.lit("Oportunidade IEL")),
    fields={
        "company": lambda row: F.lit("IEL / empresa anunciante"),
        "location": lambda row: regional_location(row["description"]),
        "plain": lambda row: T.normalize(row["description"]),
        # the blank between keeps words of the two apart
        "employment_type": lambda row: _label(F.concat_ws(" ", T.normalize(F.regexp_extract(row["url"], r"(?i)/vaga/([^/?]+)/\d+", 1)), row["plain"]), LEVELS),
        "workplace_type": lambda row: _label(row["plain"], PLACES),
        "salary": lambda row: _found(row["description"], r"(?i)(R\$\s*[\d.]+(?:,\d{2})?)"),
        "published_at": lambda row: F.date_format(F.try_to_date(F.regexp_extract(row["description"], r"(?<!\d)(\d{2}/\d{2}/\d{4})(?!\d)", 1), "dd/MM/yyyy"), "yyyy-MM-dd"),
    },
)

ADVERTISED = CardShape(
    base="https://app.walljobs.com.br/vagas",
    link=r"(?i)^https?://app\.walljobs\.com\.br/(?:[^?]*/)?vagas/",
    card=_HOLDING_CARD,
    title=("card",),
    keep=lambda row: ~F.lower(row["title"]).isin("vagas", "buscar vagas"),
    identity=lambda url: F.concat(F.lit("walljobs:"), U.native_id(url)),
    fields={
        "company": lambda row: F.lit("WallJobs / empresa anunciante"),
        "location": lambda row: T.once(without_first(row["description"], row["title"]), text_location),
        "employment_type": lambda row: _label(T.normalize(row["description"]), LEVELS),
        "salary": lambda row: _found(row["description"], r"(?i)(R\$\s*[\d.]+(?:,\d{2})?)"),
    },
)

CARDS = {"99jobs": PORTAL, "vagas_com": BOARD, "iel": REGIONAL, "walljobs": ADVERTISED}


# Pages that are read line by line or tag by tag ------------------------------------------------------------------------

#: Levels of education that close a card of lines, and headings and labels of programmes.
EDUCATION = r"(?i)^(?:Superior|Técnico|Tecnico|Médio|Medio|Pós-Graduação|Pos-Graduacao)$"
HOURS = r"(?i)^\d+\s+horas?$"
AMOUNT = r"(?i)(R\$\s*[\d.]+(?:,\d{2})?)"
PROGRAMMES = r"programa de estagio|programa de trainee|programa jovem aprendiz|programa de jovem aprendiz|^jovem aprendiz "
CLOSED, OPEN = r"inscricoes encerradas", r"fazer inscricao|inscreva se|fazer cadastro|^participar$"


def line_cards(pages: DataFrame, key: str = "page_id", html: str = "html", city: str | None = None) -> DataFrame:
    """Postings of pages that list company, title, place, hours, pay and level line after line.

    A card is known by its last line, the level: pay stands within three lines before it, hours within three before pay,
    and place, title and company right before the hours. Of equal cards of a page the first counts.
    """
    found = elements(pages, key, html)
    main = F.get(F.filter("elements", lambda e: e["name"] == "main"), F.lit(0))
    lines = found.select("key", F.posexplode(F.when(main.isNotNull(), inner_texts(F.col("texts"), main)).otherwise(F.col("texts"))).alias("at", "line"))
    is_level, is_hours, pay = F.col("line").rlike(EDUCATION), F.col("line").rlike(HOURS), _found(F.col("line"), AMOUNT)
    place, title, company = (F.lag("line", i).over(Window.partitionBy("key").orderBy("at")) for i in (1, 2, 3))
    rows = looked_back(lines.withColumns({"place": place, "title": title, "company": company, "pay": pay}), "key", "at", pay.isNotNull(), is_hours, 3)
    heads = Window.partitionBy("key").orderBy("at").rowsBetween(-3, -1)
    card = F.struct("at", "mark", "pay")
    rows = rows.withColumn("paid", F.when(is_level, F.last(F.when(F.col("pay").isNotNull(), card), ignorenulls=True).over(heads)))
    levels = rows.where("paid.mark >= 3").select("key", "at", F.col("line").alias("level"), F.col("paid.pay").alias("salary"), F.col("paid.mark").alias("hours_at"))
    hours = rows.where(is_hours).select("key", F.col("at").alias("hours_at"), F.col("line").alias("workload"), "place", "title", "company")
    cards = levels.join(hours, ["key", "hours_at"])
    fine = ~(F.col("title").rlike(HOURS) | F.col("title").rlike(AMOUNT) | F.col("title").rlike(EDUCATION))
    location = F.lit(city) if city else F.col("place")
    identity = F.sha1(T.normalize(F.concat_ws("|", "company", "title", location, "salary", "level")))
    rows = cards.where(fine).withColumn("source_job_id", F.concat(F.lit("superestagios:"), F.substring(identity, 1, 18)))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key", "source_job_id").orderBy("at"))).where("turn = 1")
    return rows.select(F.col("key").alias(key), F.lit("superestagios").alias("source"), "source_job_id", "title", "company", location.alias("location"), "salary", "level", "workload")


def programmes(pages: DataFrame, base: str = "https://www.ciadeestagios.com.br/vagas-de-estagio/", key: str = "page_id", html: str = "html") -> DataFrame:
    """Programmes that are open: a heading and the first action after it (at most 20 tags on, before the next such heading).

    An action that says that entries are closed ends the search. The address is the action's, else that of the first
    link beside the heading.
    """
    found = elements(pages, key, html)
    tags = found.select("key", "elements", "texts", F.posexplode(F.filter("elements", lambda e: e["name"].isin("a", "button", "h2", "h3"))).alias("nth", "e"))
    label = inner_text(F.col("texts"), F.col("e"))
    parent = F.get(ancestors(F.col("elements"), F.col("e")), F.lit(0))
    beside = U.joined(base, F.get(F.filter(inside(F.col("elements"), parent, "a"), lambda a: a["href"].isNotNull()), F.lit(0))["href"])
    rows = tags.select("key", "nth", F.col("e.name").alias("name"), F.when(F.col("e.name").isin("a", "button"), U.joined(base, F.col("e.href"))).alias("address"), label.alias("label"), F.when(F.col("e.name").isin("h2", "h3"), beside).alias("beside")).withColumn("plain", F.regexp_replace(T.normalize(F.col("label")), "-", " "))
    head = F.col("name").isin("h2", "h3") & T.normalize(F.col("label")).rlike(PROGRAMMES)
    rows = next_actions(rows, "key", "nth", head, F.col("plain").rlike(f"{CLOSED}|{OPEN}"), 20)
    actions = rows.select("key", F.col("nth").alias("action"), F.col("address").alias("target"), F.col("plain").rlike(CLOSED).alias("closed"))
    paired = rows.where("action is not null").join(actions, ["key", "action"]).where("not closed")
    url = F.coalesce("target", "beside", F.lit(base))
    plain = T.normalize(F.col("label"))
    company = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("label", r"(?i)^programa\s+(?:de\s+)?(?:estágio|estagio|trainee|jovem\s+aprendiz)\s*", ""), r"(?<![\wÀ-ÿ])20\d{2}(?![\wÀ-ÿ])", ""), r"^[ \-|]+|[ \-|]+$", ""))
    native = U.native_id(url)
    rows = paired.select(
        F.col("key").alias(key), F.lit("cia_estagios").alias("source"), F.concat(F.lit("cia_estagios:"), native).alias("source_job_id"), F.col("label").alias("title"), url.alias("url"),
        F.coalesce(F.nullif(company, F.lit("")), F.lit("Companhia de Estágios / empresa anunciante")).alias("company"), F.when(plain.contains("trainee"), "trainee").when(plain.contains("aprendiz"), "apprentice").otherwise("internship").alias("employment_type"), "nth",
    )
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key, "source_job_id").orderBy("nth"))).where("turn = 1").drop("turn", "nth")

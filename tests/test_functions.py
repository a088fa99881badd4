import hashlib
import json
import random
import re
import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import careers, dates, geo, text, urls


def one(spark, *columns, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_normalize(spark):
    texts = ["Programa de ESTÁGIO  de Verão\n", None, "", "İstanbul ñandú façade", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text.normalize(F.col("t"))).collect()]
    assert got[0] == "programa de estagio de verao" and got[1] == "" and got[2] == ""
    assert got[3] == text.plain("istanbul ñandú façade") and got[4] == "a b"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aáÁçñöß zÜ.,-\n1", max_size=20), min_size=1, max_size=20))
def test_normalize_equals_the_driver_side_form(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.normalize(F.col("t"))).collect()]
    assert got == [text.plain(t) for t in texts]


@pytest.mark.parametrize(("value", "terms", "found"), [("senior analyst", ["senior"], ["senior"]), ("seniority", ["senior"], []), ("c++ dev", ["c++"], ["c++"]), ("data  science", ["data science"], ["data science"]), ("x", [], [])])
def test_whole_terms(spark, value, terms, found):
    assert one(spark, text.matching_terms(F.col("t"), terms), t=value)[0] == found


def test_near_and_context(spark):
    near = text.near(F.col("t"), ["electrical"], ["engineer", "intern"], 3)
    assert one(spark, near, t="electrical systems design engineer")[0]
    assert not one(spark, near, t="electrical a b c d engineer")[0]
    inside = text.within_context(F.col("t"), ["computer science"], ["degree"], 20)
    assert one(spark, inside, t="a degree in computer science")[0]
    assert not one(spark, inside, t="degree " + "x" * 40 + " computer science")[0]
    assert one(spark, text.within_context(F.col("t"), ["a"], ["q"], 5), t="a a a q")[0]


def brute_context(body, terms, context, width):
    padded = f" {body} "
    for t in terms:
        at = padded.find(f" {t} ")
        while at >= 0:
            window = padded[max(0, at - width) : at + len(t) + 2 + width]
            if any(f" {c} " in f" {window} " for c in context):
                return True
            at = padded.find(f" {t} ", at + 1)
    return False


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "aa", "b", "q", "long"]), max_size=25).map(" ".join), min_size=1, max_size=20))
def test_context_windows_against_brute_force(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.within_context(F.col("t"), ["a", "aa b"], ["q"], 7)).collect()]
    assert got == [brute_context(b, ["a", "aa b"], ["q"], 7) for b in bodies]


def test_labels(spark):
    row = one(spark, text.workplace(F.col("t")), text.employment(F.col("t")), text.salary(F.col("t")), text.slug(F.col("t")), t="Estágio Híbrido — R$ 1.500,00 / mês")
    assert tuple(row) == ("hybrid", "internship", "R$ 1.500,00", "estagio-hibrido-r-1-500-00-mes")
    assert tuple(one(spark, text.workplace(F.col("t")), text.employment(F.col("t")), text.salary(F.col("t")), t="x")) == ("unknown", None, None)


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTPS://Example.com/Jobs/1/?utm_source=x&id=7&gclid=2#top", "https://example.com/Jobs/1/?id=7#top"),
        ("https://example.com/a?MC_eid=1", "https://example.com/a"),
        ("https://example.com:8443/", "https://example.com:8443/"),
        ("https://example.com/?%75tm_x=1&mc_x=2&&a", "https://example.com/?mc_x=2&&a"),
        ("https://example.com/?", "https://example.com/"),
        ("https://me:pw@example.com/1", ""),
        ("ftp://example.com/1", ""),
        ("https:///1", ""),
        ("not a url", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, canonical):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(urls.canonical_url(F.col("u"))).first()[0] == canonical


@pytest.mark.parametrize(("path", "named"), [("/jobs/7-clerk/apply", True), ("/7/apply", False), ("/a/v7", True), ("/a/7x", False), ("/vagas/123e4567-e89b-12d3-a456-426614174000", True), ("/2026/jobs", False), ("/?reqid=", False), ("/?gh_jid=1", True), ("/?id=1", False)])
def test_addresses_that_name_one_posting(spark, path, named):
    assert one(spark, urls.detail_url(F.concat(F.lit("https://e.com"), F.col("p"))).isNotNull(), p=path)[0] is named


def test_catalogue_addresses(spark):
    cases = {"https://www.E.com/V%C3%A1gas/A+b/?x=1": "e.com/vágas/a+b", "https://x.gupy.io/job/AbC=/": "x.gupy.io/job/AbC=", "nothing": "", "http://u:p@e.com:80/A": "e.com/a"}
    for url, address in cases.items():
        assert one(spark, urls.catalogue_address(F.col("u")), u=url)[0] == address


def test_rules_on_postings(spark):
    c = careers
    row = one(spark, c.is_early_career(F.col("t")), c.is_early_career(F.lit("Internal auditor")), c.is_terminal(F.lit("gupy_api"), F.lit(" Closed "), F.lit(None)), c.is_terminal(F.lit("other"), F.lit("closed"), F.lit("x")), c.title_from_slug(F.lit("est%C3%A1gio-em_x")), c.lines(F.lit(" a  b \n\n c")), t="Estágio (Summer intern ) X")
    assert tuple(row) == (True, False, True, False, "Estágio em x", "a b\nc")
    row = one(spark, c.is_missing_page(F.lit("gupy_api"), F.col("u"), F.lit("http_404"), F.lit(True)), c.is_missing_page(F.lit("x"), F.col("u"), F.lit("http_410"), F.lit(True)), c.is_missing_page(F.lit("x"), F.col("u"), F.lit("http_500"), F.lit(True)), c.is_telling_title(F.lit("Vaga")), c.is_telling_title(F.lit("12")), c.is_seasonal(F.lit("Férias 2026"), F.lit(None), F.lit(None), ["ferias"]), u="https://e.gupy.io/jobs/1")
    assert tuple(row) == (False, True, False, False, False, True)
    with pytest.raises(Exception, match="0..100"):
        one(spark, c.course_score_map(F.col("p")), p='{"course_scores": {"a": 101}}')


@pytest.mark.parametrize(("text_", "country"), [("Rio, Brasil", "BR"), ("Austin, TX", "US"), ("Campinas - SP", "BR"), ("Maceió - AL", "BR"), ("Mobile, AL", None), ("", None), (None, None), ("usado", "US")])
def test_countries(spark, text_, country):
    assert one(spark, geo.infer_country(F.col("t").cast("string")), t=text_ or "")[0] == country


def test_ids(spark):
    source, key = 'a"b', "x\\y"
    row = one(spark, urls.stable_id(F.col("s"), F.col("k")), urls.shard_number(F.col("k"), 12), urls.native_id(F.lit("https://e.com/jobs/12-34567-x")), urls.native_id(F.lit("https://e.com/jobs/abc/")), s=source, k=key)
    assert row[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([source, key], separators=(",", ":"))))
    assert row[1] == int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") % 12
    assert row[2] == "34567" and row[3] == "abc"


def test_detail_and_safe_urls(spark):
    rows = spark.createDataFrame([("https://e.com/jobs/12345/",), ("https://e.com/jobs?Job%5Fid=7",), ("https://e.com/jobs",), ("http://127.0.0.1/1",), ("ftp://e.com/12345",), (None,)], "u string")
    got = [tuple(r) for r in rows.select(urls.detail_url(F.col("u")).isNotNull(), urls.is_safe_url(F.col("u")), urls.is_safe_url(F.col("u"), ["com"])).collect()]
    assert [g[0] for g in got] == [True, True, False, True, False, False]
    assert [g[1] for g in got] == [True, True, True, False, False, False]


@pytest.mark.parametrize(("value", "day"), [("2026-03-09T10:00:00Z", "2026-03-09"), ("até 09/03/2026", "2026-03-09"), ("9.3.26", "2026-03-09"), ("9 de março de 2026", "2026-03-09"), ("31/02/2026", None), ("soon", None), (None, None)])
def test_dates(spark, value, day):
    df = spark.createDataFrame([(value,)], "t string")
    got = df.select(dates.tolerant_date(F.col("t"))).first()[0]
    assert (got and got.isoformat()) == day


def test_epochs(spark):
    row = one(spark, dates.epoch_to_iso(F.lit(1700000000)), dates.epoch_to_iso(F.lit("1700000000000")), dates.epoch_to_iso(F.lit("2026")), dates.epoch_to_iso(F.lit("x").try_cast("double")))
    assert row[0] == row[1] == "2023-11-14T22:13:20+00:00" and row[3] is None


def test_distances(spark):
    row = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.distance_bonus(F.lit(25.0), 100.0), geo.distance_bonus(F.lit(35.0), 100.0), geo.is_remote(F.lit("Trabalho REMOTO")), geo.location_hints(F.lit("São Carlos - SP / Campinas, SP")))
    assert abs(row[0] - 111.1951) < 1e-3
    assert row[1] == 8 and row[2] == 6 and row[3] is True and tuple(row[4]) == ("São Carlos", "BR")


def test_accents_cover_the_latin_blocks():
    assert text._BASE[text._ACCENTED.index("ę")] == "e"
    assert all(unicodedata.normalize("NFKD", a)[0] == b for a, b in zip(text._ACCENTED, text._BASE, strict=True))


def test_normalize_decomposes_the_basic_plane(spark):
    # characters that this Python's tables know; the JVM's may be newer
    rows = [chr(c) for c in [*range(0x20, 0xAC00), *range(0xE000, 0xFFFE)] if unicodedata.category(chr(c)) != "Cn"]
    words = ["".join(rows[i : i + 40]) for i in range(0, len(rows), 40)] + ["ﬁnal oﬃce ½ № ™ Ⅳ", "été", "ΆΣ ほが", "plain  ASCII\ttext"]
    words = [w for w in words if w.lower() == w or w.isascii() or len(w) < 40]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r.t: r.n for r in df.select("t", text.normalize(F.col("t")).alias("n")).collect()}
    wrong = [(w, got[w], text.plain(w)) for w in words if got[w] != text.plain(w)]
    assert len(words) > 500 and not wrong


def test_a_text_is_normalised_once_for_all_phrases(spark):
    rows = spark.createDataFrame([("Ação in the sea",), ("in  THE",), (None,), ("within them",)], "t string")
    found = rows.where(text.has_phrase(text.canonical(F.col("t")), ["in the", "de la"]))
    assert [r[0] for r in found.collect()] == ["Ação in the sea", "in  THE"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert rows.where(text.has_phrase(F.col("t"), [])).count() == 0


def test_canonical_url_of_any_order_of_signs(spark):
    """Addresses are cut as one expression over the whole would."""
    web = re.compile(r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")
    fine = re.compile(r"(?is)^https?://(:?@)?[^/?#@:][^/?#@]*(?![^/?#])")
    pick = random.Random(3)
    pieces = ["https://", "HTTP://", "X.org", "a:80", "@", "/", "//", "?", "#", "&", "utm_source=a", "b=1", "jobId=7", "=", ":", "é", " ", "\t", "\n", "12", "jobs"]
    addresses = ["".join(pick.choices(["https://", "http://", ""], [6, 2, 1]) + pick.choices(["X.org", ""], [6, 1]) + pick.choices(pieces, k=pick.randrange(9))) for _ in range(3000)]

    def want(url):
        raw = re.sub("[\t\r\n]", "", url.strip(" "))
        if not fine.search(raw):
            return ""
        scheme, host, path, query, fragment = (g or "" for g in web.match(raw).groups())
        kept = "&".join(p for p in query.split("&") if not p.split("=")[0].startswith("utm_"))
        return f"{scheme.lower()}://{host.lower()}{path}" + (kept and f"?{kept}") + (fragment and f"#{fragment}")

    df = spark.createDataFrame([(u,) for u in addresses], "u string").select("u", urls.canonical_url(F.col("u")).alias("c"))
    assert [(r.u, r.c) for r in df.collect() if r.c != want(r.u)] == []


def test_terms_are_matched_where_their_first_word_stands(spark):
    """A cheap look for the first word comes before each expression, and changes no result."""
    df = spark.createDataFrame([("the  idiot said",), ("idiotic",), ("head of it",), ("of head",), ("",)], "t string")
    found = df.select(text.matching_terms(F.col("t"), ["Idiot", "head of", "thé"]).alias("f"))
    assert [r.f for r in found.collect()] == [["Idiot", "thé"], [], ["head of"], [], []]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 3

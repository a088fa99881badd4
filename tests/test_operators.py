import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import availability, identity, lifecycle, pages, places, scoring
from tidewell.operators import search as ops


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_reconcile_counts_misses_only_after_complete_scans(spark):
    state = spark.createDataFrame([(1, True, 0, None, None, None), (2, True, 1, "t0", None, None), (3, False, 2, "t0", "t1", None), (4, True, 1, "t0", None, None)], "k int, is_active boolean, miss_count int, missing_since string, inactive_at string, last_checked_at string")
    seen = spark.createDataFrame([(4,), (4,)], "k int")
    partial = lifecycle.reconcile(state, seen, ["k"], complete=False, threshold=2, now=F.lit("t2"))
    assert rows(partial.select("k", "is_active", "miss_count"), "k") == [(1, True, 0), (2, True, 1), (3, False, 2), (4, True, 0)]
    full = lifecycle.reconcile(state, seen, ["k"], complete=True, threshold=1, now=F.lit("t2"))
    assert rows(full, "k") == [(1, True, 1, "t2", None, "t2"), (2, False, 2, "t0", "t2", "t2"), (3, False, 2, "t0", "t1", "t2"), (4, True, 0, None, None, "t2")]


def test_prepare_and_upsert(spark):
    stored = spark.createDataFrame([(1, "a", "1", 3), (2, "b", "0", 1), (3, "c", "1", 1)], "k int, raw_hash string, processing_version string, seen_count int")
    came = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, "d")], "k int, raw_hash string")
    assert rows(lifecycle.prepare(came, stored, ["k"], "1").select("k", "status"), "k") == [(1, "unchanged"), (2, "reprocess"), (3, "changed"), (4, "new")]
    merged = lifecycle.upsert(stored, came.where("k > 2"), ["k"], "seen_count")
    assert rows(merged.select("k", "raw_hash", "seen_count"), "k") == [(1, "a", 3), (2, "b", 1), (3, "x", 2), (4, "d", 1)]


def test_hash_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame([(None,), ("",)], "a string")
    assert df.select(lifecycle.content_hash([F.col("a")])).distinct().count() == 2


def test_streaks_and_retirement(spark):
    days = [f"2026-01-{d:02d}" for d in (1, 2, 3, 8, 20)]
    checks = [(1, d, f"{d}T0{h}", i * 10 + h, True) for i, d in enumerate(days) for h in (1, 2)]
    checks += [(2, "2026-01-01", "a", 100, True), (2, "2026-01-02", "b", 101, False), (2, "2026-01-03", "c", 102, True), (3, "2026-01-01", "d", 103, True), (3, "2026-01-02", "e", 104, False)]
    df = spark.createDataFrame(checks, "posting_id int, day string, checked_at string, event_id int, bad boolean")
    got = availability.retirement_stage(availability.bad_streaks(availability.daily_checks(df)))
    assert rows(got.select("posting_id", "first_bad_day", "bad_checks", "stage"), "posting_id") == [(1, "2026-01-01", 5, "purge"), (2, "2026-01-03", 1, "watch")]


def test_closed_is_sticky(spark):
    schema = "k int, verdict string, checked_at string"
    old = spark.createDataFrame([(1, "closed", "a"), (2, "open", "a"), (3, "open", "a")], schema)
    new = spark.createDataFrame([(1, "open", "b"), (2, "closed", "b"), (4, "open", "b")], schema)
    assert rows(availability.sticky_merge(old, new, ["k"]), "k") == [(1, "closed", "a"), (2, "closed", "b"), (3, "open", "a"), (4, "open", "b")]


def test_fair_queue_takes_turns(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 1)], "source string, n int")
    assert [tuple(r) for r in availability.fair_queue(df, "source", [F.asc("n")], 4).select("source", "n").collect()] == [("a", 0), ("b", 1), ("c", 1), ("a", 1)]


def test_page_verdict(spark):
    pages_ = [(404, "x"), (500, "x"), (200, "<p>Vaga encerrada</p>"), (200, "<p hidden>Vaga encerrada</p>"), (200, '<script>{"validThrough":"2025-01-01"}</script>'), (200, '<script>{"validThrough":"2027-01-01"}</script>'), (None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages_)], "i int, status int, html string")
    verdict = availability.page_verdict(F.col("status"), F.col("html"), ["vaga encerrada"], F.lit("2026-01-01").cast("date"))
    assert [r[0] for r in df.orderBy("i").select(verdict).collect()] == ["closed", "unverified", "closed", "unverified", "closed", "open", "unverified"]


POSTING = "pos long, source string, source_job_id string, url string, company string, title string, published_at string, location string, workplace_type string, employment_type string, description string, unit string"
ADDRESS = "https://e.com/jobs/12345?utm_source=x"


def posting(pos, source, ident, url=ADDRESS, company="Acmé", title="Intern", published_at=None, location=None, workplace_type=None, employment_type=None, description=None, unit=None):
    return (pos, source, ident, url, company, title, published_at, location, workplace_type, employment_type, description, unit)


def test_groups_are_complete_linkage_not_transitive(spark):
    df = spark.createDataFrame(
        [
            posting(1, "a", "1", location="x"), posting(2, "b", "9"), posting(3, "c", "5", location="Y"), posting(4, "a", "2", company="ACME"),
            posting(5, "d", "1", company="99jobs"), posting(6, "e", "1", url="https://e.com/jobs"), posting(7, "e", "1", unit="north"), posting(8, None, None, location="y"), posting(9, "f", "1", url=None),
        ],
        POSTING,
    )
    got = dict(rows(identity.grouped(df, "pos", ("unit",)).select("pos", "group_position"), "pos"))
    # 3 fits 2 but not 1, so it opens a group; 4 is another posting of source a and fits the group of 3; 7 has a unit
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 3, 9: 9}


def brute_groups(postings):
    """First fit, comparing every row with every member."""
    groups, out = [], {}
    for p in postings:
        loose = lambda q: (q[6], *(x.lower() if x else None for x in q[7:11]))
        fits = lambda q: q[3] == p[3] and not (p[1] and p[2] and q[1] == p[1] and q[2] != p[2]) and all(not x or not y or x == y for x, y in zip(loose(p), loose(q), strict=True))
        home = next((g for g in groups if all(map(fits, g))), None)
        if home is None:
            groups.append(home := [])
        home.append(p)
        out[p[0]] = home[0][0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_first_fit_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice(values)
    data = [
        posting(i, some("a", "b", "c", None), str(i), url=f"https://e.com/jobs/{some(1, 2, 3)}", published_at=some(None, "2026-01-01", "2026-01-02"), location=some(None, "", "X", "y"), workplace_type=some(None, "remote", "onsite"), description=some(None, None, "d"))
        for i in range(240)
    ]
    got = dict(rows(identity.grouped(spark.createDataFrame(data, POSTING), "pos").select("pos", "group_position")))
    assert got == brute_groups(data)
    # where all have the same attributes, ranks tell
    even = [posting(p[0], p[1] or "d", p[2], url=p[3], location="x") for p in data]
    assert dict(rows(identity.grouped(spark.createDataFrame(even, POSTING), "pos").select("pos", "group_position"))) == brute_groups(even)
    assert identity.grouped(spark.createDataFrame([], POSTING), "pos").count() == 0


def test_conflicts(spark):
    first = posting(1, "a", "1", published_at="2026-01-01", location="x")
    others = [posting(2, "a", "2"), posting(3, "b", "1", company="Gupy"), posting(4, "b", "1", title="Clerk"), posting(5, "b", "1", published_at="2026-01-02"), posting(6, "b", "1", location="X "), posting(7, "b", "1", location="y"), posting(8, "b", "1", unit="u"), posting(9, "a", "1")]
    df = identity.comparable(spark.createDataFrame([first, *others], POSTING), ("unit",))
    both = df.select(F.struct(*df.columns).alias("b")).join(df.where("pos = 1").select("url_key", F.struct(*df.columns).alias("a")), F.col("b.url_key") == F.col("url_key"))
    got = dict(rows(both.select("b.pos", identity.conflict("a", "b", ("unit",)).alias("reason"))))
    assert got == {1: None, 2: "id", 3: "company", 4: "title", 5: "published_at", 6: None, 7: "location", 8: "unit", 9: None}


def test_winner_and_gap_fill(spark):
    df = spark.createDataFrame([("g", 1, "", None), ("g", 2, "x", "p"), ("g", 3, "y", "q")], "k string, pos int, a string, b string")
    rich = identity.richness("a", "b", "a")
    assert rows(identity.winners(df, ["k"], rich, "pos").select("pos")) == [(2,)]
    assert rows(identity.gap_filled(df, ["k"], ["a", "b"], "pos")) == [("g", "x", "p")]
    assert rows(identity.representative(df, "k", ["pos"]).select("pos")) == [(1,)]


def test_merge_fills_gaps_across_sources_only(spark):
    data = [posting(1, "a", "1", location="x"), posting(2, "a", "2", published_at="2026-01-01"), posting(3, "b", "1", workplace_type="remote", description="d")]
    df = spark.createDataFrame([(*p, g) for g, ps in (("one", data[:2]), ("two", data)) for p in ps], POSTING + ", g string")
    got = rows(identity.merged(df, "g", "pos").select("g", "pos", "location", "workplace_type", "description"), "g")
    assert got == [("one", 2, None, None, None), ("two", 2, "x", "remote", "d")]
    assert identity.references(df, "g").count() == 5


def test_rows_without_an_id_stay_apart(spark):
    df = spark.createDataFrame([posting(1, "a", "1"), posting(2, "a", "1", location="x"), posting(3, "a", ""), posting(4, "a", None), posting(5, None, "1")], POSTING)
    assert [r[0] for r in rows(identity.source_deduplicated(df, "pos").select("pos"), "pos")] == [2, 3, 4, 5]
    assert [r[0] for r in rows(identity.new_rows(df, df.where("pos = 1")).select("pos"), "pos")] == [3, 4, 5]


def test_closing_and_touching(spark):
    state = spark.createDataFrame([(1, True, 0, None, None, None, "a"), (2, False, 5, "m", "i", "c", "a"), (3, True, 1, "m", None, "c", "a")], "k int, is_active boolean, miss_count int, missing_since string, inactive_at string, last_checked_at string, last_seen_at string")
    keys = spark.createDataFrame([(1,), (2,), (2,), (9,)], "k int")
    assert rows(lifecycle.closed(state, keys, ["k"], F.lit("now")), "k") == [(1, False, 2, "now", "now", "now", "a"), (2, False, 5, "m", "i", "now", "a"), (3, True, 1, "m", None, "c", "a")]
    assert rows(lifecycle.touched(state, keys, ["k"], F.lit("now")).select("k", "is_active", "last_seen_at"), "k") == [(1, True, "now"), (2, True, "now"), (3, True, "a")]


def test_probe_of_clean_pages(spark):
    seen = lambda scan, page, item, known=True, relevant=False, telling=True: (scan, page, item, known, relevant, telling)
    data = [seen(1, 1, None), seen(2, 1, "a"), seen(2, 2, None), seen(3, 1, "a"), seen(3, 2, "a"), seen(4, 1, "a"), seen(4, 2, "b", False, True), seen(5, 1, "a"), seen(5, 2, "b"), seen(5, 3, "c"), seen(6, 1, "a"), seen(7, 1, "a", False, False, False)]
    df = spark.createDataFrame(data, "scan int, page int, item string, known boolean, relevant boolean, telling boolean")
    assert rows(pages.probe_decisions(df, "scan", "page", "item", 3), "scan") == [(1, 1, False, "empty page"), (2, 2, True, "empty page"), (3, 2, False, "repeated page"), (4, 2, False, "news"), (5, 3, True, "no news"), (6, None, None, None), (7, 1, False, "news")]


def test_pages(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, True, True])], "scan int, page int, known boolean")
    assert rows(pages.known_page_stop(df, "scan", "page", "known", 2)) == [(1, 3)]
    assert rows(pages.longest_run(df, "scan", "page", "known")) == [(1, 3)]
    items = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "b"), (1, 3, "a"), (1, 4, "c")], "scan int, page int, item string")
    assert rows(pages.repeated_pages(items, "scan", "page", "item"), "page") == [(1, 3, 1)]
    assert rows(pages.pages_without_news(items, "scan", "page", "item"), "page") == [(1, 2), (1, 3)]
    lines = spark.createDataFrame([(1, 1, "City"), (1, 2, "Campinas"), (1, 3, "Pay"), (1, 4, "City")], "doc int, no int, line string")
    assert rows(pages.labelled_values(lines, "doc", "no", "line", ["City", "Pay"])) == [(1, "City", "Campinas")]


def test_geocode_takes_the_largest_namesake(spark):
    cities = spark.createDataFrame([("Springfield", "US", 1.0, 1.0, 10, ["Spfld"]), ("Springfield", "US", 2.0, 2.0, 99, []), ("São Carlos", "BR", -22.0, -47.9, 5, None)], "name string, country_code string, latitude double, longitude double, population int, alternatenames array<string>")
    df = spark.createDataFrame([(1, "sao carlos - SP"), (2, "Location: Springfield metro area | Nowhere"), (3, "spfld"), (4, None), (5, "Nowhere | Springfield"), (6, "Springfield, anywhere"), (7, "Springfield, Brazil"), (8, "São-Carlos")], "id int, location string")
    cities = cities.unionByName(spark.createDataFrame([("Springfield", "BR", 3.0, 3.0, 1, None)], cities.schema))
    got = rows(places.geocode(df, cities, "location", "id").select("id", "latitude", "resolved_country", "location_confidence"), "id")
    assert got == [(1, -22.0, "BR", "city+country"), (2, 2.0, "US", "city"), (3, 1.0, "US", "city"), (4, None, None, None), (5, None, None, None), (6, None, None, None), (7, 3.0, "BR", "city+country"), (8, -22.0, "BR", "city")]
    posts = spark.createDataFrame([(1, "São Carlos", None, None, None, None), (2, "USA", "remote", None, None, None), (3, "São Carlos", None, None, 9.0, 9.0)], "id int, location string, workplace_type string, title string, latitude double, longitude double")
    assert rows(places.enriched(posts, cities, "id").select("id", "latitude", "resolved_country"), "id") == [(1, -22.0, "BR"), (2, None, "US"), (3, 9.0, None)]


def test_radius(spark):
    df = spark.createDataFrame([(1, 0.0, 0.05), (2, 0.0, 2.0), (3, None, None), (4, 0.0, 179.9)], "id int, latitude double, longitude double")
    assert [r[0] for r in rows(places.within_radius(df, 0.0, 0.0, 50.0).select("id"), "id")] == [1]
    assert [r[0] for r in rows(places.within_radius(df, 0.0, -179.9, 50.0).select("id"), "id")] == [4]


ELECTRICAL = scoring.Course(direct=("electrical engineering",), strong=("firmware",), weak=("battery",), course=("electrical engineering",), profession=("electrical engineer",), weak_body=("telecom",), discipline=("electrical",))
CIVIL = scoring.Course(direct=("civil engineering",), strong=("construction",), course=("civil engineering",), cap_anywhere=(("aircraft",), 30))


@pytest.mark.parametrize(
    ("title", "description", "electrical", "civil"),
    [
        ("Electrical systems intern", "", 94, 0),
        ("Firmware developer", "", 74, 0),
        ("Firmware developer", "firmware team", 75, 0),
        ("Battery tests", "", 46, 0),
        ("Intern", "requires a degree in electrical engineering", 88, 0),
        ("Intern", "works with an electrical engineer", 62, 0),
        ("Intern", "about electrical engineering", 46, 0),
        ("Intern", "telecom", 0, 0),
        ("Construction intern", "aircraft", 0, 30),
        ("Civil engineering intern", "firmware", 28, 94),
    ],
)
def test_affinity(spark, title, description, electrical, civil):
    df = spark.createDataFrame([(title, description)], "title string, description string")
    got = scoring.affinity_scores(df, {"e": ELECTRICAL, "c": CIVIL}, ["intern"], ["degree"]).first().course_scores
    assert got == {"e": electrical, "c": civil}


def test_profile_rules(spark):
    df = spark.createDataFrame(
        [("Intern", "Electrical", "Acme", "Campinas", "remote", "BR", None, None, {"e": 90}, ["internship"]), ("Senior engineer", "no", "Acme", "NY", None, "US", 40.7, -74.0, {"e": 90}, None)],
        "title string, description string, company string, location string, workplace_type string, country string, latitude double, longitude double, course_scores map<string,int>, detected_intents array<string>",
    )
    p = scoring.Profile("p", courses=("e",), intents=("internship",), workplaces=("remote",), countries=("BR",), home=(-22.0, -47.9), max_distance_km=100.0)
    a, b = scoring.match_profiles(df, [p], ["title"]).collect()
    assert (a.score, a.course_score, a.distance_km, a.eligible) == (62 + 25 + 5 + 4, 90, 0.0, True)
    assert (b.score, b.distance_km, b.eligible) == (0, None, False)
    assert a.reasons == ["forte aderência ao curso", "tipo de oportunidade desejado", "modalidade desejada", "país desejado", "remoto: distância ignorada"]
    # abroad, a near place earns nothing
    here = scoring.Profile("h", countries=("BR",), home=(40.7, -74.0), max_distance_km=100.0)
    b = scoring.match_profiles(df.where("country = 'US'"), [here], ["title"]).first()
    assert (b.score, b.reasons) == (5, ["sem filtro de curso", "senioridade incompatível", "país fora da preferência"])


def test_search_input_is_tidied():
    assert ops.tidy("  x ") == "x" and ops.tidy("   ") is None and len(ops.tidy("y" * 500)) == ops.MAX_INPUT
    assert not ops.SearchRequest(latitude=91.0, longitude=0.0).located


def test_intents(spark):
    df = spark.createDataFrame([("Estágio de verão", None, "a graduate program"), ("Clerk", "Trainee", None)], "t string, e string, d string")
    terms = {"internship": ["estágio"], "trainee": ["trainee"]}
    got = df.select(scoring.detect_intents(F.col("t"), F.col("e"), F.col("d"), terms, {"graduate": ["graduate program"]})).collect()
    assert [r[0] for r in got] == [["internship", "graduate"], ["trainee"]]


def test_affinity_reasons_say_what_told_and_stay_silent_below_their_score(spark):
    courses = {"law": scoring.Course(direct=("law",), strong=("court",), weak=("legal",), course=("law",), profession=("lawyer",)), "art": scoring.Course(direct=("art",), strong=("paint",))}
    rows = [("law clerk", "degree in law"), ("legal aide", "lawyer"), ("clerk", "court"), ("clerk", "court law"), ("art", "court law"), ("clerk", "nothing"), (None, None)]
    found = scoring.affinity_scores(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, title string, description string"), courses, (), ("degree",))
    say, got = scoring.AFFINITY_REASONS, {r.id: (r.course_scores["law"], r.course_reasons.get("law")) for r in found.collect()}
    assert got[0] == (96, [say["direct"], say["education"]])
    assert got[1] == (62, [say["weak"], say["profession"]])
    assert got[2] == (35, [say["skills"]])
    assert got[3] == (46, [say["course"], say["skills"]])
    assert got[4] == (28, None)  # the title tells another course
    assert got[5] == got[6] == (0, None)
    # a filter on the reasons stays above the stages
    assert {r.id for r in found.where("size(course_reasons) > 0").select("id").collect()} == {0, 1, 2, 3, 4}

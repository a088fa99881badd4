"""Discovery on boards, and the grid of places near many centres."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import urls as U
from tidewell.operators import discovery as D
from tidewell.operators import places
from tidewell.session import shared_folder

LINK = "tenant string, from_url string, to_url string"
SEED = "tenant string, url string, method string"


def reached(spark, seeds, links, **how):
    found = D.frontier(spark.createDataFrame(seeds, SEED), spark.createDataFrame(links, LINK), **how)
    return {(r.tenant, r.url): (r.depth, r.method, r.discovered_from) for r in found.collect()}


def at(path):
    return f"https://b.example.org/{path}"


def test_frontier_takes_shortest_ways_and_ends_in_circles(spark):
    links = [("a", at("go/1"), at("go/2")), ("a", at("go/2"), at("search/3")), ("a", at("search/3"), at("go/1")), ("a", at("go/1"), at("search/3")), ("a", at("go/2"), at("job/9")), ("a", at("go/2"), at("go/2")), ("a", at("go/2"), ""), ("a", at("go/2"), None)]
    got = reached(spark, [("a", at("go/1"), "explicit"), ("a", at("go/1"), "go"), ("b", at("go/7"), "go"), (None, at("go/1"), "go"), ("a", at("job/1"), "explicit"), ("a", "", "go")], links * 2)
    assert got == {("a", at("go/1")): (0, "explicit", None), ("a", at("go/2")): (1, "go", at("go/1")), ("a", at("search/3")): (1, "search", at("go/1")), ("b", at("go/7")): (0, "go", None)}


def test_frontier_bounds_empty_tables_and_leaves_no_scratch(spark):
    chain = [("a", at(f"go/{i}"), at(f"go/{i + 1}")) for i in range(5)]
    assert len(reached(spark, [("a", at("go/0"), "go")], chain)) == 6
    assert len(reached(spark, [("a", at("go/0"), "go")], chain, max_depth=2)) == 3
    assert reached(spark, [], chain) == {}
    assert len(reached(spark, [("a", at("go/0"), "go")], [])) == 1
    left = os.listdir(os.path.dirname(shared_folder(spark, "any")).removeprefix("file:"))
    assert any(x.startswith("listings-") for x in left) and not [x for x in left if x.startswith(("frontier-", "links-"))]


def test_starts(spark):
    table = lambda *rows: spark.createDataFrame(rows, "tenant string, url string")
    got = D.starts(table(("a", at("go/1"))), table(("a", at("search/2")), ("a", at("job/3"))), table(("a", at("")), ("b", at("home")))).collect()
    assert sorted(map(tuple, got)) == [("a", at("go/1"), "explicit"), ("a", at("search/2"), "search"), ("b", at("home"), "home_listing")]


PAGES = "page_id long, url string, html string, at string"


def test_listing_links(spark):
    html = '<a href="/viewalljobs/">All</a><a href="/search/">S</a><a href="x?a=1&amp;b=2#f">x</a><a href="../go/y">y</a><a href="/job/1">j</a><!-- <a href="/go/no"> --><a href="/search/">again</a>'
    rows = [(1, at("go/page#top"), html, "clash"), (1, at("go/page"), html, "clash"), (2, None, html, ""), (3, at(""), None, ""), (4, at(""), "", "")]
    got = D.listing_links(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(tuple, got)) == [(1, at("go/page"), at(x)) for x in ("go/x?a=1&b=2", "go/y", "search/", "viewalljobs/")]


@pytest.mark.parametrize(("base", "href", "want"), [("https://h.org", "a", "https://h.org/a"), ("https://h.org/x/y?q=1", "", "https://h.org/x/y?q=1"), ("https://h.org/x/y?q=1", "?p", "https://h.org/x/y?p"), ("https://h.org/x/y", "//o.org/z", "https://o.org/z"), ("https://h.org/x/y/", "z#f", "https://h.org/x/y/z"), ("nowhere", "a", None)])
def test_resolved(spark, base, href, want):
    row = spark.createDataFrame([(base, href)], "base string, href string").select(U.resolved(F.col("base"), F.col("href")), U.joined(base, F.col("href"))).first()
    assert row[0] == want and (want is None or row[1] == want)


def test_feeds(spark):
    rows = [(1, "https://career5.successfactors.eu/career?company=ALSTOM", "", ""), (2, at(""), "<a href='https://x.sapcloud.io/?company=b%20c'>x</a><script>companyId: 1, \"company\" : 'A.1'</script>", ""), (3, at("?company=x"), None, ""), (4, None, None, "")]
    got = {}
    for r in sorted(D.feeds(spark.createDataFrame(rows, PAGES)).collect()):
        got.setdefault(r.key, []).append(r.url)
    end = "&career_ns=job_listing_summary&resultType=XML"
    # the text itself names "b" up to the percent sign
    assert got == {1: [f"https://career5.successfactors.eu/career?company=ALSTOM{end}"], 2: [f"https://x.sapcloud.io/career?company={c}{end}" for c in ("A.1", "b", "b+c")]}


def test_locales(spark):
    html = "<a href='?locale=fr_FR'><a href='?x&amp;locale=ar_AE'><a href='/4-ja_JP/'>?locale=xx_Y &locale=pt_BR"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(D.locales(F.col("h"), ["de_DE", "bad"])).collect()
    default = ["de_DE", "en_GB", "en_US", "pt_BR", "es_ES"]
    assert [r[0] for r in got] == [[*default, "ar_AE", "fr_FR", "ja_JP"], default]


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x)))


@pytest.mark.parametrize("cell_km", [20.0, 300.0])
def test_near_pairs_equal_brute_force_everywhere(spark, cell_km):
    draw = random.Random(7)
    spot = lambda: (draw.choice([draw.uniform(-90, 90), draw.uniform(88, 90), -90.0, 90.0, draw.uniform(-1, 1)]), draw.choice([draw.uniform(-180, 180), draw.uniform(179, 180), -180.0, 180.0, draw.uniform(0, 3)]))
    centres = [(i, *spot(), draw.choice([0.0, 30.0, 250.0, 900.0])) for i in range(60)]
    points = [(i, *spot(), 5.0) for i in range(400)] + [(1000 + i, c[1], c[2], 0.0) for i, c in enumerate(centres)]
    odd = [(-1, None, 0.0, 10.0), (-2, 0.0, None, 10.0), (-3, 91.0, 0.0, 10.0), (-4, 0.0, 0.0, None), (-5, 0.0, 0.0, -1.0), (-6, math.nan, 0.0, 9.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, latitude double, longitude double, radius_km double")
    got = [(r.a, r.b) for r in places.near_pairs(frame(centres + odd), frame(points + odd[:3]), cell_km).select(F.col("centre.id").alias("a"), F.col("point.id").alias("b")).collect()]
    want = [(c[0], p[0]) for c in centres for p in points if km(c[1], c[2], p[1], p[2]) <= c[3]]
    assert sorted(got) == sorted(want)


def test_near_pairs_meet_by_cells(spark):
    rows = spark.range(10).select("id", F.col("id").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(50.0).alias("radius_km"))
    plan = places.near_pairs(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_regional_search_and_its_remote_rows(spark):
    rows = [(1, "Campinas", "", "a", -22.9, -47.0, None, None), (2, "Remote", "", "b", None, None, "Campinas", "BR"), (3, "Remote", "", "c", None, None, None, None), (4, "", "remoto", "d", -22.9, -47.0, None, None), (5, "Recife", "", "e", -8.0, -34.9, None, None), (6, "", "", "f", None, None, "Campinas", "")]
    jobs = spark.createDataFrame(rows, "id long, location string, workplace_type string, title string, latitude double, longitude double, city_hint string, country_hint string")
    cities = spark.createDataFrame([("Campinas", "BR", -22.9, -47.0, 10), ("Small", "BR", -22.9, -47.0, 5), ("Abroad", "PY", -22.9, -47.0, 50)], "name string, country_code string, latitude double, longitude double, population long")
    centres = spark.createDataFrame([("x", -22.9, -47.0, 1.0, "br")], "id string, latitude double, longitude double, radius_km double, country_code string")
    ids = lambda found: sorted(r[0] for r in found.select("posting.id").collect())
    assert ids(places.regional(jobs, centres, cities, "id")) == [1]
    assert ids(places.regional(jobs, centres, cities, "id", include_remote=True)) == [1, 2, 4]
    assert ids(places.regional(jobs, centres.withColumn("radius_km", F.lit(9000.0)), cities, "id")) == [1]
    assert ids(places.regional(jobs.limit(0), centres, cities, "id", include_remote=True)) == []
    near = places.cities_in_radius(centres, cities, 1).select("city.name", "distance_km", "rank").collect()
    assert list(map(tuple, near)) == [("Campinas", 0.0, 1)]
    assert [r[0] for r in places.cities_in_radius(centres.drop("country_code"), cities).orderBy("rank").select("city.name").collect()] == ["Abroad", "Campinas", "Small"]


def pairs_formed(monkeypatch):
    """Counts of the centres and points that are handed to near_pairs."""
    seen, plain = [], places.near_pairs
    monkeypatch.setattr(places, "near_pairs", lambda centres, points, *a: seen.append((centres.count(), points.count())) or plain(centres, points, *a))
    return seen


def test_cities_of_one_spot_meet_a_centre_once(spark, monkeypatch):
    seen, draw = pairs_formed(monkeypatch), random.Random(3)
    spots = [(0.0, 0.0), (0.0, 0.1), (0.1, 0.0), (0.3, 0.3), (None, 0.0)]
    cities = [(f"c{draw.randrange(90)}", *draw.choice(spots), draw.choice([None, "AA", "BB"]), draw.choice([None, 1, 2, 3])) for _ in range(400)]
    centres = [(i, 0.0, i / 50, draw.choice([0.0, 20.0, 60.0]), draw.choice([None, "", "aa", "BB", "XX"])) for i in range(30)]
    cols = "latitude double, longitude double"
    got = places.cities_in_radius(spark.createDataFrame(centres, f"id int, {cols}, radius_km double, country_code string"), spark.createDataFrame(cities, f"name string, {cols}, country_code string, population int"), 7).orderBy("rank").collect()
    for i, lat, lon, radius, country in centres:
        near = [(round(d, 1), -(p or 0), n) for n, a, b, c, p in cities if a is not None and (not country or country.upper() == c) and (d := km(lat, lon, a, b)) <= max(1.0, radius)]
        rows = [(r.distance_km, r.city.population, r.city.name, r["rank"]) for r in got if r.centre.id == i]
        assert [(r[0], -(r[1] or 0), r[2]) for r in rows] == sorted(near)[:7] and [r[3] for r in rows] == list(range(1, len(rows) + 1))
    assert seen[0][1] <= 4 * 3


def test_regional_search_compares_equal_circles_and_spots_once(spark, monkeypatch):
    seen, cols = pairs_formed(monkeypatch), "latitude double, longitude double"
    jobs = spark.createDataFrame([(i, "", "", "", i % 3 / 10, 0.0, "", "") for i in range(60)] + [(99, "", "", "", 9.0, None, "", "")], f"id long, location string, workplace_type string, title string, {cols}, city_hint string, country_hint string")
    centres = spark.createDataFrame([(i, 0.0, 0.0, 12.0) for i in range(20)] + [(50, None, 0.0, 9.0)], f"id int, {cols}, radius_km double")
    got = places.regional(jobs, centres, jobs.limit(0), "id").select("centre.id", "posting.id", "distance_km").collect()
    assert sorted(map(tuple, got)) == sorted((c, i, [0.0, 11.1][i % 3]) for c in range(20) for i in range(60) if i % 3 < 2)
    assert seen == [(2, 3)]


def test_a_crowded_spot_is_dealt_and_its_postings_meet_centres_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(places, "CROWD", 20)
    cols = "latitude double, longitude double"
    spots = [(-0.0, 0.0)] * 200 + [(0.0, 0.0)] * 200 + [(0.1, 0.0)] * 5 + [(95.0, 0.0)]
    jobs = spark.createDataFrame([(i, "", "", "", *p, "", "") for i, p in enumerate(spots)], f"id long, location string, workplace_type string, title string, {cols}, city_hint string, country_hint string")
    centres = spark.createDataFrame([(i, i / 100, 0.0, 12.0) for i in range(8)], f"id int, {cols}, radius_km double")
    got = places.regional(jobs, centres, jobs.limit(0), "id").select(F.spark_partition_id().alias("task"), "posting.id", F.col("centre.id").alias("centre"), "distance_km").collect()
    assert sorted((r.centre, r.id, r.distance_km) for r in got) == sorted((c, i, round(d, 1)) for c in range(8) for i, p in enumerate(spots) if (d := km(c / 100, 0.0, *p)) <= 12)
    assert len({r.task for r in got if r.id < 400}) > 1
    runs = [(k, tuple(r.centre for r in g)) for k, g in itertools.groupby(got, lambda r: (r.task, r.id))]
    assert len(runs) == 405
    assert all(len({c for (task, i), c in runs if task == t and i < 400}) == 1 for t in {task for (task, i), _ in runs if i < 400})

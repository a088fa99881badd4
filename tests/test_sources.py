import json

import pytest

from tidewell.sources import files, payloads


def decode(spark, source, payload):
    df = spark.createDataFrame([("Acme", json.dumps(payload) if not isinstance(payload, str) else payload)], "company string, raw string")
    return [r.asDict() for r in payloads.decode(df, source).collect()]


@pytest.mark.parametrize(
    ("source", "payload", "want"),
    [
        ("lever", [{"id": "a", "text": "T", "categories": {"location": "L", "commitment": "Intern"}, "hostedUrl": "u", "createdAt": 1700000000000, "workplaceType": "Remote"}], {"source_job_id": "a", "title": "T", "location": "L", "published_at": "2023-11-14T22:13:20+00:00", "workplace_type": "remote"}),
        ("ashby", {"jobs": [{"title": "X", "isListed": False, "jobUrl": "n"}, {"title": "T", "isListed": True}]}, {"source_job_id": "1", "title": "T"}),
        ("greenhouse", {"jobs": [{"id": 7, "title": "T", "location": {"name": "L"}, "content": "c"}]}, {"source_job_id": "7", "location": "L", "description": "c"}),
        ("gupy", {"results": [{"id": 1, "name": "T", "city": "C", "state": "", "country": "BR"}, {"id": 2}]}, {"source_job_id": "1", "location": "C, BR"}),
        ("workday", {"total": 1, "jobPostings": [{"title": "T", "externalPath": "/p", "bulletFields": ["R1"]}]}, {"source_job_id": "R1", "url": "/p"}),
        ("smartrecruiters", {"content": [{"uuid": "u", "name": "T", "location": {"city": "C", "country": "br"}}]}, {"source_job_id": "u", "location": "C, br"}),
        ("inhire", {"jobsPage": [{"jobId": "1", "displayName": "T", "status": "Closed"}, {"jobId": "2", "displayName": "T", "workplaceType": "Híbrido"}]}, {"source_job_id": "2", "workplace_type": "hybrid"}),
        ("izirh", {"result": {"data": [{"id": 5, "name": "T", "workModel": {"name": "Presencial"}}]}}, {"source_job_id": "5", "workplace_type": "onsite"}),
        ("eightfold", {"data": {"count": 1, "positions": [{"id": 9, "name": "T", "locations": ["L", "M"], "postedTs": 1700000000}]}}, {"location": "L", "published_at": "2023-11-14T22:13:20+00:00"}),
        ("successfactors", {"jobSearchResult": [{"response": {"id": 3, "unifiedStandardTitle": "T", "jobLocationShort": ["L"]}}]}, {"source_job_id": "3", "location": "L"}),
    ],
)
def test_payload_shapes(spark, source, payload, want):
    got = decode(spark, source, payload)
    assert len(got) == 1 and got[0]["source"] == source and got[0]["company"] == "Acme"
    assert {k: got[0][k] for k in want} == want


def test_broken_json_gives_nothing_and_changed_shapes_fail(spark):
    assert decode(spark, "gupy", "not json") == []
    with pytest.raises(Exception, match="no known item list"):
        decode(spark, "gupy", {"items": []})


def test_xml_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<jobs><job><ReqId>7</ReqId><JobTitle>T</JobTitle><city>C</city></job><job><ReqId>8</ReqId><JobTitle>U</JobTitle></job></jobs>")
    got = payloads.read_xml_feed(spark, str(tmp_path / "feed.xml"), "job", "Acme", "feed").orderBy("source_job_id").collect()
    assert [(r.source_job_id, r.title, r.location, r.url) for r in got] == [("7", "T", "C", None), ("8", "U", None, None)]


def test_json_ld_and_links(spark):
    ld = {"@graph": [{"@type": "Organization"}, {"@type": "JobPosting", "title": "T", "validThrough": "2026-01-01", "hiringOrganization": {"name": "Acme"}}]}
    html = f'<script type="application/ld+json">{{broken</script><script type="application/ld+json">{json.dumps(ld)}</script><!-- <a href="no">x</a> --><a class="b" href="/jobs/1"><b>Go</b>  there</a>'
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "id int, html string")
    assert [(r.id, r.title, r.company, r.valid_through) for r in payloads.json_ld_postings(df, "id", "html").collect()] == [(1, "T", "Acme", "2026-01-01")]
    assert [tuple(r) for r in payloads.links(df, "id", "html").collect()] == [(1, 0, "/jobs/1", "Go there")]


def test_catalogue_files(spark, tmp_path):
    path = tmp_path / "jobs.json"
    path.write_text(json.dumps([{"source": "a", "source_job_id": "1", "title": "T", "unknown": 1, "course_scores": {"e": 5}, "detected_intents": ["x", "y"]}, {"source": "a"}]))
    rows = files.read_postings(spark, str(path))
    assert rows.count() == 1
    files.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.detected_intents == "x; y" and json.loads(back.course_scores) == {"e": 5}
    first, second = (files.write_version(rows, str(tmp_path / "versions")) for _ in range(2))
    assert first != second and spark.read.parquet(first).count() == 1

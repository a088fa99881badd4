"""Links between postings and opportunities, and merged listings."""

import itertools

from pyspark.sql import functions as F

from tidewell.operators import associations as A
from tidewell.operators import identity
from tidewell.plans import links

SCHEMA = "pos long, source string, source_job_id string, url string, company string, title string, description string, location string, workplace_type string, employment_type string, published_at string, first_seen_at string, last_changed_at string"


def posting(pos, source, id_, url, title="Dev", seen="2026-01-01"):
    return (pos, source, id_, url, "Acme", title, None, None, None, None, None, seen, "2026-02-0%d" % (pos % 9 + 1))


def desired(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df, A.desired_links(identity.grouped(df, "pos"), "group_position")


def ids(links):
    return {(r.source, r.source_job_id): (r.opportunity_id, r.association_method) for r in links.collect()}


def test_merge_split_and_unchanged(spark):
    url = "https://x.org/jobs/"
    before = [posting(1, "a", "1", url + "1"), posting(2, "b", "2", url + "1", "Other"), posting(3, "a", "3", url + "3"), posting(4, "b", "4", url + "3"), posting(5, "c", "5", url + "5"), posting(6, "d", "6", url + "5")]
    # 2 comes to 1, 4 leaves 3, 5 and 6 stay together.
    after = [posting(1, "a", "1", url + "1"), posting(2, "b", "2", url + "1"), posting(3, "a", "3", url + "3"), posting(4, "b", "4", url + "3", "New"), posting(5, "c", "5", url + "5"), posting(6, "d", "6", url + "5")]
    _, old = desired(spark, before)
    rows, new = desired(spark, after)
    was, now = ids(old), ids(new)
    assert now["a", "1"] == now["b", "2"] and now["a", "1"][0] == was["a", "1"][0] and now["a", "1"][1] == A.GROUPED
    assert now["a", "3"] == (was["a", "3"][0], A.ALONE) and now["b", "4"][0] not in {i for i, _ in was.values()} - {was["b", "4"][0]}
    changes = A.link_changes(old, new)
    assert {(r.source, r.source_job_id) for r in changes.collect()} == {("a", "1"), ("b", "2"), ("a", "3"), ("b", "4")}
    affected = A.affected_ids(changes, new)
    assert {r[0] for r in affected.collect()} == {was["a", "1"][0], was["b", "2"][0], was["a", "3"][0], now["b", "4"][0]}
    rebuilt = A.rebuilt_opportunities(rows, new, affected, "pos")
    old_rows = A.rebuilt_opportunities(spark.createDataFrame(before, SCHEMA), old, old.select("opportunity_id").distinct(), "pos")
    links = A.rebuilt_links(old.withColumn("associated_at", F.lit("then")), changes, F.lit("now"))
    final = {r.id: r.title for r in A.upserted(old_rows, rebuilt, links).collect()}
    assert final == {now["a", "1"][0]: "Dev", now["a", "3"][0]: "Dev", now["b", "4"][0]: "New", now["c", "5"][0]: "Dev"}
    assert {r.associated_at for r in links.where("source in ('c', 'd')").collect()} == {"then"}


def test_touched_addresses_give_the_same_links(spark):
    url = "https://x.org/jobs/"
    rows = [posting(i, "abc"[i % 3], str(i), url + str(i // 3), "T%d" % (i % 2)) for i in range(1, 13)] + [posting(20, "a", "20", "no address")]
    df, whole = desired(spark, rows)
    changed = df.where("pos in (4, 20)")
    moved = df.where("pos = 4").withColumn("url", F.lit(url + "0"))
    some = A.touched(df, changed, moved)
    assert {r.pos for r in some.collect()} == {1, 2, 3, 4, 5, 20}
    part = ids(A.desired_links(identity.grouped(some, "pos"), "group_position"))
    full = ids(whole)
    assert part == {k: full[k] for k in part}


def test_children(spark):
    df, links = desired(spark, [posting(1, "a", "1", "https://x.org/jobs/1"), posting(2, "b", "2", "https://x.org/jobs/1")])
    rows = df.withColumn("course_scores", F.when(F.col("pos") == 1, F.create_map(F.lit("x"), F.lit(40), F.lit("y"), F.lit(5))).otherwise(F.create_map(F.lit("x"), F.lit(70)))).withColumn("intents", F.when(F.col("pos") == 1, F.array(F.lit(" a "), F.lit(""))))
    scores, intents = A.children(rows, links, links.select("opportunity_id").distinct())
    assert sorted((r.course_id, r.score) for r in scores.collect()) == [("x", 70), ("y", 5)] and [r.intent_id for r in intents.collect()] == ["a"]


def plain_merge(refs):
    quality = lambda r: 3 * bool(r[0]) + 2 * bool(r[2]) + bool(r[1]) + bool(r[4]) + min(len(r[0]), 100) // 50
    held = refs[0]
    for new in refs[1:]:
        best, other = (new, held) if quality(new) > quality(held) else (held, new)
        held = tuple(a or b for a, b in zip(best, other, strict=True))
    return held


def test_merged_references_fold_in_order_however_dealt(spark):
    parts = [("", "t", "t" * 60), ("", "u"), ("", "l"), ("d1", "d2"), ("", "p")]
    options = list(itertools.product(*parts))
    rows, want = [], {}
    for key in range(40):
        refs = [options[(key * 7 + i * 13 + i * i * key) % len(options)] for i in range(1 + key % 6)] * 2
        want[key] = plain_merge(refs)
        rows += [(key, i, *r, "m%d" % (i % 2)) for i, r in enumerate(refs)]
    df = spark.createDataFrame(rows, "key long, at long, title string, url string, location string, discovered_from string, published_at string, method string")
    for n in (1, 7):
        got = {r.key: tuple(r)[1:6] for r in A.merged_references(df.repartition(n), ["key"], "at").collect()}
        assert got == want
    assert A.merged_references(df.limit(0), ["key"], "at").count() == 0


def test_merged_rows_conflict_by_every_id(spark):
    df = spark.createDataFrame([posting(1, "a", "1", "https://x.org/jobs/1"), posting(2, "b", "2", "https://x.org/jobs/1"), posting(3, "b", "9", "https://x.org/jobs/1")], SCHEMA)
    merged = identity.merged_with_references(df.withColumn("g", F.when(F.col("pos") < 3, 1).otherwise(2)), "g", "pos")
    rows = identity.comparable(merged)
    a, b = (rows.where(F.col("g") == i).select(F.struct(*rows.columns).alias(n)) for i, n in ((1, "a"), (2, "b")))
    both = a.join(b, F.lit(True))
    assert both.select(identity.conflict("a", "b", sets=True)).first()[0] == "id" and both.select(identity.conflict("a", "b")).first()[0] is None


def test_rebuild_reads_its_postings_once(spark, sf_dir):
    """Every branch of the rebuild reads the stored postings; none decodes the events anew."""
    assert not [f for f in links.association_rebuild(spark, sf_dir).inputFiles() if "events.parquet" in f]


def test_keys_are_computed_once(spark):
    """No filter below the grouping computes the keys a second time."""
    seen = []
    real = identity.written
    identity.written = lambda rows, name: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows, name)
    try:
        identity.grouped(spark.createDataFrame([posting(1, "a", "1", "https://x.org/jobs/1")], SCHEMA), "pos")
    finally:
        identity.written = real
    assert not [line for line in seen[0].splitlines() if "Filter" in line and "https?" in line]

"""Operators 11 to 13: archives of captures, repaired conversations, interacting filters."""

import base64
import gzip
import hashlib
import itertools
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import filter_audit, repair, warc
from tidewell.llm.registry import ORACLE_SQL, QUERIES

TABLES = "documents pages labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", ["op11_warc", "op12_repair", "op13_filter_audit"])
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, want.fetchall())


# op11 ----------------------------------------------------------------------------------------------------------

ODD_PAGES = [
    (1, "http://a/x y", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (None, "http://c", "<p>one</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nX: y", "z\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "http://f", "ends\r\n"), (7, "http://g", "ends\r\n\r\n"), (8, "http://h", "é\U0001f44d\x00" * 50_000), (1, "http://a/x y", "other"),
]


def written(spark, rows, path, **more):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, sha string, body string")
    warc.write_captures(pages, str(path), date="2026-01-01T00:00:00Z", **more)
    return warc.resolved(warc.captures(warc.read_records(spark, str(path)))).collect()


def page_id(metadata):
    return int(metadata[0].fields["page-id"]) if "page-id" in metadata[0].fields else None


def test_captures_come_back(spark, tmp_path):
    found = written(spark, ODD_PAGES, tmp_path / "w")
    assert len(found) == len(ODD_PAGES) and all(len(c.requests) == len(c.metadata) == 1 for c in found)
    held = {}
    for c in found:
        assert c.response.declared_digest.startswith("sha1:")
        if c.response.type == "response":
            payload = bytes(c.response.payload)
            assert c.response.declared_digest[5:] == c.response.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            held[payload] = page_id(c.metadata)
        else:
            assert not c.response.payload and c.of.payload_digest == c.response.declared_digest[5:]
    want = {}
    for page, _, html in ODD_PAGES:
        want.setdefault((html or "").encode(), []).append(page)
    assert set(held) == set(want)
    assert all(held[p] == min((i for i in ids if i is not None), default=None) for p, ids in want.items())
    assert sum(c.response.type == "revisit" for c in found) == len(ODD_PAGES) - len(want)


def test_small_payloads_are_all_written(spark, tmp_path):
    found = written(spark, ODD_PAGES, tmp_path / "w", least_bytes=8)
    small = [c for c in found if c.response.type == "response" and c.response.payload_bytes < 8]
    assert len(small) == sum(len((h or "").encode()) < 8 for _, _, h in ODD_PAGES) and len(found) == len(ODD_PAGES)


def test_no_pages(spark, tmp_path):
    assert written(spark, [], tmp_path / "w") == []


def test_files_are_plain_warc(spark, tmp_path):
    written(spark, ODD_PAGES, tmp_path / "w")
    kinds = []
    for name in os.listdir(tmp_path / "w"):
        if not name.endswith(".gz"):
            continue
        data = gzip.decompress((tmp_path / "w" / name).read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            kinds.append(fields[b"WARC-Type"].decode())
            data = rest[size + 4 :]
    assert kinds.count("request") == kinds.count("metadata") == len(ODD_PAGES)


def record(kind, name, block=b"", *concurrent, newline=b"\r\n"):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"warc-record-id: <" + name.encode() + b">", *(b"WARC-Concurrent-To: <" + c.encode() + b">" for c in concurrent), b"Content-Length: %d" % len(block)]
    return newline.join(lines) + newline * 2 + block + newline * 2


def test_links_in_any_direction_across_files(spark, tmp_path):
    os.mkdir(tmp_path / "w")
    files = [
        # The response names its request, the metadata names the response; one more metadata names the request.
        record("warcinfo", "i") + record("request", "q1", b"GET") + record("response", "r1", b"body 1", "q1"),
        record("metadata", "m1", b"k: v", "r1") + record("metadata", "n1", b"k: v", "q1") + record("metadata", "lost", b"", "nowhere"),
        # The response names request and metadata at once; plain line ends.
        record("response", "r2", b"body 2", "q2", "m2", newline=b"\n") + record("metadata", "m2", newline=b"\n") + record("request", "q2", newline=b"\n"),
    ]
    for i, data in enumerate(files):
        (tmp_path / "w" / f"{i}.warc.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    got = {c.capture_id: (c.response and c.response.record_id, [r.record_id for r in c.requests], [r.record_id for r in c.metadata]) for c in warc.captures(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert got == {"<r1>": ("<r1>", ["<q1>"], ["<m1>", "<n1>"]), "<r2>": ("<r2>", ["<q2>"], ["<m2>"]), "<nowhere>": (None, [], ["<lost>"])}


def test_damaged_bytes_stop_nothing(spark, tmp_path):
    os.mkdir(tmp_path / "w")
    whole = record("response", "a", b"x" * 10) + b"junk between\r\n" + record("response", "b", b"y") + record("response", "c", b"z" * 100)[:-60]
    (tmp_path / "w" / "1.warc").write_bytes(whole)
    got = warc.read_records(spark, str(tmp_path / "w")).select("record_id", "type").collect()
    assert [tuple(r) for r in got] == [("<a>", "response"), (None, "damaged"), ("<b>", "response"), ("<c>", "damaged")]


# op12 ----------------------------------------------------------------------------------------------------------

SOUND = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """All edits of a short conversation: the least (cost, audit) and its text."""
    best = None
    for kept in itertools.product(*("D" if f in ("blank", "duplicate") else "DKua" for _, _, f in rows)):
        base, roles = 0, []
        for (role, text, fault), how in zip(rows, kept, strict=True):
            if how == "D":
                base += 2
                roles.append((None, "D", None))
                continue
            base += (how != "K") + 5 * (fault == "truncated")
            name = role if how == "K" else {"u": "user", "a": "assistant"}[how]
            roles.append((name, "K" if how == "K" else "R", text))
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost = base + 5 * len("".join(gaps))
            if best is not None and cost > best[0]:
                continue
            initials, audit, lines = "", "", []
            for i, gap in enumerate(gaps):
                for c in gap:
                    initials, audit = initials + c, audit + "I"
                    lines.append({"u": "user:", "a": "assistant:"}[c])
                if i < len(rows):
                    name, letter, text = roles[i]
                    audit += letter
                    if name is not None:
                        initials += name[:1] or "?"
                        lines.append(f"{name}:{text}")
            if SOUND.match(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return best


def test_least_audits_against_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.choice(["", "", "truncated", "truncated", "blank"])) for i in range(rng.randint(0, 3))]
        work = repair.Repair()
        for role, text, fault in rows:
            work.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        assert work.end() == brute(rows), rows


def plain_least(rows):
    """The same programme with whole strings."""
    states = {0: (0, "")}
    for role, fault in rows:
        states = inserted(states)
        out = {}
        for s, (cost, audit) in states.items():
            options = [(s, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                options.append((repair.NEXT[s][0], 1 + more, "R"))
                if (s, role[:1]) in repair.KEPT:
                    options.append((repair.KEPT[s, role[:1]], more, "K"))
            for t, price, letter in options:
                out[t] = min(out.get(t, (10**9, "")), (cost + price, audit + letter))
        states = out
    states = inserted(states)
    return min(states[s] for s in (0, 3) if s in states)


def inserted(states):
    found = dict(states)
    for s in (0, 1, 3):
        if s in states:
            found[2] = min(found.get(2, (10**9, "")), (states[s][0] + 5, states[s][1] + "I"))
    if 2 in found:
        found[3] = min(found.get(3, (10**9, "")), (found[2][0] + 5, found[2][1] + "I"))
    return found


def test_long_conversations_settle_and_stay_least():
    rng = random.Random(5)
    for n in (200, 1000, 3000):
        for kinds in (["user", "assistant"], ["user"], ["user", "assistant", "system"], ["tool"]):
            rows = [(rng.choice(kinds), rng.choice(["", "", "", "truncated", "blank"])) for _ in range(n)]
            work = repair.Repair()
            for role, fault in rows:
                work.row(role, "x", fault == "blank", fault == "truncated")
            if kinds != ["user"] and kinds != ["tool"]:
                assert len(work.trails) < 2 * repair.SETTLE_NODES
            assert work.end()[:2] == plain_least(rows)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(repair, "_MOD", 3)  # nearly all audits share their hash
    rng = random.Random(7)
    trails = repair.Trails()
    nodes = [0]
    for _ in range(400):
        nodes.append(trails.add(rng.choice(nodes), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert trails.less(a, "K", b, "D") == (trails.text(a) + "K" < trails.text(b) + "D")


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, None, None, False), (1, 3, "user", "same.", False), (1, 3, "user", "same.", False), (1, 9, "assistant", "end!", False), (2, 1, "user", "gone", True), (None, 1, "user", "q?", False), (None, 2, "assistant", " \t", False), (3, 1, "system", "only.", False),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, gone boolean, nth string")
    got = {r.conv_id: r for r in repair.repaired(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].audit, got[1].cost, got[1].illegal) == (5, 1, 1, "DKDK", 4, 2)
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert (got[None].blank, got[None].audit, got[None].cost) == (1, "DD", 4)
    assert (got[3].audit, got[3].cost, got[3].repaired_sha256) == ("D", 2, empty)
    assert repair.repaired(df.limit(0)).count() == 0


# op13 ----------------------------------------------------------------------------------------------------------


def test_shares_equal_the_average_over_orders():
    rng = random.Random(11)
    for n in (1, 2, 3, 5):
        weights = filter_audit.shapley_weights(n)
        value = [0] + [rng.randint(0, 1000) for _ in range((1 << n) - 1)]
        totals = [0] * n
        for order in itertools.permutations(range(n)):
            mask = 0
            for i in order:
                totals[i] += value[mask | 1 << i] - value[mask]
                mask |= 1 << i
        count = len(list(itertools.permutations(range(n))))
        assert [sum(w * v for w, v in zip(row, value, strict=True)) * count for row in weights] == totals


def test_masks_of_odd_documents(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, words, "en"), (2, words, "en"), (2, words, "en"), (None, words, None), (3, None, "en"), (4, "", ""), (5, "x " * 200, "en"), (6, words + " #", "en"), (7, words.upper(), "en"), (8, " ".join(["a"] * 150), "en"), (9, "\x0b\x0ca b\t" * 60, "de"),
    ]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, fails string, same string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, None), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.fails): (r.n, r.good, r.toxic) for r in filter_audit.masks(docs, labels).where("n > 0").collect()}
    assert got == {("en", 0): (1, 1, 0), ("en", 16): (2, 0, 0), ("", 0): (1, 0, 0), ("en", 1): (2, 0, 0), ("", 17): (1, 0, 0), ("en", 2): (1, 0, 1), ("en", 8): (1, 0, 0), ("en", 4): (1, 0, 0), ("de", 2): (1, 0, 0)}


def test_every_order_is_there_and_adds_up(spark):
    counts = spark.createDataFrame([("p", 0, 3, 1, 0), ("p", 31, 4, 1, 1), ("p", 1, 2, 0, 0), ("", 6, 1, 1, 1)], "part string, fails int, n long, good long, toxic long")
    out = filter_audit.audit(filter_audit.coalitions(counts))
    assert out.count() == 2 * 120 * 5
    sums = {tuple(r) for r in out.groupBy("part", "filter_order").agg(F.sum("removed"), F.min("kept"), F.sum("good_lost"), F.sum("shapley")).drop("filter_order").collect()}
    assert sums == {("p", 6, 3, 1, 720), ("", 1, 0, 1, 120)}
    assert filter_audit.audit(filter_audit.coalitions(counts.limit(0))).count() == 0

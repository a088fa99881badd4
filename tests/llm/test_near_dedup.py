import random
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import near_dedup
from tidewell.llm.common import table
from tidewell.llm.components import components
from tidewell.llm.units import as_array


def brute_classes(rows):
    """Class of each row by all pairs: same words, or linked by similarity and alignment."""
    words = near_dedup.word_arrays(as_array(t for _, t in rows))
    sets = [near_dedup.shingles(w) for w in words]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = words[i].tobytes() == words[j].tobytes() and (len(words[i]) or (rows[i][1] or "").strip() == (rows[j][1] or "").strip())
            if not same and len(sets[i]) and len(sets[j]):
                same = near_dedup.shingle_similarity(sets[i], sets[j]) >= 0.8 and near_dedup.aligned(words[i].tolist(), words[j].tolist(), 0.8) > 0
            if same:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(sorted(g, key=str) for g in groups.values())


def found_classes(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.class_id, []).append(r.doc_id)
    return groups


def test_classes_of_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    groups = found_classes(near_dedup.near_duplicates(docs))
    assert sorted(sorted(g, key=str) for g in groups.values()) == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert all(min(g) == c for c, g in groups.items())


@pytest.fixture(scope="module")
def planted(spark):
    """A large group of near copies, chains of them, a passage that many share, and strangers."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        add(copy)
    chain = [word() for _ in range(80)]
    for i in range(12):
        add(chain)
        chain = list(chain)
        chain[6 * i + 3] = word()
    passage = [word() for _ in range(60)]
    for _ in range(150):
        add([*(word() for _ in range(60)), *passage, *(word() for _ in range(60))])
    for _ in range(40):
        add([word() for _ in range(rng.randint(1, 80))])
    menu = [(at, word()) for at in range(0, 150, 5) for _ in range(3)]
    base = [word() for _ in range(150)]
    for i in range(200):  # one to nine edits, some of them shared: linked ones, and many that are not
        copy = list(base)
        for _ in range(1 + i % 9):
            at, new = rng.choice(menu) if rng.random() < 0.7 else (rng.randrange(150), word())
            copy[at] = new
        add(copy)
    parts = [[word() for _ in range(30)] for _ in range(8)]
    for _ in range(30):  # the same shingles in other orders: no links
        rng.shuffle(parts)
        add([w for p in parts for w in p])
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_large_groups_chains_and_shared_passages(planted):
    groups = found_classes(near_dedup.near_duplicates(planted))
    assert sorted(sorted(g, key=str) for g in groups.values()) == brute_classes([(r.doc_id, r.text) for r in planted.collect()])


def test_sharing_finds_all_linked_pairs_of_a_galaxy(spark):
    """Against all pairs: members that are linked to one another but not both near the hub."""
    rng = random.Random(6)
    hub = list(range(100))
    texts = [hub]
    for _ in range(220):
        text = list(texts[0] if rng.random() < 0.3 else rng.choice(texts))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(text))
            text[at : at + 1] = [rng.randrange(10**6)] * rng.choice((0, 1, 1, 1, 2))
        texts.append(text)
    sets = [near_dedup.shingles(np.array(t, np.uint32)) for t in texts]
    rows = []
    for i, x in enumerate(sets[1:], 1):
        apart = np.setxor1d(sets[0], x)
        rows.append((0, i, len(x), len(sets[0]), apart.view(np.int64).tolist(), i))
    found = near_dedup.sharing(spark.createDataFrame(rows, "hub long, key long, n int, n_hub int, cells array<long>, root long"))
    similar = lambda i, j: near_dedup.shingle_similarity(sets[i], sets[j]) >= 0.8
    wanted = {(i, j) for j in range(1, len(texts)) for i in range(1, j) if similar(i, j) and not (similar(0, i) and similar(0, j))}
    pairs = {(r.a, r.b) for r in found.collect()}
    assert len(wanted) > 50 and wanted <= pairs and len(pairs) < 3 * len(wanted)


def test_short_pairs(spark):
    """Pairs of similarity 0.8 and a little more: a word more at an end, or at both."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in [*[8] * 20, *[9] * 20, *[12] * 100, *range(10, 60)]:
        words = [word() for _ in range(n)]
        more = max(1, (n - 4) // 4)
        texts += [words, [*words, *(word() for _ in range(more))] if n % 2 else [*(word() for _ in range(more)), *words]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    groups = found_classes(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(sorted(g) for g in groups.values()) == brute_classes(rows) == [[i, i + 1] for i in range(0, len(rows), 2)]


def test_short_buckets_lose_no_pair():
    rng = random.Random(9)
    for _ in range(2000):
        n = rng.randint(1, near_dedup.SHORT - 1)
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        gone = rng.randint(0, n // 5)
        b = np.concatenate([a[gone:], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 4))], np.uint64)])
        if near_dedup.shingle_similarity(a, b) >= 0.8:
            assert len(np.intersect1d(near_dedup.buckets(a), near_dedup.buckets(b)))


def test_odd_rows(odd_documents, no_documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert sum(r.kept for r in rows) == 7  # one row twice, and two nulls and an empty text are one class
    kept = near_dedup.keep_one(odd_documents)
    assert kept.schema == odd_documents.schema and kept.count() == 7
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_alignment_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randrange(6)] * rng.randint(0, 1)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        share = 2 * best[-1, -1] / (len(a) + len(b)) if a or b else 1.0
        got = near_dedup.aligned(a, b, 0.8)
        assert abs(got - share) < 1e-9 if share >= 0.8 else got == 0


def test_shingles_are_a_multiset():
    words = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], np.uint32)
    assert len(np.unique(near_dedup.shingles(words))) == 6
    assert Counter(near_dedup.shingles(words[:5]).tolist() + near_dedup.shingles(words).tolist()).most_common(1)[0][1] == 2


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import labelled, pii, quality, toxicity
from tidewell.llm.common import table
from tidewell.llm.units import as_array

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and sum((lambda q: q - 9 if q > 9 else q)(int(x) * (1 + i % 2)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(3)
    parts = ["1", "22", "255", "256", "0", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "é", "\n", "4111111111111111", "00012", "%"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert [tuple(s) for s in pii.base_spans(text)] == plain_base(text)


def test_base_spans_are_quick_on_hostile_texts():
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "+(((" * 20_000) == []


def test_semi_markov_field_finds_variants_and_keeps_off_other_numbers(spark, sf_dir):
    texts = [f"the user jo{i}x@mail{i % 7}.example.com wrote from 4{i % 10}.10.1.{i % 200} or +1 ({200 + i}) 555-{1000 + i} about it" for i in range(120)]
    texts += [f"see page {i} of 20{i % 10}1 and order {10000 + i} or key={i}ab{i}cd{i}" for i in range(60)]
    model = pii.train([e for t in texts for e in pii.training_examples(t)])
    kinds = lambda t: [s.kind for s in model.spans(t)]
    assert kinds("call (456) 555-2186 now") == ["phone"]
    assert kinds("mail joe.smith(at)mail5.example(dot)com ok") == ["email"]
    assert kinds("nothing 12345 on page 12 of 2021") == []
    text = "a jo@mail.example.com b"
    base, spans = pii.all_spans(text, model)
    assert base == spans and pii.redacted(text, spans) == "a <EMAIL> b"


def segmentations(window, at=0):
    """All ways to cover the tokens of a window from ``at`` on, as lists of (segment, kind)."""
    n = len(window.borders) - 1
    if at == n:
        yield []
        return
    for rest in segmentations(window, at + 1):
        yield rest
    for k, (i, j, kinds, _) in enumerate(window.segments):
        if i == at:
            for rest in segmentations(window, j):
                yield from ([(k, kind), *rest] for kind in range(len(kinds)))


def test_decoding_against_all_segmentations():
    rng = random.Random(5)
    parts = ["+1", " 555", "-1234", " 10.0.0.1", "a", " 4111", "(at)", "b", ".c", " "]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        for window in pii.windows(text):
            names = sorted({f for *_, found in window.segments for f in found})
            weights = np.array([[rng.gauss(0, 1) for _ in names] for _ in pii.KINDS]).reshape(len(pii.KINDS), len(names))
            model = pii.SemiCrf({f: i for i, f in enumerate(names)}, weights)
            scores = model.scores(window)
            best = max(sum(scores[k][kind] for k, kind in way) for way in segmentations(window))
            at = {(window.borders[i], window.borders[j]): (k, kinds) for k, (i, j, kinds, _) in enumerate(window.segments)}
            got = sum(scores[at[s.start, s.end][0]][at[s.start, s.end][1].index(pii.KINDS.index(s.kind))] for s in model.decode(window))
            assert abs(got - best) < 1e-9


@pytest.fixture(scope="module")
def big_documents(spark):
    return [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(table(spark, "/root/testdata/sf0.1", "documents"))


def test_recall_of_respelled_data(field, big_documents):
    """Matches of the documents, respelled, are found with their borders and kinds."""
    found, planted, added = 0, 0, 0
    for text in big_documents:
        base, spans = pii.all_spans(text, field)
        added += len(spans) - len(base)
        for turn, s in enumerate(base):
            if any(b is not s and b.start < s.end and s.start < b.end for b in base):
                continue
            new = pii.respelled(s, text[s.start : s.end], turn)
            planted += 1
            found += pii.Span(s.kind, s.start, s.start + len(new)) in pii.all_spans(text[: s.start] + new + text[s.end :], field)[1]
    assert planted > 40 and found >= 0.95 * planted and added < 0.1 * planted


def test_field_reaches_as_far_as_its_tokens(field):
    local, host = "a" * 70, "b" * 80
    text = "word " * 50_000 + f"write to {local}[at]{host}[dot]example[dot]com now " + "word " * 50_000
    assert pii.redacted(text, pii.all_spans(text, field)[1]) == "word " * 50_000 + "write to <EMAIL> now " + "word " * 50_000


def test_personal_data_on_odd_rows(spark, odd_documents, no_documents):
    got = pii.find(odd_documents)
    assert got.count() == odd_documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in got.where("doc_id = 2 or doc_id = 3").collect())
    assert pii.find(no_documents).count() == 0
    assert pii.redact(odd_documents).schema == odd_documents.schema


def test_op5_base_spans(spark, sf_dir):
    got = {r.doc_id: r for r in pii.op5_pii(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        base = plain_base(r.text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[r.doc_id].base_sha256 == digest
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[r.doc_id].spans.split(",")) | {""}
        assert got[r.doc_id].n_email == sum(k == "email" for k, _, _ in base)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def accuracy(rows, labels, label):
    pairs = [(r.predicted, getattr(labels[r.doc_id], label)) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([p == y for p, y in pairs]), len(pairs)


def test_classifiers_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, big, "labels").collect()}
    for query, label, least in ((quality.op1_quality, "quality", 0.95), (toxicity.op4_toxicity, "toxic", 0.88)):
        rows = query(spark, big).collect()
        assert len(rows) == table(spark, big, "documents").count()
        assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
        share, n = accuracy(rows, labels, label)
        assert n > 50 and share >= least


def test_held_out_labels_are_not_learnt(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    drawn = labelled.labelled_sample(docs, labels, "toxic").collect()
    assert drawn and not any(held(r.doc_id) for r in drawn)
    assert labelled.labelled_sample(docs, labels, "toxic", rows=5).count() == 5


def words_with_pair(n, together, rng):
    """Texts of common words with two words of interest, and their labels."""
    texts, labels = [], []
    for _ in range(n):
        words = [rng.choice(["the", "of", "and", "in", "was", "by", "for", "with"]) for _ in range(6)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * insult + ["martians"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(together(insult, group)))
    return texts, labels


@pytest.mark.parametrize("together", [lambda a, b: a and b, lambda a, b: a != b])
def test_factorization_machine_learns_a_pair(spark, together):
    """Neither word alone is a sign, both together are; in the second case neither has any association of its own."""
    texts, labels = words_with_pair(2500, together, random.Random(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit(docs, truth)
    both, one, other, none = model.scores(as_array(["the vermin and martians", "the vermin of", "in martians", "by the in"]))
    assert (both > 0.5) == bool(together(True, True)) and (one > 0.5) == (other > 0.5) == bool(together(True, False)) and none < 0.5


def test_interactions_against_all_pairs():
    """The machine's logits against the sum over all pairs of a document's terms."""
    rng = np.random.default_rng(1)
    slot = np.full(toxicity.BUCKETS, -1, np.int32)
    model = toxicity.FactorizationMachine(slot, 0.3, rng.normal(size=21), rng.normal(size=(21, toxicity.FACTORS)))
    sets = [rng.choice(20, rng.integers(0, 9), replace=False) for _ in range(40)]
    got = model.logits(np.repeat(np.arange(40), [len(x) for x in sets]), np.concatenate(sets), 40)
    for logit, x in zip(got, sets, strict=True):
        plain = 0.3 + model.weight[x].sum() + sum(model.factors[a] @ model.factors[b] for i, a in enumerate(x) for b in x[:i])
        assert abs(logit - plain) < 1e-9


def test_pairs_are_counted_as_by_hand():
    texts, labels = words_with_pair(300, lambda a, b: a != b, random.Random(2))
    words = sorted({w for t in texts for w in t.split()})
    sets = [sorted({words.index(w) for w in t.split()}) for t in texts]
    got = toxicity.telling_pairs(np.repeat(np.arange(300), [len(x) for x in sets]), np.concatenate(sets), np.array(labels, float), len(words))
    share = lambda *ts: (sum(lab for x, lab in zip(sets, labels, strict=True) if set(ts) <= set(x)), sum(set(ts) <= set(x) for x in sets))
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            toxic, n = share(i, j)
            if i != j and n >= toxicity.LEAST_DOCS:
                low, high = sorted(t / m for t, m in (share(i), share(j)))
                beyond, q = max((toxic - n * high, high), (n * low - toxic, low))
                q = min(max(q, 0.5 / 300), 1 - 0.5 / 300)
                best = max(best, max(beyond - 0.5, 0) ** 2 / (n * q * (1 - q)))
        assert got[i] == (best >= toxicity.LEAST_PAIR_CHI)
    assert {words[i] for i in np.flatnonzero(got)} == {"vermin", "martians"}


def test_classifiers_without_labels_or_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(odd_documents, labels)
        rows = module.score(odd_documents, model).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.score(no_documents, module.fit(no_documents, labels)).count() == 0

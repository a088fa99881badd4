import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import bpe, elias_fano, packing, token_ids, units
from tidewell.llm.common import table
from tidewell.llm.units import as_array, library_encoder

PARTS = ["a", "aa", "B", "'s", " ", "  ", "\n", "\n\n", "\t", "\xa0", "1", "é", "é", "<|endoftext|>", "<|startoftext|>", ",", "...", "\x1c", "x", "Σ", "İ", "ß", "　", "\r\n", "\U0001f44d\U0001f3fd", "\x00", ".", "cat", "nation", " "]


def library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def random_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    texts = random_texts(3000)
    want = [e.ids for e in library(name).encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in library_encoder(name).encode(as_array(texts))] == want


def test_pair_index_matches_the_library_and_decodes():
    texts = [*random_texts(3000), "aaaaaaa banana bananana"]
    tok = library("word_bpe_49k.json")
    own, encoder = bpe.pair_index_encoder("word_bpe_49k.json")
    for text, blob in zip(texts, encoder.encode(as_array(texts)), strict=True):
        ids = np.frombuffer(blob, "<u2")
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids).decode() == tok.decode(want, skip_special_tokens=False)


def test_elias_fano_select_and_values():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (1000, 5), (1000, 10**9), (777, 777)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = elias_fano.EliasFano(elias_fano.encode(values))
        assert len(code) == n and code.values().tolist() == values.tolist()
        assert [code.select(i) for i in range(n)] == values.tolist()
    raw = elias_fano.encode(np.arange(0, 10**6, 100))
    assert len(raw) < 10_000 * (2 + np.log2(100)) / 8 * 1.15  # near the least possible
    with pytest.raises(IndexError):
        code.select(n)


def test_token_files_round_trip(spark, odd_documents, tmp_path):
    path = str(tmp_path / "ids")
    token_ids.write_token_ids(odd_documents, path)
    got = token_ids.read_token_ids(spark, path).collect()
    tok = library("byte_bpe_50k.json")
    want = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in odd_documents.collect()]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want), key=str)
    in_file = sorted(got, key=lambda r: r.start)
    assert [key((r.doc_id,)) for r in in_file] == sorted(key((r.doc_id,)) for r in got)
    assert [r.start for r in in_file] == np.cumsum([0, *(r.n_tokens for r in in_file)])[:-1].tolist()
    segment = spark.read.parquet(path).orderBy("shard", "segment").first().asDict()
    first = token_ids.document_ids(segment, 0)
    assert len(first) == in_file[0].n_tokens


def test_token_files_of_an_empty_table(spark, no_documents, tmp_path):
    path = str(tmp_path / "ids")
    token_ids.write_token_ids(no_documents, path)
    assert token_ids.read_token_ids(spark, path).count() == 0


def test_op2_matches_the_library(spark, sf_dir):
    tok = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_ids.op2_token_ids(spark, sf_dir).collect()}
    start = 0
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7_matches_the_library(spark, sf_dir):
    tok = library("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_bpe_columns(spark, odd_documents, no_documents):
    ids = bpe.encode_column(odd_documents)
    assert ids.count() == odd_documents.count()
    back = {(r.doc_id, r.text) for r in bpe.decode_column(ids).collect()}
    assert (2, "") in back and (3, "") in back and any("<|endoftext|>" in t for _, t in back)
    assert bpe.encode_column(no_documents).count() == 0 and bpe.round_trip(no_documents).count() == 0


def check_pieces(pieces, want, size):
    """Every document whole, every sequence gapless and full or of a power of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    for doc_id, ids in want:
        copies = by_doc[doc_id, len(ids)]
        assert sum(p.length for p in copies) % len(ids) == 0
        for p in copies:
            if len([w for w in want if w[0] == doc_id and len(w[1]) == len(ids)]) == 1:
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in want)


def test_packing(spark, sf_dir, odd_documents, no_documents):
    tok = library("word_bpe_49k.json")
    for docs in (table(spark, sf_dir, "documents"), odd_documents):
        want = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
        check_pieces(packing.pack(docs).collect(), want, 4096)
    assert packing.pack(no_documents).count() == 0


def test_bm25_scores_against_brute_force():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(30)]
    idf = rng.random(64)
    index = packing.ShardIndex(docs, idf, 30.0)
    for seed in (0, 7):
        want = []
        for d in docs:
            total = 0.0
            for t in index.query[seed].tolist():
                tf = (d == t).sum()
                total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / 30.0)) if tf else 0
            want.append(total)
        assert np.allclose(index.scores(seed), want)


def test_related_documents_share_a_window():
    a, b = np.arange(100, 140, dtype=np.uint16), np.arange(500, 540, dtype=np.uint16)
    docs = [a, b, a.copy(), b.copy(), a.copy(), b.copy()]
    idf = np.ones(1024)
    pieces = packing.short_tail(list(packing.fill_windows(docs, packing.ShardIndex(docs, idf, 40.0), 120)), 120)
    assert {p[0] for p in pieces if p[3] == 0} == {0, 2, 4}


def test_relatives_share_windows_with_many_shards(spark, monkeypatch):
    """Groups of six texts that have two thirds of their words in common, in 12 shards and more."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 32)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = [word() for _ in range(40)]
    rows = []
    for g in range(64):
        own = [word() for _ in range(20)]
        for _ in range(6):
            words = [*own, *(word() for _ in range(5)), *(rng.choice(common) for _ in range(5))]
            rng.shuffle(words)
            rows.append((g, " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(4)
    pieces = packing.pack(docs, size=1024).collect()
    assert len({p.sequence_id >> 32 for p in pieces}) >= 12
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, set()).add(p.doc_id)
    near = [any(rows[e][0] == rows[d][0] for w in windows.values() if d in w for e in w if e != d) for d in range(len(rows))]
    assert np.mean(near) > 0.6  # 0.24 where shards are dealt by chance


def test_shards_are_cut_where_neighbours_differ_most():
    places = np.array([[1, 1], [1, 2], [3, 1], [3, 1], [4, 1], [4, 1], [4, 2], [4, 2]])
    assert packing.cut_point(places) == 4
    assert packing.cut_point(places[:2]) == 1
    assert packing.cut_point(places[2:4]) == 1


def test_units_of_a_batch_are_told_apart_together(monkeypatch):
    """No expression is matched in Python for each unit, and ids equal the library's."""
    def refuse(unit):
        raise AssertionError(unit)

    monkeypatch.setattr(units, "_LATIN", refuse)
    monkeypatch.setattr(units, "_LOADED", {})
    texts = ["Größe, hey! hey\nStraße\n\nx 12 ÇA.", "", None, "one two,, two", "\nhey ŁÓDŹ ok", "a", " "]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        whole = Tokenizer.from_file(units.tokenizer_path(name))
        whole.no_truncation()
        whole.no_padding()
        want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        encoder = units.library_encoder(name)
        assert encoder.encode(units.as_array(texts)) == want
        assert encoder.encode(units.as_array(["", None])) == [b"", b""] and encoder.encode(units.as_array([])) == []


def test_a_word_is_encoded_once_for_all_its_forms(monkeypatch):
    """Case, line ends and marks behind a word make no new word for a vocabulary of lower-case words."""
    monkeypatch.setattr(units, "_LOADED", {})
    encoder = units.library_encoder("word_bpe_49k.json")
    asked = []
    encode_units = encoder.encode_units

    def recorded(found):
        asked.extend(found)
        return encode_units(found)

    monkeypatch.setattr(encoder, "encode_units", recorded)
    texts = ["Größe größe\ngröße GRÖSSE größe$$$ Größe.&&& größe,### größe)", "\nGröße %%%"]
    whole = library("word_bpe_49k.json")
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(as_array(texts)) == want
    assert [u for u in asked if u.strip().lower().startswith("größe")] == [" größe"]
    assert encoder.encode(as_array([*texts, "größe&&&&"])) == [*want, np.array(whole.encode("größe&&&&").ids, "<u2").tobytes()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marks_behind_words_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(units, "MAX_STOPS", 20)
    rng = random.Random(3)
    parts = ["Word", "é", "ß", "́", "'s", "'", "|>", "<|", "<|endoftext|>", "\n", " ", " ", "1", "·", *units._STOPS]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    want = [e.ids for e in library(name).encode_batch_fast(texts, add_special_tokens=False)]
    encoder = library_encoder(name)
    got = [b for at in range(0, len(texts), 500) for b in encoder.encode(as_array(texts[at : at + 500]))]
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == want


def test_occurrences_of_ids_in_documents():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 9, n).astype("<u2") for n in (0, 5, 30, 1)] + [np.array([65535, 0, 65535], "<u2")]
    for more in (0, 1 << 16):  # with more than 65,536 documents, too
        flat, lengths = packing.joined([d.tobytes() for d in docs] + [b""] * more)
        want = sorted((t, i, int((d == t).sum())) for i, d in enumerate(docs) for t in set(d.tolist()))
        assert list(zip(*(x.tolist() for x in packing.occurrences(flat, lengths)), strict=True)) == want


def test_frequent_terms_have_rows_and_rare_ones_lists():
    docs = [np.array([1, 2, 2, 10 + i // 2], np.uint16) for i in range(20)]
    idf = np.linspace(0.1, 1, 64)
    index = packing.ShardIndex(docs, idf, 4.0)
    assert index.rows.shape == (2, 20) and len(index.owners) == 20
    part = lambda t, tf: idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1)
    want = part(1, 1) + part(2, 2)
    assert np.allclose(index.scores(5), [want + (part(12, 1) if i in (4, 5) else 0) for i in range(20)])

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute_classes
from tidewell.llm import packing, pii, quality, toxicity
from tidewell.llm.common import table
from tidewell.llm.units import as_array, tokenizer_path


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path_factory.mktemp("stages") / name))
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_columns_and_rows(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.count() == len(rows_of(after)) and set(rows_of(after)) <= set(rows_of(before))


@pytest.mark.parametrize(("name", "module", "kept"), [("toxicity", toxicity, lambda s: s < 0.3), ("quality", quality, lambda s: s >= 0.7)])
def test_classifier_stages_keep_by_score(spark, sf_dir, stages, name, module, kept):
    before, after = stages[name]
    model = module.fit(before, table(spark, sf_dir, "labels"))
    rows = before.collect()
    scores = model.scores(as_array(r.text for r in rows))
    assert set(rows_of(after)) == {r.doc_id for r, s in zip(rows, scores, strict=True) if kept(s)}
    assert all(rows_of(after)[d] == rows_of(before)[d] for d in rows_of(after))


def test_one_document_of_each_class_stays(stages):
    before, after = stages["near-dedup"]
    classes = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert set(rows_of(after)) == {min(c) for c in classes}


def test_texts_are_masked(stages):
    before, after = stages["pii"]
    model = pii.fit(before)
    masked = rows_of(after)
    for d, r in rows_of(before).items():
        text = pii.redacted(r.text, pii.all_spans(r.text, model)[1])
        assert masked[d] == r.__class__(**{**r.asDict(), "text": text, "n_chars": len(text)})


def test_every_id_is_packed_once(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tok = Tokenizer.from_file(tokenizer_path(packing.WORD_VOCABULARY))
    pieces, windows = {}, {}
    for p in after.collect():
        pieces.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    texts = rows_of(before)
    assert set(pieces) == set(texts)
    for d, found in pieces.items():
        ids = np.array([*tok.encode(texts[d].text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for found in windows.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.SEQUENCE


def test_stages_on_odd_rows(spark, odd_documents, no_documents, tmp_path):
    """Null, empty, long and repeated texts, null ids and clashing columns go through; empty tables stay empty."""
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], labels).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_documents.withColumn("n_chars", odd_documents.doc_id), no_documents.withColumn("n_chars", no_documents.doc_id)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            assert found.count() <= docs.count() or name == "packing"
            assert name == "packing" or found.columns == docs.columns

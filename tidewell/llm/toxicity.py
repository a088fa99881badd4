"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed words and word beginnings. The machine adds a weight for each
term and, by a short vector for each term, the interaction of every pair, so that two words that
are harmless alone can count together. Terms are the buckets that tell the classes of the training
sample apart alone, and those of the most frequent buckets that do so in a pair, beyond what either
of the two tells.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import broadcasted, gather, held_out, sliced, stored, table
from tidewell.llm.labelled import labelled_sample
from tidewell.llm.units import split_units, strings

BUCKETS = 1 << 20
#: Length of the word beginnings that are terms of their own.
STEM = 5
#: Buckets that the machine has weights for, and documents of the sample a bucket must occur in.
TERMS, LEAST_DOCS = 16_384, 4
#: Chi-square that a bucket must reach, its count lowered by half a document as in Yates's correction.
LEAST_CHI = 12.0
#: Buckets whose pairs are looked at (up to half of them tell alone, the rest are the most frequent others), chi-square that a pair must reach, documents counted at a time.
PAIR_TERMS, LEAST_PAIR_CHI, PAIR_ROWS = 2048, 40.0, 2048
FACTORS, EPOCHS, BATCH, RATE, L2 = 8, 10, 64, 0.15, 1e-4
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def terms_of_unit(unit: str) -> list[int]:
    """Buckets of the words in a unit and of their beginnings."""
    out = []
    for word in _WORD.findall(unit.lower()):
        raw = word.encode()
        out.append(zlib.crc32(raw) % BUCKETS)
        if len(word) > STEM:
            out.append(zlib.crc32(b"^" + word[:STEM].encode()) % BUCKETS)
    return out


def document_terms(texts: pa.Array, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs of all texts, each once, by row. With ``slot`` buckets turn into its entries and
    those of -1 fall out."""
    units, counts = split_units(texts)
    found = list(map(terms_of_unit, strings(units.dictionary)))
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((t for f in found for t in f), np.int64, int(n.sum()))
    if slot is not None:
        flat = slot[flat]
        keep = flat >= 0
        n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
        flat = flat[keep]
    starts = np.cumsum(n) - n
    use = units.indices.to_numpy()
    rows = np.repeat(np.arange(len(counts)), counts)
    has = n[use] > 0
    use, rows = use[has], rows[has]
    lengths = n[use]
    ends = np.cumsum(lengths)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    codes = np.unique(np.repeat(rows, lengths) * BUCKETS + flat[np.repeat(starts[use], lengths) + inner])
    return codes // BUCKETS, codes % BUCKETS


class FactorizationMachine:
    def __init__(self, slot: np.ndarray, bias: float, weight: np.ndarray, factors: np.ndarray):
        self.slot, self.bias, self.weight, self.factors = slot, bias, weight, factors

    def logits(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Of n documents given by (row, term) pairs; pair interactions in linear time."""
        linear = np.bincount(rows, self.weight[terms], n)
        v = self.factors[terms]
        pairs = np.zeros(n)
        for f in range(v.shape[1]):
            pairs += np.bincount(rows, v[:, f], n) ** 2 - np.bincount(rows, v[:, f] ** 2, n)
        return self.bias + linear + pairs / 2

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, terms = document_terms(texts, self.slot)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, terms, len(texts)), -30, 30)))


def choose_terms(docs: np.ndarray, toxic: np.ndarray, n: int, n_toxic: float) -> tuple[np.ndarray, np.ndarray]:
    """Of terms in ``docs`` documents, ``toxic`` of them toxic: (those of the largest chi-square between occurrence and
    label, further ones of the ``PAIR_TERMS`` most frequent), as indices."""
    if not 0 < n_toxic < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    expected = docs * n_toxic / n
    apart = np.maximum(np.abs(toxic - expected) - 0.5, 0) ** 2
    chi = np.where(docs >= LEAST_DOCS, apart / np.maximum(expected, 1e-9) + apart / np.maximum(docs - expected, 1e-9), 0)
    alone = np.argsort(-chi, kind="stable")[:TERMS]
    alone = alone[chi[alone] >= LEAST_CHI]
    frequent = np.argsort(-docs, kind="stable")[:PAIR_TERMS]
    return alone, np.setdiff1d(frequent[docs[frequent] >= LEAST_DOCS], alone)


def telling_pairs(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` slots tell in a pair: the toxic share of the documents that have both is further up or down
    than the share of those that have either. Counts of pairs have ``size`` squared cells."""
    n = len(labels)
    both, toxic = np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
    for at in range(0, n, PAIR_ROWS):
        upto = min(n, at + PAIR_ROWS)
        a, b = np.searchsorted(rows, [at, upto])
        has = np.zeros((upto - at, size), np.float32)
        has[rows[a:b] - at, slots[a:b]] = 1
        both += has.T @ has
        toxic += has.T @ (has * labels[at:upto, None].astype(np.float32))
    share = np.diag(toxic) / np.maximum(np.diag(both), 1)
    best = np.zeros(size)
    for i in range(size):
        low, high = np.minimum(share[i], share), np.maximum(share[i], share)
        above, below = toxic[i] - both[i] * high, both[i] * low - toxic[i]
        usual = np.clip(np.where(above > below, high, low), 0.5 / n, 1 - 0.5 / n)
        chi = np.maximum(np.maximum(above, below) - 0.5, 0) ** 2 / np.maximum(both[i] * usual * (1 - usual), 1e-9)
        chi[i] = 0
        best[i] = np.where(both[i] >= LEAST_DOCS, chi, 0).max(initial=0)
    return best >= LEAST_PAIR_CHI


def train(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, buckets: np.ndarray, n_alone: int, seed: int = 0) -> FactorizationMachine:
    """Logistic loss by Adagrad over small batches. One class alone gives its smoothed share as every score.

    ``rows`` (in order) and ``slots`` are the terms of all documents, ``buckets`` the bucket of each slot; slots
    from ``n_alone`` on are used if they tell in a pair.
    """
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    use = np.arange(len(buckets)) < n_alone
    docs = np.bincount(slots, minlength=len(buckets))
    paired = np.concatenate([np.argsort(-docs[:n_alone], kind="stable")[: PAIR_TERMS // 2], n_alone + np.argsort(-docs[n_alone:], kind="stable")])[:PAIR_TERMS]
    place = np.full(len(buckets), -1, np.int32)
    place[paired] = np.arange(len(paired))
    counted = place[slots] >= 0
    use[paired[telling_pairs(rows[counted], place[slots[counted]], labels, len(paired))]] = True
    size = int(use.sum())
    place[:] = -1
    place[use] = np.arange(size)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[buckets[use]] = np.arange(size)
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(slot, float(np.log(share / (1 - share))), np.zeros(size + 1), rng.normal(0, 0.01, (size + 1, FACTORS)))
    keep = use[slots]
    rows, terms = rows[keep], place[slots[keep]]
    starts = np.searchsorted(rows, np.arange(n + 1))
    grown_w, grown_v, grown_b = np.full(size + 1, 1e-6), np.full((size + 1, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if size else 0):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            docs = order[at : at + BATCH]
            lengths = starts[docs + 1] - starts[docs]
            t = gather(terms, starts[docs], lengths)
            r = np.repeat(np.arange(len(docs)), lengths)
            v = model.factors[t]
            sums = np.stack([np.bincount(r, v[:, f], len(docs)) for f in range(FACTORS)], 1)
            squares = np.stack([np.bincount(r, v[:, f] ** 2, len(docs)) for f in range(FACTORS)], 1)
            logit = model.bias + np.bincount(r, model.weight[t], len(docs)) + (sums**2 - squares).sum(1) / 2
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[docs]
            touched, back = np.unique(t, return_inverse=True)
            g = np.bincount(back, error[r], len(touched)) + L2 * model.weight[touched]
            grown_w[touched] += g * g
            model.weight[touched] -= RATE * g / np.sqrt(grown_w[touched])
            gv = np.stack([np.bincount(back, error[r] * (sums[r, f] - v[:, f]), len(touched)) for f in range(FACTORS)], 1) + L2 * model.factors[touched]
            grown_v[touched] += gv * gv
            model.factors[touched] -= RATE / 4 * gv / np.sqrt(grown_v[touched])
            grown_b += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(grown_b)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Trains on a sample of at most ``labelled.SAMPLE_ROWS`` rows. Spark counts the documents of each bucket; what
    the driver gets is one count for each bucket and, of each sample row, the slots of chosen buckets."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, found = document_terms(batch.column(1))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["doc_id", "label", "terms"])

    sample = stored(labelled_sample(docs, labels, "toxic", id_col, text_col).mapInArrow(terms, "doc_id long, label int, terms array<int>"), "toxicity-terms")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("docs"), F.sum("label").alias("toxic"))
    counts = counts.where(F.col("docs") >= LEAST_DOCS).orderBy("term").toArrow()
    buckets, n_docs, toxic = (counts[c].to_numpy() for c in ("term", "docs", "toxic"))
    alone, frequent = choose_terms(n_docs, toxic, n, n_toxic)
    buckets = buckets[np.concatenate([alone, frequent])]
    slot = np.full(BUCKETS, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))
    shared = docs.sparkSession.sparkContext.broadcast(slot)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value[x.values.to_numpy()] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.sort(x[x >= 0]).astype("<u2").tobytes() for x in found], pa.binary())], ["doc_id", "label", "slots"])

    drawn = sample.mapInArrow(slots, "doc_id long, label int, slots binary").toArrow()
    shared.destroy()
    drawn = drawn.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("slots", "ascending")])
    lists = [np.frombuffer(x.as_buffer(), "<u2") for x in drawn["slots"]]
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    return train(rows, np.concatenate([np.zeros(0, "<u2"), *lists]), drawn["label"].to_numpy().astype(np.float64), buckets, len(alone))


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text counts as empty. Repeated rows and
    those without an id are scored each; other columns are not read."""
    shared = broadcasted(docs.sparkSession, model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text scores below the threshold."""
    shared = broadcasted(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

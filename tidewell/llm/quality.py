"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Every term has a sparse random index vector that never changes; its word vector is the sum of the
index vectors of all its neighbours in the whole corpus. Terms are hashed words and, so that layout
counts as well as wording, each unit's shape: letter case, marks around it, whether it repeats the
unit before it. A document is the mean of its words' vectors and the mean of its shapes' vectors.
A network with one hidden layer is trained on a labelled sample; a part of the sample that it does
not see sets the temperature that its logits are divided by.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import broadcasted, held_out, sliced, table
from tidewell.llm.labelled import labelled_sample
from tidewell.llm.units import split_units, strings

#: Hash buckets of shapes and of words, width of a vector, non-zero components of an index vector.
SHAPES, WORDS, WIDTH, NON_ZERO = 2048, 14_336, 64, 4
TERMS = SHAPES + WORDS
#: Terms in a row of the shuffled sums.
BLOCK = 256
HIDDEN, EPOCHS, BATCH, RATE, L2 = 32, 40, 64, 3e-3, 1e-4
THRESHOLD = 0.7

_MARKS = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero components of each term's index vector."""
    rng = np.random.default_rng(17)
    return rng.integers(0, WIDTH, (TERMS, NON_ZERO)), rng.choice((-1.0, 1.0), (TERMS, NON_ZERO))


def unit_terms(key: str) -> tuple[int, int]:
    """(shape bucket, word bucket) of a unit; shape bucket 0 is kept for repetitions."""
    lead, core, trail = _MARKS.match(key).groups()  # type: ignore[union-attr]
    case = "U" if len(core) > 1 and core.isupper() else "C" if core[:1].isupper() else "L" if core.isalpha() else "D" if core.isdigit() else "M" if core else "-"
    shape = f"{case} {lead.strip()[:3]} {trail.strip()[:3]}"
    return 1 + zlib.crc32(shape.encode()) % (SHAPES - 1), SHAPES + zlib.crc32(core.lower().encode()) % WORDS


def unit_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape, word) buckets of all units, joined, and the number of units of each text."""
    units, counts = split_units(texts)
    known = np.array(list(map(unit_terms, strings(units.dictionary))), np.int64).reshape(-1, 2)
    use = units.indices.to_numpy()
    shape, word = known[use, 0], known[use, 1]
    same = np.zeros(len(use), bool)
    same[1:] = use[1:] == use[:-1]
    same[(np.cumsum(counts) - counts)[counts > 0]] = False
    shape[same] = 0
    return shape, word, counts


def neighbour_sums(docs: DataFrame, text_col: str) -> np.ndarray:
    """Summed index vectors of the neighbours of each term in all texts, (TERMS, WIDTH).

    Each task sends its sums in blocks of terms; blocks are added as they stream in, and what the
    driver gathers is the one table of fixed size.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(TERMS * WIDTH)
        for batch in sliced(batches):
            shape, word, counts = unit_arrays(batch.column(0))
            first = (np.cumsum(counts) - counts)[counts > 0]
            inside = np.ones(len(word), bool)
            inside[first] = False
            for terms in (shape, word):
                right = np.flatnonzero(inside)
                codes, n = np.unique(terms[right - 1] * TERMS + terms[right], return_counts=True)
                a, b = codes // TERMS, codes % TERMS
                for j in range(NON_ZERO):
                    total += np.bincount(a * WIDTH + places[b, j], signs[b, j] * n, TERMS * WIDTH)
                    total += np.bincount(b * WIDTH + places[a, j], signs[a, j] * n, TERMS * WIDTH)
        blocks = total.astype("<i8").reshape(-1, BLOCK * WIDTH)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].astype("<i4").tobytes() for i in used], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, "<i4" if len(raw) == BLOCK * WIDTH * 4 else "<i8")
                total[block] = total.get(block, 0) + part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    out = np.zeros((TERMS // BLOCK, BLOCK * WIDTH))
    for block, raw in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(sums, schema).repartition(TERMS // BLOCK, "block").mapInArrow(add, schema).collect():
        out[block] = np.frombuffer(raw, "<i8")
    return out.reshape(TERMS, WIDTH)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors: the direction of a term's neighbours plus its own index vector."""
    places, signs = index_vectors()
    own = np.zeros((TERMS, WIDTH))
    np.add.at(own, (np.repeat(np.arange(TERMS), NON_ZERO), places.ravel()), signs.ravel())
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
    return unit(unit(sums) + unit(own)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * WIDTH): means of the shapes' and of the words' vectors."""
    shape, word, counts = unit_arrays(texts)
    out = np.zeros((len(counts), 2 * WIDTH), np.float32)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + 100_000)))
        a, b = int(ends[at] - counts[at]), int(ends[upto - 1])
        starts = (ends[at:upto] - counts[at:upto]) - a
        for half, terms in ((0, shape), (1, word)):
            sums = np.add.reduceat(vectors[terms[a:b]], starts, axis=0)
            out[at:upto, half * WIDTH : (half + 1) * WIDTH] = sums / counts[at:upto, None]
        at = upto
    return out


class Network:
    """Two layers in numpy; ``temperature`` divides the logit."""

    def __init__(self, width: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Adam on four fifths of the rows, temperature on the rest. One class alone gives its smoothed share as every score."""
    net = Network(x.shape[1], seed)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    if not 0 < y.sum() < n:
        net.w2[:], net.b2[:] = 0, np.log(share / (1 - share))
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    rest, used = (order[: n // 5], order[n // 5 :]) if n >= 50 else (order, order)
    net.mean, net.scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - net.mean) / net.scale
    net.b2[:] = np.log(share / (1 - share))
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        used = rng.permutation(used)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            hidden = np.tanh(z[rows] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * net.w2 * (1 - hidden**2)
            grads = [z[rows].T @ back + L2 * net.w1, back.sum(0), hidden.T @ error + L2 * net.w2, error.sum(keepdims=True)]
            step += 1
            for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= RATE * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
    logits = net.logits(x[rest])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    losses = [np.logaddexp(0, np.where(y[rest] > 0, -1, 1) * logits / t).mean() for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


class QualityModel:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.scores(pooled(texts, self.vectors).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors from all texts; the network from at most ``labelled.SAMPLE_ROWS`` labelled rows."""
    vectors = word_vectors(neighbour_sums(docs, text_col))
    shared = broadcasted(docs.sparkSession, vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = pooled(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", id_col, text_col).mapInArrow(features, "doc_id long, label int, x binary").toPandas()
    sample = sample.sort_values(["doc_id", "label", "x"], kind="stable")
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, 2 * WIDTH).astype(np.float64)
    return QualityModel(vectors, train(x, sample["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text counts as empty. Repeated rows and
    those without an id are scored each; other columns are not read."""
    shared = broadcasted(docs.sparkSession, model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(scores, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text scores at or above the threshold."""
    shared = broadcasted(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) >= THRESHOLD))

    return docs.mapInArrow(good, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Lexical retrieval packing.

Documents are ordered by content: by MinHashes of their token ids in which a rare id weighs more, so
that documents which share rare ids stand side by side, and copies next to each other. Shards are runs
of that order, cut where neighbours have least in common. Each shard holds an inverted BM25 index over
token ids, with document frequencies and the mean length of the whole corpus. A seed document opens a window of ``SEQUENCE`` ids; its best unused neighbours follow
greedily. A document that does not fit is cut, and its rest opens the next window, so windows are
full. What a shard has left over at the end becomes sequences of a power of two each, which need
no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.bpe import WORD_VOCABULARY
from tidewell.llm.common import broadcasted, crc_of_ids, runs, sliced, stored, table
from tidewell.llm.units import library_encoder

SEQUENCE = 4096
END_ID = 2
VOCABULARY_SIZE = 1 << 16
#: A shard holds about so many documents and ids: what bounds a task's memory.
SHARD_DOCS, SHARD_IDS = 1024, 2_000_000
#: MinHashes that order the documents, and shards in a partition of that order.
SIGNATURE, PARTITION_SHARDS = 4, 8
K1, B = 1.2, 0.75
#: A term that at least one in so many documents of a shard has gets a whole row in the shard's index.
OFTEN = 4

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_ENCODED = pa.schema([("kind", pa.int32()), ("deal", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("term", pa.int32())])


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents, one after another, and how many each has."""
    return np.frombuffer(b"".join(docs), "<u2"), np.array([len(d) // 2 for d in docs], np.int64)


def occurrences(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (term, document) pairs by term, then document, and how often each occurs."""
    narrow = len(lengths) <= 0x10000
    pairs = flat.astype(np.uint32 if narrow else np.uint64)
    pairs <<= 16 if narrow else 32
    pairs |= np.repeat(np.arange(len(lengths), dtype=pairs.dtype), lengths)
    pairs.sort()
    at = np.flatnonzero(np.concatenate([[len(pairs) > 0], pairs[1:] != pairs[:-1]]))
    found = pairs[at]
    return (found >> (16 if narrow else 32)).astype(np.uint16), (found & (0xFFFF if narrow else 0xFFFFFFFF)).astype(np.int64), np.diff(at, append=len(pairs))


def encode_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """The stored ids of all documents (kind 0) and each task's document frequencies (kind 1).

    Both come from one pass over the texts and are written once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        frequency = np.zeros(VOCABULARY_SIZE, np.int64)
        end = end_id.to_bytes(2, "little")
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            keys, blobs = batch.column(0), [b + end for b in encoder.encode(batch.column(1))]
            flat, lengths = joined(blobs)
            frequency += np.bincount(occurrences(flat, lengths)[0], minlength=VOCABULARY_SIZE)
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.arange(row, row + n)), keys, pa.array(lengths), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int32())], schema=_ENCODED)
            row += n
        terms = np.flatnonzero(frequency)
        n = len(terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(frequency[terms]), pa.nulls(n, pa.binary()), pa.array(terms, pa.int32())], schema=_ENCODED)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(encode, "kind int, deal long, doc_id long, n long, ids binary, term int"), "packing-ids", "kind")


class ShardIndex:
    """Inverted BM25 index of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(d) for d in docs], np.int64)
        terms, owners, counts = occurrences(np.concatenate(docs), lengths)
        weights = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[owners] / mean))
        at = np.flatnonzero(np.concatenate([[len(terms) > 0], terms[1:] != terms[:-1]]))
        self.terms, n_owners = terms[at], np.diff(at, append=len(terms))
        order = np.argsort(owners.astype(np.uint16 if len(docs) <= 0x10000 else np.int64), kind="stable")
        self.query = np.split(terms[order], np.cumsum(np.bincount(owners, minlength=len(docs)))[:-1])
        self.n = len(docs)
        # a term of many documents has a row with a weight for each document, others have lists
        often = n_owners * OFTEN >= self.n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.n))
        row = np.repeat(self.row, n_owners)
        listed = row < 0
        self.rows[row[~listed], owners[~listed]] = weights[~listed]
        self.owners, self.weights = owners[listed], weights[listed]
        self.lengths = np.where(often, 0, n_owners)
        self.at = np.cumsum(self.lengths) - self.lengths

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        slot = np.searchsorted(self.terms, self.query[seed])
        row = self.row[slot]
        rare = slot[row < 0]
        lengths = self.lengths[rare]
        at = np.repeat(self.at[rare], lengths) + runs(lengths)
        return np.bincount(self.owners[at], self.weights[at], self.n) + self.rows[row[row >= 0]].sum(0)


def fill_windows(docs: list[np.ndarray], index: ShardIndex, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of each piece; the last window may be short."""
    used = np.zeros(len(docs), bool)
    in_order = iter(range(len(docs)))
    window = offset = 0
    waiting: list[int] = []
    for _ in range(len(docs)):
        while waiting and used[waiting[-1]]:
            waiting.pop()
        if waiting:
            doc = waiting.pop()
        else:  # nothing related is left: the next unused document
            doc = next(i for i in in_order if not used[i])
        used[doc] = True
        start, left = 0, len(docs[doc])
        opened = offset == 0
        while left:
            length = min(left, size - offset)
            yield doc, start, length, window, offset
            start, left, offset = start + length, left - length, offset + length
            if offset == size:
                window, offset, opened = window + 1, 0, left > 0
        if opened:  # this document, or its rest, is the seed of a window
            scores = index.scores(doc)
            scores[used] = 0
            related = np.flatnonzero(scores > 0)
            waiting = related[np.lexsort((-related, scores[related]))].tolist()


def short_tail(pieces: list[tuple[int, int, int, int, int]], size: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the last window, where it isn't full, into windows of falling powers of two."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in tail)
    if total == size:
        return pieces
    out = [p for p in pieces if p[3] != last]
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    window, room, offset = last, sizes.pop(0), 0
    for doc, start, length, _, _ in tail:
        while length:
            part = min(length, room - offset)
            out.append((doc, start, part, window, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == room and sizes:
                window, room, offset = window + 1, sizes.pop(0), 0
    return out


def signature_ranks(weight: np.ndarray) -> np.ndarray:
    """Place of each term in ``SIGNATURE`` random orders, in which a term comes first of a set with a chance in
    proportion to its weight."""
    draws = np.random.default_rng(29).exponential(size=(SIGNATURE, len(weight))) / np.maximum(weight, 1e-9)
    return draws.argsort(1).argsort(1).astype(np.uint16)


def signatures(blobs: pa.Array, ranks: np.ndarray) -> np.ndarray:
    """The least place in each order of the ids of every document; no document is without ids."""
    flat, lengths = joined(blobs.to_pylist())
    starts = np.cumsum(lengths) - lengths
    flat = flat.astype(np.intp)
    return np.stack([np.minimum.reduceat(r[flat], starts) for r in ranks])


def cut_point(places: np.ndarray) -> int:
    """Where a full run of documents is cut: in its later half, before the last document that differs from its
    neighbour in the earliest place of the signature."""
    half = max(1, len(places) // 2)
    differs = places[half:] != places[half - 1 : -1]
    tie = np.where(differs.any(1), differs.argmax(1), places.shape[1])
    return half + int(np.flatnonzero(tie == tie.min())[-1])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_VOCABULARY, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty: its document is the end id alone. Repeated rows and rows that share
    or lack an id are packed each for itself; documents of any length are cut at window borders;
    ties of a score go to the row first in the order; an empty table gives no piece; other columns are
    not read. Every id lies in exactly one piece.
    """
    spark = df.sparkSession
    encoded = encode_documents(df, id_col, text_col, vocabulary, end_id)
    n_docs, n_ids = encoded.where("kind = 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most 65,536 rows, one for each id of the vocabulary
    frequency = np.zeros(VOCABULARY_SIZE, np.int64)
    for term, n in encoded.where("kind = 1").groupBy("term").agg(F.sum("n")).collect():
        frequency[term] = n
    idf = broadcasted(spark, np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)))
    mean = n_ids / max(n_docs, 1)
    shard_docs = SHARD_DOCS
    n_shards = max(1, -(-n_docs // shard_docs), -(-n_ids // SHARD_IDS))
    # an id that one document alone has relates it to none
    ranks = broadcasted(spark, signature_ranks(np.where(frequency > 1, idf.value, 0)))
    places = [f"place_{i}" for i in range(SIGNATURE)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            signed = signatures(batch.column(2), ranks.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, signed)], ["deal", "doc_id", "ids", *places])

    def pieces_of(docs: list[np.ndarray], keys: list, shard: int) -> pa.RecordBatch:
        pieces = short_tail(list(fill_windows(docs, ShardIndex(docs, idf.value, mean), size)), size)
        rows = [(keys[d], start, n, crc_of_ids(docs[d][start : start + n]), len(docs[d]), shard << 32 | window, offset) for d, start, n, window, offset in pieces]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _PIECES)

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 15
        docs: list[np.ndarray] = []
        keys: list = []
        signed: list[tuple] = []
        held = 0
        for batch in batches:
            for key, blob, *at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                docs.append(np.frombuffer(blob, "<u2"))
                keys.append(key)
                signed.append(tuple(at))
                held += len(docs[-1])
                if len(docs) > 1 and (len(docs) > shard_docs or held > SHARD_IDS):
                    cut = cut_point(np.array(signed))
                    yield pieces_of(docs[:cut], keys[:cut], shard)
                    shard += 1
                    docs, keys, signed = docs[cut:], keys[cut:], signed[cut:]
                    held = sum(map(len, docs))
        if docs:
            yield pieces_of(docs, keys, shard)

    rows = encoded.where("kind = 0").select("deal", "doc_id", "ids")
    signed = rows.mapInArrow(sign, ", ".join(["deal long, doc_id long, ids binary", *(f"{p} int" for p in places)]))
    order = [*places, "deal"]
    dealt = signed.repartitionByRange(-(-n_shards // PARTITION_SHARDS), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids", *places).mapInArrow(pack_shards, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

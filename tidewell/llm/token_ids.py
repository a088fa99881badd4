"""Token-ID output: concatenated ids with Elias-Fano encoded document boundaries.

The file format is a Parquet table of *segments* in ascending document order. A segment is a
bounded run of documents: ``ids`` holds all their ids joined (little-endian unsigned 16-bit
integers, enough for vocabularies below 65,536), ``bounds`` the Elias-Fano code of each
document's end, ``keys`` that of the document ids less ``first_key``. ``shard`` numbers the
range partitions in order, ``segment`` counts within one, ``start`` is the number of ids
before the segment in its shard. Spark's writer commits the files, so that a task that is run
again after a lost executor leaves no half-written or doubled part, in any file system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import crc_of_ids, scratch, table
from tidewell.llm.elias_fano import EliasFano, encode
from tidewell.llm.units import library_encoder

BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Ids after which a segment is closed. A longer document makes a longer segment.
SEGMENT_IDS = 1 << 20

_SEGMENTS = "shard int, segment int, start long, first_key long, n_docs long, n_null long, n_ids long, keys binary, bounds binary, ids binary"
_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("first_key", pa.int64()), ("n_docs", pa.int64()),
    ("n_null", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary()),
])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _segment(shard: int, number: int, start: int, keys: list[int | None], blobs: list[bytes]) -> pa.RecordBatch:
    known = [k for k in keys if k is not None]
    first = known[0] if known else 0
    ends = np.cumsum([len(b) // 2 for b in blobs])
    row = {
        "shard": shard, "segment": number, "start": start, "first_key": first, "n_docs": len(keys), "n_null": len(keys) - len(known), "n_ids": int(ends[-1]),
        "keys": encode(np.array(known, np.int64) - first), "bounds": encode(ends), "ids": b"".join(blobs),
    }
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def write_token_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_VOCABULARY, end_id: int = 0) -> None:
    """Encode ``text_col`` of every row and write segments to ``path`` in ascending ``id_col`` order.

    A null text counts as empty, so it has the end id alone. Null ids come first; rows that share
    an id follow each other in the order of their texts, and repeated rows are all kept. An empty
    table gives an empty folder of segments. Other columns are not read. The range partitioning
    also goes by a hash of the text, so that rows that share one id spread over partitions.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        shard, number, start, waiting = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        blobs: list[bytes] = []
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                keys.append(key)
                blobs.append(blob + end)
                waiting += len(blob) // 2 + 1
                if waiting >= SEGMENT_IDS:
                    yield _segment(shard, number, start, keys, blobs)
                    number, start, waiting, keys, blobs = number + 1, start + waiting, 0, [], []
        if keys:
            yield _segment(shard, number, start, keys, blobs)

    rows = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    spread = F.xxhash64("text")
    rows.repartitionByRange(F.col("key").asc_nulls_first(), spread).sortWithinPartitions(F.col("key").asc_nulls_first(), spread, "text").mapInArrow(segments, _SEGMENTS).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    What the driver gathers is one number for each shard (the shards are the partitions of the
    writing job), read from the narrow columns.
    """
    files = spark.read.schema(_SEGMENTS).parquet(path)
    totals = dict(files.groupBy("shard").agg(F.sum("n_ids")).collect())
    before, total = {}, 0
    for shard in sorted(totals):
        before[shard] = total
        total += totals[shard]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [None] * row["n_null"] + (EliasFano(row["keys"]).values() + row["first_key"]).tolist()
                bounds = EliasFano(row["bounds"])
                ends = bounds.values()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], "<u2")
                crcs = [crc_of_ids(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = before[row["shard"]] + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crcs, pa.int64())], schema=_OUT)

    return files.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(row: dict, i: int) -> np.ndarray:
    """Ids of document ``i`` of one segment row, found by two selects."""
    bounds = EliasFano(row["bounds"])
    start = bounds.select(i - 1) if i else 0
    return np.frombuffer(row["ids"], "<u2")[start : bounds.select(i)]


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return read_token_ids(spark, path)

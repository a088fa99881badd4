"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (a local test
    session) a folder below the warehouse is set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidewell-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Broadcasts and scratch folders of this driver that :func:`release` frees.
_broadcasts: list[Broadcast] = []
_folders: list[str] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path for a table in the shared folder; unless it is to be kept, :func:`release` deletes it."""
    path = f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
    if not keep:
        _folders.append(path)
    return path


def broadcasted(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that :func:`release` destroys."""
    _broadcasts.append(spark.sparkContext.broadcast(value))
    return _broadcasts[-1]


def release(spark: SparkSession) -> None:
    """Destroy the broadcasts and delete the scratch tables made so far.

    Only for callers that have written every result that came from them: plans that still need them fail afterwards.
    """
    while _broadcasts:
        _broadcasts.pop().destroy()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name, keep)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes, which bounds what a worker holds for them."""
    for batch in batches:
        n = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
        pa.default_memory_pool().release_unused()


def held_out(doc_id: Column) -> Column:
    """Rows whose label may not be learnt: crc32(doc_id as text) mod 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n-1 for each n of ``lengths``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], joined."""
    return flat[np.repeat(starts, lengths) + runs(lengths)]


def texts_of(column) -> Iterable[str]:
    """Strings of an Arrow column; a null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]

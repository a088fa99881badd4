"""The bounded, hash-drawn sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out

#: Labelled rows that a classifier is fitted on at most: those of the lowest id hashes.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled rows that are not held out.

    Null labels and labels other than 0 and 1 are left out. The drawn labels have that bound, so
    they may be broadcast. A document listed several times in either table counts each time.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # about twice as many as are wanted pass the first draw, so that no task sorts all labels
    share = max(1, known.count() // (2 * rows))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(share)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")

"""Bounded samples of labelled documents, for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Labelled documents from which a classifier is fitted, at most; the first by a hash of their ids.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y), at most ``rows`` rows.

    A document with several labels counts once, with the highest; rows
    without an id or a label are left out, as are labels without a document.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Of a proven size: SAMPLE_ROWS rows of two numbers.
    return written(own.join(F.broadcast(ids), "doc_id"), "labelled")

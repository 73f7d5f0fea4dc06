"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; ``run`` writes each result as Parquet to the shared folder and
reads it again. All but the last return the columns of ``documents``, with
``n_chars`` brought in line with the text. Rows with a null id or a null text pass
through all stages; a null text is packed as an empty one. A table without
rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shipping import ship_package
from gridloom.llm.bpe import default_vocabulary
from gridloom.llm.common import table, written
from gridloom.llm.linededup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import redact_pii
from gridloom.llm.toxicity import fitted, score_toxicity

#: Documents of at least this probability are rejected.
TOXIC = 0.5
#: Words of a shingle and percent of similarity of near duplicates.
SHINGLE_WORDS, SIMILAR = 5, 80


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic; all documents stay where no labelled row is left to learn from."""
    ship_package(spark)
    model = fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    scored = score_toxicity(docs, model, score="_toxic_score")
    return scored.where(F.col("_toxic_score") < TOXIC).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that stand on many sites, but where they come first; all documents stay."""
    ship_package(spark)
    return _recounted(dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    ship_package(spark)
    found = near_duplicates(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR)
    return docs.join(found.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind in brackets."""
    ship_package(spark)
    return _recounted(redact_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of a fixed length."""
    ship_package(spark)
    return pack_documents(docs.select("doc_id", "text"), default_vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Minima of hashes, trees and tokens aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

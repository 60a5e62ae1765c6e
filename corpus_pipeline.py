"""A corpus pipeline of four operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back
as the next stage's documents.  All but the last return the columns of ``documents``; a stage's rejected
documents are gone for those after it.  Labels come from the labels table of ``sf_dir``, for the documents
that are still there.  The last stage gives the packed pieces with their ids.

Null and empty texts are scored like any other and link with nothing; rows with a null doc_id aren't learned from, link
with nothing and are kept by the third stage.  Rows that repeat a doc_id are scored each, and go or stay together as copies.  Columns beyond doc_id
and text are carried through, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mirrorlake.llm import near_duplicates, packing, quality_model, toxicity
from mirrorlake.llm.common import documents, labels, settle, shared_dir
from mirrorlake.llm.labelled import labelled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier, fitted to the labelled ones among them, doesn't reject."""
    return quality_model.accepted(docs, quality_model.fit(labelled(docs, labels(spark, sf_dir), "quality")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models, counted on the labelled ones among them, don't call toxic."""
    return toxicity.accepted(docs, toxicity.fit(labelled(docs, labels(spark, sf_dir), "toxic")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words a shingle, similarity 0.8 or more): the least doc_id."""
    found = near_duplicates.groups(docs, words=5, percent=80)
    return docs.join(near_duplicates.few(found.where("NOT kept").select("doc_id")), "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 1024."""
    return packing.pack(docs, capacity=1024)


STAGES = [("quality classifier", quality), ("toxicity", not_toxic), ("MinHash near-dedup", without_copies), ("packing", packed)]

#: The learned stages and the tokenizer can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, docs = shared_dir(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = settle(spark, stage(spark, docs, sf_dir), f"{root}/{k}")
    return docs

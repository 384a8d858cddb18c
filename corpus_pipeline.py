"""A training corpus from raw documents: drop junk, exact copies and near copies, mix the sources, pack sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's result and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbrel.llm.common import documents, materialize, release
from timbrel.llm.exact_dedup import drop_copies
from timbrel.llm.mixing import take_mix
from timbrel.llm.ngram_join import keep_one_of_similar
from timbrel.llm.packing import pack_documents
from timbrel.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return drop_rejected(docs, documents(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that links of 0.8 or more in 5-word shingles form, the one with the smallest id."""
    return keep_one_of_similar(docs, k=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule, which without given weights goes on until every source has run
    out. The order is the rows' own, and the next stage packs in it."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, which follow the order of the documents."""
    return pack_documents(docs, in_order=True)


STAGES = [("quality", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("best-fit packing", packing)]

#: The classifier and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return out
        out = materialize(out, "stage")
        release(docs)
        docs = out
    return docs

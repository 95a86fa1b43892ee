"""From raw documents to tokens: the stages of a training corpus, in order.

Each stage works on everything the one before kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import bpe, quality, similar
from meterlake.llm.common import durable, read
from meterlake.llm.exact_dedup import distinct_documents
from meterlake.llm.mixing import mixed_documents
from meterlake.llm.queries import token_digests, vocabulary_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return distinct_documents(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 of five-word shingles), that with the smallest doc_id.

    Candidates are found by SimHash through its segment-popcount embedding, as in
    op7, at a radius wide enough for that similarity; the shingle sets decide.
    """
    return similar.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights."""
    return mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix holds, a row for each copy."""
    return token_digests(bpe.encode(docs, vocabulary_path(), decoded=True))


STAGES = [("quality", classify), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("bpe", tokenise)]

#: No stage but exact deduplication can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

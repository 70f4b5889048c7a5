"""A cleaning pipeline over documents: each stage works on all that the one before it kept.

Every stage but the last returns the columns of documents. Rows with null or empty texts, without an id or with a repeated one, pass each
stage as its function says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import bpe, copies, decontaminate, secrets, toxicity
from lanewise.llm.common import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go, by a model that learns from the documents it is given and from labels. Null and empty texts score by the
    bias alone and stay; repeated rows and rows without an id are judged each by its text."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at a Jaccard similarity of 0.8 of five-word shingles, the row of the least id stays, ids before nulls, of
    equal ids that of the least hash of its text. Texts without words, null ones too, are copies of one another."""
    return copies.drop_near_copies(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in text by a mark, and n_chars follows; every row stays, null and empty texts as they are."""
    return secrets.redact_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens and digests of the ids and of the decoded text, one row for each document; a null text counts as empty."""
    return bpe.digests(bpe.encode_texts(docs), "ids")


STAGES = [("toxicity", toxic), ("near_duplicates", near_copies), ("decontamination", leaked), ("secrets", redacted), ("tokens", encoded)]
#: A trained classifier, graph components and BPE cannot be said in SQL: tests compare each stage with brute force over a whole small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

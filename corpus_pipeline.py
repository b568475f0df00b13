"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, token ids.

Each stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents:
rejected documents go, one document of each group of near duplicates stays, benchmark passages and secrets are cut out
of the texts. Null and empty texts fail the quality rules; extra columns are carried along; repeated rows are one group
of duplicates, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadprep.llm import decontaminate, jaccard, pieces, quality, secrets
from roadprep.llm.queries import _table, tokenizer
from roadprep.llm.scratch import settled_alone

#: Near duplicates share PERCENT of their runs of SHINGLE words.
SHINGLE = 5
PERCENT = 80


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs, PERCENT, SHINGLE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(decontaminate.remove_passages(docs, _table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secrets.redact_secrets(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, tokenizer())


STAGES = [
    ("quality", good_documents),
    ("jaccard", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", token_ids),
]

#: Token ids and the network's spans can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each but the last is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

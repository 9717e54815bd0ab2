"""From raw documents to token ids: quality rules, quality classifier, near duplicates, mixing, encoding.

Each stage is written as Parquet in the shared folder and read again as the next one's documents.
The models of the first two stages are fitted on the labelled rows of the original documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe_codec, jaccard_join, mixing, quality_rank, quality_rules
from corvane.llm.common import table, written


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go; null and empty texts fail the base rules. Repeated rows and all columns stay as they are."""
    model = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.kept_documents(docs, model)


def keep_by_rank(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the ranker's cut go; without labelled rows all stay. Null texts are scored as empty ones."""
    ranker = quality_rank.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rank.kept_documents(docs, ranker)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five words, similarity 0.8): that of the smallest id, null ids last. Texts without words all stay,
    but of rows that agree in id and text one does."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, up to three times; rows without words go. A null source is a source of its own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each row; null and empty texts have no ids."""
    return bpe_codec.encode(docs)


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_rank),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL expresses neither the trained stages nor the tokenizer; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""From raw documents to token files: five stages, each written as Parquet and read again as the next one's documents.

* toxicity: a lexicon is learned from the labelled documents, and documents that it predicts toxic go.
* near_duplicates: of each class of documents that n-gram similarity connects, the one with the least id stays.
* decontamination: documents of which a twentieth or more is benchmark text go.
* mixing: documents are repeated or left out so that sources reach their target words.
* token_files: what is left is encoded and packed into Arrow files; the result tells where each document lies.

Every stage keeps all columns of the documents but the last, and works on all rows that its predecessor kept. Nulls and
empty texts are neither toxic nor duplicates nor contaminated; having no words, they are never taken in a mix's further
copies but by the whole part of their source's rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumspark.llm import decontaminate, jaccard, mixing, token_files, toxicity
from vellumspark.llm.common import table, written
from vellumspark.session import ship


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL can express neither the learned lexicon nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each one an operator of
``tessera.llm`` with the parameters of its query.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again as the next
stage's documents, so a lost executor costs no earlier stage. All stages but the
last return the columns of ``documents``.

1. toxicity: documents whose score is 0.7 or more go.
2. line_dedup: boilerplate lines of a source go; ``n_chars`` follows the text.
3. ngram_join: of each group of documents with a Jaccard similarity of 0.8 on
   five-word shingles, the one with the least id stays.
4. decontamination: documents that hold a benchmark item go.
5. mixing: documents are sampled to the target weights; the sample's rows carry
   n_tokens, topic and probability as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from tessera.llm.common import cut, table
from tessera.llm.queries import toxicity_model


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def boilerplate_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.drop_boilerplate(docs).withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_similar(docs)


def leaking_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def sampled_documents_stay(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.with_probability(docs).where("sampled").drop("sampled")


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", boilerplate_lines_go),
    ("ngram_join", one_of_each_group_stays),
    ("decontamination", leaking_documents_go),
    ("mixing", sampled_documents_stay),
]

#: Scores of a fitted classifier, edit distances and raking are beyond SQL; the
#: tests hold every stage against a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, source mixing, token files.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows with equal ids are judged each by its own text, but
for the join, which keeps one row of each group: of those with the group's smallest id, the one with the least text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docmill.llm.common import table
from docmill.llm.decontaminate import clean_documents
from docmill.llm.mixing import mixed_documents
from docmill.llm.ngram_jaccard import ngram_jaccard_join
from docmill.llm.token_files import read_documents, write_token_files
from docmill.llm.toxicity import without_toxic
from docmill.shipping import ship

#: What the stages return has no SQL form: its first stage learns from labels, its last runs a tokenizer.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected as toxic."""
    ship(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    ship(spark)
    groups = table(ngram_jaccard_join(docs, n=5, num=4, den=5).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    kept = docs.join(groups, docs["doc_id"] == groups["gone"], "left_anti")
    again = kept.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 and doc_id is not null").select(F.col("doc_id").alias("twice"))
    again = table(again, "repeated-ids")
    if not again.head(1):
        return kept
    rows = kept.join(again, kept["doc_id"] == again["twice"]).drop("twice")
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where("nth = 1").drop("nth")
    return kept.join(again, kept["doc_id"] == again["twice"], "left_anti").unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often as the mix of sources takes them."""
    ship(spark)
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    ship(spark)
    return read_documents(write_token_files(docs, room=300_000, step=1_000_000))  # other stages share the workers


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

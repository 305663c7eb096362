"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cap_join import cap_join
from .decontaminate import decontaminate
from .html_text import extract_text
from .line_spread import dedup_lines
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard_join
from .quality_crf import score_quality
from .secrets import scan_secrets
from .token_files import read_documents, write_token_files
from .toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).drop("source")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("h")


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents"))


def op5_line_spread_two_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the least spread there is: any line on more than one site."""
    return dedup_lines(_read(spark, sf_dir, "documents"), sites=2)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_token_files(_read(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_cap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_join(_read(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_jaccard_join, op2_mixing_sources, op3_token_files, op4_decontamination, op5_line_spread, op5_line_spread_two_sites, op6_toxicity, op7_cap_join, op8_html_text, op9_secret_scans, op10_quality_crf)
    return {f.__name__: f for f in every}

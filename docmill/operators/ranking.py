"""Scores and rankings: aggregates per model and language, distributions, rank gaps, spreads, fitness, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed value: terms of single texts, whose names in a prompt say that it fits those.
TEXT_TERMS = "austen wilde doyle thoreau melville pride prejudice dorian gray scarlet walden moby dick ishmael watson holmes wotton afghanistan laburnum persian".split()


def score_bucket(score: Column) -> Column:
    return F.when(score >= 9, "excellent").when(score >= 7, "good").when(score >= 5, "acceptable").when(score >= 3, "poor").otherwise("failed")


def gap_bucket(gap: Column) -> Column:
    return F.when(gap < 0.1, "<0.1").when(gap < 0.2, "0.1-0.2").when(gap < 0.3, "0.2-0.3").otherwise(">=0.3")


def model_stats(scores: DataFrame) -> DataFrame:
    """Of scores (model, language, overall; null overall: failed): counts and means per model."""
    return scores.groupBy("model").agg(F.count("*").alias("n"), F.count("overall").alias("succeeded"), F.round(F.avg("overall"), 6).alias("mean_overall"))


def language_stats(scores: DataFrame) -> DataFrame:
    """Per language its mean, and its best and worst model by mean; ties go to the smaller name."""
    each = scores.groupBy("language", "model").agg(F.sum("overall").alias("s"), F.count("overall").alias("n")).withColumn("mean", F.round(F.col("s") / F.col("n"), 6))
    best, worst = F.min_by("model", F.struct(-F.col("mean"), F.col("model"))), F.min_by("model", F.struct(F.col("mean"), F.col("model")))
    return each.groupBy("language").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_overall"), best.alias("best_model"), worst.alias("worst_model"))


def ranked(scores: DataFrame) -> DataFrame:
    """Models by mean, best first; the window is over one row a model."""
    return model_stats(scores).withColumn("place", F.dense_rank().over(W.orderBy(F.desc("mean_overall")))).select("model", "mean_overall", "place")


def rank_gaps(scores: DataFrame, threshold: float = 0.3, least_models: int = 2) -> DataFrame:
    """Per (text, language): models by median, the least gap between neighbours, and the first pair with it."""
    medians = scores.groupBy("text", "language", "model").agg(F.expr("percentile(overall, 0.5)").alias("overall"))
    cell = W.partitionBy("text", "language")
    order = cell.orderBy(F.desc("overall"), "model")
    pairs = medians.withColumns({"below": F.lead("overall").over(order), "rival": F.lead("model").over(order), "place": F.row_number().over(order), "models": F.count("*").over(cell)})
    pairs = pairs.where(f"models >= {least_models} and rival is not null").withColumn("gap", F.round(F.col("overall") - F.col("below"), 6))
    first = F.struct("gap", "place")
    out = pairs.groupBy("text", "language").agg(F.min("gap").alias("min_gap"), F.min_by("model", first).alias("leader"), F.min_by("rival", first).alias("follower"), F.max("models").alias("models"))
    return out.withColumns({"bucket": gap_bucket(F.col("min_gap")), "flagged": F.col("min_gap") < threshold})


def spread(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.count("overall").alias("n_scores"), F.round(F.avg("overall"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("overall"), F.lit(0.0)), 6).alias("stddev"))


def nearest_rank(rows: DataFrame, key: str, value: str, percent: float) -> DataFrame:
    """(key, rank value): the value at the half-even rounded rank of each key. Values are counted first, so a window runs
    over different values and not over rows; nulls are not ranked."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    own = W.partitionBy(key)
    upto = counts.withColumns({"_to": F.sum("_n").over(own.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(own)})
    wanted = F.bround(F.lit(percent / 100.0) * (F.col("_all") - 1)).cast("long") + 1
    return upto.where((F.col("_to") >= wanted) & (F.col("_to") - F.col("_n") < wanted)).select(key, value)


def penalized_fitness(evaluations: DataFrame, variance: float = 0.1, longest: int = 500, excess: float = 0.001, term: float = 0.05, gap: float = 0.5) -> DataFrame:
    """Per prompt: mean training score less penalties on the sample variance of all scores, the prompt's length, its
    terms that name single texts, and the fall from training to test (test is a column; no scores are a mean of 0)."""
    mean = lambda of: F.coalesce(F.avg(F.when(of, F.col("score"))), F.lit(0.0))
    train, test = mean(~F.col("test")), mean(F.col("test"))
    means = evaluations.groupBy("prompt").agg(train.alias("train"), test.alias("held"), F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("v"))
    terms = sum((F.lower("prompt").contains(t).cast("int") for t in TEXT_TERMS), F.lit(0))
    found = F.col("train") - F.col("v") * variance - F.greatest(F.lit(0), F.length("prompt") - longest) * excess - terms * term - F.greatest(F.lit(0.0), F.col("train") - F.col("held")) * gap
    return means.select("prompt", F.round(found, 6).alias("fitness"))


def orphans(judgments: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    return judgments.join(translations, keys, "left_anti")

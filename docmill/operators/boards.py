"""Leaderboards, runs and prompts as tables: results (run, model, language, text, accuracy, fluency, style, overall,
success) and what is told of them.

Every statistic is one or two aggregates with map-side combining; ties go to the smaller name. Defined cases: results
without success count but have no scores; groups without scores have null means; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docmill.operators.ranking import TEXT_TERMS, gap_bucket

SCORES = ("accuracy", "fluency", "style", "overall")
#: Weights of the four scores in a prompt's fitness.
WEIGHTS = (0.35, 0.30, 0.20, 0.15)


def _means(digits: int = 6) -> list[Column]:
    return [F.round(F.avg(F.when(F.col("success"), F.col(s))), digits).alias(f"avg_{s}") for s in SCORES]


def stats(results: DataFrame, *keys: str) -> DataFrame:
    """Per key: translations, successful ones, and the means of the four scores over these."""
    return results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), *_means())


def with_extremes(results: DataFrame, key: str, other: str) -> DataFrame:
    """stats of a key, with the best and the worst of another one by mean overall score in it."""
    each = results.where("success").groupBy(key, other).agg(F.round(F.avg("overall"), 6).alias("mean"))
    best, worst = F.min_by(other, F.struct(-F.col("mean"), F.col(other))), F.min_by(other, F.struct("mean", other))
    return stats(results, key).join(each.groupBy(key).agg(best.alias("best"), worst.alias("worst")), key, "left")


def summary(results: DataFrame) -> DataFrame:
    scored = F.when(F.col("success"), F.col("overall"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(F.count("*").alias("total"), F.count(scored).alias("succeeded"), (F.count("*") - F.count(scored)).alias("failed"), F.round(zero(F.avg(scored)), 6).alias("avg_overall"), zero(F.min(scored)).alias("min_score"), zero(F.max(scored)).alias("max_score"))


def badges(results: DataFrame, key: str) -> DataFrame:
    """Per key: observations, results that are verified and that are not, and what to call that."""
    told = results.groupBy(key).agg(F.sum("n_obs").alias("n_obs"), F.count_if("verified").alias("verified"), F.count("*").alias("n"))
    name = F.when(F.col("verified") == F.col("n"), "verified").when(F.col("verified") == 0, "self-reported").otherwise("mixed")
    return told.select(key, "n_obs", "verified", (F.col("n") - F.col("verified")).alias("self_reported"), name.alias("badge"))


def best_of(results: DataFrame, key: str, other: str = "model") -> DataFrame:
    """Per key the highest mean that one of another has in it; 0 without any."""
    each = results.groupBy(key, other).agg(F.avg(F.when(F.col("success"), F.col("overall"))).alias("mean"))
    return each.groupBy(key).agg(F.round(F.coalesce(F.max("mean"), F.lit(0.0)), 6).alias("best_overall"))


def ranked(rows: DataFrame, score: str, name: str) -> DataFrame:
    """Rows by score, best first, each with its own rank; a row a model, language or prompt, so one window holds them."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), name)))


def observations(scores: DataFrame) -> DataFrame:
    """Per text, language and model: scores, distinct judges and rubrics."""
    return scores.groupBy("text", "language", "model").agg(F.count("*").alias("n_obs"), F.count_distinct("judge").alias("judges"), F.count_distinct("rubric").alias("rubrics"))


def rank_audit(scores: DataFrame, threshold: float = 0.3, least_models: int = 2) -> DataFrame:
    """Per text and language what a ranking by median scores is worth: mixed_rubric, too_few_models, flagged (two
    neighbours are closer than the threshold) or compliant; with the least gap and the first pair that has it."""
    cells = scores.groupBy("text", "language").agg(F.count_distinct("rubric").alias("rubrics"), F.count_distinct("model").alias("models"))
    medians = scores.groupBy("text", "language", "model").agg(F.expr("percentile(overall, 0.5)").alias("overall"))
    order = W.partitionBy("text", "language").orderBy(F.desc("overall"), "model")
    pairs = medians.withColumns({"gap": F.round(F.col("overall") - F.lead("overall").over(order), 6), "rival": F.lead("model").over(order), "place": F.row_number().over(order)}).where("rival is not null")
    first = F.struct("gap", "place")
    least = pairs.groupBy("text", "language").agg(F.min("gap").alias("min_gap"), F.min_by("model", first).alias("leader"), F.min_by("rival", first).alias("follower"))
    out = cells.join(least, ["text", "language"], "left")
    state = F.when(F.col("rubrics") > 1, "mixed_rubric").when(F.col("models") < least_models, "too_few_models").when(F.col("min_gap") < threshold, "flagged").otherwise("compliant")
    told = out.withColumn("state", state)
    shown = lambda c: F.when(F.col("state").isin("flagged", "compliant"), F.col(c)).alias(c)
    return told.select("text", "language", "models", "state", shown("min_gap"), shown("leader"), shown("follower"))


def gap_histogram(audit: DataFrame) -> DataFrame:
    return audit.where("state in ('flagged', 'compliant')").groupBy(gap_bucket(F.col("min_gap")).alias("bucket")).agg(F.count("*").alias("cells"))


# Runs -------------------------------------------------------------------------------------------------------------------


def aggregated(translations: DataFrame, judgments: DataFrame) -> DataFrame:
    """Translations (model, text, language, output_hash) with the judgment of the same output: matched, hash_mismatch or
    not_judged, and scores only where it matched."""
    keys = ["model", "text", "language"]
    told = translations.join(judgments.select(*keys, F.col("output_hash").alias("_hash"), "overall"), keys, "left")
    state = F.when(F.col("_hash").isNull(), "not_judged").when(F.col("_hash") == F.col("output_hash"), "matched").otherwise("hash_mismatch")
    return told.withColumn("state", state).withColumn("overall", F.when(F.col("state") == "matched", F.col("overall"))).drop("_hash")


def merged_run(runs: DataFrame, results: DataFrame, chosen: list[str]) -> DataFrame:
    """One run of the results of some: earliest start, latest end, number of results, distinct models and languages."""
    some = runs.where(F.col("run").isin(*chosen))
    told = some.agg(F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"))
    counts = results.where(F.col("run").isin(*chosen)).agg(F.count("*").alias("results"), F.count_distinct("model").alias("models"), F.count_distinct("language").alias("languages"))
    state = F.when(F.col("completed_at").isNotNull(), "completed").otherwise("running")
    return counts.where("results > 0").join(told).withColumn("status", state)  # a row each


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run")).alias("r")).where("r is not null").select("r.*")


def open_jobs(models: DataFrame, pairs: DataFrame, texts: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs (model, text, source, target) of all models on the texts of each pair's source language that are not done.
    Models and pairs are small dimensions; texts meet pairs by language."""
    wanted = texts.join(F.broadcast(pairs), "source").join(F.broadcast(models))  # dimension tables of configured names
    return wanted.join(done.where("success").select("model", "text", "target"), ["model", "text", "target"], "left_anti").select("model", "text", "source", "target")


def with_dimensions(translations: DataFrame, texts: DataFrame, languages: DataFrame) -> DataFrame:
    """Translations with their text and the name of their language; those whose text or language is unknown go."""
    return translations.join(F.broadcast(languages), "language").join(texts, "text")  # languages: a configured list


def comparison(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per model: newly scored rows, their old and new means and the change (0 without old scores)."""
    both = new.select(*keys, F.col("overall").alias("now")).join(old.select(*keys, F.col("overall").alias("was")), keys, "left")
    means = both.groupBy("model").agg(F.count("now").alias("n"), F.avg("was").alias("o"), F.avg("now").alias("v")).where("n > 0")
    return means.select("model", "n", F.round("o", 6).alias("old_avg"), F.round("v", 6).alias("new_avg"), F.round(F.coalesce(F.col("v") - F.col("o"), F.lit(0.0)), 6).alias("delta"))


def resolved(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the most recent observation, how many there are, and whether their outputs differ."""
    rest = [c for c in observed.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("submitted_at", "file"))
    return observed.groupBy(*keys).agg(last.alias("o"), F.count("*").alias("seen"), (F.count_distinct("output_hash") > 1).alias("conflict")).select(*keys, "o.*", "seen", "conflict")


def marked_existing(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates with whether their name, in any case, is known."""
    have = known.select(F.lower(F.trim(F.col(key))).alias("_k")).distinct().withColumn("_known", F.lit(True))
    return candidates.join(have, F.lower(F.trim(F.col(key))) == F.col("_k"), "left").withColumn("existing", F.coalesce("_known", F.lit(False))).drop("_k", "_known")


# Prompts ----------------------------------------------------------------------------------------------------------------


def _weighted() -> Column:
    return sum((F.col(s) * w for s, w in zip(SCORES, WEIGHTS, strict=True)), F.lit(0.0))


def base_scores(evaluations: DataFrame, key: str = "prompt") -> DataFrame:
    """Per prompt the means of successful evaluations, weighed; 0 without any."""
    means = evaluations.groupBy(key).agg(*[F.coalesce(F.avg(F.when(F.col("success"), F.col(s))), F.lit(0.0)).alias(s) for s in SCORES])
    return means.select(key, F.round(_weighted(), 6).alias("base_score"))


def variance_penalties(evaluations: DataFrame, weight: float = 0.1, key: str = "prompt") -> DataFrame:
    """Per prompt the sample variance of the weighed scores of successful evaluations (0 for fewer than two), times a
    weight."""
    scored = evaluations.withColumn("_w", F.when(F.col("success"), _weighted()))
    return scored.groupBy(key).agg(F.round(F.coalesce(F.var_samp("_w"), F.lit(0.0)) * weight, 6).alias("variance_penalty"))


def specificity(prompt: Column, rate: float = 0.05) -> Column:
    """The penalty for terms of single texts in a prompt."""
    return sum((F.lower(prompt).contains(t).cast("int") for t in TEXT_TERMS), F.lit(0)) * rate


def fitness(evaluations: DataFrame, variance: float = 0.1, longest: int = 500, excess: float = 0.001, term: float = 0.05, gap: float = 0.5) -> DataFrame:
    """Per prompt the weighed score of its training evaluations less all penalties: on the variance of all weighed scores,
    on its length, on terms of single texts and on the fall from training to test."""
    part = lambda test: F.struct(*[F.coalesce(F.avg(F.when(F.col("success") & (F.col("test") == test), F.col(s))), F.lit(0.0)).alias(s) for s in SCORES])
    scored = evaluations.withColumn("_w", F.when(F.col("success"), _weighted()))
    told = scored.groupBy("prompt").agg(part(False).alias("train"), part(True).alias("held"), F.coalesce(F.var_samp("_w"), F.lit(0.0)).alias("v"))
    base = lambda c: sum((F.col(f"{c}.{s}") * w for s, w in zip(SCORES, WEIGHTS, strict=True)), F.lit(0.0))
    told = told.withColumns({"train_score": base("train"), "test_score": base("held")})
    penalty = F.col("v") * variance + F.greatest(F.lit(0), F.length("prompt") - longest) * excess + specificity(F.col("prompt"), term) + F.greatest(F.lit(0.0), F.col("train_score") - F.col("test_score")) * gap
    return told.select("prompt", F.round("train_score", 6).alias("train_score"), F.round("test_score", 6).alias("test_score"), F.round(F.col("train_score") - penalty, 6).alias("fitness"))


def folds(texts: DataFrame, order: str, k: int, holdout: int | None = 0) -> DataFrame:
    """(fold, text, role): each of k folds (at most the texts that are left, and all of them if k is under two) tests one
    text and trains on the others; the text at the holdout's place (the first, if there is none there) is in none."""
    ranked_ = texts.select("text", (F.row_number().over(W.orderBy(order)) - 1).alias("place"))  # a configured list of texts
    n = F.count("*").over(W.partitionBy())
    rows = ranked_.withColumn("n", n)
    if holdout is not None:
        rows = rows.where(F.col("place") != F.when(F.lit(holdout) < F.col("n"), holdout).otherwise(0))
    rows = rows.withColumns({"place": F.row_number().over(W.orderBy("place")) - 1, "n": F.count("*").over(W.partitionBy())})
    many = F.when(F.least(F.lit(k), F.col("n")) < 2, F.col("n")).otherwise(F.least(F.lit(k), F.col("n")))
    each = rows.select("text", "place", F.explode(F.sequence(F.lit(1), many.cast("int"))).alias("fold"))
    return each.select("fold", "text", F.when(F.col("place") == F.col("fold") - 1, "test").otherwise("train").alias("role"))


def iterations(population: DataFrame) -> DataFrame:
    """Per iteration: the best, mean and worst fitness above 0, the best prompt and how many were evaluated."""
    positive = population.where("fitness > 0")
    return positive.groupBy("iteration").agg(F.max("fitness").alias("best"), F.round(F.avg("fitness"), 6).alias("mean"), F.min("fitness").alias("worst"), F.max_by("prompt", F.struct("fitness", "prompt")).alias("best_prompt"), F.count("*").alias("evaluated"))


def tournament(population: DataFrame, slots: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """(slot, prompt): for each slot the fittest of `size` prompts drawn by hash, so that reruns agree. Populations and
    slots are small, a few hundred rows."""
    drawn = slots.join(F.broadcast(population.select("prompt", "fitness")))  # a population of configured size
    rank = F.row_number().over(W.partitionBy("slot").orderBy(F.xxhash64(F.col("slot"), F.col("prompt"), F.lit(seed)), "prompt"))
    return drawn.withColumn("draw", rank).where(F.col("draw") <= size).groupBy("slot").agg(F.max_by("prompt", F.struct("fitness", "prompt")).alias("prompt"))


def next_generation(population: DataFrame, elite: int, size: int, tournament_size: int = 3, seed: int = 7) -> DataFrame:
    """(slot, prompt, role): the elite as they are, parents by tournament for the other slots."""
    best = ranked(population.select("prompt", "fitness"), "fitness", "prompt").where(F.col("rank") <= elite)
    rest = population.sparkSession.range(max(0, size - elite)).select(F.col("id").alias("slot"))
    parents = tournament(population, rest, tournament_size, seed).select((F.col("slot") + elite + 1).alias("slot"), "prompt", F.lit("parent").alias("role"))
    return best.select(F.col("rank").cast("long").alias("slot"), "prompt", F.lit("elite").alias("role")).unionByName(parents)


# Mergeable metrics and counts ---------------------------------------------------------------------------------------------


def merged_metrics(parts: DataFrame, key: str) -> DataFrame:
    """Partial metrics (attempts, successes, seconds, least, most, failed, errors: a map) as one row a key; the maps are
    summed name by name."""
    sums = parts.groupBy(key).agg(F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes"), F.round(F.sum("seconds"), 6).alias("seconds"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("failed").alias("failed"))
    errors = parts.select(key, F.explode("errors").alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("n"))
    maps = errors.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda e: F.concat_ws("=", e["name"], e["n"].cast("string"))), ",").alias("errors"))  # a row an error's name
    rate = F.round(F.coalesce(F.try_divide(F.col("successes"), F.col("attempts")), F.lit(0.0)), 6)
    return sums.join(maps, key, "left").withColumns({"errors": F.coalesce("errors", F.lit("")), "success_rate": rate})


def decision_counts(rows: DataFrame, key: str, decision: str = "decision") -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col(decision) == d).alias(d) for d in ("accepted", "warned", "rejected")])


def control_summary(records: DataFrame, key: str) -> DataFrame:
    """How negative controls came out: records (expected: a kind or null, found: an array of kinds, or null where nothing
    was assessed)."""
    known, expected = F.col("found").isNotNull(), F.col("expected").isNotNull()
    hit = F.array_contains("found", F.col("expected"))
    return records.groupBy(key).agg(
        F.count_if(known & expected & hit).alias("detected"),
        F.count_if(known & expected & ~hit).alias("missed"),
        F.count_if(known & ~expected & (F.size("found") > 0)).alias("false_positives"),
        F.count_if(known & ~expected & (F.size("found") == 0)).alias("true_negatives"),
        F.count_if(~known).alias("not_evaluated"),
    )


def error_summary(records: DataFrame, *keys: str) -> DataFrame:
    told = records.groupBy(*keys).agg(F.count("*").alias("errors"), F.count_if("recovered").alias("recovered"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return told.withColumn("recovery_rate", F.round(F.try_divide(F.col("recovered"), F.col("errors")), 6))

"""Queries of leaderboards, runs and prompts, with the SQL that checks them.

Line items stand for results: part type as model, supplier nation as language, part brand as text; their numbers make
the scores.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import boards, ranking
from docmill.plans.base import query, read

RESULT = {
    "run": "concat('r', l_orderkey % 6)",
    "model": "p_type",
    "language": "s_nationkey",
    "text": "p_brand",
    "accuracy": "CAST(l_quantity AS BIGINT) % 10 + 1",
    "fluency": "l_partkey % 10 + 1",
    "style": "l_suppkey % 10 + 1",
    "overall": "CAST(l_quantity AS BIGINT) % 50 / 5.0",
    "success": "l_returnflag <> 'R'",
    "judge": "concat('judge', l_linenumber % 3)",
    "rubric": "CASE WHEN p_brand < 'Brand#2' AND l_linenumber = 7 THEN 'v2' ELSE 'v1' END",
    "n_obs": "l_linenumber",
    "verified": "s_nationkey % 4 = 0 OR (s_nationkey % 4 = 1 AND l_linenumber < 4)",
    "output_hash": "concat('h', l_suppkey % 50)",
    "submitted_at": "l_shipdate",
    "file": "concat('f', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)",
}
RAW = "WITH raw AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RESULT.items()).replace("/ 5.0", "/ 5.0::DOUBLE") + " FROM raw) "
MEANS = ", ".join(f"round(avg({s}) FILTER (success), 6) AS avg_{s}" for s in boards.SCORES)


def results(spark, sf_dir):
    line, part, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.selectExpr(*[f"{e} AS {c}".replace("/ 5.0", "/ 5D") for c, e in RESULT.items()])


@query(RAW + f"SELECT model, count(*) AS total, count_if(success) AS succeeded, {MEANS} FROM r GROUP BY 1")
def g13_model_scores(spark, sf_dir):
    return boards.stats(results(spark, sf_dir), "model")


def _extremes(key: str, other: str) -> str:
    return RAW + f", e AS (SELECT {key}, {other}, round(avg(overall), 6) AS m FROM r WHERE success GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY m DESC, {other}) AS b, row_number() OVER (PARTITION BY {key} ORDER BY m, {other}) AS w FROM e), x AS (SELECT {key}, max(CASE WHEN b = 1 THEN {other} END) AS best, max(CASE WHEN w = 1 THEN {other} END) AS worst FROM o GROUP BY 1), t AS (SELECT {key}, count(*) AS total, count_if(success) AS succeeded, {MEANS} FROM r GROUP BY 1) SELECT t.*, best, worst FROM t LEFT JOIN x USING ({key})"


@query(_extremes("language", "model"))
def g14_language_scores(spark, sf_dir):
    return boards.with_extremes(results(spark, sf_dir), "language", "model")


@query(_extremes("model", "language"))
def g15_model_languages(spark, sf_dir):
    return boards.with_extremes(results(spark, sf_dir), "model", "language")


@query(RAW + "SELECT count(*) AS total, count_if(success) AS succeeded, count_if(NOT success) AS failed, round(avg(overall) FILTER (success), 6) AS avg_overall, min(overall) FILTER (success) AS min_score, max(overall) FILTER (success) AS max_score FROM r")
def g15_run_summary(spark, sf_dir):
    return boards.summary(results(spark, sf_dir))


@query(RAW + "SELECT language, CAST(sum(n_obs) AS BIGINT) AS n_obs, count_if(verified) AS verified, count_if(NOT verified) AS self_reported, CASE WHEN count_if(verified) = count(*) THEN 'verified' WHEN count_if(verified) = 0 THEN 'self-reported' ELSE 'mixed' END AS badge FROM r GROUP BY 1")
def g16_badges(spark, sf_dir):
    return boards.badges(results(spark, sf_dir), "language")


BEST = RAW + ", e AS (SELECT language, model, avg(overall) FILTER (success) AS m FROM r GROUP BY 1, 2), b AS (SELECT language, round(coalesce(max(m), 0), 6) AS best_overall FROM e GROUP BY 1) "


@query(BEST + "SELECT * FROM b")
def g17_best_overall(spark, sf_dir):
    return boards.best_of(results(spark, sf_dir), "language")


@query(BEST + "SELECT language, best_overall, row_number() OVER (ORDER BY best_overall DESC, language)::INT AS rank FROM b")
def w02_language_ranking(spark, sf_dir):
    return boards.ranked(boards.best_of(results(spark, sf_dir), "language"), "best_overall", "language")


@query(RAW + "SELECT text, language, model, count(*) AS n_obs, count(DISTINCT judge) AS judges, count(DISTINCT rubric) AS rubrics FROM r GROUP BY 1, 2, 3")
def g18_observations(spark, sf_dir):
    return boards.observations(results(spark, sf_dir))


AUDIT = RAW + """, c AS (SELECT text, language, count(DISTINCT rubric) AS rubrics, count(DISTINCT model) AS models FROM r GROUP BY 1, 2), m AS (SELECT text, language, model, median(overall) AS o FROM r GROUP BY 1, 2, 3),
p AS (SELECT *, round(o - lead(o) OVER w, 6) AS gap, lead(model) OVER w AS rival, row_number() OVER w AS place FROM m WINDOW w AS (PARTITION BY text, language ORDER BY o DESC, model)), f AS (SELECT * FROM p WHERE rival IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text, language ORDER BY gap, place) = 1),
a AS (SELECT c.text, c.language, models, CASE WHEN rubrics > 1 THEN 'mixed_rubric' WHEN models < 2 THEN 'too_few_models' WHEN gap < 0.3 THEN 'flagged' ELSE 'compliant' END AS state, gap, model, rival FROM c LEFT JOIN f USING (text, language)),
t AS (SELECT text, language, models, state, CASE WHEN state IN ('flagged', 'compliant') THEN gap END AS min_gap, CASE WHEN state IN ('flagged', 'compliant') THEN model END AS leader, CASE WHEN state IN ('flagged', 'compliant') THEN rival END AS follower FROM a) """


@query(AUDIT + "SELECT * FROM t")
def w01_rank_audit(spark, sf_dir):
    return boards.rank_audit(results(spark, sf_dir))


@query(AUDIT + "SELECT CASE WHEN min_gap < 0.1 THEN '<0.1' WHEN min_gap < 0.2 THEN '0.1-0.2' WHEN min_gap < 0.3 THEN '0.2-0.3' ELSE '>=0.3' END AS bucket, count(*) AS cells FROM t WHERE state IN ('flagged', 'compliant') GROUP BY 1")
def g20_gap_histogram(spark, sf_dir):
    return boards.gap_histogram(boards.rank_audit(results(spark, sf_dir)))


# Runs -------------------------------------------------------------------------------------------------------------------

KEYED = RAW + ", tr AS (SELECT model, text, language, max(output_hash) AS output_hash FROM r GROUP BY 1, 2, 3), ju AS (SELECT model, text, language, max(output_hash) FILTER (success) AS output_hash, round(avg(overall), 6) AS overall FROM r WHERE language % 5 <> 0 GROUP BY 1, 2, 3 HAVING max(output_hash) FILTER (success) IS NOT NULL) "


def _judged(spark, sf_dir):
    r = results(spark, sf_dir)
    keys = ["model", "text", "language"]
    translations = r.groupBy(*keys).agg(F.max("output_hash").alias("output_hash"))
    judgments = r.where("language % 5 <> 0").groupBy(*keys).agg(F.max(F.when(F.col("success"), F.col("output_hash"))).alias("output_hash"), F.round(F.avg("overall"), 6).alias("overall")).where("output_hash is not null")
    return translations, judgments


@query(KEYED + "SELECT model, text, language, tr.output_hash, CASE WHEN ju.output_hash IS NULL THEN 'not_judged' WHEN ju.output_hash = tr.output_hash THEN 'matched' ELSE 'hash_mismatch' END AS state, CASE WHEN ju.output_hash = tr.output_hash THEN overall END AS overall FROM tr LEFT JOIN ju USING (model, text, language)")
def j01_aggregated(spark, sf_dir):
    return boards.aggregated(*_judged(spark, sf_dir))


RUNS = "ru AS (SELECT run, min(submitted_at) AS started_at, CASE WHEN run = 'r5' THEN NULL ELSE max(submitted_at) END AS completed_at FROM r GROUP BY 1)"


def _runs(spark, sf_dir):
    return results(spark, sf_dir).groupBy("run").agg(F.min("submitted_at").alias("started_at"), F.max("submitted_at").alias("completed_at")).withColumn("completed_at", F.when(F.col("run") != "r5", F.col("completed_at")))


@query(RAW + ", " + RUNS + "SELECT (SELECT count(*) FROM r WHERE run IN ('r1', 'r3', 'r5')) AS results, (SELECT count(DISTINCT model) FROM r WHERE run IN ('r1', 'r3', 'r5')) AS models, (SELECT count(DISTINCT language) FROM r WHERE run IN ('r1', 'r3', 'r5')) AS languages, min(started_at) AS started_at, max(completed_at) AS completed_at, 'completed' AS status FROM ru WHERE run IN ('r1', 'r3', 'r5')")
def u01_merged_run(spark, sf_dir):
    return boards.merged_run(_runs(spark, sf_dir), results(spark, sf_dir), ["r1", "r3", "r5"])


@query(RAW + ", " + RUNS + "SELECT * FROM ru ORDER BY started_at DESC, run DESC LIMIT 1")
def t07_latest_run(spark, sf_dir):
    return boards.latest_run(_runs(spark, sf_dir))


JOBS = RAW + ", m AS (SELECT DISTINCT p_type AS model FROM part WHERE p_type < 'F'), p AS (SELECT a.n_regionkey AS source, b.n_nationkey AS target FROM nation a JOIN nation b ON a.n_nationkey % 5 = 0 AND b.n_nationkey % 7 = 1), t AS (SELECT DISTINCT p_brand AS text, length(p_name) % 5 AS source FROM part), d AS (SELECT DISTINCT model, text, language AS target FROM r WHERE success AND run = 'r0') "


def _work(spark, sf_dir):
    part, nation = read(spark, sf_dir, "part"), read(spark, sf_dir, "nation")
    models = part.where("p_type < 'F'").select(F.col("p_type").alias("model")).distinct()
    pairs = nation.where("n_nationkey % 5 = 0").select(F.col("n_regionkey").alias("source")).join(nation.where("n_nationkey % 7 = 1").select(F.col("n_nationkey").alias("target")))
    texts = part.select(F.col("p_brand").alias("text"), (F.length("p_name") % 5).alias("source")).distinct()
    return models, pairs, texts, results(spark, sf_dir).select("model", "text", F.col("language").alias("target"), (F.col("success") & (F.col("run") == "r0")).alias("success"))


@query(JOBS + "SELECT model, text, source, target FROM t JOIN p USING (source), m WHERE (model, text, target) NOT IN (SELECT (model, text, target) FROM d)")
def j17_open_jobs(spark, sf_dir):
    return boards.open_jobs(*_work(spark, sf_dir))


@query(RAW + "SELECT model, text, language FROM (SELECT DISTINCT model, text, language FROM r) EXCEPT SELECT model, text, language FROM r WHERE run = 'r0' AND success")
def u02_remaining_work(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.select("model", "text", "language").distinct().join(r.where("run = 'r0' and success").select("model", "text", "language").distinct(), ["model", "text", "language"], "left_anti")


@query(RAW + "SELECT model, text, language, n_name AS name, count(*) AS n FROM r JOIN nation ON language = n_nationkey JOIN (SELECT DISTINCT p_brand AS text FROM part WHERE p_size < 3) USING (text) GROUP BY ALL")
def j16_with_dimensions(spark, sf_dir):
    texts = read(spark, sf_dir, "part").where("p_size < 3").select(F.col("p_brand").alias("text")).distinct()
    languages = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("language"), F.col("n_name").alias("name"))
    return boards.with_dimensions(results(spark, sf_dir), texts, languages).groupBy("model", "text", "language", "name").agg(F.count("*").alias("n"))


@query(RAW + ", n AS (SELECT model, text, language, avg(overall) AS overall FROM r WHERE run IN ('r1', 'r2') GROUP BY 1, 2, 3), o AS (SELECT model, text, language, avg(overall) AS overall FROM r WHERE run = 'r0' GROUP BY 1, 2, 3), b AS (SELECT n.model, n.overall AS v, o.overall AS w FROM n LEFT JOIN o USING (model, text, language)) SELECT model, count(v) AS n, round(avg(w), 6) AS old_avg, round(avg(v), 6) AS new_avg, round(coalesce(avg(v) - avg(w), 0), 6) AS delta FROM b GROUP BY 1")
def j19_comparison(spark, sf_dir):
    keys = ["model", "text", "language"]
    scores = lambda where: results(spark, sf_dir).where(where).groupBy(*keys).agg(F.avg("overall").alias("overall"))
    return boards.comparison(scores("run = 'r0'"), scores("run in ('r1', 'r2')"), keys)


@query(RAW + "SELECT text, language, model, output_hash, submitted_at, file, count(*) OVER w AS seen, max(output_hash) OVER w <> min(output_hash) OVER w AS conflict FROM r WINDOW w AS (PARTITION BY text, language, model) QUALIFY row_number() OVER (PARTITION BY text, language, model ORDER BY submitted_at DESC, file DESC) = 1")
def u09_resolved(spark, sf_dir):
    return boards.resolved(results(spark, sf_dir).select("text", "language", "model", "output_hash", "submitted_at", "file"), ["text", "language", "model"])


@query("SELECT p_partkey, lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_partkey < 30) AS existing FROM part")
def j15_marked_existing(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_type")).alias("p_type"))
    return boards.marked_existing(part, read(spark, sf_dir, "part").where("p_partkey < 30").select("p_type"), "p_type").select("p_partkey", "existing")


# Prompts: models are prompts, odd languages the test set -----------------------------------------------------------------

EVAL = RAW + ", v AS (SELECT model AS prompt, accuracy, fluency, style, overall, success, language % 2 = 1 AS test, accuracy * 0.35::DOUBLE + fluency * 0.3::DOUBLE + style * 0.2::DOUBLE + overall * 0.15::DOUBLE AS w FROM r) "
WEIGHED = " + ".join(f"coalesce(avg({s}) FILTER (success{{0}}), 0) * {w}::DOUBLE" for s, w in zip(boards.SCORES, boards.WEIGHTS, strict=True))


def _evaluations(spark, sf_dir):
    return results(spark, sf_dir).select(F.col("model").alias("prompt"), *boards.SCORES, "success", (F.col("language") % 2 == 1).alias("test"))


@query(EVAL + f"SELECT prompt, round({WEIGHED.format('')}, 6) AS base_score FROM v GROUP BY 1")
def g38_base_scores(spark, sf_dir):
    return boards.base_scores(_evaluations(spark, sf_dir))


@query(EVAL + "SELECT prompt, round(coalesce(var_samp(w) FILTER (success), 0) * 0.1::DOUBLE, 6) AS variance_penalty FROM v GROUP BY 1")
def g39_variance_penalties(spark, sf_dir):
    return boards.variance_penalties(_evaluations(spark, sf_dir))


FITTED = EVAL + f", s AS (SELECT prompt, {WEIGHED.format(' AND NOT test')} AS train, {WEIGHED.format(' AND test')} AS held, coalesce(var_samp(w) FILTER (success), 0) AS v FROM v GROUP BY 1), f AS (SELECT prompt, round(train, 6) AS train_score, round(held, 6) AS test_score, round(train - (v * 0.1::DOUBLE + greatest(0, length(prompt) - 500) * 0.001::DOUBLE + len(list_filter({ranking.TEXT_TERMS}, lambda t: contains(lower(prompt), t))) * 0.05::DOUBLE + greatest(0, train - held) * 0.5::DOUBLE), 6) AS fitness FROM s) "


@query(FITTED + "SELECT * FROM f")
def g40_fitness_whole(spark, sf_dir):
    return boards.fitness(_evaluations(spark, sf_dir))


@query(FITTED + "SELECT prompt, fitness, row_number() OVER (ORDER BY fitness DESC, prompt)::INT AS rank FROM f")
def w15_ranked_prompts(spark, sf_dir):
    return boards.ranked(boards.fitness(_evaluations(spark, sf_dir)).select("prompt", "fitness"), "fitness", "prompt")


PROMPT = "concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' Holmes and Watson' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ' PRIDE' ELSE '' END)"


@query(f"SELECT p_partkey, len(list_filter({ranking.TEXT_TERMS}, lambda t: contains(lower({PROMPT}), t))) * 0.05::DOUBLE AS penalty FROM part")
def x58_specificity(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", boards.specificity(F.expr(PROMPT)).alias("penalty"))


@query("WITH t AS (SELECT n_name AS text, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation WHERE n_regionkey = 2), a AS (SELECT text, row_number() OVER (ORDER BY p) - 1 AS p FROM t WHERE p <> 1) SELECT fold::INT AS fold, text, CASE WHEN p = fold - 1 THEN 'test' ELSE 'train' END AS role FROM a, (SELECT unnest(range(1, 4)) AS fold)")
def x59_folds(spark, sf_dir):
    texts = read(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("ord"))
    return boards.folds(texts, "ord", 3, 1)


@query(RAW + ", p AS (SELECT run AS iteration, model AS prompt, round(avg(overall) - 5, 6) AS fitness FROM r GROUP BY 1, 2) SELECT iteration, max(fitness) AS best, round(avg(fitness), 6) AS mean, min(fitness) AS worst, max_by(prompt, (fitness, prompt)) AS best_prompt, count(*) AS evaluated FROM p WHERE fitness > 0 GROUP BY 1")
def y46_iterations(spark, sf_dir):
    rows = results(spark, sf_dir).groupBy(F.col("run").alias("iteration"), F.col("model").alias("prompt")).agg(F.round(F.avg("overall") - 5, 6).alias("fitness"))
    return boards.iterations(rows)


@query()
def y45_next_generation(spark, sf_dir):
    return boards.next_generation(boards.fitness(_evaluations(spark, sf_dir)).select("prompt", "fitness"), 5, 30)


# Metrics and counts -----------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT user_id % 9 AS part, value, event_type, event_id FROM events), e AS (SELECT part, event_type AS name, CAST(sum(event_id % 4) AS BIGINT) AS n FROM m GROUP BY 1, 2)
SELECT part, CAST(sum(event_id % 5 + 1) AS BIGINT) AS attempts, CAST(sum(event_id % 5) AS BIGINT) AS successes, round(sum(CAST(value AS DECIMAL(18,4)))::DOUBLE, 6) AS seconds, min(value) AS least, max(value) AS most, bool_or(event_type = 'error') AS failed,
  (SELECT string_agg(name || '=' || n, ',' ORDER BY name) FROM e WHERE e.part = m.part) AS errors, round(sum(event_id % 5) / sum(event_id % 5 + 1)::DOUBLE, 6) AS success_rate FROM m GROUP BY part""")
def g30_merged_metrics(spark, sf_dir):
    parts = read(spark, sf_dir, "events").select((F.col("user_id") % 9).alias("part"), (F.col("event_id") % 5 + 1).alias("attempts"), (F.col("event_id") % 5).alias("successes"), F.col("value").cast("decimal(18,4)").alias("seconds"), F.col("value").alias("least"), F.col("value").alias("most"), (F.col("event_type") == "error").alias("failed"), F.create_map("event_type", F.col("event_id") % 4).alias("errors"))
    return boards.merged_metrics(parts, "part").withColumn("seconds", F.col("seconds").cast("double"))


DECIDED = "CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'warned' WHEN 2 THEN 'rejected' ELSE 'other' END"


@query(f"WITH d AS (SELECT event_type, {DECIDED} AS decision FROM events) SELECT event_type, count_if(decision = 'accepted') AS accepted, count_if(decision = 'warned') AS warned, count_if(decision = 'rejected') AS rejected FROM d GROUP BY 1")
def g35_decision_counts(spark, sf_dir):
    return boards.decision_counts(read(spark, sf_dir, "events").selectExpr("event_type", f"{DECIDED} AS decision"), "event_type")


@query("WITH c AS (SELECT user_id % 20 AS book, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS expected, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN [event_type, 'x'] WHEN event_id % 5 = 0 THEN [] ELSE ['y'] END AS found FROM events) SELECT book, count_if(found IS NOT NULL AND expected IS NOT NULL AND list_contains(found, expected)) AS detected, count_if(found IS NOT NULL AND expected IS NOT NULL AND NOT list_contains(found, expected)) AS missed, count_if(found IS NOT NULL AND expected IS NULL AND len(found) > 0) AS false_positives, count_if(found IS NOT NULL AND expected IS NULL AND len(found) = 0) AS true_negatives, count_if(found IS NULL) AS not_evaluated FROM c GROUP BY 1")
def g42_control_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("user_id % 20 AS book", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS expected", "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN array(event_type, 'x') WHEN event_id % 5 = 0 THEN cast(array() as array<string>) ELSE array('y') END AS found")
    return boards.control_summary(rows, "book")


@query("SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'critical' ELSE 'low' END AS severity, count(*) AS errors, count_if(event_id % 4 = 1) AS recovered, count_if(event_id % 3 = 0) AS critical, round(count_if(event_id % 4 = 1) / count(*)::DOUBLE, 6) AS recovery_rate FROM events GROUP BY 1, 2")
def g37_error_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("event_type", "CASE event_id % 3 WHEN 0 THEN 'critical' ELSE 'low' END AS severity", "event_id % 4 = 1 AS recovered")
    return boards.error_summary(rows, "event_type", "severity")


@query("WITH r AS (SELECT part, CAST(sum(a) AS BIGINT) AS a, CAST(sum(s) AS BIGINT) AS s FROM (SELECT user_id % 50 AS part, event_id % 5 + 1 AS a, event_id % 5 AS s FROM events) GROUP BY 1) SELECT part, round(s / a::DOUBLE, 6) AS success_rate FROM r")
def g31_success_rate(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("part")).agg(F.sum(F.col("event_id") % 5 + 1).alias("a"), F.sum(F.col("event_id") % 5).alias("s"))
    return rows.select("part", F.round(F.coalesce(F.try_divide(F.col("s"), F.col("a")), F.lit(0.0)), 6).alias("success_rate"))

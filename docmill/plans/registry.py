"""Registered queries over the driver's tables, each with the SQL that DuckDB checks it with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import chunking, ledger, ranking, rows
from docmill.plans.base import QUERIES, SQL, query, read

__all__ = ["QUERIES", "SQL"]

# Hosts: what the driver's tables stand for -----------------------------------------------------------------------


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("translation_id"), F.col("event_type").alias("phase"), F.lit("").alias("process_type"),
        k.alias("prompt_tokens"), (k % 7).alias("completion_tokens"), (k + k % 7).alias("total_tokens"), F.col("value").alias("total_cost_usd"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
    )


USAGE = """WITH e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
u AS (SELECT event_id, ts AS created_at, CAST(user_id AS VARCHAR) AS translation_id, event_type AS phase, '' AS process_type, k AS prompt_tokens,
  k % 7 AS completion_tokens, k + k % 7 AS total_tokens, value AS total_cost_usd, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM e0)
"""
SUMS = "count(*) AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, round(coalesce(sum(total_cost_usd), 0), 6) AS total_cost_usd"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judgments: part brand as text, supplier nation as language, part type as model."""
    line, part, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.select("l_partkey", "l_suppkey", "l_quantity").join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("p_brand").alias("text"), F.col("s_nationkey").alias("language"), F.col("p_type").alias("model"), (F.col("l_quantity") / 5).alias("overall"))


SCORES = "WITH s AS (SELECT p_brand AS text, s_nationkey AS language, p_type AS model, l_quantity / 5 AS overall FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)\n"


# Ledger ----------------------------------------------------------------------------------------------------------


@query(USAGE + f"SELECT {SUMS}, count_if(status <> 'ok') AS failed_calls FROM u")
def g01_ledger_totals(spark, sf_dir):
    return ledger.totals(usage(spark, sf_dir))


@query(USAGE + f"SELECT status, phase, {SUMS} FROM u GROUP BY ALL")
def g03_ledger_by_status_and_phase(spark, sf_dir):
    return ledger.by_keys(usage(spark, sf_dir), "status", "phase")


@query(USAGE + f"SELECT translation_id, {SUMS}, min(created_at) AS first_seen, max(created_at) AS last_seen FROM u WHERE translation_id <> '' GROUP BY 1")
def g04_ledger_by_translation(spark, sf_dir):
    return ledger.by_translation(usage(spark, sf_dir))


@query(USAGE + f"SELECT coalesce(nullif(phase, ''), nullif(process_type, ''), 'unknown') AS phase, coalesce(nullif(process_type, ''), 'unknown') AS process_type, {SUMS} FROM u GROUP BY ALL")
def g06_ledger_by_phase(spark, sf_dir):
    return ledger.by_phase(usage(spark, sf_dir))


@query(USAGE + f"SELECT translation_id, {SUMS}, min(created_at) AS first_seen, max(created_at) AS last_seen FROM u WHERE created_at >= (SELECT max(created_at) FROM u) - INTERVAL 86400 SECONDS GROUP BY 1")
def g08_ledger_recent(spark, sf_dir):
    return ledger.recent_by_translation(usage(spark, sf_dir), 86_400)


@query(USAGE + f"SELECT CAST(created_at AS DATE) AS day, {SUMS} FROM u GROUP BY 1")
def g09_ledger_daily(spark, sf_dir):
    return ledger.daily(usage(spark, sf_dir))


@query(USAGE + f", p AS (SELECT translation_id, phase, {SUMS} FROM u GROUP BY ALL) SELECT translation_id, phase, calls, round(coalesce(100.0::DOUBLE * total_tokens / nullif(sum(total_tokens) OVER w, 0), 0), 4) AS token_share, round(coalesce(100.0::DOUBLE * total_cost_usd / nullif(sum(total_cost_usd) OVER w, 0), 0), 4) AS cost_share FROM p WINDOW w AS (PARTITION BY translation_id)")
def g10_phase_shares(spark, sf_dir):
    return ledger.phase_shares(usage(spark, sf_dir))


@query(USAGE + f", r AS (SELECT translation_id, {SUMS} FROM u WHERE created_at >= (SELECT max(created_at) FROM u) - INTERVAL 86400 SECONDS GROUP BY 1) SELECT translation_id, round(calls * (60 / 86400::DOUBLE), 6) AS calls_per_minute, round(total_tokens * (60 / 86400::DOUBLE), 6) AS tokens_per_minute, round(total_cost_usd * (3600 / 86400::DOUBLE), 6) AS cost_per_hour FROM r")
def g11_recent_rates(spark, sf_dir):
    return ledger.recent_rates(ledger.recent_by_translation(usage(spark, sf_dir), 86_400), 86_400)


@query(USAGE + "SELECT event_id, translation_id, phase, status, total_tokens FROM u ORDER BY created_at DESC, event_id DESC LIMIT 50")
def t01_latest_events(spark, sf_dir):
    return ledger.latest_events(usage(spark, sf_dir), 50)


@query(USAGE + "SELECT event_id, round(((least(completion_tokens, prompt_tokens)) * 0.1::DOUBLE + (prompt_tokens - least(completion_tokens, prompt_tokens)) * 0.5::DOUBLE + completion_tokens * 1.5::DOUBLE) / 1000000, 10) AS cost FROM u")
def x26_call_cost(spark, sf_dir):
    u = usage(spark, sf_dir)
    return u.select("event_id", F.round(ledger.call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("completion_tokens"), F.lit(0), 0.5, 0.1, 1.5), 10).alias("cost"))


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 3.7::DOUBLE) AS BIGINT)) AS tokens FROM documents")
def x32_estimated_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ledger.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, least(2.0::DOUBLE * pow(2.0, event_id % 9), 60.0) AS delay FROM events")
def x71_backoff(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", ledger.backoff_delay(F.col("event_id") % 9 + 1, 2.0, 2.0, 60.0).alias("delay"))


@query("""WITH s AS (SELECT c_custkey AS scope_id, CAST(floor(c_acctbal * 1000) AS BIGINT) AS limit_nusd FROM customer),
r AS (SELECT o_custkey AS scope_id, CAST(ceil(o_totalprice) AS BIGINT) AS upper_nusd, CAST(floor(o_totalprice) AS BIGINT) AS actual_nusd, CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'reserved' ELSE 'released' END AS state FROM orders),
a AS (SELECT scope_id, sum(CASE WHEN state = 'settled' THEN actual_nusd ELSE 0 END)::BIGINT AS used_nusd, sum(CASE WHEN state = 'reserved' THEN upper_nusd ELSE 0 END)::BIGINT AS reserved_nusd, count(*) AS calls FROM r GROUP BY 1)
SELECT scope_id, limit_nusd, coalesce(used_nusd, 0) AS used_nusd, coalesce(reserved_nusd, 0) AS reserved_nusd, coalesce(calls, 0) AS calls, greatest(0, limit_nusd - coalesce(used_nusd, 0) - coalesce(reserved_nusd, 0)) AS available_nusd FROM s LEFT JOIN a USING (scope_id)""")
def d10_budget_snapshot(spark, sf_dir):
    scopes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope_id"), F.floor(F.col("c_acctbal") * 1000).alias("limit_nusd"))
    state = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "reserved").otherwise("released")
    held = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope_id"), F.ceil("o_totalprice").alias("upper_nusd"), F.floor("o_totalprice").alias("actual_nusd"), state.alias("state"))
    return ledger.budget_snapshot(scopes, held)


# Rankings --------------------------------------------------------------------------------------------------------


@query(SCORES + """, e AS (SELECT language, model, sum(overall) AS s, count(overall) AS n, round(sum(overall) / count(overall), 6) AS mean FROM s GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY mean DESC, model) AS b, row_number() OVER (PARTITION BY language ORDER BY mean, model) AS w FROM e)
SELECT language, round(sum(s) / sum(n), 6) AS mean_overall, max(CASE WHEN b = 1 THEN model END) AS best_model, max(CASE WHEN w = 1 THEN model END) AS worst_model FROM o GROUP BY 1""")
def g14_language_stats(spark, sf_dir):
    return ranking.language_stats(scores(spark, sf_dir))


@query(SCORES + ", m AS (SELECT model, round(avg(overall), 6) AS mean_overall FROM s GROUP BY 1) SELECT model, mean_overall, dense_rank() OVER (ORDER BY mean_overall DESC)::INT AS place FROM m")
def w02_model_ranking(spark, sf_dir):
    return ranking.ranked(scores(spark, sf_dir))


@query(SCORES + """, m AS (SELECT text, language, model, median(overall) AS overall FROM s GROUP BY ALL),
p AS (SELECT *, lead(overall) OVER o AS below, lead(model) OVER o AS rival, row_number() OVER o AS place, count(*) OVER (PARTITION BY text, language) AS models FROM m WINDOW o AS (PARTITION BY text, language ORDER BY overall DESC, model)),
g AS (SELECT *, round(overall - below, 6) AS gap FROM p WHERE models >= 2 AND rival IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY text, language ORDER BY gap, place) AS nth FROM g)
SELECT text, language, gap AS min_gap, model AS leader, rival AS follower, models, CASE WHEN gap < 0.1 THEN '<0.1' WHEN gap < 0.2 THEN '0.1-0.2' WHEN gap < 0.3 THEN '0.2-0.3' ELSE '>=0.3' END AS bucket, gap < 0.3 AS flagged FROM f WHERE nth = 1""")
def w01_rank_gaps(spark, sf_dir):
    return ranking.rank_gaps(scores(spark, sf_dir))


@query(SCORES + "SELECT language, count(overall) AS n_scores, round(avg(overall), 6) AS mean, round(coalesce(stddev_samp(overall), 0), 6) AS stddev FROM s GROUP BY 1")
def g19_judge_spread(spark, sf_dir):
    return ranking.spread(scores(spark, sf_dir), "language")


@query(SCORES + "SELECT language, CASE WHEN overall >= 9 THEN 'excellent' WHEN overall >= 7 THEN 'good' WHEN overall >= 5 THEN 'acceptable' WHEN overall >= 3 THEN 'poor' ELSE 'failed' END AS label, count(*) AS n FROM s GROUP BY ALL")
def f39_score_distribution(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("language", ranking.score_bucket(F.col("overall")).alias("label")).agg(F.count("*").alias("n"))


@query(SCORES + f", m AS (SELECT model AS prompt, coalesce(avg(overall) FILTER (language % 2 = 0), 0) AS train, coalesce(avg(overall) FILTER (language % 2 = 1), 0) AS held, coalesce(var_samp(overall), 0) AS v FROM s GROUP BY 1) SELECT prompt, round(train - v * 0.1::DOUBLE - greatest(0, length(prompt) - 500) * 0.001::DOUBLE - len(list_filter({ranking.TEXT_TERMS}, lambda t: contains(lower(prompt), t))) * 0.05::DOUBLE - greatest(0, train - held) * 0.5::DOUBLE, 6) AS fitness FROM m")
def g40_penalized_fitness(spark, sf_dir):
    return ranking.penalized_fitness(scores(spark, sf_dir).select(F.col("model").alias("prompt"), F.col("overall").alias("score"), (F.col("language") % 2 == 1).alias("test")))


@query("SELECT lang, list_sort(list(n_chars))[CAST(round_even(0.9::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1] AS p90 FROM documents GROUP BY 1")
def g41_nearest_rank(spark, sf_dir):
    return ranking.nearest_rank(read(spark, sf_dir, "documents"), "lang", "n_chars", 90).select("lang", F.col("n_chars").alias("p90"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j05_orphans(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return ranking.orphans(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), orders, ["c_custkey"])


@query("SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 5000 GROUP BY 1")
def j04_groups_with_counts(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").where("c_acctbal > 5000")
    return read(spark, sf_dir, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


# Ordered and keyed rows ------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def d01_latest_per_key(spark, sf_dir):
    return rows.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def u03_first_wins(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.first_wins(docs, ["digest"], ["doc_id"])


@query("SELECT min(p_partkey) AS p_partkey FROM part WHERE lower(trim(p_brand)) NOT IN (SELECT lower(trim(p_brand)) FROM part WHERE p_partkey <= 10) AND trim(p_brand) <> '' AND p_partkey > 10 GROUP BY lower(trim(p_brand))")
def u06_insert_absent(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return rows.insert_absent(part.where("p_partkey > 10"), part.where("p_partkey <= 10"), F.col("p_brand"), ["p_partkey"]).select("p_partkey")


@query("WITH n AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS i, role <> 'system' OR turn % 2 = 0 AS ok FROM conversations), c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS r FROM n), b AS (SELECT conv_id, min(CASE WHEN NOT ok OR i <> r THEN r END) AS first_bad, count(*) AS chunks FROM c GROUP BY 1) SELECT conv_id, coalesce(first_bad, chunks) AS prefix, chunks FROM b")
def w03_completed_prefix(spark, sf_dir):
    from pyspark.sql.window import Window as W

    turns = read(spark, sf_dir, "conversations").withColumn("i", F.col("turn") - F.min("turn").over(W.partitionBy("conv_id")))
    return rows.completed_prefix(turns, "conv_id", "i", (F.col("role") != "system") | (F.col("turn") % 2 == 0))


@query("SELECT conv_id, count(*) AS units, count(DISTINCT role) < count(*) AS duplicate_unit_id, min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*) AS non_contiguous_order FROM conversations GROUP BY 1")
def w04_identity_issues(spark, sf_dir):
    return rows.identity_issues(read(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


@query(r"WITH n AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) AS t FROM documents), f AS (SELECT doc_id, first_value(doc_id) OVER w AS holder, source, first_value(source) OVER w AS fs FROM n WHERE length(t) >= 100 WINDOW w AS (PARTITION BY t ORDER BY doc_id)) SELECT doc_id, holder FROM f WHERE source <> fs")
def w05_duplicate_outputs(spark, sf_dir):
    return rows.duplicate_outputs(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", F.col("source"), F.col("text"))


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS progress FROM events")
def w08_running_progress(spark, sf_dir):
    return rows.running_progress(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("value")).select("user_id", "event_id", "progress")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def w13_carried_text(spark, sf_dir):
    heading = F.when(F.col("role") == "user", F.col("text"))
    return rows.carried(read(spark, sf_dir, "conversations"), "conv_id", "turn", heading, "heading").select("conv_id", "turn", "heading")


@query(r"WITH l AS (SELECT conv_id, turn, lag(text) OVER w AS p, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, list_filter(string_split(p, chr(10)), lambda x: trim(x) <> '')[-1] AS context_before, list_filter(string_split(n, chr(10)), lambda x: trim(x) <> '')[1] AS context_after FROM l")
def w12_neighbours(spark, sf_dir):
    return rows.neighbours(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context_before", "context_after")


@query("WITH j AS (SELECT c_custkey AS job, c_custkey % 9 AS total FROM customer), c AS (SELECT DISTINCT o_custkey AS job, o_orderkey % 9 AS i FROM orders), w AS (SELECT job, unnest(range(0, total)) AS i FROM j) SELECT w.job, count(*) AS missing FROM w LEFT JOIN c ON c.job = w.job AND c.i = w.i WHERE c.job IS NULL GROUP BY 1")
def w14_missing_chunks(spark, sf_dir):
    jobs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 9).alias("total"))
    chunks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), (F.col("o_orderkey") % 9).alias("i"))
    return rows.missing_chunks(jobs, chunks, "job", "i", "total")


NAMES = r"WITH n AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS v, role FROM conversations), "


@query(NAMES + "a AS (SELECT conv_id, v, count_if(role = 'user') AS x, count_if(role = 'assistant') AS y FROM n GROUP BY 1, 2) SELECT conv_id, v, greatest(0, x - y) AS missing, greatest(0, y - x) AS added FROM a WHERE x <> y")
def u04_name_mismatch(spark, sf_dir):
    n = read(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("v"))
    return rows.multiset_difference(n.where("role = 'user'"), n.where("role = 'assistant'"), ["conv_id"], "v")


# Text ------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, 3 * len(regexp_extract_all(text, 'Ã.|Â[\x{0080}-\x{00FF}\x{20AC}\x{2122}]?|â[\x{0080}-\x{00FF}\x{20AC}\x{2122}]{1,3}|ï¿½|\x{FFFD}|ðŸ')) + 2 * len(regexp_extract_all(text, '[\x{0080}-\x{009F}]')) + 5 * len(regexp_extract_all(text, '\x{FFFD}')) AS score FROM documents")
def c01_mojibake_score(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.mojibake_score(F.col("text")).alias("score"))


@query(
    r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS a FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{024F}]-\s*\n\s*[A-Za-z\x{00C0}-\x{024F}]')) AS h, len(a) AS n, len(list_filter(a, lambda x: length(trim(x)) BETWEEN 18 AND 95)) AS s,
  len(list_filter(a, lambda x: length(trim(x)) >= 20 AND NOT regexp_matches(x, '[.!?;:)\]"'']\s*$') AND NOT regexp_matches(x, '^\s*(?:[-*\x{2022}]|[0-9]+[.)]|[A-Za-z][.)])\s+'))) AS o,
  len(list_filter(a, lambda x: regexp_matches(x, '(?i)^\s*(?:page\s*)?[0-9]{1,4}\s*$'))) AS p, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\n\t]', '', 'g'), '[\p{Cc}\p{Cf}]')) AS k FROM l),
q AS (SELECT *, CASE WHEN n < 6 THEN 0 ELSE CASE WHEN h >= 2 THEN 3 WHEN h = 1 THEN 1 ELSE 0 END + CASE WHEN s / n::DOUBLE >= 0.65 THEN 2 ELSE 0 END + CASE WHEN o / n::DOUBLE >= 0.45 THEN 2 ELSE 0 END + CASE WHEN p >= 2 THEN 1 ELSE 0 END + CASE WHEN k > 0 THEN 1 ELSE 0 END END AS score FROM c)
SELECT doc_id, h AS hyphen_breaks, p AS page_lines, k AS controls, score AS ocr_score, score >= 3 AS likely_scan FROM q"""
)
def c12_ocr_signals(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in T.ocr_signals(F.col("text")).items()])


@query(r"WITH l AS (SELECT doc_id, text, string_split(text || chr(10) || 'Page ' || doc_id % 90 || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '12 ' ELSE 'end' END, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, l, len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*(?:page\s*)?[0-9]{1,4}\s*$'))) AS n FROM l) SELECT doc_id, md5(CASE WHEN n >= 2 THEN array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '(?i)^\s*(?:page\s*)?[0-9]{1,4}\s*$') THEN '' ELSE x END), chr(10)) ELSE array_to_string(l, chr(10)) END) AS digest FROM p")
def c14_without_page_lines(spark, sf_dir):
    paged = F.expr("concat(text, chr(10), 'Page ', doc_id % 90, chr(10), CASE WHEN doc_id % 2 = 0 THEN '12 ' ELSE 'end' END)")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.without_page_lines(paged)).alias("digest"))


@query("WITH c AS (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in T.SCRIPTS.items()) + " FROM documents), s AS (SELECT *, " + " + ".join(T.SCRIPTS) + " AS total FROM c) SELECT doc_id, " + ", ".join(f"coalesce({k} / nullif(total, 0)::DOUBLE, 0) AS {k}" for k in T.SCRIPTS) + " FROM s")
def f13_script_shares(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in T.script_counts(F.col("text")).items()])
    return counts.select("doc_id", *[c.alias(k) for k, c in T.script_shares({k: F.col(k) for k in T.SCRIPTS}).items()])


_SCORE = "len(list_filter(w, lambda x: list_contains(string_split('{}', ' '), x)))"


@query(
    r"WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}]') AS latin FROM documents), s AS (SELECT doc_id, latin, "
    + ", ".join(f"{_SCORE.format(v)} AS {k.lower()}" for k, v in T.MARKERS.items())
    + " FROM d) SELECT doc_id, CASE WHEN greatest(spanish, english, french) = 0 THEN CASE WHEN latin THEN 'latin' ELSE 'unknown' END WHEN spanish = greatest(spanish, english, french) THEN 'Spanish' WHEN english = greatest(spanish, english, french) THEN 'English' ELSE 'French' END AS language FROM s"
)
def f15_detected_language(spark, sf_dir):
    return T.with_language(read(spark, sf_dir, "documents"), "text").select("doc_id", "language")


@query(r"SELECT doc_id, greatest(length(text) // 4, len(regexp_extract_all(text, '[^\s]+'))) AS tokens FROM documents")
def k07_token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, coalesce(list_min(list_filter([2048, 4096, 8192, 16384, 32768, 65536, 131072], lambda s: s >= n_chars)), n_chars) AS size FROM documents")
def k24_context_size(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.context_size(F.col("n_chars")).alias("size"))


@query("WITH t AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS t FROM documents) SELECT doc_id, array_to_string(CASE WHEN t < 3 THEN range(0, least(t, 5)) WHEN t - 2 <= 5 THEN range(1, greatest(1, t - 2) + 1) ELSE list_sort(list_distinct(list_transform(range(1, 6), lambda i: greatest(1, least(t - 2, CAST(round_even(i * (t - 1) / 6.0::DOUBLE, 0) AS BIGINT)))))) END, ',') AS indices FROM t")
def k08_sample_indices(spark, sf_dir):
    total = F.size(T.lines(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.sample_indices(total, 5).cast("array<string>"), ",").alias("indices"))


@query()
def k01_chunks(spark, sf_dir):
    return chunking.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", 400, "\n")


@query()
def k06_chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunking.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", 400, "\n"), 400)


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: list_contains(string_split('" + T.NEGATIONS + "', ' '), w))) AS n FROM documents")
def x10_negations(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.negations(F.col("text")).alias("n"))


PAIRS = "WITH p AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant') "


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    b = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return a.join(b, ["conv_id", "turn"])


_NEGATED = "len(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: list_contains(string_split('" + T.NEGATIONS + "', ' '), w)))"


@query(
    PAIRS
    + r", n AS (SELECT conv_id, turn, length(regexp_replace(s, '[\s\x{00A0}]+', '', 'g')) AS a, length(regexp_replace(t, '[\s\x{00A0}]+', '', 'g')) AS b, length(regexp_replace(s, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS whole, "
    + f"{_NEGATED.format('s')} AS x, {_NEGATED.format('t')} AS y FROM p) "
    + "SELECT conv_id, turn, CASE WHEN a > 0 AND b > 0 THEN concat_ws(',', CASE WHEN whole < 100 THEN NULL WHEN b / a::DOUBLE < 0.55 THEN 'probable_semantic_omission' WHEN b / a::DOUBLE > 2.2 THEN 'probable_semantic_addition' END, CASE WHEN x > 0 AND y = 0 THEN 'possible_negation_loss' END) ELSE '' END AS issues FROM n"
)
def x11_semantic_issues(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", T.semantic_issues(F.col("s"), F.col("t")).alias("issues"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def x33_checksum(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(concat('-', p_name, '_x--é ', p_brand)), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM part")
def x57_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.expr("concat('-', p_name, '_x--é ', p_brand)")).alias("slug"))


from docmill.plans import boards, mark_plans, more_plans, ordered_plans, quality_plans, text_plans, usage_plans  # noqa: E402, F401

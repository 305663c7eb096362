"""Queries of the usage ledger and the job store, with the SQL that checks them.

The driver's tables stand for the ledger's by expressions that Spark and DuckDB both read (CALLS, JOBS); the operators
and their SQL are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import jobs, ledger
from docmill.plans.base import query, read

#: Events as calls. k is the number in their properties.
CALLS = {
    "event_id": "event_id",
    "created_at": "ts",
    "translation_id": "CASE WHEN user_id % 11 = 0 THEN '' ELSE CAST(user_id AS STRING) END",
    "process_id": "concat('p', user_id % 50)",
    "process_type": "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'translation' WHEN 2 THEN 'transform' ELSE NULL END",
    "phase": "CASE WHEN event_type = 'view' THEN '' ELSE event_type END",
    "provider": "CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END",
    "model": "concat('m', event_id % 5)",
    "book_name": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('book ', user_id % 40) END",
    "input_filename": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat('in', user_id % 30, '.txt') END",
    "output_filename": "''",
    "prompt_tokens": "CASE WHEN k % 9 = 0 THEN 0 ELSE k END",
    "completion_tokens": "k % 7",
    "total_tokens": "k + k % 7",
    "cache_hit_tokens": "k % 5",
    "cache_miss_tokens": "k % 3",
    "input_cost_usd": "value / 4",
    "output_cost_usd": "value / 2",
    "total_cost_usd": "value",
    "pricing_source": "CASE k % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'usage_unknown' WHEN 2 THEN 'not_billed' ELSE 'table' END",
    "estimated": "CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' WHEN k % 8 = 3 THEN 'empty_response' WHEN k % 8 = 4 THEN 'estimated_local' ELSE 'ok' END",
}
#: Orders as jobs.
JOBS = {
    "job": "o_orderkey",
    "translation_id": "CAST(o_custkey AS STRING)",
    "created_at": "o_orderdate",
    "status": "CASE o_orderkey % 9 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'paused' WHEN 3 THEN 'interrupted' WHEN 4 THEN 'error' WHEN 5 THEN 'partial' WHEN 6 THEN 'validating' WHEN 7 THEN 'processing' ELSE 'completed' END",
    "session": "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'now' ELSE 'old' END",
    "config": "concat('{\"requested_name\": \"', CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('f', o_custkey % 700) END, '\", \"job_name\": \"f', o_custkey % 500, '\", \"operation_mode\": \"', CASE WHEN o_orderkey % 7 = 0 THEN 'transform' ELSE 'x' END, '\", \"text_process\": \"', CASE WHEN o_orderkey % 14 = 0 THEN 'clean' ELSE '' END, '\", \"refine_only\": ', CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END, ', \"enable_refinement\": ', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END, '}')",
}
#: Line items as chunks of jobs.
CHUNKS = {
    "job": "l_orderkey",
    "chunk_index": "CAST(l_linenumber AS BIGINT) - 1",
    "original": "concat('text ', l_partkey)",
    "translated": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('out ', l_suppkey) END",
    "status": "CASE WHEN l_linestatus = 'F' OR l_returnflag = 'R' THEN 'failed' ELSE 'completed' END",
    "tokens": "CAST(l_quantity AS BIGINT)",
    "seconds": "CAST(l_extendedprice AS DECIMAL(18,2))",
}


def _as(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as(read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), CALLS)


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as(read(spark, sf_dir, "orders"), JOBS)


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as(read(spark, sf_dir, "lineitem"), CHUNKS)


C = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), c AS (" + _sql(CALLS, "e") + ") "
J = "WITH j AS (" + _sql(JOBS, "orders") + "), h AS (" + _sql(CHUNKS, "lineitem") + ") "
TOKENS = ", ".join(f"CAST(coalesce(sum({t}), 0) AS BIGINT) AS {t}" for t in ledger.COUNTED)
MONEY = ", ".join(f"round(coalesce(sum({t}), 0), 6) AS {t}" for t in ledger.PRICED)
COST = "round(coalesce(sum(total_cost_usd), 0), 6) AS total_cost_usd"
USED = f"count(*) AS calls, {TOKENS}, {COST}, CAST(sum(estimated) AS BIGINT) AS estimated_events"
BOOK = "coalesce(nullif(book_name, ''), nullif(input_filename, ''), nullif(output_filename, ''), {}, 'Sin libro')"
PHASE, PROCESS = "coalesce(nullif(phase, ''), nullif(process_type, ''), 'unknown')", "coalesce(nullif(process_type, ''), 'unknown')"
NOW = "TIMESTAMP '1998-08-02 00:00:00'"


@query(C + f"SELECT count(*) AS calls, {TOKENS}, {MONEY}, CAST(coalesce(sum(estimated), 0) AS BIGINT) AS estimated_events, count_if(pricing_source IN ('unknown', 'usage_unknown')) AS unknown_cost_events FROM c")
def g01_usage_totals(spark, sf_dir):
    return ledger.whole_totals(calls(spark, sf_dir))


@query(C + f"SELECT {BOOK.format('translation_id, process_id')} AS book_name, translation_id, process_type, {USED}, max(created_at) AS last_seen FROM c GROUP BY 1, 2, 3")
def g02_usage_by_book(spark, sf_dir):
    return ledger.by_book(calls(spark, sf_dir))


@query(C + f"SELECT provider, model, {USED} FROM c GROUP BY 1, 2")
def g03_usage_by_model(spark, sf_dir):
    return ledger.by_model(calls(spark, sf_dir))


@query(C + f", n AS (SELECT translation_id, {BOOK.format('translation_id')} AS book_name, {PROCESS} AS process_type FROM c WHERE translation_id <> '' QUALIFY row_number() OVER (PARTITION BY translation_id ORDER BY created_at DESC, event_id DESC) = 1), u AS (SELECT translation_id, count(*) AS calls, {TOKENS}, {MONEY}, CAST(sum(estimated) AS BIGINT) AS estimated_events, min(created_at) AS first_seen, max(created_at) AS last_seen FROM c WHERE translation_id <> '' GROUP BY 1) SELECT u.*, n.book_name, n.process_type FROM u JOIN n USING (translation_id)")
def g04_usage_by_translation(spark, sf_dir):
    return ledger.by_translation_whole(calls(spark, sf_dir))


@query(C + f"SELECT process_type, {USED} FROM c GROUP BY 1")
def g05_usage_by_process(spark, sf_dir):
    return ledger.by_process(calls(spark, sf_dir))


@query(C + f"SELECT translation_id, {PHASE} AS phase, {PROCESS} AS process_type, {USED}, max(created_at) AS last_seen FROM c WHERE translation_id <> '' GROUP BY 1, 2, 3")
def g07_usage_by_translation_and_phase(spark, sf_dir):
    return ledger.by_translation_and_phase(calls(spark, sf_dir))


@query(C + f", p AS (SELECT translation_id, {PHASE} AS phase, {PROCESS} AS process_type, {USED} FROM c WHERE translation_id <> '' GROUP BY 1, 2, 3) SELECT translation_id, phase, process_type, round(coalesce(100.0::DOUBLE * total_tokens / nullif(sum(total_tokens) OVER w, 0), 0), 4) AS token_share_pct, round(coalesce(CASE WHEN sum(total_cost_usd) OVER w > 0 THEN 100.0::DOUBLE * total_cost_usd / sum(total_cost_usd) OVER w END, 0), 4) AS cost_share_pct, round(coalesce(cache_hit_tokens / nullif(cache_hit_tokens + cache_miss_tokens, 0)::DOUBLE, 0), 6) AS cache_hit_ratio FROM p WINDOW w AS (PARTITION BY translation_id)")
def g10_usage_shares(spark, sf_dir):
    return ledger.with_shares(ledger.by_translation_and_phase(calls(spark, sf_dir))).select("translation_id", "phase", "process_type", "token_share_pct", "cost_share_pct", "cache_hit_ratio")


PROJECTED = """, r AS (SELECT *, CASE WHEN coalesce(completed_chunks, 0) + coalesce(failed_chunks, 0) > 0 THEN coalesce(completed_chunks, 0) + coalesce(failed_chunks, 0) ELSE greatest(0, coalesce(chunk_index, -1) + 1) END AS n FROM {}),
q AS (SELECT *, CASE WHEN percent >= 1 AND total_cost_usd > 0 THEN percent / 100 WHEN total_chunks > 0 AND n > 0 AND total_cost_usd > 0 THEN n / total_chunks::DOUBLE END AS part FROM r),
o AS (SELECT *, coalesce(total_cost_usd / part, 0) AS pc, CASE WHEN total_tokens > 0 THEN coalesce(total_tokens / part, 0) ELSE 0 END AS pt FROM q)
SELECT {}, CAST(n AS BIGINT) AS processed_chunks, round(CASE WHEN n > 0 AND total_cost_usd > 0 THEN total_cost_usd / n ELSE 0 END, 6) AS cost_per_chunk, round(CASE WHEN n > 0 AND total_tokens > 0 THEN total_tokens / n::DOUBLE ELSE 0 END, 6) AS tokens_per_chunk,
  round(CASE WHEN total_tokens > 0 AND total_cost_usd > 0 THEN total_cost_usd / total_tokens * 1000 ELSE 0 END, 6) AS cost_per_1k, round(pc, 4) AS projected_cost, round(CASE WHEN pc > 0 THEN greatest(0, pc - total_cost_usd) ELSE 0 END, 4) AS remaining_cost,
  round(pt, 4) AS projected_tokens, round(CASE WHEN pt > 0 THEN greatest(0, pt - total_tokens) ELSE 0 END, 4) AS remaining_tokens, CASE WHEN percent >= 1 AND total_cost_usd > 0 THEN 'progress_percent' WHEN part IS NOT NULL THEN 'chunk_ratio' ELSE '' END AS basis FROM o"""
STATE = {"translation_id": "translation_id", "total_cost_usd": "total_cost_usd", "total_tokens": "total_tokens", "percent": "CASE WHEN calls % 3 = 0 THEN CAST(calls AS DOUBLE) ELSE 0.0 END", "completed_chunks": "calls % 5", "failed_chunks": "CASE WHEN calls % 2 = 0 THEN NULL ELSE calls % 2 END", "chunk_index": "calls % 4 - 1", "total_chunks": "calls % 6"}


@query(C + f", t AS (SELECT translation_id, {USED} FROM c WHERE translation_id <> '' GROUP BY 1), s AS (" + _sql(STATE, "t") + ")" + PROJECTED.format("s", "translation_id"))
def g12_projections(spark, sf_dir):
    return _as(ledger.by_translation_whole(calls(spark, sf_dir)), STATE).withColumns(ledger.projection()).select("translation_id", "processed_chunks", "cost_per_chunk", "tokens_per_chunk", "cost_per_1k", "projected_cost", "remaining_cost", "projected_tokens", "remaining_tokens", "basis")


LIVE = "translation_id, coalesce(status, '') AS status, calls, round(recent_tokens / (86400 / 60.0), 6) AS tokens_per_minute, round(recent_cost / (86400 / 60.0), 6) AS cost_per_minute"


@query(
    C
    + f""", u AS (SELECT translation_id, {USED}, max(created_at) AS last_seen FROM c WHERE translation_id <> '' GROUP BY 1), m AS (SELECT max(created_at) AS now FROM c),
v AS (SELECT translation_id, {USED} FROM c, m WHERE translation_id <> '' AND created_at >= now - INTERVAL 86400 SECONDS GROUP BY 1),
jb AS (SELECT CAST(c_custkey AS STRING) AS translation_id, CASE WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'completed' END AS status, c_custkey % 2 = 0 AS is_active, CAST(c_custkey % 90 AS DOUBLE) AS percent, c_custkey % 7 AS completed_chunks, 0 AS failed_chunks, 0 AS chunk_index, c_custkey % 11 AS total_chunks FROM customer WHERE c_custkey % 3 = 0),
l AS (SELECT translation_id, status, is_active, percent, completed_chunks, failed_chunks, chunk_index, total_chunks, coalesce(u.calls, 0) AS calls, coalesce(u.total_tokens, 0) AS total_tokens, coalesce(u.total_cost_usd, 0) AS total_cost_usd, u.last_seen, coalesce(v.total_tokens, 0) AS recent_tokens, coalesce(v.total_cost_usd, 0) AS recent_cost
  FROM jb FULL JOIN u USING (translation_id) LEFT JOIN v USING (translation_id), m WHERE CASE WHEN status IS NOT NULL THEN is_active ELSE coalesce(last_seen >= now - INTERVAL 86400 SECONDS, false) END)"""
    + PROJECTED.format("l", LIVE)
)
def j11_live_jobs(spark, sf_dir):
    c = calls(spark, sf_dir)
    own = "CAST(c_custkey AS STRING) AS translation_id|CASE WHEN c_custkey % 2 = 0 THEN 'running' ELSE 'completed' END AS status|c_custkey % 2 = 0 AS is_active|CAST(c_custkey % 90 AS DOUBLE) AS percent|c_custkey % 7 AS completed_chunks|0 AS failed_chunks|0 AS chunk_index|c_custkey % 11 AS total_chunks"
    running = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr(*own.split("|"))
    last = c.agg(F.max("created_at").alias("now"))
    day = ledger.of_translations(c.join(F.broadcast(last), F.col("created_at") >= F.col("now") - F.expr("interval 86400 seconds"))).groupBy("translation_id").agg(*ledger.whole_usage("total_cost_usd"))  # one row
    usage = ledger.by_translation_whole(c).join(F.broadcast(last))  # one row
    out = ledger.live_jobs(running, usage, day, F.col("now"), 86_400, 86_400)
    return out.select("translation_id", F.coalesce("status", F.lit("")).alias("status"), "calls", "tokens_per_minute", "cost_per_minute", "processed_chunks", "cost_per_chunk", "tokens_per_chunk", "cost_per_1k", "projected_cost", "remaining_cost", "projected_tokens", "remaining_tokens", "basis")


@query(C + "SELECT event_id, translation_id, process_id, total_tokens FROM c WHERE translation_id = '7' AND process_id = 'p7' ORDER BY created_at DESC, event_id DESC LIMIT 40")
def t01_filtered_events(spark, sf_dir):
    return ledger.filtered_events(calls(spark, sf_dir), 40, "7", "p7").select("event_id", "translation_id", "process_id", "total_tokens")


RECORDED = {"event_id": "event_id", "created_at": "ts", "provider": "CASE event_id % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END", "model": "concat('m', event_id % 2)", "status": "CASE k % 8 WHEN 0 THEN 'error' WHEN 1 THEN 'estimated_local' ELSE 'ok' END", "prompt": "concat('prompt ', props, event_type)", "system_prompt": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'system' END", "response": "CASE WHEN k % 5 = 0 THEN NULL ELSE concat(event_type, ' said ', props) END", "prompt_tokens": "CASE WHEN k % 3 = 0 THEN NULL ELSE k END", "completion_tokens": "CASE WHEN k % 4 = 0 THEN 0 ELSE k % 50 END", "cache_hit_tokens": "k % 9", "cache_miss_tokens": "k % 4", "cache_written_tokens": "k % 2", "total_tokens": "CASE WHEN k % 7 = 0 THEN k * 3 ELSE 0 END", "process_type": "CASE WHEN k % 6 = 0 THEN '' ELSE 'translation' END", "phase": "CASE WHEN k % 10 = 0 THEN NULL ELSE event_type END"}
PRICES = [("Alpha", "m0", 2.0, 0.5, 2.5, 8.0), ("beta", "m0", 0.3, 0.03, 0.3, 1.2), ("beta", "m1", 1.0, 0.1, 1.25, 4.0)]


@query(
    "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), c AS (" + _sql(RECORDED, "e") + "), p(provider, model, price_in, price_hit, price_written, price_out) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in PRICES)
    + r"""), t AS (SELECT *, trim(coalesce(system_prompt, '') || chr(10) || coalesce(prompt, ''), ' ' || chr(10) || chr(9) || chr(13)) AS text, (status = 'ok' OR starts_with(status, 'estimated')) AS may FROM c),
g AS (SELECT *, may AND coalesce(prompt_tokens, 0) = 0 AS gi, may AND coalesce(completion_tokens, 0) = 0 AND coalesce(response, '') <> '' AS go FROM t),
n AS (SELECT * REPLACE (CASE WHEN gi THEN greatest(1, CAST(floor(length(text) / 3.7::DOUBLE) AS BIGINT)) ELSE coalesce(prompt_tokens, 0) END AS prompt_tokens, CASE WHEN go THEN greatest(1, CAST(floor(length(response) / 3.7::DOUBLE) AS BIGINT)) ELSE coalesce(completion_tokens, 0) END AS completion_tokens), CAST(gi OR go OR starts_with(status, 'estimated') AS INT) AS estimated FROM g),
k AS (SELECT n.*, p.price_in, p.price_hit, p.price_written, p.price_out, least(cache_hit_tokens, prompt_tokens) AS hit, least(cache_written_tokens, prompt_tokens - least(cache_hit_tokens, prompt_tokens)) AS stored, (prompt_tokens + completion_tokens = 0 AND estimated = 0) OR cache_written_tokens + cache_hit_tokens > prompt_tokens AS lost FROM n LEFT JOIN p USING (provider, model)),
m AS (SELECT *, (hit * price_hit + stored * price_written + (prompt_tokens - hit - stored) * price_in) / 1e6 AS ic, completion_tokens * price_out / 1e6 AS oc FROM k)
SELECT event_id, created_at, lower(provider) AS provider, model, status, estimated, prompt_tokens, completion_tokens, greatest(total_tokens, prompt_tokens + completion_tokens) AS total_tokens, coalesce(nullif(process_type, ''), 'unknown') AS process_type, coalesce(nullif(phase, ''), 'llm_call') AS phase,
  CAST(length(text) AS INT) AS prompt_chars, CAST(length(coalesce(response, '')) AS INT) AS completion_chars, round(coalesce(ic, 0), 9) AS input_cost_usd, round(coalesce(oc, 0), 9) AS output_cost_usd, round(coalesce(ic + oc, 0), 9) AS total_cost_usd,
  CASE WHEN lost THEN 'usage_unknown' WHEN price_in IS NULL THEN 'unknown' ELSE 'table' END AS pricing_source, CASE WHEN lost OR price_in IS NULL THEN 'unknown' WHEN estimated = 1 THEN 'estimated' ELSE 'provider_usage' END AS cost_basis, sha256(text) AS prompt_hash, sha256(coalesce(response, '')) AS response_hash FROM m"""
)
def r01_recorded_calls(spark, sf_dir):
    given = _as(read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), RECORDED)
    prices = spark.createDataFrame(PRICES, "provider string, model string, price_in double, price_hit double, price_written double, price_out double")
    return ledger.recorded(given, F.broadcast(prices))  # a row a model


HOLLOW = "status IN ('error', 'empty_response') AND estimated = 1 AND completion_tokens = 0 AND cache_hit_tokens = 0 AND cache_miss_tokens = 0"


@query(
    C
    + f", h AS (SELECT *, {HOLLOW} AS hollow FROM c) SELECT event_id, CASE WHEN hollow THEN 0 ELSE prompt_tokens END AS prompt_tokens, CASE WHEN hollow THEN 0 ELSE total_tokens END AS total_tokens, CASE WHEN hollow THEN 0 ELSE total_cost_usd END AS total_cost_usd, CASE WHEN hollow THEN 0 ELSE estimated END AS estimated, CASE WHEN hollow OR (pricing_source = 'not_billed' AND status IN ('error', 'empty_response') AND total_tokens = 0) THEN 'usage_unknown' ELSE pricing_source END AS pricing_source FROM h"
)
def d06_without_unbillable(spark, sf_dir):
    return ledger.without_unbillable(calls(spark, sf_dir)).select("event_id", "prompt_tokens", "total_tokens", "total_cost_usd", "estimated", "pricing_source")


TIERS = [("m0", "peak", 2.0, 0.2, 8.0), ("m0", "off_peak", 1.0, 0.1, 4.0), ("m1", "peak", 0.6, 0.06, 2.0), ("m1", "off_peak", 0.3, 0.03, 1.0), ("m2", "off_peak", 0.5, 0.05, 2.0)]
IN_PEAK = "isodow({0}) <= 5 AND ((hour({0}) >= 1 AND hour({0}) < 4) OR (hour({0}) >= 6 AND hour({0}) < 10))"


@query(
    C
    + f", d AS (SELECT *, CASE WHEN provider = 'beta' AND status = 'ok' AND created_at >= TIMESTAMP '2024-01-10' THEN CASE WHEN {IN_PEAK.format('created_at')} THEN 'peak' ELSE 'off_peak' END END AS tier FROM c), p(model, tier, pi, ph, po) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in TIERS)
    + "), k AS (SELECT d.*, pi, ph, po, least(cache_hit_tokens, prompt_tokens) AS hit FROM d LEFT JOIN p USING (model, tier)) SELECT event_id, round(CASE WHEN pi IS NULL THEN total_cost_usd ELSE (hit * ph + (prompt_tokens - hit) * pi) / 1e6 + completion_tokens * po / 1e6 END, 9) AS total_cost_usd, CASE WHEN pi IS NULL THEN pricing_source ELSE 'schedule_' || tier END AS pricing_source FROM k"
)
def d07_repriced(spark, sf_dir):
    prices = spark.createDataFrame(TIERS, "model string, tier string, price_in double, price_hit double, price_out double")
    return ledger.repriced(calls(spark, sf_dir), "beta", F.lit("2024-01-10").cast("timestamp_ntz"), jobs.peak_window(F.col("created_at")).isNotNull(), F.broadcast(prices))  # a row a model and tier


@query(
    f"""WITH t AS (SELECT event_id, ts, {IN_PEAK.format('ts')} AS peak, date_trunc('day', ts) AS d FROM events),
s AS (SELECT event_id, ts, peak, d, unnest([d + INTERVAL 1 HOUR, d + INTERVAL 6 HOUR, d + INTERVAL 25 HOUR, d + INTERVAL 30 HOUR, d + INTERVAL 49 HOUR, d + INTERVAL 54 HOUR, d + INTERVAL 73 HOUR, d + INTERVAL 78 HOUR]) AS n FROM t),
f AS (SELECT event_id, min(n) AS next_peak FROM s WHERE n > ts AND isodow(n) <= 5 GROUP BY 1)
SELECT event_id, CASE WHEN peak THEN 'peak' ELSE 'off_peak' END AS tier, NOT peak AS available, CASE WHEN NOT peak THEN 0 ELSE greatest(1, CAST(ceil(epoch(d + CASE WHEN hour(ts) < 4 THEN INTERVAL 4 HOUR ELSE INTERVAL 10 HOUR END) - epoch(ts)) AS BIGINT)) END AS wait_seconds, next_peak FROM t JOIN f USING (event_id)"""
)
def x30_pricing_status(spark, sf_dir):
    status = jobs.pricing_status(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in status.items()])


@query(f"SELECT event_id, CASE WHEN {IN_PEAK.format('ts')} THEN date_trunc('day', ts) + CASE WHEN hour(ts) < 4 THEN INTERVAL 1 HOUR ELSE INTERVAL 6 HOUR END END AS peak_start FROM events")
def x31_peak_window(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", jobs.peak_window(F.col("ts"))["start"].alias("peak_start"))


# Jobs -----------------------------------------------------------------------------------------------------------------


@query(J + "SELECT job, CASE WHEN json_extract_string(config, '$.operation_mode') = 'transform' OR json_extract_string(config, '$.text_process') <> '' THEN 'transform_' || coalesce(nullif(json_extract_string(config, '$.text_process'), ''), 'custom') WHEN json_extract_string(config, '$.refine_only') = 'true' THEN 'editorial_refinement' WHEN json_extract_string(config, '$.enable_refinement') = 'true' THEN 'translation_with_refinement' ELSE 'translation' END AS process_type FROM j")
def x60_process_type(spark, sf_dir):
    return job_rows(spark, sf_dir).select("job", jobs.process_type(F.col("config")).alias("process_type"))


@query(J + f"SELECT job, status FROM j WHERE status IN ('paused', 'interrupted', 'error', 'partial', 'validating') AND created_at > {NOW} - INTERVAL 400 DAYS")
def t06_resumable_jobs(spark, sf_dir):
    return jobs.resumable(job_rows(spark, sf_dir), F.lit("1998-08-02").cast("timestamp_ntz"), 400).select("job", "status")


OLD = f"status IN ('paused', 'interrupted', 'error', 'partial', 'completed') AND created_at <= {NOW} - INTERVAL 400 DAYS"


@query(J + f", k AS (SELECT job FROM j WHERE NOT ({OLD})) SELECT job, count(h.chunk_index) AS chunks FROM k LEFT JOIN h USING (job) GROUP BY 1")
def d04_without_old_jobs(spark, sf_dir):
    kept, chunks = jobs.without_old(job_rows(spark, sf_dir), chunk_rows(spark, sf_dir), F.lit("1998-08-02").cast("timestamp_ntz"), 400)
    return kept.select("job").join(chunks.select("job", "chunk_index"), "job", "left").groupBy("job").agg(F.count("chunk_index").alias("chunks"))


@query(J + "SELECT job, CASE WHEN status IN ('queued', 'running', 'validating') AND (session IS NULL OR session <> 'now') THEN 'interrupted' ELSE status END AS status FROM j")
def d05_interrupted_jobs(spark, sf_dir):
    return jobs.interrupted(job_rows(spark, sf_dir), "now").select("job", "status")


@query(
    J
    + """, n AS (SELECT job, created_at, status, nullif(json_extract_string(config, '$.requested_name'), '') AS r, nullif(json_extract_string(config, '$.job_name'), '') AS b FROM j WHERE job % 50 = 0 OR translation_id IN ('3', '7', '12'))
SELECT o.job, c.job AS candidate FROM n o JOIN n c ON coalesce(o.r, o.b) = coalesce(c.r, c.b) AND c.status = 'completed' AND (c.created_at > o.created_at OR (c.created_at = o.created_at AND c.job > o.job))""".replace("WHERE job % 50 = 0 OR translation_id IN ('3', '7', '12')", "")
)
def j02_later_same_name(spark, sf_dir):
    return jobs.later_same_name(job_rows(spark, sf_dir))


@query(J + ", u AS (SELECT DISTINCT l_orderkey AS job FROM lineitem WHERE l_quantity > 49) SELECT DISTINCT job, status FROM j WHERE status IN ('running', 'processing', 'queued', 'pricing_wait', 'paused', 'error') OR job IN (SELECT job FROM u)")
def j18_active_or_used(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("job"))
    return jobs.active_or_used(job_rows(spark, sf_dir), used).select("job", "status")


@query(
    J
    + """, n AS (SELECT job, chunk_index, concat('new ', chunk_index) AS original, 'again' AS translated, 'completed' AS status, chunk_index + 10 AS version FROM h WHERE job % 4 = 0 AND chunk_index % 2 = 0 UNION ALL SELECT job, 77, 'extra', NULL, 'failed', 1 FROM j WHERE job % 10 = 0),
b AS (SELECT job, chunk_index, original, translated, status, tokens - 1000 AS version, 0 AS new FROM h UNION ALL SELECT *, 1 FROM n)
SELECT DISTINCT job, chunk_index, translated FROM b QUALIFY row_number() OVER (PARTITION BY job, chunk_index ORDER BY version DESC, new DESC, original DESC) = 1"""
)
def d02_saved_chunks(spark, sf_dir):
    old = chunk_rows(spark, sf_dir).selectExpr("job", "chunk_index", "original", "translated", "status", "int(tokens) - 1000 AS version")
    old = old.groupBy("job", "chunk_index").agg(F.max_by(F.struct("original", "translated", "status", "version"), F.struct("version", "original")).alias("r")).select("job", "chunk_index", "r.*")
    again = old.where("job % 4 = 0 and chunk_index % 2 = 0").selectExpr("job", "chunk_index", "concat('new ', chunk_index) AS original", "'again' AS translated", "'completed' AS status", "int(chunk_index) + 10 AS version")
    extra = job_rows(spark, sf_dir).where("job % 10 = 0").selectExpr("job", "77L AS chunk_index", "'extra' AS original", "string(null) AS translated", "'failed' AS status", "1 AS version")
    return jobs.saved(old, again.unionByName(extra), ["job", "chunk_index"], "version").select("job", "chunk_index", "translated")


MARKED = "(job + chunk_index) % 5 = 0"


@query(J + f"SELECT job, chunk_index, CASE WHEN {MARKED} THEN NULL ELSE translated END AS translated, CASE WHEN {MARKED} AND translated <> '' THEN translated END AS rejected, CASE WHEN {MARKED} THEN 'failed' ELSE status END AS status FROM h")
def d03_marked_for_repair(spark, sf_dir):
    h = chunk_rows(spark, sf_dir)
    return jobs.marked_for_repair(h, h.where(MARKED)).select("job", "chunk_index", "translated", "rejected", "status")


@query(
    J
    + f""", m AS (SELECT job, CASE WHEN {MARKED} THEN NULL ELSE translated END AS t, CASE WHEN {MARKED} THEN 'failed' ELSE status END AS s FROM h), n AS (SELECT job, count_if(s = 'completed' AND t IS NOT NULL) AS completed_chunks, count_if(s = 'failed') AS failed_chunks FROM m GROUP BY 1)
SELECT job, CASE WHEN status IN ('running', 'processing', 'validating', 'completed', 'partial') THEN 'partial' ELSE status END AS status, coalesce(completed_chunks, 0) AS completed_chunks, coalesce(failed_chunks, 0) AS failed_chunks FROM j LEFT JOIN n USING (job)"""
)
def g32_totals_after_repair(spark, sf_dir):
    h = chunk_rows(spark, sf_dir)
    return jobs.after_repair(job_rows(spark, sf_dir), jobs.chunk_totals(jobs.marked_for_repair(h, h.where(MARKED)))).select("job", "status", "completed_chunks", "failed_chunks")


@query(J + "SELECT job, count(*) AS chunks, CAST(coalesce(sum(length(original)), 0) AS BIGINT) AS original_chars, CAST(coalesce(sum(length(translated)), 0) AS BIGINT) AS translated_chars FROM h WHERE status = 'completed' GROUP BY 1")
def g33_completed_sizes(spark, sf_dir):
    return jobs.completed_sizes(chunk_rows(spark, sf_dir))


@query(J + ", s AS (SELECT job, sum(CASE WHEN status = 'completed' THEN tokens ELSE 0 END) AS t, sum(tokens) AS n, CAST(sum(CASE WHEN status = 'completed' THEN seconds ELSE 0 END) AS DOUBLE) AS s FROM h GROUP BY 1) SELECT job, round(coalesce(100.0::DOUBLE * t / nullif(n, 0), 0), 4) AS percent, round(t / nullif(s, 0), 4) AS rate, (n - t) * s / nullif(t, 0) AS seconds_left FROM s")
def y25_progress(spark, sf_dir):
    return jobs.progress(chunk_rows(spark, sf_dir).withColumn("done", F.col("status") == "completed"))


# Terms: parts as glossary terms (brand as glossary) --------------------------------------------------------------------

TERM = "SELECT p_brand AS glossary, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE ' ' || p_type || ' ' END AS source, p_name AS translated, p_partkey AS ord FROM part"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_brand AS glossary", "CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE concat(' ', p_type, ' ') END AS source", "p_name AS translated", "p_partkey AS ord")


@query(
    f"""WITH t AS ({TERM}), o AS (SELECT DISTINCT glossary, trim(source) AS source FROM t WHERE ord % 40 = 1), n AS (SELECT glossary, trim(source) AS source, ord FROM t WHERE ord % 40 <> 1),
a AS (SELECT glossary, count(DISTINCT source) AS added FROM n WHERE source <> '' AND (glossary, source) NOT IN (SELECT (glossary, source) FROM o) GROUP BY 1),
g AS (SELECT glossary, count(*) AS given, count_if(source = '') AS skipped_empty FROM n GROUP BY 1)
SELECT glossary, coalesce(added, 0) AS added, given - coalesce(added, 0) - skipped_empty AS conflicts, skipped_empty FROM g LEFT JOIN a USING (glossary)"""
)
def d11_added_terms(spark, sf_dir):
    t = _terms(spark, sf_dir)
    old = t.where("ord % 40 = 1").withColumn("source", F.trim("source"))
    return jobs.added_terms(old, t.where("ord % 40 <> 1"), "ord")[1]


@query(
    f"""WITH t AS ({TERM}), n AS (SELECT glossary, trim(source) AS source, ord FROM t WHERE ord % 3 = 0 AND glossary > 'Brand#3'), k AS (SELECT glossary, source, ord FROM n WHERE source <> '' QUALIFY row_number() OVER (PARTITION BY glossary, source ORDER BY ord) = 1),
o AS (SELECT glossary, source, ord FROM t WHERE ord % 3 <> 0 AND glossary NOT IN (SELECT glossary FROM n)) SELECT * FROM k UNION ALL SELECT * FROM o"""
)
def d12_replaced_terms(spark, sf_dir):
    t = _terms(spark, sf_dir)
    return jobs.replaced_terms(t.where("ord % 3 <> 0"), t.where("ord % 3 = 0 and glossary > 'Brand#3'"), "ord")[0].select("glossary", "source", "ord")


@query("SELECT 900 AS glossary, n_name AS source FROM nation WHERE n_regionkey = 1")
def d13_copied_glossary(spark, sf_dir):
    names = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("").alias("source_language"), F.lit(None).cast("string").alias("target_language"))
    terms = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("glossary"), F.col("n_name").alias("source"))
    first = names.where("id = 1").select("name")  # the name of one region
    return jobs.copied_glossary(names, terms, first.first()["name"], 900)[1].select(F.col("glossary").cast("int").alias("glossary"), "source")


# Budgets: orders as reservations, customers as scopes -------------------------------------------------------------------

HELD = "SELECT o_orderkey AS reservation, o_custkey % 40 AS scope, CAST(ceil(o_totalprice) AS BIGINT) AS upper, CASE WHEN o_orderkey % 5 < 2 THEN CAST(floor(o_totalprice * (o_orderkey % 3 + 1) / 2) AS BIGINT) END AS actual, CASE o_orderkey % 5 WHEN 0 THEN 'settled' WHEN 1 THEN 'overrun' WHEN 2 THEN 'uncertain' ELSE 'reserved' END AS state FROM orders"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS reservation", "o_custkey % 40 AS scope", "CAST(ceil(o_totalprice) AS BIGINT) AS upper", "CASE WHEN o_orderkey % 5 < 2 THEN CAST(floor(o_totalprice * (o_orderkey % 3 + 1) / 2) AS BIGINT) END AS actual", "CASE o_orderkey % 5 WHEN 0 THEN 'settled' WHEN 1 THEN 'overrun' WHEN 2 THEN 'uncertain' ELSE 'reserved' END AS state")


@query(
    f"WITH r AS ({HELD}) SELECT scope, count(*) AS calls, CAST(sum(CASE WHEN state IN ('settled', 'overrun') THEN actual ELSE upper END) AS BIGINT) AS committed, CAST(sum(CASE WHEN state IN ('settled', 'overrun') THEN actual ELSE 0 END) AS BIGINT) AS settled, CAST(sum(CASE WHEN state IN ('reserved', 'uncertain') THEN upper ELSE 0 END) AS BIGINT) AS reserved, count_if(state = 'uncertain') AS uncertain_calls, count_if(state = 'overrun') AS overruns FROM r GROUP BY 1"
)
def j03_budget_usage(spark, sf_dir):
    held = _held(spark, sf_dir)
    return jobs.budget_usage(held.drop("scope"), held.select("reservation", "scope"))


@query(
    f"WITH r AS ({HELD}), s AS (SELECT reservation, CASE WHEN reservation % 7 = 0 THEN NULL ELSE upper + reservation % 11 - 5 END AS paid FROM r WHERE reservation % 2 = 0) SELECT reservation, CASE WHEN s.reservation IS NOT NULL AND state NOT IN ('settled', 'overrun') THEN paid ELSE actual END AS actual, CASE WHEN s.reservation IS NULL OR state IN ('settled', 'overrun') THEN state WHEN paid IS NULL THEN 'uncertain' WHEN paid > upper THEN 'overrun' ELSE 'settled' END AS state FROM r LEFT JOIN s USING (reservation)"
)
def d09_settled(spark, sf_dir):
    held = _held(spark, sf_dir)
    told = held.where("reservation % 2 = 0").selectExpr("reservation", "CASE WHEN reservation % 7 = 0 THEN NULL ELSE upper + reservation % 11 - 5 END AS paid")
    return jobs.settled(held, told).select("reservation", "actual", "state")


@query(
    """WITH RECURSIVE q AS (SELECT o_custkey % 40 AS scope, o_orderkey AS request, CAST(ceil(o_totalprice) AS BIGINT) AS upper, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT scope, CASE WHEN scope = 39 THEN NULL ELSE 3000000 + scope * 100000 END AS most, 30 + scope AS calls FROM (SELECT unnest(range(0, 40)) AS scope)),
f AS (SELECT q.scope, 0::BIGINT AS request, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS done, '' AS verdict FROM q WHERE n = 1
  UNION ALL SELECT f.scope, q.request, q.n, CASE WHEN most IS NOT NULL AND f.done < calls AND f.used + upper <= most THEN f.used + upper ELSE f.used END, CASE WHEN most IS NOT NULL AND f.done < calls AND f.used + upper <= most THEN f.done + 1 ELSE f.done END,
    CASE WHEN most IS NULL THEN 'budget_configuration' WHEN f.done >= calls THEN 'call_budget_exhausted' WHEN f.used + upper > most THEN 'insufficient_budget' ELSE 'admitted' END
  FROM f JOIN q ON q.scope = f.scope AND q.n = f.n + 1 JOIN b ON b.scope = f.scope)
SELECT scope, request, verdict FROM f WHERE n > 0"""
)
def d08_admitted(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey % 40 AS scope", "o_orderkey AS request", "o_orderkey AS ord", "CAST(ceil(o_totalprice) AS BIGINT) AS upper")
    scopes = spark.range(40).selectExpr("id AS scope", "CASE WHEN id = 39 THEN NULL ELSE 3000000 + id * 100000 END AS most", "30 + id AS max_calls")
    return jobs.admitted(asked, scopes, "ord")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,4)) * 10000 AS BIGINT) * 100000 AS upper_nusd FROM orders")
def d10_nano_dollars(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", jobs.nano(F.col("o_totalprice").cast("decimal(18,4)")).alias("upper_nusd"))

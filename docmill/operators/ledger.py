"""Usage ledger: totals, breakdowns, recent windows, shares, rates, projections and prices.

Every breakdown is one aggregate with map-side combining; top lists are ordered and limited by Spark's top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")
#: Seconds of the recent window.
RECENT = 300


def filled(*names: str, default: str | None = None) -> Column:
    """The first of some columns that is neither null nor empty."""
    found = [F.nullif(F.col(n), F.lit("")) for n in names]
    return F.coalesce(*found, *([F.lit(default)] if default is not None else []))


def _sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]


def _usage() -> list[Column]:
    return [F.count("*").alias("calls"), *_sums(*TOKENS), F.round(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd")]


def totals(events: DataFrame) -> DataFrame:
    return events.agg(*_usage(), F.count_if(F.col("status") != "ok").alias("failed_calls"))


def by_keys(events: DataFrame, *keys: Column | str) -> DataFrame:
    return events.groupBy(*keys).agg(*_usage())


def by_phase(events: DataFrame) -> DataFrame:
    return by_keys(events, filled("phase", "process_type", default="unknown").alias("phase"), filled("process_type", default="unknown").alias("process_type"))


def by_translation(events: DataFrame) -> DataFrame:
    known = events.where("translation_id is not null and translation_id <> ''")
    return known.groupBy("translation_id").agg(*_usage(), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def recent_by_translation(events: DataFrame, seconds: int = RECENT) -> DataFrame:
    """Usage of the seconds before the ledger's last event."""
    last = events.agg((F.max("created_at") - F.expr(f"interval {seconds} seconds")).alias("cutoff"))
    return by_translation(events.join(F.broadcast(last), events["created_at"] >= F.col("cutoff")))  # one row


def recent_rates(recent: DataFrame, seconds: int = RECENT) -> DataFrame:
    per = lambda c, s: F.round(F.col(c) * (s / seconds), 6)
    return recent.select("translation_id", per("calls", 60).alias("calls_per_minute"), per("total_tokens", 60).alias("tokens_per_minute"), per("total_cost_usd", 3600).alias("cost_per_hour"))


def daily(events: DataFrame) -> DataFrame:
    return by_keys(events, F.to_date("created_at").alias("day"))


def phase_shares(events: DataFrame) -> DataFrame:
    """Each phase's share of its translation's tokens and cost, in percent."""
    phases = by_keys(events.where("translation_id is not null and translation_id <> ''"), "translation_id", filled("phase", "process_type", default="unknown").alias("phase"))
    whole = W.partitionBy("translation_id")
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.sum(c).over(whole)), F.lit(0.0)), 4)
    return phases.select("translation_id", "phase", "calls", share("total_tokens").alias("token_share"), share("total_cost_usd").alias("cost_share"))


def latest_events(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(max(1, min(1000, limit))).select("event_id", "translation_id", "phase", "status", "total_tokens")


def call_cost(prompt: Column, completion: Column, hit: Column, miss: Column, price_in: float, price_hit: float, price_out: float) -> Column:
    """Dollars of a call: cached prompt tokens at their own price, unreported ones as missed; prices are per million."""
    zero = F.lit(0)
    prompt, completion = F.greatest(zero, prompt), F.greatest(zero, completion)
    hit = F.least(F.greatest(zero, hit), prompt)
    missed = F.least(F.greatest(zero, miss), prompt - hit)
    rest = prompt - hit - missed
    return (hit * price_hit + (missed + rest) * price_in + completion * price_out) / 1e6


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(3.7))).cast("long")


def backoff_delay(attempt: Column, first: float, factor: float, most: float, exponential: bool = True) -> Column:
    grown = F.lit(first) * F.pow(F.lit(factor), attempt - 1) if exponential else F.lit(first) * attempt
    return F.least(grown, F.lit(most))


def budget_snapshot(scopes: DataFrame, reservations: DataFrame) -> DataFrame:
    """Of scopes (scope_id, limit_nusd) and reservations (scope_id, upper_nusd, actual_nusd, state): what is used,
    reserved and available, in whole nano-dollars."""
    used = F.sum(F.when(F.col("state") == "settled", F.col("actual_nusd")).otherwise(0))
    held = F.sum(F.when(F.col("state") == "reserved", F.col("upper_nusd")).otherwise(0))
    sums = reservations.groupBy("scope_id").agg(used.alias("used_nusd"), held.alias("reserved_nusd"), F.count("*").alias("calls"))
    out = scopes.join(sums, "scope_id", "left").select("scope_id", "limit_nusd", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used_nusd", "reserved_nusd", "calls")])
    return out.withColumn("available_nusd", F.greatest(F.lit(0), F.col("limit_nusd") - F.col("used_nusd") - F.col("reserved_nusd")))


# Whole breakdowns -----------------------------------------------------------------------------------------------------

COUNTED = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_hit_tokens", "cache_miss_tokens")
PRICED = ("input_cost_usd", "output_cost_usd", "total_cost_usd")
#: Fixed value: the name of what has none.
NO_BOOK = "Sin libro"


def whole_usage(*costs: str) -> list[Column]:
    """Calls, tokens of each kind, costs and estimated calls of a group."""
    money = [F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6).alias(c) for c in costs]
    return [F.count("*").alias("calls"), *_sums(*COUNTED), *money, F.coalesce(F.sum("estimated"), F.lit(0)).cast("long").alias("estimated_events")]


def whole_totals(events: DataFrame) -> DataFrame:
    return events.agg(*whole_usage(*PRICED), F.count_if(F.col("pricing_source").isin("unknown", "usage_unknown")).alias("unknown_cost_events"))


def book_name(*more: str) -> Column:
    """The first name that a call has: of its book, its input, its output, or else of what it belongs to."""
    return F.coalesce(filled("book_name", "input_filename", "output_filename"), *map(F.col, more), F.lit(NO_BOOK))


def by_book(events: DataFrame) -> DataFrame:
    keyed = events.withColumn("book_name", book_name("translation_id", "process_id"))
    return keyed.groupBy("book_name", "translation_id", "process_type").agg(*whole_usage("total_cost_usd"), F.max("created_at").alias("last_seen"))


def by_process(events: DataFrame) -> DataFrame:
    return events.groupBy("process_type").agg(*whole_usage("total_cost_usd"))


def by_model(events: DataFrame) -> DataFrame:
    return events.groupBy("provider", "model").agg(*whole_usage("total_cost_usd"))


def of_translations(events: DataFrame) -> DataFrame:
    return events.where("translation_id is not null and translation_id <> ''")


def by_translation_whole(events: DataFrame) -> DataFrame:
    """Per translation its usage, with the names of its latest call (of calls at once, the one of the greatest id)."""
    named = of_translations(events).withColumns({"book_name": book_name("translation_id"), "process_type": filled("process_type", default="unknown")})
    last = F.max_by(F.struct("book_name", "process_type"), F.struct("created_at", "event_id"))
    return named.groupBy("translation_id").agg(*whole_usage(*PRICED), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), last.alias("names")).select("*", "names.*").drop("names")


def by_translation_and_phase(events: DataFrame) -> DataFrame:
    phase, process = filled("phase", "process_type", default="unknown").alias("phase"), filled("process_type", default="unknown").alias("process_type")
    return of_translations(events).groupBy("translation_id", phase, process).agg(*whole_usage("total_cost_usd"), F.max("created_at").alias("last_seen"))


def with_shares(phases: DataFrame, key: str = "translation_id") -> DataFrame:
    """Each phase's percent of its translation's tokens and cost, and its share of cached prompt tokens."""
    whole = W.partitionBy(key)
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.when(F.sum(c).over(whole) > 0, F.sum(c).over(whole))), F.lit(0.0)), 4)
    hit = F.coalesce(F.try_divide(F.col("cache_hit_tokens"), F.col("cache_hit_tokens") + F.col("cache_miss_tokens")), F.lit(0.0))
    return phases.withColumns({"token_share_pct": share("total_tokens"), "cost_share_pct": share("total_cost_usd"), "cache_hit_ratio": F.round(hit, 6)})


def projection() -> dict[str, Column]:
    """What a job will cost: by its percent of progress from 1 on, else by its share of chunks, else unknown (0)."""
    cost, tokens = F.col("total_cost_usd"), F.col("total_tokens")
    counted = F.coalesce(F.col("completed_chunks"), F.lit(0)) + F.coalesce(F.col("failed_chunks"), F.lit(0))
    done = F.when(counted > 0, counted).otherwise(F.greatest(F.lit(0), F.coalesce(F.col("chunk_index"), F.lit(-1)) + 1))
    part = F.when((F.col("percent") >= 1) & (cost > 0), F.col("percent") / 100).when((F.col("total_chunks") > 0) & (done > 0) & (cost > 0), done / F.col("total_chunks"))
    per = lambda x, n: F.when((n > 0) & (x > 0), x / n).otherwise(0.0)
    whole_cost, whole_tokens = F.coalesce(cost / part, F.lit(0.0)), F.when(tokens > 0, F.coalesce(tokens / part, F.lit(0.0))).otherwise(0.0)
    basis = F.when((F.col("percent") >= 1) & (cost > 0), "progress_percent").when(part.isNotNull(), "chunk_ratio").otherwise("")
    return {
        "processed_chunks": done.cast("long"),
        "cost_per_chunk": F.round(per(cost, done), 6),
        "tokens_per_chunk": F.round(per(tokens, done), 6),
        "cost_per_1k": F.round(per(cost, tokens) * 1000, 6),
        "projected_cost": F.round(whole_cost, 4),
        "remaining_cost": F.round(F.greatest(F.lit(0.0), F.when(whole_cost > 0, whole_cost - cost).otherwise(0.0)), 4),
        "projected_tokens": F.round(whole_tokens, 4),
        "remaining_tokens": F.round(F.greatest(F.lit(0.0), F.when(whole_tokens > 0, whole_tokens - tokens).otherwise(0.0)), 4),
        "basis": basis,
    }


def live_jobs(jobs: DataFrame, usage: DataFrame, recent: DataFrame, now: Column, seconds: int = RECENT, fresh: int = 900) -> DataFrame:
    """Active jobs, and translations without a job whose last call is fresh: usage, rates of the recent window, and
    projections. Full outer joins on the id; no side is broadcast."""
    both = jobs.join(usage, "translation_id", "full_outer").join(recent.select("translation_id", F.col("calls").alias("recent_calls"), F.col("total_tokens").alias("recent_tokens"), F.col("total_cost_usd").alias("recent_cost")), "translation_id", "left")
    active = F.when(F.col("status").isNotNull(), F.col("is_active")).otherwise(F.coalesce(F.col("last_seen") >= now - F.expr(f"interval {fresh} seconds"), F.lit(False)))
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("calls", "total_tokens", "total_cost_usd", "recent_calls", "recent_tokens", "recent_cost")}
    out = both.where(active).withColumns(numbers)
    out = out.withColumns({"tokens_per_minute": F.round(F.col("recent_tokens") / F.lit(seconds / 60), 6), "cost_per_minute": F.round(F.col("recent_cost") / F.lit(seconds / 60), 6)})
    return out.withColumns(projection())


# Recording ------------------------------------------------------------------------------------------------------------


def recorded(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls as they go into the ledger. Tokens that a successful or estimated call does not tell are estimated from its
    texts; the total is at least their sum; costs are by the model's prices (prices per million); usage is unknown when
    it is neither observed nor estimated, or when cached and written tokens exceed the prompt's. Works on streams."""
    prompt_text = F.trim(F.concat_ws("\n", F.coalesce("system_prompt", F.lit("")), F.coalesce("prompt", F.lit(""))), F.lit(" \n\t\r"))
    may = (F.col("status") == "ok") | F.col("status").startswith("estimated")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    guess_in = may & (n("prompt_tokens") == 0)
    guess_out = may & (n("completion_tokens") == 0) & (F.coalesce(F.col("response"), F.lit("")) != "")
    rows = calls.withColumns({"_text": prompt_text, "_in": guess_in, "_out": guess_out, "_told": (n("prompt_tokens") > 0) | (n("completion_tokens") > 0)})
    rows = rows.withColumns({
        "prompt_tokens": F.when(F.col("_in"), estimated_tokens(F.col("_text"))).otherwise(n("prompt_tokens")),
        "completion_tokens": F.when(F.col("_out"), estimated_tokens(F.col("response"))).otherwise(n("completion_tokens")),
        "estimated": (F.col("status").startswith("estimated") | F.col("_in") | F.col("_out")).cast("int"),
    })
    hit, miss, written = n("cache_hit_tokens"), n("cache_miss_tokens"), n("cache_written_tokens")
    observed = (F.col("prompt_tokens") + F.col("completion_tokens") > 0) & (F.col("estimated") == 0)
    unknown = (~observed & (F.col("estimated") == 0)) | (written + hit > F.col("prompt_tokens"))
    rows = rows.join(prices, ["provider", "model"], "left")
    zero = F.lit(0)
    cached = F.least(F.greatest(zero, hit), F.col("prompt_tokens"))
    stored = F.least(F.greatest(zero, written), F.col("prompt_tokens") - cached)
    missed = F.col("prompt_tokens") - cached - stored
    into = (cached * F.col("price_hit") + stored * F.col("price_written") + missed * F.col("price_in")) / 1e6
    out = F.col("completion_tokens") * F.col("price_out") / 1e6
    cost = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    return rows.select(
        "event_id", "created_at", F.lower("provider").alias("provider"), "model", "status", "estimated", "prompt_tokens", "completion_tokens",
        F.greatest(n("total_tokens"), F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        filled("process_type", default="unknown").alias("process_type"), filled("phase", default="llm_call").alias("phase"),
        F.length("_text").alias("prompt_chars"), F.length(F.coalesce("response", F.lit(""))).alias("completion_chars"),
        cost(into).alias("input_cost_usd"), cost(out).alias("output_cost_usd"), cost(into + out).alias("total_cost_usd"),
        F.when(unknown, "usage_unknown").when(F.col("price_in").isNull(), "unknown").otherwise("table").alias("pricing_source"),
        F.when(unknown | F.col("price_in").isNull(), "unknown").when(F.col("estimated") == 1, "estimated").otherwise("provider_usage").alias("cost_basis"),
        F.sha2("_text", 256).alias("prompt_hash"), F.sha2(F.coalesce("response", F.lit("")), 256).alias("response_hash"),
    )


def without_unbillable(events: DataFrame) -> DataFrame:
    """Events whose estimates were never billed (failed or empty calls without any reported usage) with nothing."""
    failed = F.col("status").isin("error", "empty_response")
    hollow = failed & (F.col("estimated") == 1) & (F.col("completion_tokens") == 0) & (F.col("cache_hit_tokens") == 0) & (F.col("cache_miss_tokens") == 0)
    zeroed = {c: F.when(hollow, F.lit(0)).otherwise(F.col(c)) for c in ("prompt_tokens", "completion_tokens", "total_tokens", *PRICED, "estimated")}
    out = events.withColumn("_hollow", hollow).withColumns({c: F.when(F.col("_hollow"), F.lit(0)).otherwise(F.col(c)) for c in zeroed})
    unbilled = F.col("_hollow") | ((F.col("pricing_source") == "not_billed") & failed & (F.col("total_tokens") == 0))
    return out.withColumn("pricing_source", F.when(unbilled, "usage_unknown").otherwise(F.col("pricing_source"))).drop("_hollow")


def repriced(events: DataFrame, provider: str, since: Column, peak: Column, prices: DataFrame) -> DataFrame:
    """Events with the successful ones of a provider, since a time, priced anew by tier (peak or off_peak). prices: a row
    a model and tier."""
    due = (F.col("provider") == provider) & (F.col("status") == "ok") & (F.col("created_at") >= since)
    rows = events.withColumn("tier", F.when(due, F.when(peak, "peak").otherwise("off_peak"))).join(prices, ["model", "tier"], "left")
    hit = F.least(F.greatest(F.lit(0), F.col("cache_hit_tokens")), F.col("prompt_tokens"))
    into = (hit * F.col("price_hit") + (F.col("prompt_tokens") - hit) * F.col("price_in")) / 1e6
    total = into + F.col("completion_tokens") * F.col("price_out") / 1e6
    known = F.col("price_in").isNotNull()
    return rows.select("event_id", F.round(F.when(known, total).otherwise(F.col("total_cost_usd")), 9).alias("total_cost_usd"), F.when(known, F.concat(F.lit("schedule_"), F.col("tier"))).otherwise(F.col("pricing_source")).alias("pricing_source"))


def filtered_events(events: DataFrame, limit: int, translation: str | None = None, process: str | None = None) -> DataFrame:
    """The latest events, at most 1,000, of a translation and a process where they are named."""
    for name, value in (("translation_id", translation), ("process_id", process)):
        if value:
            events = events.where(F.col(name) == value)
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(max(1, min(limit or 200, 1000)))


def estimate(chunks: DataFrame, ratio: Column, passes: int, price_in: float, price_out: float, cached: float = 0.0, overhead: int = 0) -> DataFrame:
    """(chunks, tokens in and out, cost) of a job per document: tokens of its chunks times passes, an output ratio by
    languages, and a share of cached input that costs nothing."""
    sums = chunks.groupBy("doc").agg(F.count("*").alias("chunks"), F.sum(F.col("n_tokens") + overhead).alias("input"), F.sum(F.col("n_tokens") * ratio).alias("output"))
    return sums.select("doc", "chunks", (F.col("input") * passes).alias("input_tokens"), F.ceil(F.round(F.col("output") * passes, 6)).alias("output_tokens"), F.round((F.col("input") * passes * (1 - cached) * price_in + F.col("output") * passes * price_out) / 1e6, 4).alias("cost_usd"))

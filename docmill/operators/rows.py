"""Ordered and keyed row operators: latest per key, first wins, prefixes, identity checks, state over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _extreme(rows: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    """One row a key by an aggregate that combines before the shuffle, so no key's rows meet; keys may be null."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    kept = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert as compaction: the last row of each key by the order's columns (null sorts first)."""
    return _extreme(rows, keys, order, last=True)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return _extreme(rows, keys, order, last=False)


def insert_absent(new: DataFrame, old: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Rows of new whose key, trimmed and in small letters, old lacks; of several, the first. Blank keys are none."""
    folded = F.lower(F.trim(key))
    seen = old.select(folded.alias("_seen")).where("_seen <> ''").distinct()
    kept = new.withColumn("_key", folded).where("_key <> ''").join(seen, F.col("_key") == F.col("_seen"), "left_anti")
    return first_wins(kept, ["_key"], order).drop("_key")


def completed_prefix(chunks: DataFrame, job: str, index: str, done: Column) -> DataFrame:
    """How many chunks of each job are done without a gap, from index 0."""
    w = W.partitionBy(job).orderBy(index)
    whole = chunks.withColumn("_ok", done & (F.col(index) == F.row_number().over(w) - 1))
    whole = whole.withColumn("_all", F.min(F.col("_ok").cast("int")).over(w))
    return whole.groupBy(job).agg(F.sum("_all").cast("long").alias("prefix"), F.count("*").alias("chunks"))


def missing_chunks(jobs: DataFrame, chunks: DataFrame, job: str, index: str, total: str) -> DataFrame:
    """Per job, how many indices under its total have no completed chunk."""
    wanted = jobs.where(F.col(total) > 0).select(job, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1)).alias(index))
    return wanted.join(chunks.select(job, index).distinct(), [job, index], "left_anti").groupBy(job).agg(F.count("*").alias("missing"))


def identity_issues(units: DataFrame, document: str, unit: str, order: str) -> DataFrame:
    """Documents whose units repeat an id or are not numbered 0, 1, 2, ..."""
    out = units.groupBy(document).agg(F.count("*").alias("units"), F.count_distinct(unit).alias("ids"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.count_distinct(order).alias("places"))
    return out.select(document, "units", (F.col("ids") < F.col("units")).alias("duplicate_unit_id"), ((F.col("lo") != 0) | (F.col("hi") != F.col("units") - 1) | (F.col("places") != F.col("units"))).alias("non_contiguous_order"))


def duplicate_outputs(units: DataFrame, unit: str, source: Column, target: Column, least: int = 100) -> DataFrame:
    """Units whose long normalised output first stood for another source. Outputs are known by a digest, and their first
    holders come from an aggregate, so neither texts nor the units of one output meet in a task."""
    norm = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(target, F.lit("")), r"[\s\x{00A0}]+", " "), "^ | $", ""))
    rows = units.select(unit, norm.alias("_norm"), F.sha2(F.coalesce(source.cast("string"), F.lit("")), 256).alias("_source")).where(F.length("_norm") >= least).select(unit, F.sha2("_norm", 256).alias("_digest"), "_source")
    firsts = rows.groupBy("_digest").agg(F.min_by(F.struct(F.col(unit).alias("holder"), F.col("_source").alias("_first")), unit).alias("f"), F.count("*").alias("n")).where("n > 1").select("_digest", "f.*")
    return rows.join(firsts, "_digest").where("_first <> _source").select(unit, "holder")


def carried(rows: DataFrame, document: str, order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value so far, as a heading carries on over what follows it."""
    w = W.partitionBy(document).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def neighbours(rows: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """The last line of the row before and the first line of the row after."""
    w = W.partitionBy(document).orderBy(order)
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    return rows.withColumns({"context_before": F.try_element_at(lines(F.lag(text).over(w)), F.lit(-1)), "context_after": F.try_element_at(lines(F.lead(text).over(w)), F.lit(1))})


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, missing, added): how many more of a value one side has, per key."""
    a = left.groupBy(*keys, value).agg(F.count("*").alias("_a"))
    b = right.groupBy(*keys, value).agg(F.count("*").alias("_b"))
    both = a.join(b, [*keys, value], "full_outer").withColumns({"_a": F.coalesce("_a", F.lit(0)), "_b": F.coalesce("_b", F.lit(0))})
    out = both.select(*keys, value, F.greatest(F.lit(0), F.col("_a") - F.col("_b")).alias("missing"), F.greatest(F.lit(0), F.col("_b") - F.col("_a")).alias("added"))
    return out.where("missing > 0 or added > 0")


def running_progress(rows: DataFrame, job: str, order: str, percent: Column) -> DataFrame:
    """Progress that never falls back."""
    return rows.withColumn("progress", F.max(percent).over(W.partitionBy(job).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))

"""From issues of units to gates and the state of a document, all as aggregates over the table of issues.

Units are rows (document, unit, ord, ...), issues are rows (document, unit, code, severity, gate). Issues without a gate
get that of the first fragment of their code that names one. Defined cases: a document without issues passes; one
without units is blocked; repeated issues count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gates; severities that block; which fragment of a code names which gate, in order; strategies of repair.
GATES = ("extraction", "segmentation", "translation", "language", "entities", "semantics", "structure", "typography", "metadata", "final")
BLOCKING = ("critical", "high", "error", "reject")
FRAGMENTS = (
    ("metadata", "metadata"), ("language", "language"), ("script", "language"), ("entity", "entities"), ("number", "entities"), ("isbn", "entities"), ("url", "entities"),
    ("semantic", "semantics"), ("omission", "semantics"), ("addition", "semantics"), ("negation", "semantics"), ("spacing", "typography"), ("structure", "structure"), ("epub", "structure"),
    ("docx", "structure"), ("srt", "structure"), ("duplicate", "segmentation"), ("order", "segmentation"), ("checksum", "segmentation"), ("source", "extraction"), ("translation", "translation"), ("protocol", "translation"),
)
STRATEGIES = ((("language", "untranslated"), "strict_target_language"), (("entity", "number", "isbn"), "entity_preserving_repair"), (("spacing",), "deterministic_structure_repair"), (("semantic", "negation"), "source_aware_semantic_repair"))
STAGES = ("extraction", "segmentation", "translation", "review", "audit", "approval", "export")


def gate_of(code: Column) -> Column:
    out = F.lit("final")
    for fragment, gate in reversed(FRAGMENTS):
        out = F.when(F.lower(code).contains(fragment), gate).otherwise(out)
    return out


def blocking(severity: Column) -> Column:
    return severity.isin(*BLOCKING)


def manifest_counts(units: DataFrame, document: str = "document") -> DataFrame:
    """Per document: units extracted, translatable, excluded, sent, responded, and how many passed each stage. Stages are
    columns named as they are, of passed, failed or null."""
    sent = F.col("translatable") & F.col("translation").isin("passed", "failed")
    stages = [F.count_if(F.col(s) == "passed").alias(f"passed_{s}") for s in STAGES if s in units.columns]
    return units.groupBy(document).agg(F.count("*").alias("extracted"), F.count_if("translatable").alias("translatable"), F.count_if(~F.col("translatable")).alias("excluded"), F.count_if(sent).alias("sent_to_model"), F.count_if(F.col("translatable") & (F.col("target") != "")).alias("responded"), *stages)


def language_ratios(units: DataFrame, keys: list[str], section_most: float = 0.15, document_most: float = 0.01, least: int = 40) -> DataFrame:
    """Per section and per document (section null): share of checked characters that are in the source language, and
    whether that is too much. units: keys (document, section), chars, checked, is_source."""
    document, section = keys
    sums = [F.sum(F.when(F.col("checked"), F.col("chars")).otherwise(0)).alias("checked_chars"), F.sum(F.when(F.col("checked") & F.col("is_source"), F.col("chars")).otherwise(0)).alias("source_chars")]
    ratio = F.coalesce(F.try_divide(F.col("source_chars").cast("double"), F.col("checked_chars")), F.lit(0.0))
    every = units.groupBy(document, section).agg(*sums)
    # Documents are sums of sections.
    whole = every.groupBy(document).agg(F.sum("checked_chars").alias("checked_chars"), F.sum("source_chars").alias("source_chars")).withColumn(section, F.lit(None).cast(units.schema[section].dataType))
    told = every.withColumn("code", F.when((ratio > section_most) & (F.col("source_chars") >= least), "section_source_language_ratio"))
    told = told.unionByName(whole.withColumn("code", F.when(ratio > document_most, "document_source_language_ratio")))
    return told.select(document, section, "checked_chars", "source_chars", F.round(ratio, 6).alias("ratio"), "code")


def model_usage(units: DataFrame, document: str = "document") -> DataFrame:
    total = F.when(F.col("total_tokens") > 0, F.col("total_tokens")).otherwise(F.col("prompt_tokens") + F.col("completion_tokens"))
    return units.groupBy(document).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("model"), F.lit("")))), ",").alias("models"))


def gate_statuses(counts: DataFrame, issues: DataFrame, warnings: bool = True, document: str = "document") -> DataFrame:
    """(document, gate, status, issues, blocking) of every gate of every document. Coverage itself makes issues: units
    that did not pass translation or approval. counts are manifest_counts."""
    whole = counts.select(
        document,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("extracted") == 0, F.struct(F.lit("extraction").alias("gate"), F.lit("no_units_extracted").alias("code"))),
                    F.when(F.col("passed_translation") != F.col("translatable"), F.struct(F.lit("translation").alias("gate"), F.lit("incomplete_translation_coverage").alias("code"))),
                    F.when(F.col("passed_approval") != F.col("translatable"), F.struct(F.lit("final").alias("gate"), F.lit("unapproved_units").alias("code"))),
                )
            )
        ).alias("i"),
    ).select(document, F.lit(None).cast("string").alias("unit"), "i.code", F.lit("critical").alias("severity"), "i.gate")
    own = issues.select(document, F.col("unit").cast("string").alias("unit"), "code", "severity", F.when(F.col("gate").isin(*GATES), F.col("gate")).otherwise(gate_of(F.col("code"))).alias("gate"))
    # The first of like issues counts; which is first does not matter to what is counted.
    each = own.unionByName(whole).groupBy(document, "gate", "code", "unit").agg(F.max(blocking(F.col("severity"))).alias("blocks"))
    found = each.groupBy(document, "gate").agg(F.count("*").alias("issues"), F.count_if("blocks").alias("blocking"))
    every = counts.select(document, F.explode(F.array(*map(F.lit, GATES))).alias("gate"))
    out = every.join(found, [document, "gate"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("issues", "blocking")})
    status = F.when(F.col("blocking") > 0, "blocked").when(F.col("issues") > 0, "passed_with_warnings" if warnings else "blocked").otherwise("passed")
    return out.withColumn("status", status).select(document, "gate", "status", "issues", "blocking")


def final_status(gates: DataFrame, document: str = "document") -> DataFrame:
    worst = F.max(F.when(F.col("status") == "blocked", 2).when(F.col("status") == "passed_with_warnings", 1).otherwise(0))
    return gates.groupBy(document).agg(worst.alias("w"), F.count_if(F.col("status") == "blocked").alias("blocked_gates"), F.sum("issues").alias("issues")).select(document, F.element_at(F.array(*map(F.lit, ("passed", "passed_with_warnings", "blocked"))), F.col("w") + 1).alias("status"), "blocked_gates", "issues")


def repair_units(units: DataFrame, issues: DataFrame, document: str = "document") -> DataFrame:
    """Units with blocking issues, how many codes, and how to repair them: by the gravest fragment among their codes."""
    held = lambda fragments: F.max(F.greatest(*[F.col("code").contains(f) for f in fragments]) if len(fragments) > 1 else F.col("code").contains(fragments[0]))
    flags = [held(fragments).alias(f"s{k}") for k, (fragments, _) in enumerate(STRATEGIES)]
    found = issues.where(blocking(F.col("severity")) & F.col("unit").isNotNull()).groupBy(document, "unit").agg(F.count_distinct("code").alias("codes"), *flags)
    strategy = F.lit("strict_retranslation")
    for k, (_, name) in reversed(list(enumerate(STRATEGIES))):
        strategy = F.when(F.col(f"s{k}"), name).otherwise(strategy)
    return units.select(document, "unit", "ord").join(found, [document, "unit"]).select(document, "unit", "ord", "codes", strategy.alias("strategy"))


def entity_report(issues: DataFrame) -> DataFrame:
    """How many issues there are of each code, and in how many units."""
    return issues.groupBy("code").agg(F.count("*").alias("issues"), F.count_distinct("unit").alias("units"))


def manifest_identity(units: DataFrame, document: str = "document") -> DataFrame:
    """Per document: codes of what is wrong with its units' ids, order and checksums. units: unit, ord, source, target,
    source_checksum, target_checksum (null where none was stored). One aggregate; no unit meets another."""
    wrong = lambda text, sum_: F.count_if(F.col(sum_).isNotNull() & (F.sha2(F.coalesce(F.col(text), F.lit("")), 256) != F.col(sum_)))
    told = units.groupBy(document).agg(F.count("*").alias("n"), F.count_distinct("unit").alias("ids"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count_distinct("ord").alias("places"), wrong("source", "source_checksum").alias("bad_source"), wrong("target", "target_checksum").alias("bad_target"))
    codes = F.array_compact(F.array(
        F.when(F.col("ids") < F.col("n"), "duplicate_unit_id"),
        F.when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("places") != F.col("n")), "non_contiguous_order"),
        F.when(F.col("bad_source") > 0, "source_checksum_mismatch"),
        F.when(F.col("bad_target") > 0, "target_checksum_mismatch"),
    ))
    return told.select(document, F.array_join(codes, ",").alias("codes"))


def aligned(source: DataFrame, output: DataFrame, document: str = "document", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Blocks of a source with those of its output in the same place (empty where there is none), and per document how
    many more blocks the output has."""
    pairs = source.select(document, order, F.col("text").alias("source")).join(output.select(document, order, F.col("text").alias("target")), [document, order], "left").withColumn("target", F.coalesce("target", F.lit("")))
    a, b = (f.groupBy(document).agg(F.count("*").alias(n)) for f, n in ((source, "n_source"), (output, "n_output")))
    return pairs, a.join(b, document, "left").select(document, (F.coalesce("n_output", F.lit(0)) - F.col("n_source")).alias("surplus"))

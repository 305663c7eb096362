"""Terms of a glossary in texts, and candidates for one.

A term may hold alternatives, parted by `|`. Alternatives that begin and end with word characters match whole words;
others, and those in scripts without blanks, match anywhere. A text meets only the alternatives whose first word it
has, by an equality join; what has no word to join by (few) meets every text.

Defined cases: null and blank texts and terms match nothing; a term that is listed twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docmill.functions.cleaning import folded_letters
from docmill.functions.entities import WORD

#: Scripts without blanks between words; weights of categories; purposes that look at targets, too.
DENSE = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{3400}-\x{4DBF}]"
WEIGHTS = {"character": 1.25, "organization": 1.2, "location": 1.15, "acronym": 1.35, "technical": 1.1, "concept": 1.0, "title": 1.1, "item": 1.0}
TARGET_SIDE = ("refinement", "transform", "transformation", "modernize", "same-language")
#: Rows of terms that no word joins, up to which each text is tested for each.
ODD_TERMS = 10_000


def alternatives(source: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), r"\|"), F.trim), lambda a: a != "")


def longest(source: Column) -> Column:
    """The length of a term's longest alternative, by which terms are ordered."""
    return F.coalesce(F.array_max(F.transform(alternatives(source), F.length)), F.lit(0))


def target_alternatives(target: Column) -> Column:
    """A rendering and the forms that a Spanish-like language makes of a single word: gender, plural."""
    plain = F.trim(F.coalesce(target, F.lit("")))
    words = F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))
    word = F.element_at(words, 1)
    low, stem = F.lower(word), F.substr(word, F.lit(1), F.length(word) - 1)
    forms = (
        F.when(low.rlike("[oó]$") & (F.length(word) > 2), F.array(*[F.concat(stem, F.lit(x)) for x in ("a", "as", "os")]))
        .when(low.rlike("[aeiíuú]$") & (F.length(word) > 2), F.array(F.concat(word, F.lit("s"))))
        .when((F.length(word) > 3) & ~low.rlike("s$") & ~low.rlike("[aeiouíúó]$"), F.array(F.concat(word, F.lit("es"))))
    )
    at = F.instr(plain, word)
    before, after = F.substr(plain, F.lit(1), at - 1), F.substr(plain, at + F.length(word))
    more = F.transform(F.array_sort(forms), lambda w: F.concat(before, w, after))
    one = F.array(plain)
    return F.when(plain == "", F.array().cast("array<string>")).when(F.size(words) != 1, one).otherwise(F.coalesce(F.concat(one, more), one))


def _normal(text: Column, case_sensitive: bool, accents: bool) -> Column:
    out = F.coalesce(text, F.lit("")) if accents else folded_letters(text)
    return out if case_sensitive else F.lower(out)


def _escaped(needle: Column) -> Column:
    return F.regexp_replace(needle, r"([\\.\[\]{}()*+?^$|&\-#])", r"\\$1")


def matched_terms(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, case_sensitive: bool = False, accents: bool = True) -> DataFrame:
    """(id, source, n): how often a text holds each term, by all its alternatives."""
    each = terms.select("source", F.explode(F.array_distinct(F.transform(alternatives(F.col("source")), lambda a: a))).alias("alt")).distinct()
    each = each.select("source", F.col("alt").rlike(DENSE).alias("dense"), _normal(F.col("alt"), case_sensitive, accents).alias("needle")).where("needle <> ''").distinct()
    loose = F.col("dense") | ~(F.col("needle").rlike(rf"^{WORD}") | F.col("needle").rlike(rf"{WORD}$"))
    edge = lambda p, side: F.when(F.col("needle").rlike(p), F.lit(side)).otherwise(F.lit(""))
    pattern = F.when(loose, _escaped(F.col("needle"))).otherwise(F.concat(edge(rf"^{WORD}", rf"(?<!{WORD})"), _escaped(F.col("needle")), edge(rf"{WORD}$", rf"(?!{WORD})")))
    each = each.select("source", "needle", pattern.alias("pattern"), loose.alias("loose"), F.regexp_extract("needle", rf"^({WORD}+)", 1).alias("first"))
    docs = texts.select(F.col(id_col).alias("_id"), _normal(F.col(text_col), case_sensitive, accents).alias("_hay"))
    words = docs.select("_id", F.explode(F.array_distinct(F.regexp_extract_all("_hay", F.lit(rf"{WORD}+"), F.lit(0)))).alias("first"))
    joined = each.where(~F.col("loose") & (F.col("first") != ""))
    met = words.join(joined, "first").select("_id", "source", "needle", "pattern")
    odd = each.where(F.col("loose") | (F.col("first") == ""))
    hay = docs.where("_hay <> ''")
    counted = hay.join(met, "_id").where(F.contains("_hay", F.col("needle")))
    if odd.limit(1).count():
        if odd.limit(ODD_TERMS + 1).count() > ODD_TERMS:
            raise ValueError(f"more than {ODD_TERMS} terms have no word to be joined by")
        counted = counted.unionByName(hay.join(F.broadcast(odd.select("source", "needle", "pattern")), F.contains("_hay", F.col("needle"))))  # ODD_TERMS rows at most
    found = counted.select(F.col("_id").alias(id_col), "source", F.regexp_count("_hay", F.col("pattern")).alias("n"))
    return found.groupBy(id_col, "source").agg(F.sum("n").alias("n")).where("n > 0")


def kept_terms(found: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, source, n, place, capped): of each text at most `most` terms, the most frequent, then the longest; in the order
    of their lengths."""
    many, by_text = W.partitionBy(id_col), found.withColumn("size", longest(F.col("source")))
    ranked = by_text.withColumns({"rank": F.row_number().over(many.orderBy(F.desc("n"), F.desc("size"), "source")), "all": F.count("*").over(many)}).where(F.col("rank") <= most)
    return ranked.select(id_col, "source", "n", F.row_number().over(many.orderBy(F.desc("size"), "source")).alias("place"), (F.col("all") > most).alias("capped"))


def terms_for(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, purpose: str = "translation") -> DataFrame:
    """(id, source): terms that a text holds; for some purposes also those whose rendering it holds, in any form."""
    found = matched_terms(texts, terms, id_col, text_col).select(id_col, "source")
    if purpose.strip().lower() not in TARGET_SIDE:
        return found
    sides = terms.where((F.trim("source") != "") & (F.trim("target") != "")).select(F.col("source").alias("_source"), F.array_join(target_alternatives(F.col("target")), "|").alias("source"))
    more = matched_terms(texts, sides.select("source").distinct(), id_col, text_col).join(sides, "source").select(id_col, F.col("_source").alias("source"))
    return found.unionByName(more).distinct()


def candidate_score(category: Column, occurrences: Column, source: Column) -> Column:
    weight = F.lit(1.0)
    for name, w in WEIGHTS.items():
        weight = F.when(category == name, w).otherwise(weight)
    return occurrences * weight + F.least(F.length(source), F.lit(40)) / 80.0


def candidate_confidence(score: Column, occurrences: Column, category: Column) -> Column:
    base = 1.0 - F.exp(-F.greatest(occurrences, F.lit(0)) / 4.0) + F.when(category.isin("acronym", "technical"), 0.08).otherwise(0.0)
    return F.greatest(F.lit(0.15), F.least(F.lit(0.98), base + F.least(score, F.lit(10.0)) / 80.0))


def pattern_counts(texts: DataFrame, pattern: str, id_col: str, text_col: str, least: int = 2, lowered: bool = False) -> DataFrame:
    """(term, occurrences, texts): how often what a pattern matches stands in all texts, by one aggregate."""
    found = texts.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("term"))
    term = F.lower("term") if lowered else F.col("term")
    return found.select(id_col, term.alias("term")).where(F.length("term") >= least).groupBy("term").agg(F.count("*").alias("occurrences"), F.count_distinct(id_col).alias("texts"))


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """Of candidates (source, category, occurrences) that differ in case alone the one of the highest score, then the
    longest; with its confidence."""
    scored = candidates.withColumn("score", candidate_score(F.col("category"), F.col("occurrences"), F.col("source")))
    best = F.max_by(F.struct("source", "category", "occurrences", "score"), F.struct("score", F.length("source"), "source"))
    out = scored.groupBy(F.lower("source").alias("key")).agg(best.alias("b")).select("b.*")
    return out.withColumn("confidence", candidate_confidence(F.col("score"), F.col("occurrences"), F.col("category")))


def corrected(text: Column, old: str, new: str, case_sensitive: bool = True) -> tuple[Column, Column]:
    """A text with a rendering replaced where it stands as whole words, and how often."""
    import re

    edges = (r"(?<![\p{L}\p{N}_])" if re.match(r"\w", old) else "", r"(?![\p{L}\p{N}_])" if re.match(r"\w", old[-1:]) else "")
    pattern = ("" if case_sensitive else "(?iu)") + edges[0] + "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in old) + edges[1]
    if not old or old == new:
        return text, F.lit(0)
    return F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$")), F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def name_variants(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, spellings): capitalised names that a text spells in two ways or more, but for case and marks."""
    names = texts.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(r"\p{Lu}[\p{L}]{2,}"), F.lit(0))).alias("name")).distinct()
    keyed = names.withColumn("key", F.lower(folded_letters(F.col("name"))))
    return keyed.groupBy(id_col, "key").agg(F.array_sort(F.collect_set("name")).alias("spellings")).where("size(spellings) >= 2")

"""What a pair of texts (source and candidate, draft and refined) shows: codes of issues and their severities.

An issue is a struct (code, severity); functions return null where there is none, so that a list of them is an array
without its nulls. Defined cases: null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.entities import AFTER, BEFORE, WORD

#: Marker words of languages, placeholders, the marks of lost spaces, literals that spaces say nothing of.
PLACEHOLDERS = (r"(?i)\[id[0-9]+\]",)
MARKERS = {
    "Spanish": "el la los las un una unos unas de del que en para con por se no su sus al es son era fue fueron esta está estaba habia había pero pues cuando entonces tambien también mas más menos como desde hasta sobre",
    "English": "the and of to in that is was for with as on by from this it be are were or an at which no not have has had but they their",
    "French": "le la les des du de et que qui dans pour avec sur est sont une un ce cette par pas plus mais comme",
}
FAIL_CODES = "placeholder_mismatch modernize_block_marker_mismatch epub_extraction_critical_fail"
RETRY_CODES = "target_language_missing target_script_mismatch untranslated_source translation_extraction_failed missing_translation_tags"
SPACING = {
    "period_join": r"(?<=[a-zÀ-ɏ0-9])[.](?=[A-ZÀ-ɏ])",
    "comma_join": r"(?<=[a-zÀ-ɏ]),(?=[A-ZÀ-ɏ])",
    "semicolon_join": r"(?<=[a-zÀ-ɏ]);(?=[A-ZÀ-ɏ])",
    "colon_join": r"(?<=[a-zÀ-ɏ]):(?=[A-ZÀ-ɏ])",
    "word_join": r"(?<=[a-zß-ɏ])(?=[A-ZÀ-Þ][a-zß-ɏ]{2,})",
}
LITERAL = rf"(?i)(?:https?|ftp)://[^\s<>\"“”«»)]+|{BEFORE}www\.[^\s<>\"“”«»)]+|{BEFORE}[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{2,}}{AFTER}|{BEFORE}(?:doi(?:\.org/|:)\s*)?10\.[0-9]{{4,9}}/[^\s<>\"“”«»)]+|{BEFORE}(?:\.\.?/|/)[A-Z0-9._~!$&'()*+,;=:@%/\-]+"
PARTICLES = "de del da dos van von la le"
DENSE = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"
#: What \s is, and hard blanks; written out, as the engine then looks each character up in one table.
BLANK = r"[ \t\n\x0B\f\r\x{00A0}]+"


def full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(full(text), rf"^{BLANK}|{BLANK}$", "")


def folded(text: Column) -> Column:
    """One blank for each run of them, trimmed, in small letters."""
    return F.lower(stripped(F.regexp_replace(full(text), BLANK, " ")))


def solid_size(text: Column) -> Column:
    return F.length(F.regexp_replace(full(text), BLANK, ""))


def issue(code: str, severity: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def enough_evidence(text: Column, least: int = 40) -> Column:
    """Whether a text is long enough to tell its language: dense scripts need less."""
    return F.when(full(text).rlike(DENSE), solid_size(text) >= min(least, 12)).otherwise(F.length(stripped(text)) >= least)


def protected_name(text: Column) -> Column:
    """At most eight words, all with a capital or a particle."""
    words = F.regexp_extract_all(full(text), F.lit(r"[\p{L}\p{N}_'’-]+"), F.lit(0))
    return (F.size(words) > 0) & (F.size(words) <= 8) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(PARTICLES.split()))


def quoted(text: Column) -> Column:
    """A whole quotation."""
    return (F.length(stripped(text)) <= 800) & stripped(text).rlike(r"^[\"'“”‘’«»][^\"'“”‘’«»]{8,}[\"'“”‘’«»]$")


def coverage_issues(source: Column, target: Column, same_language: Column, least: int = 40) -> Column:
    """Missing source, empty translation, or a source that was left as it is."""
    s, t = stripped(source), stripped(target)
    echo = (s != "") & (t != "") & ~same_language & (folded(source) == folded(target)) & enough_evidence(source, least) & ~protected_name(source) & ~(quoted(source) & (s == t))
    return issues(F.when(s == "", issue("missing_source_unit", "critical")), F.when(t == "", issue("empty_translation", "critical")), F.when(echo, issue("untranslated_source", "critical")))


def without_literals(text: Column) -> Column:
    """A text whose technical literals are single marks: no pattern of prose matches inside them."""
    return F.regexp_replace(full(text), LITERAL, "￼")


def spacing_counts(text: Column) -> dict[str, Column]:
    """Lost spaces of each kind outside literals."""
    prose = without_literals(text)
    return {code: F.coalesce(F.regexp_count(prose, F.lit(p)), F.lit(0)).cast("long") for code, p in SPACING.items()}


def spacing_issues(counts: dict[str, Column], strict: bool = True) -> Column:
    return issues(*[F.when(n > 0, issue(f"spacing_{code}", "critical" if strict and code != "word_join" else "medium")) for code, n in counts.items()])


def length_ratio_issue(source_chars: Column, candidate_chars: Column) -> Column:
    """What the length of a candidate says against its source; short sources and empty candidates say nothing."""
    ratio = candidate_chars / F.greatest(F.lit(1), source_chars)
    severe = ((source_chars >= 120) & (ratio < 0.35)) | ((source_chars >= 300) & (ratio < 0.45))
    found = F.when(severe, issue("severe_length_drop", "reject")).when(ratio < 0.58, issue("length_drop", "warning")).when(ratio > 2.2, issue("length_expansion", "warning"))
    return F.when((source_chars >= 80) & (candidate_chars > 0), found)


def refined_length_issue(draft_chars: Column, refined_chars: Column, modernize: bool = False) -> Column:
    """The same for a draft and its refinement; bands are wider when the task is to modernise."""
    (low, high), (less, more) = ((0.45, 2.2), (0.6, 1.9)) if modernize else ((0.7, 1.6), (0.55, 2.0))
    ratio = refined_chars / F.greatest(F.lit(1), draft_chars)
    found = F.when((draft_chars >= 500) & ((ratio < low) | (ratio > high)), issue("length_regression", "reject")).when((ratio < less) | (ratio > more), issue("length_warning", "warning"))
    return F.when((draft_chars >= 120) & (refined_chars > 0), found)


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(full(text), r"\n\s*\n+"), lambda p: stripped(p) != ""))


def collapse_issue(source: Column, candidate: Column) -> Column:
    return F.when((source >= 3) & (candidate <= 1), issue("paragraph_collapse", "warning"))


def refined_paragraph_issue(draft: Column, refined: Column, modernize: bool = False) -> Column:
    lost = (draft >= 5) & (refined < F.greatest(F.lit(2), F.floor(draft * 0.5)))
    return F.when((draft >= 3) & (refined <= 1), issue("paragraph_collapse", "warning" if modernize else "reject")).when(lost, issue("paragraph_loss", "warning"))


def placeholder_issue(source: Column, candidate: Column) -> Column:
    """The first kind of placeholder whose occurrences (each as often as it comes) differ; kinds that the source lacks
    say nothing."""
    found = F.lit(None)
    for p in reversed(PLACEHOLDERS):
        a, b = (F.array_sort(F.regexp_extract_all(full(t), F.lit(p), F.lit(0))) for t in (source, candidate))
        found = F.when((F.size(a) > 0) & (a != b), issue("placeholder_mismatch", "reject")).otherwise(found)
    return found


def lost_terms(draft: Column, refined: Column, terms: Column) -> Column:
    """The terms (an array) that a draft has and its refinement has not, in any case."""
    return F.filter(terms, lambda t: (F.trim(t) != "") & F.contains(F.lower(full(draft)), F.lower(t)) & ~F.contains(F.lower(full(refined)), F.lower(t)))


def missing_tokens_issue(total: Column, missing: Column, code: str, threshold: float, least: int = 1, warning_only: bool = False) -> Column:
    """What a share of missing tokens says."""
    severity = F.lit("warning") if warning_only else F.when(missing / F.greatest(F.lit(1), total) <= threshold, "warning").otherwise("reject")
    return F.when((total >= least) & (missing > 0), F.struct(F.lit(code).alias("code"), severity.alias("severity")))


def marker_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(full(text)), F.lit(rf"{WORD}+"), F.lit(0))


def latin_echo(source: Column, candidate: Column, target: str) -> Column:
    """Whether a candidate is its source, in a language that is not the target's: some of its words mark another one, and
    none the target's."""
    tokens = marker_words(candidate)
    count = lambda k: F.size(F.filter(tokens, lambda w: F.array_contains(F.array(*map(F.lit, MARKERS[k].split())), w)))
    rule = {"Spanish": (count("English") >= 1) & (count("Spanish") == 0), "English": (count("Spanish") >= 2) & (count("English") == 0), "French": (count("English") >= 1) & (count("French") == 0)}[target]
    words = F.size(F.filter(tokens, lambda w: w.rlike(r"\p{L}")))
    return (folded(source) == folded(candidate)) & (words >= 3) & rule


def decision(scores: dict[str, Column], high: Column, medium: Column, least: float, critical: tuple[str, ...], floor: float = 7.0) -> Column:
    """fail for a high issue or a low critical score, warn for any score under the least or a medium issue, else pass."""
    low = lambda names, x: F.exists(F.array(*[scores[n].cast("double") for n in names]), lambda v: F.coalesce(v < x, F.lit(False))) if names else F.lit(False)
    return F.when(high | low(critical, floor), "fail").when(low(tuple(scores), least) | medium, "warn").otherwise("pass")


def candidate_decision(found: Column, accepted: Column) -> Column:
    """What becomes of a candidate by its issues: accepted, fail, retry, repair or accepted with warnings, in that order."""
    codes = F.transform(found, lambda i: i["code"])
    reject = F.exists(found, lambda i: i["severity"] == "reject")
    some = lambda names: F.arrays_overlap(codes, F.array(*map(F.lit, names.split())))
    return F.when(accepted & ~reject, "accepted").when(some(FAIL_CODES), "fail").when(some(RETRY_CODES), "retry").when(reject, "repair").when(F.size(found) > 0, "accepted_with_warnings").otherwise("accepted")


def worst(editorial: Column, fidelity: Column, profile: Column) -> Column:
    """The gravest verdict of three axes: pass, warn or fail. A verdict that is not known is a warning; none is a pass."""
    def rank(verdict: Column, fine: str, grave: str) -> Column:
        return F.when(verdict.isNull() | (verdict == fine), 0).when(verdict == grave, 2).otherwise(1)

    most = F.greatest(rank(editorial, "accept", "reject"), rank(fidelity, "pass", "fail"), rank(profile, "pass", "fail"))
    return F.element_at(F.array(*map(F.lit, ("pass", "warn", "fail"))), most + 1)

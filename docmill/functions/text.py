"""Text expressions: cleaning, counting, classifying and segmenting, all of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts by code point, marker words of languages, page-number lines.
SCRIPTS = {
    "latin": r"[A-Za-z\x{00C0}-\x{024F}]",
    "greek": r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]",
    "cyrillic": r"[\x{0400}-\x{052F}]",
    "cjk": r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]",
    "hangul": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]",
    "hebrew": r"[\x{0590}-\x{05FF}]",
    "devanagari": r"[\x{0900}-\x{097F}]",
}
MARKERS = {"Spanish": "el la los las un una de del que en para con por se no su al es son era fue habia había pero pues cuando entonces tambien también mas más como desde hasta sobre", "English": "the and of to in that is was for with as on by from this it be are were or an at which not have has had but they their", "French": "le la les des du de et que qui dans pour avec sur est sont une un ce cette par pas plus mais comme"}
PAGE_LINE = r"(?i)^\s*(?:page\s*)?[0-9]{1,4}\s*$"
NEGATIONS = "no not never nicht kein keine jamais ne pas non nunca sin sans senza nao нет не jamás nadie nada tampoco ningún ninguna ninguno ningunas ningunos μη δεν 无 不 未 ない ません"
#: "Though ... never so much" grants something and denies nothing.
CONCESSIVE = r"(?<![\p{L}\p{N}_])(?:though|although)(?![\p{L}\p{N}_])[^.!?;:«»“”\"‘’\n]*(?<![\p{L}\p{N}_])never\s+so\s+much(?![\p{L}\p{N}_])(?!\s+as(?![\p{L}\p{N}_]))"
#: Boxes that stand for what could not be shown; the one range around them tells most characters apart at once.
BOXES = r"[\x{2580}-\x{FFFD}&&[\x{FFFC}\x{FFFD}\x{2580}-\x{259F}\x{25A0}-\x{25A1}\x{25AA}-\x{25AC}\x{25AE}-\x{25B0}\x{25FB}-\x{25FE}\x{2B1B}-\x{2B1C}]]+"
#: Runs of blanks become one, those around line ends and before punctuation none.
SINGLE_BLANKS = ((r"[ \t]{2,}", " "), (r"[ \t]++(?:(\n)[ \t]*+|([,.;:!?]))|(\n)[ \t]++", "$1$2$3"))
#: Controls but for tabs and line ends, one by one: the engine then looks each character up in one table.
CONTROLS = "[" + "".join(rf"\x{c:02x}" for c in (*range(0x20), *range(0x7F, 0xA0)) if c not in b"\t\n\r") + "]"
CONTEXT_SIZES = (2048, 4096, 8192, 16384, 32768, 65536, 131072)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that names a value more than once, which is worked out once a row for all of them. Without it, each
    name repeats the whole expression of the value, and rules in turn repeat what was repeated. Python functions may stand
    in the value, not in its use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column, trim: Callable[[Column, Column], Column], pattern: str) -> Column:
    """Blanks at the ends of a text go: a pattern whose $ also stands before a last line end, without going over the whole
    text where it has none. trim does the same for those."""
    return bound(text, lambda t: F.when(F.substring(t, -1, 1).isin("\n", "\r", "\u0085", "\u2028", "\u2029"), F.regexp_replace(t, pattern, "")).otherwise(trim(t, F.lit(" \t"))))


def right_trimmed(text: Column) -> Column:
    return trimmed(text, F.rtrim, r"[ \t]+$")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def mojibake_score(text: Column) -> Column:
    return count(text, r"Ã.|Â[\x{0080}-\x{00FF}\x{20AC}\x{2122}]?|â[\x{0080}-\x{00FF}\x{20AC}\x{2122}]{1,3}|ï¿½|\x{FFFD}|ðŸ") * 3 + count(text, r"[\x{0080}-\x{009F}]") * 2 + count(text, r"\x{FFFD}") * 5


def tidy_spaces(text: Column) -> Column:
    """Runs of blanks, blanks at line ends and starts, blanks before punctuation."""
    for pattern, to in SINGLE_BLANKS:
        text = F.regexp_replace(text, pattern, to)
    return right_trimmed(text)


def without_artifacts(text: Column) -> Column:
    """Zero-width marks, controls and replacement boxes go; a box between two letters or digits becomes a blank."""
    text = F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{2060}]", "")
    text = F.regexp_replace(text, CONTROLS, "")
    text = F.regexp_replace(text, rf"(?s)(?=.{BOXES})([\p{{L}}\p{{N}}]){BOXES}(?=[\p{{L}}\p{{N}}])", "$1 ")
    return tidy_spaces(F.regexp_replace(text, BOXES, ""))


def without_page_lines(text: Column) -> Column:
    """Page-number lines are blanked if there are two or more."""
    parts = lines(text)
    many = F.size(F.filter(parts, lambda x: x.rlike(PAGE_LINE))) >= 2
    return F.when(many, F.array_join(F.transform(parts, lambda x: F.when(x.rlike(PAGE_LINE), "").otherwise(x)), "\n")).otherwise(F.coalesce(text, F.lit("")))


def ocr_signals(text: Column) -> dict[str, Column]:
    """What makes a text look scanned, from a score of three; a text of fewer than six lines looks like nothing."""
    full = F.filter(lines(text), lambda x: F.trim(x) != "")
    n = F.size(full)
    short = F.size(F.filter(full, lambda x: F.length(F.trim(x)).between(18, 95)))
    open_ = F.size(F.filter(full, lambda x: (F.length(F.trim(x)) >= 20) & ~x.rlike(r"[.!?;:)\]\"']\s*$") & ~x.rlike(r"^\s*(?:[-*\x{2022}]|[0-9]+[.)]|[A-Za-z][.)])\s+")))
    hyphens = count(text, r"[A-Za-z\x{00C0}-\x{024F}]-\s*\n\s*[A-Za-z\x{00C0}-\x{024F}]")
    pages = F.size(F.filter(full, lambda x: x.rlike(PAGE_LINE)))
    controls = count(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]")
    points = F.when(hyphens >= 2, 3).when(hyphens == 1, 1).otherwise(0) + F.when(short / n >= 0.65, 2).otherwise(0) + F.when(open_ / n >= 0.45, 2).otherwise(0) + F.when(pages >= 2, 1).otherwise(0) + F.when(controls > 0, 1).otherwise(0)
    score = F.when(n >= 6, points).otherwise(0).cast("long")
    return {"hyphen_breaks": hyphens, "page_lines": pages.cast("long"), "controls": controls, "ocr_score": score, "likely_scan": score >= 3}


def script_counts(text: Column) -> dict[str, Column]:
    return {k: count(text, p) for k, p in SCRIPTS.items()}


def script_shares(counts: dict[str, Column]) -> dict[str, Column]:
    """The share of each script among the letters of all; 0 where there are none. counts are columns already made, as
    each is used in every share."""
    total = sum(counts.values(), F.lit(0))
    return {k: F.when(total > 0, c / total).otherwise(0.0) for k, c in counts.items()}


def language_signals(text: Column) -> Column:
    """What tells a text's language, as one struct: letters of each script, marker words of each language. Make it a column
    before detected_language, which looks at each field several times."""
    tokens = words(text)
    marks = F.create_map(*[x for w in sorted({w for v in MARKERS.values() for w in v.split()}) for x in (F.lit(w), F.lit(sum(1 << k for k, v in enumerate(MARKERS.values()) if w in v.split())))])
    # Each word is looked up once; its languages are bits.
    bits = F.filter(F.transform(tokens, lambda w: F.try_element_at(marks, w)), lambda b: b.isNotNull())
    counts = F.aggregate(bits, F.array(*[F.lit(0)] * len(MARKERS)), lambda a, b: F.array(*[F.get(a, F.lit(k)) + F.shiftright(b, k).bitwiseAND(F.lit(1)) for k in range(len(MARKERS))]))
    return F.struct(*[c.alias(k) for k, c in script_counts(text).items()], counts.alias("markers"))


def detected_language(signals: Column) -> Column:
    """The dominant script if it is not Latin, else the language of most marker words; the first of equals. signals is a
    column of language_signals."""
    total = sum((signals[k] for k in SCRIPTS), F.lit(0))
    best = F.greatest(*[signals[k] for k in SCRIPTS])
    script = F.lit("")
    for k in reversed(SCRIPTS):
        script = F.when((best > 0) & (signals[k] == best), k).otherwise(script)
    top = F.array_max(signals["markers"])
    language = F.when(top > 0, F.element_at(F.array(*map(F.lit, MARKERS)), F.array_position(signals["markers"], top).cast("int"))).otherwise(F.when(script != "", script).otherwise("unknown"))
    return F.when((script != "") & (script != "latin") & (best / total >= 0.35), script).otherwise(language)


def with_language(texts, text_col: str, name: str = "language"):
    """Rows with the language of a text."""
    signals = texts.withColumn("_signals", language_signals(F.col(text_col)))
    return signals.withColumn(name, detected_language(F.col("_signals"))).drop("_signals")


def token_estimate(text: Column) -> Column:
    """Tokens without a vocabulary: a quarter of the characters, or the words if they are more."""
    value = F.coalesce(text, F.lit(""))
    return F.greatest(F.floor(F.length(value) / 4), F.regexp_count(value, F.lit(r"[^\s]+"))).cast("long")


def context_size(need: Column) -> Column:
    """The least standard size that holds need, or need itself beyond them all."""
    fits = F.filter(F.array(*map(F.lit, CONTEXT_SIZES)), lambda s: s >= need)
    return F.coalesce(F.array_min(fits), need)


def sample_indices(total: Column, n: int) -> Column:
    """At most n indices spread evenly over the inner chunks, half-even rounded; all inner ones if there are no more."""
    spread = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.greatest(F.lit(1), F.least(total - 2, F.bround(i * (total - 1) / F.lit(float(n + 1))).cast("int")))))
    few = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(total, F.lit(n)) - 1))
    return F.when(total < 3, few).when(total - 2 <= n, F.sequence(F.lit(1), F.greatest(F.lit(1), total - 2))).otherwise(spread)


def negations(text: Column) -> Column:
    """Negations among a text's words, without the never of a concession; none in a null text."""
    small = F.lower(F.coalesce(text, F.lit("")))
    found = F.size(F.filter(words(text), lambda w: w.isin(NEGATIONS.split())))
    return (found - F.when(small.contains("never"), F.regexp_count(small, F.lit(CONCESSIVE))).otherwise(0)).cast("long")


def semantic_issues(source: Column, target: Column) -> Column:
    """Omission or addition by the ratio of non-blank characters, for sources of 100 characters or more, and the loss
    of every negation; an empty source or target has none."""
    blank = r"[\s\x{00A0}]+"
    trimmed = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    size = lambda t: F.length(F.regexp_replace(F.coalesce(t, F.lit("")), blank, ""))
    ratio = F.when((F.length(trimmed(source)) >= 100) & (size(source) > 0), size(target) / size(source))
    length = F.when(ratio < 0.55, "probable_semantic_omission").when(ratio > 2.2, "probable_semantic_addition")
    loss = F.when((negations(source) > 0) & (negations(target) == 0), "possible_negation_loss")
    return F.when((size(source) > 0) & (size(target) > 0), F.concat_ws(",", length, loss)).otherwise("")


def slug(text: Column) -> Column:
    """Small letters, digits, hyphens and underscores; hyphens for all else, one for a run, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\-_]", "-"), "-+", "-"), "^-+|-+$", "")

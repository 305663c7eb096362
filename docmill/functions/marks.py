"""Small marks in texts: numbered tags, formulas or prices, symbols within names, note calls, where sentences begin, and
what a prompt is for. All are built-in expressions; null text is the empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docmill.functions.cleaning import rewritten
from docmill.functions.pairs import full
from docmill.functions.structure import JUNK

#: Patterns.
PLACEHOLDER = r"\[id[0-9]+\]"
PRICE_OR_WORD = r"^(?:[0-9]+(?:\.[0-9]{1,2})?|[a-zA-Z]+)$"
BEGINS = r"(?:^|\n|[.!?][\"'»”)]?\s)\s*[\"'«“(]?$"
SYMBOL_NAME = r"(?<![\p{L}\p{N}_])[A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{1,24}(?:[*\\][A-ZÁÉÍÓÚÜÑ][A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{1,24})+(?![\p{L}\p{N}_])"
FOOTNOTE = r"(?:\b(?:notas?|notes?|footnotes?|endnotes?)\b|#nt[0-9]+)"
NOTE_CALLS = (r"\s*\[\[[0-9]{1,4}\]\]\([^)]+\)", r"\s*\[\[[0-9]{1,4}\]\]", r"(?<![\p{L}\p{N}_])\s*\[[0-9]{1,4}\](?![\p{L}\p{N}_])")
LINK = r"\[[^\]]+\]\([^)]+\)"
URL = r"(?i)\b(?:https?://|www\.)\S+"

#: Phases and the phrases that tell them, tried in this order.
PHASES = (
    ("combined_quality_audit", ("<combined_quality_audit_json>", "independent bilingual quality auditor")),
    ("fidelity_audit", ("fidelity supervisor", "independent bilingual fidelity auditor", "<fidelity_audit_json>", "audita esta modernización", "audita esta traducción", '"overall_decision"', '"content_fidelity"', '"censored_or_softened"')),
    ("editorial_audit", ("<editorial_guard_json>", "source-aware editorial guard", "juez fuente-aware")),
    ("repair", ("corrige la modernización usando la auditoría", "corrige la traducción usando la auditoría", "resolve los problemas marcados", "suggested_fix", "quality alert repair")),
    ("format_repair", ("technical placeholder correction specialist", "placeholders were corrupted", "correction request", "corrige los marcadores", "repair the placeholder", "restore every placeholder")),
    ("glossary_discovery", ("descubrimiento léxico", "descubrimiento lexico", "glossary_discovery", "pending_suggestions", '"suggestions"')),
    ("voice_restoration", ("editor final de voz", "restauración de voz", "restauracion de voz", "voice restoration")),
    ("modernization", ("modernización intralingüística", "modernizacion intralinguistica", "moderniza todo lo que", "español literario mexicano contemporáneo", "espanol literario mexicano contemporaneo")),
    ("editorial_refinement", ("revisión editorial", "revision editorial", "refinamiento editorial", "editorial refinement", "# draft to refine", "final editorial review", "refina el texto", "corrige estilo")),
    ("translation", ("traduce", "translate", "<translation>", "</translation>")),
)
#: Fixed value: a phrase that tells its phase only beside another.
BESIDE = {'"suggestions"': "glosario"}
#: Pairs of languages in three tiers, each with those before it.
PAIR_TIERS = (
    ("quick", "en>zh-Hans en>es en>fr en>vi ja>en ko>en zh-Hans>en ja>zh-Hans"),
    ("standard", "en>de en>pt en>ja en>ko en>ru en>it en>ar en>hi"),
    ("full", "en>nl en>pl en>sv en>da en>el en>tr en>th en>id en>bn en>ta en>he zh-Hans>ja"),
)


def begins_sentence(text: Column, position: Column) -> Column:
    """Whether a sentence begins at a position (from 0): at the start, after a line feed, or after an end mark and blanks;
    one opening quote may stand before it."""
    before = F.substr(full(text), F.lit(1), F.greatest(F.lit(0), position))
    return before.rlike(BEGINS)


def is_formula(content: Column) -> Column:
    """What stands between dollar signs is a formula, unless it is a plain price or a word."""
    return ~full(content).rlike(PRICE_OR_WORD)


def halves(text: Column, ratio: float = 0.5) -> tuple[Column, Column]:
    """A text in two at a share of its characters, trimmed; under 100 characters, in the middle as it is."""
    whole = full(text)
    n = F.length(whole)
    at = F.when(n < 100, F.floor(n / 2)).otherwise(F.floor(n * F.lit(ratio))).cast("int")
    parts = F.substr(whole, F.lit(1), at), F.substr(whole, at + 1, n)
    return tuple(F.when(n < 100, p).otherwise(rewritten(p, (r"^\s+|\s+$", ""))) for p in parts)


def restored_tags(text: Column, tags: Column) -> Column:
    """Numbered placeholders as the tags that a map names, the highest numbers first."""
    number = F.regexp_extract
    last_first = F.reverse(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.struct(F.coalesce(F.try_to_number(number(e["key"], r"([0-9]+)", 1), F.lit("999999999")), F.lit(0)).cast("int").alias("n"), e["key"].alias("key"), e["value"].alias("value")))))
    return F.aggregate(last_first, full(text), lambda t, e: F.replace(t, e["key"], e["value"]))


def signature(text: Column, structural: Column) -> Column:
    """The placeholders of a text, in their order, that stand for the tags of blocks."""
    return F.filter(F.regexp_extract_all(full(text), F.lit(PLACEHOLDER), F.lit(0)), lambda p: F.array_contains(structural, p))


def phase(prompt: Column, system: Column | None = None) -> Column:
    """What a request to a model is for, by the phrases in the first 12,000 characters of its prompts."""
    text = F.substring(F.lower(F.concat(full(system if system is not None else F.lit("")), F.lit("\n"), full(prompt))), 1, 12_000)
    out = F.lit("llm_call")
    for name, phrases in reversed(PHASES):
        told = F.lit(False)
        for p in phrases:
            told |= text.contains(p) & text.contains(BESIDE[p]) if p in BESIDE else text.contains(p)
        out = F.when(told, name).otherwise(out)
    return out


def symbol_names(text: Column) -> Column:
    """Names with * or \\ between their parts, in order, with repeats."""
    return F.regexp_extract_all(full(text), F.lit(SYMBOL_NAME), F.lit(0))


def missing_symbol_names(pairs: DataFrame, unit: str, source: str, candidate: str) -> DataFrame:
    """(unit, name, missing): names that a candidate has fewer times than its source. Names it has more of make up for
    others that differ by an I read as l at the end of a part; the name that comes first is made up for first."""
    names = lambda c: F.posexplode(symbol_names(F.col(c))).alias("at", "name")
    of_source = pairs.select(unit, names(source)).groupBy(unit, "name").agg(F.count("*").alias("_a"), F.min("at").alias("_at"))
    of_candidate = pairs.select(unit, names(candidate)).groupBy(unit, "name").agg(F.count("*").alias("_b"))
    both = of_source.join(of_candidate, [unit, "name"], "full_outer").na.fill(0, ["_a", "_b"])
    told = both.select(unit, "name", "_at", (F.col("_a") - F.col("_b")).alias("_lack"), F.lower(F.regexp_replace("name", r"I(?=$|[*\\])", "l")).alias("_key"))
    key = W.partitionBy(unit, "_key")
    spare = F.sum(F.greatest(F.lit(0), -F.col("_lack"))).over(key)
    upto = F.sum(F.greatest(F.lit(0), F.col("_lack"))).over(key.orderBy(F.col("_at").asc_nulls_last(), "name").rowsBetween(W.unboundedPreceding, 0))
    left = F.least(F.col("_lack"), upto - spare)
    return told.withColumn("missing", left).where("_lack > 0 and missing > 0").select(unit, "name", "missing")


def restored_symbol_names(source: Column, candidate: Column) -> Column:
    """A candidate in which names that lost their symbols have them again, where the source spells their letters in one
    way only."""
    exact = F.array_distinct(symbol_names(source))
    letters = lambda n: F.lower(F.regexp_replace(n, r"[*\\\s]+", ""))
    keys = F.transform(exact, letters)
    sure = F.filter(exact, lambda n: F.size(F.filter(keys, lambda k: k == letters(n))) == 1)

    def put(text: Column, name: Column) -> Column:
        loose = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.regexp_replace(name, r"[*\\]", r"\\s*"), F.lit(r"(?![\p{L}\p{N}_])"))
        return F.regexp_replace(text, loose, F.regexp_replace(name, r"\\", r"\\\\"))

    return F.when(F.size(sure) > 0, F.aggregate(sure, full(candidate), put)).otherwise(full(candidate))


def spoken(text: Column) -> tuple[Column, Column, Column]:
    """(text to be read aloud, links removed, note calls removed): no note calls, links as their labels, no addresses."""
    count = lambda t, p: F.coalesce(F.regexp_count(t, F.lit(p)), F.lit(0))
    out, notes = full(text), F.lit(0)
    for call in NOTE_CALLS:
        notes = notes + count(out, call)
        out = F.regexp_replace(out, call, "")
    junk = JUNK.removeprefix("(?i)")
    dropped = rf"(?i:\[[^\]]*?{junk}[^\]]*\]\([^)]+\)|\[[^\]]+\]\([^)]*?{junk}[^)]*\)|\[\s*\[?[0-9]{{1,4}}\s*\]\([^)]*?{FOOTNOTE}[^)]*\))"
    plain = F.regexp_replace(out, rf"{dropped}|\[(?=[^\]])\s*([^\]]*?)\s*\]\([^)]+\)", "$1")  # no label where none is kept
    links = count(out, LINK) + count(plain, URL)
    tidy = rewritten(plain, (URL, ""), (r"[ \t]{2,}", " "), (r"\s+([,.;:!?])", "$1"), (r"\(\s*\)", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
    return tidy, links, notes


def emptied_blocks(pairs: DataFrame, document: str, order: str, source: str, output: str) -> DataFrame:
    """(document, order, source, context_before, context_after): blocks with a word in the source and nothing in the output,
    between up to 500 characters of their neighbours."""
    flat = lambda c: rewritten(full(F.col(c)), (r"\s+", " "), (r"^ | $", ""))
    own = W.partitionBy(document).orderBy(order)
    rows = pairs.select(document, order, flat(source).alias(source), flat(output).alias("_out"))
    near = {"context_before": F.right(F.coalesce(F.lag(source).over(own), F.lit("")), F.lit(500)), "context_after": F.substring(F.coalesce(F.lead(source).over(own), F.lit("")), 1, 500)}
    return rows.withColumns(near).where((F.col("_out") == "") & F.col(source).rlike(r"[\p{L}\p{N}_]")).drop("_out")


def pair_tier(spark, name: str) -> DataFrame:
    """(place, source, target) of a tier; a name that is none raises KeyError."""
    names = [n for n, _ in PAIR_TIERS]
    key = name.strip().lower()
    if key not in names:
        raise KeyError(f"no tier {name!r}; there are {', '.join(names)}")
    chosen = " ".join(p for _, p in PAIR_TIERS[: names.index(key) + 1]).split()
    return spark.createDataFrame([(k, *p.split(">")) for k, p in enumerate(chosen)], "place int, source string, target string")
